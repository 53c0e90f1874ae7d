"""Scalar functions of the graph engine as column expressions."""
