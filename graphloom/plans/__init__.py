"""Registered queries by operator, with their SQL."""
