"""Workspace scan, paths and globs, declaration extraction, outputs."""
