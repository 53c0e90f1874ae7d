"""A subset of Cypher, compiled to DataFrame plans."""

from .compiler import explain, run, scalar
from .parser import CypherError, ReadOnlyError, parse

__all__ = ["CypherError", "ReadOnlyError", "explain", "parse", "run", "scalar"]
