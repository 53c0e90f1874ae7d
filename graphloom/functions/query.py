"""Values as they stand in the text of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_value(c) -> Column:
    """A value as a literal of a query's text: null, or in quotes with backslashes, line ends and quotes escaped."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def query_parameter(value) -> str:
    """A parameter's value as it stands in a query's prefix: lists and maps by their parts, texts quoted."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(query_parameter, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {query_parameter(v)}" for k, v in value.items()) + "}"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def parameter_prefix(params: dict) -> str:
    """``CYPHER k=v ..`` for a plan's text; nothing without parameters."""
    return "".join(["CYPHER ", *[f"{k}={query_parameter(v)} " for k, v in params.items()]]) if params else ""
