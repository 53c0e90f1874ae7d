"""Results as text: tables, JSON lines, GraphML, display rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_table(df: DataFrame) -> str:
    """A padded table of all rows: nulls empty, nested values as JSON; ``(0 rows)`` if there are none.

    For people to read: the rows come to the driver (a query's own LIMIT bounds them).
    """
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    if not rows:
        return "(0 rows)"
    show = lambda v: "" if v is None else json.dumps(v, default=str) if isinstance(v, (dict, list)) else str(v)
    table = [list(rows[0]), *[[show(r[c]) for c in rows[0]] for r in rows]]
    widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in table)


def json_lines(df: DataFrame) -> DataFrame:
    """``line``: each row as JSON, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes ``label, key`` and edges ``type, from_key, to_key`` as lines of GraphML, in part files between a head and a tail."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')], "at int, value string")
    n = nodes.select(F.lit(1).alias("at"), F.concat(F.lit('<node id="'), _escaped(F.col("key")), F.lit('"><data key="label">'), _escaped(F.col("label")), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("at"), F.concat(F.lit('<edge source="'), _escaped(F.col("from_key")), F.lit('" target="'), _escaped(F.col("to_key")), F.lit('"><data key="type">'), _escaped(F.col("type")), F.lit("</data></edge>")).alias("value"))
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "at int, value string")
    head.union(n).union(e).union(tail).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def display(nodes: DataFrame) -> DataFrame:
    """``id, name, type, code, val`` for drawing."""
    from ..operators.diff import weight

    return nodes.select("id", F.coalesce("name", "id").alias("name"), F.col("label").alias("type"), F.substring("code", 1, 40).alias("code"), weight(F.col("label")).alias("val"))
