"""Property graphs as typed node and edge tables.

A graph has one DataFrame for each node label and each edge type.  Nodes are named by a key of one
type within the graph (long or string); edges hold both ends' keys, so an edge always has its ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Table:
    """Rows that are given, or made when they are first wanted."""

    rows: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()


@dataclass(eq=False)
class Nodes(_Table):
    """The nodes of one label: a DataFrame (or a function that gives it), the column of their key, and the labels that all of them carry."""

    label: str
    rows: DataFrame | Callable[[], DataFrame]
    key: str
    extra: tuple[str, ...] = ()

    @property
    def labels(self) -> tuple[str, ...]:
        return (self.label, *self.extra)

    @property
    def properties(self) -> list[str]:
        return self.df.columns


@dataclass(eq=False)
class Edges(_Table):
    """The edges of one type between two labels.  ``id`` names a column (or several) that tells edges apart."""

    type: str
    rows: DataFrame | Callable[[], DataFrame]
    source: str
    target: str
    source_key: str
    target_key: str
    id: tuple[str, ...] = ()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.source_key, self.target_key)]


@dataclass
class Graph:
    nodes: list[Nodes]
    edges: list[Edges]
    key_type: str = "string"
    indexes: list[tuple[str, str]] = field(default_factory=list)
    constraints: list[tuple[str, str]] = field(default_factory=list)
    _tables: dict = field(default_factory=dict, repr=False)

    def node_tables(self, wanted) -> list[Nodes]:
        """The tables whose labels satisfy ``wanted`` (a function of a set of labels)."""
        return [n for n in self.nodes if wanted(frozenset(n.labels))]

    def edge_tables(self, types: list[str] | None) -> list[Edges]:
        return [e for e in self.edges if not types or e.type in types]

    def all_nodes(self) -> DataFrame:
        """``label, key, props``: every node, its properties as a map of strings."""
        parts = [n.df.select(F.lit(n.label).alias("label"), F.col(n.key).cast(self.key_type).alias("key"), string_map(n.df).alias("props")) for n in self.nodes]
        return _union(parts)

    def all_edges(self) -> DataFrame:
        """``type, from_label, from_key, to_label, to_key``: every edge."""
        parts = [e.df.select(F.lit(e.type).alias("type"), F.lit(e.source).alias("from_label"), F.col(e.source_key).cast(self.key_type).alias("from_key"), F.lit(e.target).alias("to_label"), F.col(e.target_key).cast(self.key_type).alias("to_key")) for e in self.edges]
        return _union(parts)


def string_map(df: DataFrame) -> Column:
    """The columns of a row that are not null, as a map of strings."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
