"""Schema rules as DataFrames of problems: all of them are told, none stops the check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_SPECS, NODE_SPECS, Property

PROBLEM = "rule string, subject string, detail string"


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _problem(when: Column, rule: str, detail) -> Column:
    detail = detail.cast("string") if isinstance(detail, Column) else F.lit(detail)
    return F.when(when, F.array(F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))))


def _told(df: DataFrame, subject: Column, problems: list[Column]) -> DataFrame:
    """All problems of each row, in one pass over the rows."""
    empty = F.array().cast("array<struct<rule:string,detail:string>>")
    found = F.concat(*[F.coalesce(p, empty) for p in problems])
    return df.select(subject.cast("string").alias("subject"), F.explode(found).alias("p")).select("p.rule", "subject", "p.detail")


def _bad_type(p: Property) -> Column:
    """Values are strings here: whether one cannot be of the property's type."""
    v = F.col("props")[p.name]
    if p.type in ("int", "float"):
        return v.isNotNull() & v.try_cast("double").isNull()
    if p.type == "bool":
        return v.isNotNull() & ~v.isin("true", "false")
    return v.isNotNull() & ~v.startswith("[")


def _property_problems(own: Column, properties: tuple[Property, ...]) -> Column:
    """Of a row of one label or type: missing, mistyped, out of their vocabulary, and undeclared properties."""
    parts = []
    for p in properties:
        if p.required and p.type != "list":
            parts.append(_problem(F.col("props")[p.name].isNull(), "required", p.name))
        if p.values:
            parts.append(_problem(F.col("props")[p.name].isNotNull() & ~F.col("props")[p.name].isin(*p.values), "enum", p.name))
        if p.type != "string":
            parts.append(_problem(_bad_type(p), "type", p.name))
    empty = F.array().cast("array<struct<rule:string,detail:string>>")
    extra = F.array_except(F.map_keys("props"), F.array(*[F.lit(p.name) for p in properties]).cast("array<string>"))
    parts.append(F.transform(extra, lambda k: F.struct(F.lit("undeclared property").alias("rule"), k.alias("detail"))))
    return F.when(own, F.concat(*[F.coalesce(x, empty) for x in parts]))


def validate_delta(nodes: DataFrame, edges: DataFrame, file: str | None = None) -> DataFrame:
    """``rule, subject, detail`` for nodes ``labels, key, file, props`` and edges ``type, from_label, from_key, to_label, to_key, props``."""
    kinds = F.filter("labels", lambda x: x != "CPG")
    n = nodes.withColumn("label", F.get(kinds, F.lit(0))).withColumn("cpg", F.array_contains("labels", "CPG"))
    label, one = F.col("label"), F.size(kinds) == 1
    declared = F.coalesce(label.isin(*NODE_SPECS), F.lit(False))
    owned = label.isin(*[k for k, s in NODE_SPECS.items() if s.cpg])
    keys = F.element_at(F.create_map(*[F.lit(x) for k, s in NODE_SPECS.items() if s.key for x in (k, s.key)]), label)
    known = one & declared
    problems = [
        _problem(~one, "label count", F.array_join("labels", ",")),
        _problem(one & ~declared, "undeclared label", label),
        _problem(known & (F.col("cpg") != owned), "co-label", label),
        _problem(known & (owned == F.col("file").isNull()), "file", label),
        _problem(known & keys.isNotNull() & F.element_at("props", keys).isNull(), "key", keys),
        *[_property_problems(known & (label == k), s.properties) for k, s in NODE_SPECS.items()],
    ]
    if file:
        problems.append(_problem(known & label.isin(*[k for k, s in NODE_SPECS.items() if s.write == "overlay"]), "overlay in a file's delta", label))
        problems.append(_problem(F.col("file") != file, "file mismatch", F.col("file")))
    kind = F.col("type")
    ends = F.lit(False)
    for k, s in EDGE_SPECS.items():
        ends = ends | ((kind == k) & (~F.col("from_label").isin(*s.sources) | ~F.col("to_label").isin(*s.targets)))
    of_edges = [
        _problem(~kind.isin(*EDGE_SPECS), "undeclared type", kind),
        _problem(ends, "end labels", F.concat_ws(">", "from_label", "to_label")),
        *[_property_problems(kind == k, s.properties) for k, s in EDGE_SPECS.items()],
    ]
    out = [_told(n, F.col("key"), problems), _told(edges, F.concat_ws(" ", "from_key", "type", "to_key"), of_edges)]
    out += missing_ends(nodes.select(F.explode("labels").alias("label"), "key"), edges)
    return reduce(DataFrame.unionByName, out)


def missing_ends(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Edges whose given ends are no nodes."""
    out = []
    for side in ("from", "to"):
        ends = nodes.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key")).distinct()
        lost = edges.where(F.col(f"{side}_key").isNotNull()).join(ends, [f"{side}_label", f"{side}_key"], "left_anti")
        out.append(_rows(lost, "missing end", F.concat_ws(" ", "from_key", "type", "to_key"), F.col(f"{side}_key")))
    return out


def invariants(symbols: DataFrame, edges: DataFrame, files: DataFrame, samples: int = 10) -> DataFrame:
    """Names that two symbols have, symbols without an edge into them, files that are not ready: the first of each."""
    twice = symbols.groupBy("fqn").count().where("count > 1").orderBy(F.desc("count"), "fqn").limit(samples)
    alone = symbols.select("fqn").distinct().join(edges.where("to_label = 'SYMBOL'").select(F.col("to_key").alias("fqn")), "fqn", "left_anti").orderBy("fqn").limit(samples)
    unready = files.where("status <> 'ready'").orderBy("path").limit(samples)
    return _rows(twice, "duplicate fqn", F.col("fqn"), F.col("count")).unionByName(_rows(alone, "orphan symbol", F.col("fqn"), F.lit(""))).unionByName(_rows(unready, "not ready", F.col("path"), F.col("status")))
