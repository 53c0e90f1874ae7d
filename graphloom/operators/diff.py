"""Comparing two states of a graph: diffs, patches, reconciliation, pairing by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Display weight by label.
WEIGHTS = {"METHOD": 4.0, "TYPE_DECL": 3.0, "DIRECTORY": 3.0, "CALL": 2.0, "CONTROL_STRUCTURE": 2.0, "IDENTIFIER": 1.5, "LITERAL": 1.5, "BLOCK": 1.0}


def weight(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), label), F.lit(2.0))


def changed(old: str, new: str, columns: list[str]) -> Column:
    """Whether any of the columns differs between two sides (nulls compare equal)."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out


def node_changed(old: str = "o", new: str = "n") -> Column:
    """Label or name differ; for files size or time; for directories time; else, where both have lines, line or code."""
    def differs(c: str) -> Column:
        return ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))

    label = F.col(f"{old}.label")
    both = F.col(f"{old}.line").isNotNull() & F.col(f"{new}.line").isNotNull()
    by_label = F.when(label == "FILE", differs("size") | differs("modified")).when(label == "DIRECTORY", differs("modified")).otherwise(both & (differs("line") | differs("code")))
    return differs("label") | differs("name") | by_label


def diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str] | Column) -> DataFrame:
    """The keys with ``change``: added, removed or updated.  One full outer join."""
    o, n = old.withColumn("here", F.lit(True)).alias("o"), new.withColumn("here", F.lit(True)).alias("n")
    on = None
    for k in keys:
        eq = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = eq if on is None else on & eq
    test = changed("o", "n", compare) if isinstance(compare, list) else compare
    kind = F.when(F.col("o.here").isNull(), "added").when(F.col("n.here").isNull(), "removed").when(test, "updated")
    both = o.join(n, on, "full_outer")
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], kind.alias("change")).where("change is not null")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["from_key", "to_key", "type"]
    return diff(old.select(keys).distinct(), new.select(keys).distinct(), keys, [])


def patch(changes: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Display rows for each change: a removed key alone, else name (or the key), label, the first 40 characters of code and weight."""
    rows = changes.join(new, key, "left")
    gone = F.col("change") == "removed"
    shown = lambda c: F.when(~gone, c)
    return rows.select(key, "change", shown(F.coalesce("name", F.col(key).cast("string"))).alias("name"), shown(F.col("label")).alias("type"), shown(F.substring("code", 1, 40)).alias("code"), shown(weight(F.col("label"))).alias("val"))


def apply_patch(base: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """Remove, add and update by key; null values of an update keep what is there."""
    columns = [c for c in base.columns if c != key]
    p = rows.select(F.col(key).alias("p_key"), "change", *[F.col(c).alias(f"p_{c}") for c in columns if c in rows.columns])
    both = base.join(p, base[key] == p["p_key"], "full_outer").where("change is null or change <> 'removed'")
    return both.select(F.coalesce(key, "p_key").alias(key), *[F.coalesce(f"p_{c}", c).alias(c) if f"p_{c}" in p.columns else F.col(c) for c in columns])


def has_changes(changes: DataFrame) -> bool:
    return not changes.isEmpty()


def pair_by_content(deleted: DataFrame, created: DataFrame) -> DataFrame:
    """``from_path, to_path``: the k-th deletion of a content hash pairs with its k-th creation, by ``seq``; the rest pairs not.

    Both: ``hash, path, seq``.  Deletions without a known hash never pair.
    """
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("seq", "path")).alias("k")
    d = deleted.where("hash is not null").select("hash", F.col("path").alias("from_path"), nth)
    c = created.select("hash", F.col("path").alias("to_path"), nth)
    return d.join(c, ["hash", "k"]).select("from_path", "to_path")


def orphans(stored: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """``path, state``: stored ones that are not found any more, and found ones that are not stored."""
    gone = stored.select(key).join(found.select(key), key, "left_anti").withColumn("state", F.lit("orphan"))
    new = found.select(key).join(stored.select(key), key, "left_anti").withColumn("state", F.lit("missing"))
    return gone.unionByName(new)


def reconcile(stored: DataFrame, found: DataFrame, by: str = "hybrid") -> DataFrame:
    """``path, action``: delete, add, and verify or update; ``by`` hash compares contents, time compares times, hybrid contents where times differ."""
    differ = {"hash": "s.hash <> f.hash", "time": "s.modified <> f.modified", "hybrid": "s.modified <> f.modified and s.hash <> f.hash"}[by]
    s, f = stored.withColumn("here", F.lit(1)).alias("s"), found.withColumn("here", F.lit(1)).alias("f")
    action = F.when(F.col("s.here").isNull(), "add").when(F.col("f.here").isNull(), "delete").when(F.expr(differ), "update")
    return s.join(f, F.col("s.path") == F.col("f.path"), "full_outer").select(F.coalesce("s.path", "f.path").alias("path"), action.alias("action")).where("action is not null")


def symbol_changes(old: DataFrame, new: DataFrame, compare: list[str]) -> DataFrame:
    """Added, removed and modified exported symbols by full name."""
    return diff(old.where("exported"), new.where("exported"), ["full_name"], compare)


def id_difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids of one side only, ``missing`` (in a) or ``extra`` (in b)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.subtract(y).withColumn("side", F.lit("missing")).unionByName(y.subtract(x).withColumn("side", F.lit("extra")))
