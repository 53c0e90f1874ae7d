"""The driver's tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Edges, Graph, Nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders, with edges from their foreign keys.

    Keys are long; ``PLACE`` is a further label of regions and nations, ``PARTY`` of customers and suppliers.
    Tables are opened when a query first needs them.
    """
    t = lambda n: table(spark, sf_dir, n)
    nodes = [
        Nodes("REGION", lambda: t("region").toDF("id", "name"), "id", ("PLACE",)),
        Nodes("NATION", lambda: t("nation").toDF("id", "name", "region"), "id", ("PLACE",)),
        Nodes("CUSTOMER", lambda: t("customer").toDF("id", "name", "nation", "balance", "segment"), "id", ("PARTY",)),
        Nodes("SUPPLIER", lambda: t("supplier").toDF("id", "name", "nation", "balance"), "id", ("PARTY",)),
        Nodes("PART", lambda: t("part").toDF("id", "name", "brand", "type", "size", "price"), "id"),
        Nodes("ORDER", lambda: t("orders").toDF("id", "customer", "status", "total", "date", "priority"), "id"),
    ]
    line = lambda: t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"))
    ids = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "price", "flag", "status")
    pair = lambda name, a, b: lambda: t(name).select(a, b)
    edges = [
        Edges("IN_REGION", pair("nation", "n_nationkey", "n_regionkey"), "NATION", "REGION", "n_nationkey", "n_regionkey"),
        Edges("IN_NATION", pair("customer", "c_custkey", "c_nationkey"), "CUSTOMER", "NATION", "c_custkey", "c_nationkey"),
        Edges("IN_NATION", pair("supplier", "s_suppkey", "s_nationkey"), "SUPPLIER", "NATION", "s_suppkey", "s_nationkey"),
        Edges("PLACED", pair("orders", "o_custkey", "o_orderkey"), "CUSTOMER", "ORDER", "o_custkey", "o_orderkey"),
        Edges("CONTAINS_ITEM", line, "ORDER", "PART", "l_orderkey", "l_partkey", ids),
        Edges("SUPPLIED_BY", line, "PART", "SUPPLIER", "l_partkey", "l_suppkey", ids),
    ]
    # containment from the top down, for traversals
    edges += [
        Edges("HAS", pair("nation", "n_regionkey", "n_nationkey"), "REGION", "NATION", "n_regionkey", "n_nationkey"),
        Edges("HAS", pair("customer", "c_nationkey", "c_custkey"), "NATION", "CUSTOMER", "c_nationkey", "c_custkey"),
        Edges("HAS", pair("orders", "o_custkey", "o_orderkey"), "CUSTOMER", "ORDER", "o_custkey", "o_orderkey"),
    ]
    return Graph(nodes, edges, "long", [("REGION", "id"), ("NATION", "id"), ("CUSTOMER", "id"), ("ORDER", "id")], [("CUSTOMER", "id")])


#: suppliers by key that make up one unit of code, as it were
UNIT = 32

#: the same graph in SQL: ``u`` (id, nation, place in its unit) and ``e`` (a, b)
CODE_SQL = f"""WITH RECURSIVE u AS (SELECT s_suppkey AS id, s_nationkey AS n, s_suppkey % {UNIT} AS o FROM supplier),
e AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON y.id = x.id + x.o + 1 WHERE 2 * x.o + 1 < {UNIT}
UNION ALL SELECT x.id, y.id FROM u x JOIN u y ON y.id = x.id + x.o + 2 WHERE 2 * x.o + 2 < {UNIT}
UNION ALL SELECT x.id, y.id FROM u x JOIN u y ON y.id = x.id - x.o + x.o // 4 WHERE x.id % 3 = 0 AND x.o > 0)"""


def code(spark: SparkSession, sf_dir: str) -> Graph:
    """A cyclic graph of all suppliers, of as many edges as nodes up to a factor, in components of bounded size.

    Each :data:`UNIT` consecutive keys make a binary heap whose members call their two children; every third one calls back an
    ancestor's place, so there are cycles.
    """
    s = table(spark, sf_dir, "supplier")
    nodes = [Nodes("UNIT", s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), "id")]
    a, o = F.col("s_suppkey"), F.col("s_suppkey") % UNIT
    called = F.array(F.when(2 * o + 1 < UNIT, a + o + 1), F.when(2 * o + 2 < UNIT, a + o + 2), F.when((a % 3 == 0) & (o > 0), a - o + F.floor(o / 4)))
    calls = s.select(a.alias("a"), F.explode(F.array_compact(called)).alias("b")).join(s.select(a.alias("b")), "b", "left_semi").select("a", "b")
    return Graph(nodes, [Edges("CALLS", calls, "UNIT", "UNIT", "a", "b")], "long")
