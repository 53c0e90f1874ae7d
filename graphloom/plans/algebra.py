"""Registered queries of joins by key, set operations, traversal, writes, validation and diff on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import traverse as V
from ..operators import validate as C
from ..operators import write as W
from ..sources import paths as S
from .star import CODE_SQL, code, star, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``path, parent, name, language, hash, loc``."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return d.select("doc_id", path.alias("path"), S.parent(path).alias("parent"), S.base_name(path).alias("name"), F.col("lang").alias("language"), F.sha2("text", 256).alias("hash"), S.lines(F.col("text")).cast("long").alias("loc"))


FILES = "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS parent, doc_id || '.txt' AS name, lang AS language, sha256(text) AS hash, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS loc FROM documents)"


def filesystem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files, one MODULE that each of them owns, the directories above them, and the links."""
    f = files(spark, sf_dir)
    dirs, links = W.entries(f)
    none, no_props = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    nodes = f.select(F.lit("FILE").alias("label"), F.col("path").alias("key"), none.alias("file"), F.create_map(F.lit("name"), F.col("name"), F.lit("path"), F.col("path")).alias("props"))
    nodes = nodes.unionByName(f.select(F.lit("MODULE").alias("label"), F.concat("path", F.lit(":MODULE:"), "name").alias("key"), F.col("path").alias("file"), F.create_map(F.lit("name"), F.col("name")).alias("props")))
    nodes = nodes.unionByName(dirs.select(F.lit("DIRECTORY").alias("label"), F.col("path").alias("key"), none.alias("file"), F.create_map(F.lit("name"), S.base_name(F.col("path")), F.lit("path"), F.col("path")).alias("props")))
    edges = links.select(F.lit("HAS_ENTRY").alias("type"), F.lit("DIRECTORY").alias("from_label"), F.col("parent").alias("from_key"), F.col("kind").alias("to_label"), F.col("child").alias("to_key"), no_props.alias("props"))
    # each module defines the symbol of its language
    nodes = nodes.unionByName(f.select("language").distinct().select(F.lit("SYMBOL").alias("label"), F.col("language").alias("key"), none.alias("file"), no_props.alias("props")))
    defines = f.select(F.lit("DEFINES").alias("type"), F.lit("MODULE").alias("from_label"), F.concat("path", F.lit(":MODULE:"), "name").alias("from_key"), F.lit("SYMBOL").alias("to_label"), F.col("language").alias("to_key"), no_props.alias("props"))
    return nodes, edges.unionByName(defines)


TREE = f"""WITH {FILES},
d AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), parent]) AS path FROM f),
n AS (SELECT 'FILE' AS label, path AS key, NULL AS file, name FROM f UNION ALL SELECT 'MODULE', path || ':MODULE:' || name, path, name FROM f UNION ALL SELECT 'DIRECTORY', path, NULL, split_part(path, '/', -1) FROM d UNION ALL SELECT DISTINCT 'SYMBOL', language, NULL, NULL FROM f),
e AS (SELECT 'HAS_ENTRY' AS type, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS a, path AS b FROM d WHERE path <> '.' UNION ALL SELECT DISTINCT 'HAS_ENTRY', parent, path FROM f UNION ALL SELECT 'DEFINES', path || ':MODULE:' || name, language FROM f)"""


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", "key", "file", F.col("props")["name"].alias("name"))


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("type", F.col("from_key").alias("a"), F.col("to_key").alias("b"))


@query("wr2_scope_delete_nodes", TREE + " SELECT * FROM n WHERE file IS NULL OR file <> 'src1/en/1.txt'")
def _(spark, sf_dir):
    return _nodes(W.scope_delete(*filesystem(spark, sf_dir), "src1/en/1.txt")[0])


@query("wr2_scope_delete_edges", TREE + " SELECT * FROM e WHERE a <> 'src1/en/1.txt:MODULE:1.txt'")
def _(spark, sf_dir):
    return _edges(W.scope_delete(*filesystem(spark, sf_dir), "src1/en/1.txt")[1])


@query("wr3_create", "SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 5) GROUP BY 1")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.lit("TAG").alias("label"), F.col("n_name").alias("key"), F.lit(None).cast("string").alias("file"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"), "n_nationkey")
    return W.create_nodes(rows.drop("n_nationkey"), rows.where("n_nationkey < 5")).groupBy(F.col("key").alias("name")).agg(F.count("*").alias("n"))


@query("wr4_merge", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, COALESCE(p, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, sf_dir):
    none = F.lit(None).cast("string")
    base = table(spark, sf_dir, "customer").select(F.lit("C").alias("label"), F.col("c_custkey").cast("string").alias("key"), none.alias("file"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("props"))
    # orders write their customer's segment in order of their key; finished ones write null, which erases nothing
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.lit("C").alias("label"), F.col("o_custkey").cast("string").alias("key"), none.alias("file"), F.create_map(F.lit("segment"), value, F.lit("name"), none).alias("props"), F.col("o_orderkey").alias("seq"))
    return W.merge_nodes(base, rows).select("key", F.col("props")["name"].alias("name"), F.col("props")["segment"].alias("segment"))


def _items(spark, sf_dir):
    none, no_props = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    part = table(spark, sf_dir, "part").where("p_size <= 10").select(F.lit("P").alias("label"), F.col("p_partkey").cast("string").alias("key"), none.alias("file"), no_props.alias("props"))
    order = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("O").alias("label"), F.col("o_orderkey").cast("string").alias("key"), none.alias("file"), no_props.alias("props"))
    line = table(spark, sf_dir, "lineitem").select(F.lit("ITEM").alias("type"), F.lit("O").alias("from_label"), F.col("l_orderkey").cast("string").alias("from_key"), F.lit("P").alias("to_label"), F.col("l_partkey").cast("string").alias("to_key"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("props"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"))
    return part.unionByName(order), line


_ITEMS = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' JOIN part ON l_partkey = p_partkey AND p_size <= 10"


@query("jn6_keyed_lookup", f"SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, count(*) AS n {_ITEMS} GROUP BY 1, 2")
def _(spark, sf_dir):
    nodes, rows = _items(spark, sf_dir)
    return W.join_ends(nodes, rows).groupBy(F.col("from_key").alias("a"), F.col("to_key").alias("b")).agg(F.count("*").alias("n"))


@query("wr5_merge_edges", f"SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, arg_max(l_returnflag, (l_linenumber, l_suppkey, l_extendedprice)) AS flag {_ITEMS} GROUP BY 1, 2")
def _(spark, sf_dir):
    nodes, rows = _items(spark, sf_dir)
    empty = rows.drop("seq").where("false")
    return W.merge_edges(nodes, empty, rows).select(F.col("from_key").alias("a"), F.col("to_key").alias("b"), F.col("props")["flag"].alias("flag"))


@query("wr9_subtree_delete", TREE + " SELECT * FROM n WHERE NOT (starts_with(coalesce(file, ''), 'src2/') OR (label IN ('FILE', 'DIRECTORY') AND (key = 'src2' OR starts_with(key, 'src2/'))))")
def _(spark, sf_dir):
    return _nodes(W.remove_path(*filesystem(spark, sf_dir), "src2", True)[0])


@query("wr9_subtree_delete_edges", TREE + " SELECT * FROM e WHERE NOT (a = 'src2' OR starts_with(a, 'src2/') OR b = 'src2' OR starts_with(b, 'src2/'))")
def _(spark, sf_dir):
    return _edges(W.remove_path(*filesystem(spark, sf_dir), "src2", True)[1])


_MOVED = "CASE WHEN {0} = 'src3' OR starts_with({0}, 'src3/') THEN 'lib/old' || substr({0}, 5) ELSE {0} END"


@query("wr10_move", TREE + f" SELECT label, {_MOVED.format('key')} AS key, file, CASE WHEN key = 'src3' THEN 'old' ELSE name END AS name FROM n WHERE file IS NULL OR NOT starts_with(file, 'src3/')")
def _(spark, sf_dir):
    return _nodes(W.move_path(*filesystem(spark, sf_dir), "src3", "lib/old")[0])


@query("wr10_move_edges", TREE + f" SELECT type, {_MOVED.format('a')} AS a, {_MOVED.format('b')} AS b FROM e WHERE NOT (type = 'DEFINES' AND starts_with(a, 'src3/')) AND NOT (type = 'HAS_ENTRY' AND b = 'src3')")
def _(spark, sf_dir):
    return _edges(W.move_path(*filesystem(spark, sf_dir), "src3", "lib/old")[1])


@query("wr11_links", f"WITH {FILES}, d AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), parent]) AS path FROM f) SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS parent, path AS child, 'DIRECTORY' AS kind FROM d WHERE path <> '.' UNION ALL SELECT parent, path, 'FILE' FROM f")
def _(spark, sf_dir):
    return W.entries(files(spark, sf_dir))[1]


@query("wr12_constraint", "SELECT CAST(l_orderkey AS VARCHAR) || '.' || l_linenumber AS fqn, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    fqn = F.concat_ws(".", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(fqn.alias("fqn")).agg(F.count("*").alias("n")).where("n > 1")


@query("wr17_create_missing", "SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'there' ELSE 'new' END AS state FROM customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("C").alias("label"), F.col("c_name").alias("key"), F.lit(None).cast("string").alias("file"), "c_custkey")
    state = lambda x: F.create_map(F.lit("state"), F.lit(x)).alias("props")
    there, rows = c.where("c_custkey % 3 = 0").select("label", "key", "file", state("there")), c.select("label", "key", "file", state("new"))
    return W.create_missing(there, rows).select("key", F.col("props")["state"].alias("state"))


@query("wr18_merge_variable_edges", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)")
def _(spark, sf_dir):
    rows = _items(spark, sf_dir)[1].drop("seq").withColumn("props", F.create_map(F.lit("variable"), F.col("props")["flag"]))
    return W.merge_variable_edges(rows.where("false"), rows).agg(F.count("*").alias("n"))


@query("wr22_soft_delete", TREE + " SELECT label, count(*) AS n FROM n WHERE NOT (label = 'FILE' AND starts_with(key, 'src4/')) GROUP BY 1")
def _(spark, sf_dir):
    nodes, edges = filesystem(spark, sf_dir)
    marked = W.soft_delete(nodes, (F.col("label") == "FILE") & W.inside("key", "src4"), 10.0)
    return W.sweep(marked, edges, 16.0)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("wr24_ancestors", f"WITH {FILES}, d AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), parent]) AS path FROM f) SELECT path FROM d WHERE path NOT IN ('.', 'src0')")
def _(spark, sf_dir):
    known = spark.createDataFrame([(".",), ("src0",)], "path string")
    return W.entries(files(spark, sf_dir))[0].join(known, "path", "left_anti")


@query("wr26_incremental_update", "SELECT label, count(*) AS n FROM (SELECT 'O' AS label FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 UNION ALL SELECT 'P' FROM part WHERE p_size <= 10) GROUP BY 1")
def _(spark, sf_dir):
    nodes, rows = _items(spark, sf_dir)
    edges = W.create_edges(nodes, rows.drop("seq").where("false"), rows.drop("seq"))
    removed = nodes.where((F.col("label") == "O") & (F.col("key").cast("long") % 7 == 0))
    modified = nodes.where((F.col("label") == "O") & (F.col("key").cast("long") % 7 == 1))
    return W.update_incrementally(nodes, edges, removed, modified, nodes.where("false"), rows.drop("seq").where("false"))[0].groupBy("label").agg(F.count("*").alias("n"))


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base = d.select("doc_id", F.col("lang").alias("name"), F.col("n_chars").alias("size"))
    return base.where("doc_id % 7 <> 0"), base.where("doc_id % 11 <> 0").withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))


@query("df1_diff", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'updated' END AS change FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0)")
@query("jn10_full_outer", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'updated' END AS change FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0)")
def _(spark, sf_dir):
    return D.diff(*_snapshots(spark, sf_dir), ["doc_id"], ["name", "size"])


def _typed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 3 == 0, "FILE").when(F.col("doc_id") % 3 == 1, "DIRECTORY").otherwise("METHOD")
    line = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id"))
    old = d.select(F.col("doc_id").alias("key"), label.alias("label"), F.col("source").alias("name"), F.col("n_chars").alias("size"), F.lit(1).alias("modified"), line.alias("line"), F.col("text").alias("code"))
    new = old.withColumn("size", F.col("size") + (F.col("key") % 2)).withColumn("code", F.concat("code", F.when(F.col("key") % 2 == 0, F.lit("!")).otherwise(F.lit(""))))
    return old, new


@query("df2_node_changed", "SELECT doc_id AS key, 'updated' AS change FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 1 WHEN 1 THEN false ELSE doc_id % 4 <> 0 AND doc_id % 2 = 0 END")
def _(spark, sf_dir):
    return D.diff(*_typed(spark, sf_dir), ["key"], D.node_changed())


@query("df3_patch", "SELECT doc_id AS key, 'updated' AS change, source AS name, CASE doc_id % 3 WHEN 0 THEN 'FILE' ELSE 'METHOD' END AS type, substr(substr(text, 1, 60) || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END, 1, 40) AS code, CAST(CASE doc_id % 3 WHEN 0 THEN 2 ELSE 4 END AS DOUBLE) AS val FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 1 WHEN 1 THEN false ELSE doc_id % 4 <> 0 AND doc_id % 2 = 0 END")
def _(spark, sf_dir):
    old, new = _typed(spark, sf_dir)
    return D.patch(D.diff(old, new, ["key"], D.node_changed()), new)


@query("df4_apply_patch", "SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE lang END AS name FROM documents WHERE doc_id % 9 <> 0")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("key"), F.col("lang").alias("name"))
    change = F.when(F.col("doc_id") % 9 == 0, "removed").when(F.col("doc_id") % 4 == 0, "added").when(F.col("doc_id") % 5 == 0, "updated")
    rows = d.select(F.col("doc_id").alias("key"), change.alias("change"), F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("lang")).alias("name")).where("change is not null")
    return D.apply_patch(base, rows)


@query("df6_symbol_changes", "SELECT doc_id AS full_name, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'updated' END AS change FROM documents WHERE lang = 'en' AND ((doc_id % 7 = 0) <> (doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0))")
def _(spark, sf_dir):
    old, new = (s.withColumnRenamed("doc_id", "full_name").withColumn("exported", F.col("name") == "en") for s in _snapshots(spark, sf_dir))
    return D.symbol_changes(old, new, ["size"])


@query("jn11_pair_by_content", f"WITH {FILES}, d AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY doc_id, path) AS k FROM f WHERE doc_id % 2 = 0), c AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY doc_id, path) AS k FROM f WHERE doc_id % 2 = 1) SELECT d.path AS from_path, c.path AS to_path FROM d JOIN c USING (hash, k)")
def _(spark, sf_dir):
    f = files(spark, sf_dir).withColumnRenamed("doc_id", "seq")
    return D.pair_by_content(f.where("seq % 2 = 0"), f.where("seq % 2 = 1"))


@query("jn12_first_by_name", "SELECT c_nationkey AS nation, c_mktsegment AS segment, min(c_custkey) AS first FROM customer GROUP BY 1, 2")
def _(spark, sf_dir):
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("first"))


@query("jn15_missing_ends", "SELECT 'to' AS side, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 UNION ALL SELECT 'from', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def _(spark, sf_dir):
    nodes, rows = _items(spark, sf_dir)
    lost_from, lost_to = C.missing_ends(nodes, rows)
    return lost_from.agg(F.count("*").alias("n")).select(F.lit("from").alias("side"), "n").unionByName(lost_to.agg(F.count("*").alias("n")).select(F.lit("to").alias("side"), "n"))


@query("jn16_orphans", f"WITH {FILES} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'orphan' END AS state FROM f WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return D.orphans(f.where("doc_id % 7 <> 0"), f.where("doc_id % 11 <> 0"))


@query("rc1_reconcile", f"WITH {FILES} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'add' WHEN doc_id % 11 = 0 THEN 'delete' ELSE 'update' END AS action FROM f WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 15 = 0)")
def _(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path", "hash", F.col("loc").alias("modified"))
    new = f.withColumn("modified", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("modified"))).withColumn("hash", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("hash")))
    return D.reconcile(f.where("doc_id % 7 <> 0"), new.where("doc_id % 11 <> 0"))


@query("rc3_cleanup", TREE + " SELECT label, count(*) AS n FROM n WHERE NOT regexp_full_match(key, '.*/[0-9]*7[.]txt') GROUP BY 1")
def _(spark, sf_dir):
    return W.remove_nodes(*filesystem(spark, sf_dir), F.col("key").rlike(r"^(?:.*/[0-9]*7[.]txt)$"))[0].groupBy("label").agg(F.count("*").alias("n"))


@query("st1_union", "SELECT kind, id, size FROM (SELECT 'part' AS kind, p_partkey AS id, p_size AS size FROM part UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier)")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return p.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@query("st2_difference", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'extra' END AS side FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)")
def _(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return D.id_difference(a, b, "doc_id")


@query("ag7_group_rows", "SELECT l_returnflag AS type, count(*) AS rows, CAST(ceil(count(*) / 5000.0) AS BIGINT) AS chunks FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / 5000).alias("chunks"))


@query("ag8_first_by_key", "SELECT event_type AS kind, user_id AS owner, min(event_id) AS first FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("event_type").alias("kind"), F.col("user_id").alias("owner"), F.col("event_id").alias("first"))


# traversal


def _calls(spark, sf_dir) -> DataFrame:
    return code(spark, sf_dir).edges[0].df.toDF("src", "dst")


_E = CODE_SQL


def _typed_calls(spark, sf_dir) -> DataFrame:
    return _calls(spark, sf_dir).select("src", "dst", F.when(F.col("src") % 2 == 0, "CDG").otherwise("DDG").alias("type"), F.concat(F.lit("v"), F.col("dst") % 3).alias("variable"))


def _at(spark, *ids) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node long")


@query("gt8_backward_slice", _E + ", t(x) AS (SELECT a FROM e WHERE b = 30 AND (a % 2 = 0 OR b % 3 = 0) UNION SELECT e.a FROM t JOIN e ON e.b = t.x WHERE e.a % 2 = 0 OR e.b % 3 = 0) SELECT x AS node FROM t UNION SELECT 30")
def _(spark, sf_dir):
    return V.backward_slice(_at(spark, 30), _typed_calls(spark, sf_dir), "v0")


@query("gt9_impact", _E + ", t(x) AS (SELECT b FROM e WHERE a = 30 UNION SELECT e.b FROM t JOIN e ON e.a = t.x), s AS (SELECT x FROM t UNION SELECT 30) SELECT 'f' || n AS file, count(*) AS statements FROM s JOIN u ON u.id = s.x GROUP BY 1")
def _(spark, sf_dir):
    owner = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("f"), "s_nationkey").alias("file"))
    return V.impact(_at(spark, 30), _typed_calls(spark, sf_dir), owner)


@query("gt10_dead", _E + ", t(x) AS (SELECT b FROM e WHERE a IN (30, 31) UNION SELECT e.b FROM t JOIN e ON e.a = t.x) SELECT id AS node FROM u WHERE id NOT IN (SELECT x FROM t) AND id NOT IN (30, 31)")
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return V.dead(nodes, _at(spark, 30, 31), _calls(spark, sf_dir))


@query("gt11_loops", _E + ", t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT DISTINCT a AS node FROM t WHERE a = b")
def _(spark, sf_dir):
    return V.loops(_calls(spark, sf_dir))


@query("gt5_dependents", _E + " SELECT DISTINCT a AS node FROM e WHERE b IN (30, 31, 33) AND a NOT IN (30, 31, 33)")
@query("gt6_dependents_of_changed", _E + " SELECT DISTINCT a AS node FROM e WHERE b IN (30, 31, 33) AND a NOT IN (30, 31, 33)")
def _(spark, sf_dir):
    return V.dependents(_at(spark, 30, 31, 33), _calls(spark, sf_dir))


@query("gt12_subgraph", _E + " SELECT a AS src, b AS dst FROM e JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE x.n < 9 AND y.n < 9")
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").where("s_nationkey < 9").select(F.col("s_suppkey").alias("node"))
    return V.subgraph(nodes, _calls(spark, sf_dir)).select("src", "dst")


def _resolution(spark, sf_dir):
    """Items call parts with a status, sizes define parts, and of each four parts by key the later ones are aliases of the one before."""
    line = table(spark, sf_dir, "lineitem")
    calls = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("external").alias("status"))
    part = table(spark, sf_dir, "part")
    defines = part.select(F.col("p_size").alias("src"), F.col("p_partkey").alias("dst"))
    aliases = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst"))
    return calls, defines, aliases


_ROOT = "{0} - {0} % 4"
_TARGETS = f"SELECT DISTINCT l_orderkey AS call, CAST(p_size AS BIGINT) AS definition FROM lineitem JOIN part ON {_ROOT.format('p_partkey')} = {_ROOT.format('l_partkey')} WHERE l_returnflag = 'R'"


@query("gt13_canonical", f"SELECT p_partkey AS node, {_ROOT.format('p_partkey')} AS root FROM part WHERE p_partkey % 4 <> 0")
def _(spark, sf_dir):
    return V.canonical(_resolution(spark, sf_dir)[2])


@query("gt14_targets", _TARGETS)
def _(spark, sf_dir):
    return V.targets(*_resolution(spark, sf_dir)).select("call", F.col("definition").cast("long").alias("definition"))


@query("gt14_rollup", f"SELECT DISTINCT 'o' || call % 10 AS src, 'd' || definition % 10 AS dst FROM ({_TARGETS})")
def _(spark, sf_dir):
    pairs = V.targets(*_resolution(spark, sf_dir))
    owner = pairs.select(F.col("call").alias("node"), F.concat(F.lit("o"), F.col("call") % 10).alias("file")).distinct()
    other = pairs.select(F.col("definition").alias("node"), F.concat(F.lit("d"), F.col("definition") % 10).alias("file")).distinct()
    both = pairs.select((F.col("call") * 2).alias("call"), (F.col("definition").cast("long") * 2 + 1).alias("definition"))
    return V.rollup(both, owner.select((F.col("node") * 2).alias("node"), "file").unionByName(other.select((F.col("node").cast("long") * 2 + 1).alias("node"), "file")))


@query("gt15_communities")
def _(spark, sf_dir):
    edges = _calls(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    return V.community_summary(V.communities(edges), edges, names)


@query("gt18_sample", _E + " SELECT a AS src, b AS dst FROM e ORDER BY 1, 2 LIMIT 500")
def _(spark, sf_dir):
    return _calls(spark, sf_dir).orderBy("src", "dst").limit(500)


# validation


@query("va1_validate", "SELECT rule, count(*) AS n FROM (SELECT 'required' AS rule FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'enum' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'co-label' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'undeclared property' FROM documents UNION ALL SELECT 'missing end' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'end labels' FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    key = F.concat(F.lit("m"), i)
    labels = F.when(i % 7 == 0, F.array(F.lit("MODULE"))).otherwise(F.array(F.lit("CPG"), F.lit("MODULE")))
    props = F.create_map(F.lit("id"), key, F.lit("name"), F.when(i % 5 != 0, F.col("lang")), F.lit("file"), F.col("source"), F.lit("range"), F.lit("1:0-2:0"), F.lit("status"), F.when(i % 3 == 0, "odd").otherwise("ready"), F.lit("colour"), F.lit("red"))
    nodes = d.select(labels.alias("labels"), key.alias("key"), F.col("source").alias("file"), props.alias("props"))
    edges = d.select(F.lit("DEFINES").alias("type"), F.lit("MODULE").alias("from_label"), key.alias("from_key"), F.lit("MODULE").alias("to_label"), F.when(i % 2 == 0, F.lit("none")).otherwise(key).alias("to_key"), F.create_map().cast("map<string,string>").alias("props"))
    return C.validate_delta(nodes, edges).groupBy("rule").agg(F.count("*").alias("n"))


@query("va2_conformance", TREE + " SELECT label, count(*) AS nodes FROM n WHERE label NOT IN ('FILE', 'DIRECTORY', 'SYMBOL') GROUP BY 1")
def _(spark, sf_dir):
    from ..schema import NODE_SPECS

    nodes, _ = filesystem(spark, sf_dir)
    wrong = [k for k, s in NODE_SPECS.items() if s.cpg]
    return nodes.where(F.col("label").isin(*wrong) & F.col("file").isNotNull()).groupBy("label").agg(F.count("*").alias("nodes"))


@query("va3_invariants", "SELECT * FROM (SELECT 'duplicate fqn' AS rule, b AS subject, CAST(n AS VARCHAR) AS detail FROM (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, b LIMIT 10)) UNION ALL SELECT * FROM (SELECT 'not ready', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderstatus <> 'O' ORDER BY 2 LIMIT 10)")
def _(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(F.col("p_brand").alias("fqn"))
    edges = symbols.distinct().select(F.lit("SYMBOL").alias("to_label"), F.col("fqn").alias("to_key"))
    unready = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise(F.col("o_orderstatus")).alias("status"))
    return C.invariants(symbols, edges, unready)


@query("prj16_parameters", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def _(spark, sf_dir):
    from ..cypher import run

    return run(star(spark, sf_dir), spark, "MATCH (c:CUSTOMER) WHERE c.segment = $segment AND c.balance > $least RETURN c.id AS id", {"segment": "BUILDING", "least": 1000})


@query("prj21_layer_filter", "SELECT 'CALLS' AS type, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "CALLS").otherwise("OTHER").alias("type"))
    return edges.where(F.col("type").isin("CALLS", "REACHING_DEF")).groupBy("type").agg(F.count("*").alias("n"))


@query("prj22_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), '11')")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("11")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
