"""Registered queries of scans, stores, outputs, reconciliation, resolution and quality, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cypher import run, scalar
from ..cypher.parser import ReadOnlyError, parse
from ..functions import query as N
from ..functions import source as M
from ..operators import diff as D
from ..operators import taint as T
from ..operators import traverse as V
from ..operators import write as W
from ..passes import flow as L
from ..passes import resolve as R
from ..schema import document, tables, to_json
from ..sources import extract as E
from ..sources import outputs as O
from ..sources import paths as S
from ..sources import syntax as Y
from ..sources import workspace as K
from ..streaming import changes as C
from .algebra import FILES, TREE, _edges, _nodes, files, filesystem
from .star import star, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, for a store or an output that a query writes and reads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/graphloom-{name}-{uuid.uuid4().hex}"


# scans

_LISTING = """l AS (SELECT CASE doc_id % 10 WHEN 0 THEN 'node_modules/x/' || doc_id || '.js' WHEN 1 THEN 'src/' || doc_id || '.min.js' WHEN 2 THEN 'src/' || doc_id || '.d.ts' WHEN 3 THEN 'src/a/' || doc_id || '.py' WHEN 4 THEN 'src/' || doc_id || '.ts' WHEN 5 THEN 'docs/' || doc_id || '.md' WHEN 6 THEN '.git/' || doc_id WHEN 7 THEN 'lib/dist/' || doc_id || '.py' WHEN 8 THEN 'big/' || doc_id || '.py' ELSE 'main' || doc_id || '.tsx' END AS path,
CASE WHEN doc_id % 10 = 8 AND doc_id % 20 = 8 THEN 3000000 ELSE n_chars END AS size, doc_id % 50 = 49 AS is_link, doc_id FROM documents),
w AS (SELECT path, size, CASE WHEN is_link THEN 'symlink' WHEN doc_id % 10 IN (0, 1, 2, 6, 7) THEN 'excluded' WHEN size > 2097152 THEN 'too large' ELSE 'kept' END AS state, CASE doc_id % 10 WHEN 0 THEN 'javascript' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'python' WHEN 4 THEN 'typescript' WHEN 7 THEN 'python' WHEN 8 THEN 'python' WHEN 9 THEN 'tsx' END AS language FROM l)"""


def _listing(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = lambda head, tail: F.concat(F.lit(head), i, F.lit(tail))
    ways = [name("node_modules/x/", ".js"), name("src/", ".min.js"), name("src/", ".d.ts"), name("src/a/", ".py"), name("src/", ".ts"), name("docs/", ".md"), name(".git/", ""), name("lib/dist/", ".py"), name("big/", ".py"), name("main", ".tsx")]
    size = F.when(i % 20 == 8, F.lit(3_000_000)).otherwise(F.col("n_chars"))
    return d.select(F.get(F.array(*ways), (i % 10).cast("int")).alias("path"), size.cast("long").alias("size"), (i % 50 == 49).alias("is_link"))


@query("src1_walk", f"WITH {_LISTING} SELECT path, size, state, language FROM w")
def _(spark, sf_dir):
    return K.scan(_listing(spark, sf_dir))


@query("src2_counters", f"""WITH {_LISTING} SELECT count(*) FILTER (state <> 'symlink') AS "filesSeen", count(*) FILTER (state = 'excluded') AS "filesExcluded", count(*) FILTER (state = 'kept' AND language IS NULL) AS "filesUnsupported", count(*) FILTER (state = 'too large') AS "filesTooLarge", count(*) FILTER (state = 'symlink') AS "symlinksSkipped" FROM w""")
def _(spark, sf_dir):
    return K.scan_counts(K.scan(_listing(spark, sf_dir)))


@query("src4_records", f"WITH {_LISTING} SELECT path, split_part(path, '/', -1) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, coalesce(language, 'none') AS language FROM w WHERE state = 'kept'")
def _(spark, sf_dir):
    return K.records(K.scan(_listing(spark, sf_dir)))


@query("src5_scope", f"WITH {_LISTING} SELECT path FROM l WHERE doc_id % 10 IN (3, 4, 5, 8) AND size < 5000 AND NOT is_link")
def _(spark, sf_dir):
    scope = K.define_scope(include=("src/**", "docs/**", "big/**"), exclude_extra=("**/nothing/**",), max_bytes=4999)
    return K.scan(_listing(spark, sf_dir), scope).where("state = 'kept'").select("path")


@query("src9_tolerant_parser", "SELECT label, sum(n)::BIGINT AS n FROM (SELECT count(*) AS c FROM part), LATERAL (VALUES ('MODULE', c), ('UNKNOWN', c), ('METHOD', 2 * c), ('PARAM', c), ('MEMBER', c)) t(label, n) GROUP BY 1")
def _(spark, sf_dir):
    text = F.concat(F.lit("X = 1\n\ndef a(p):\n    return p\n\ndef broken(:\n    pass\n\ndef b"), "p_partkey", F.lit("():\n    pass\n"))
    broken = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))
    return E.extract(broken)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("src11_configuration", "SELECT * FROM (VALUES ('include', '**/*.py'), ('exclude', 'a/**'), ('exclude', 'b/**'), ('max_bytes', '10')) t(setting, value)")
def _(spark, sf_dir):
    scope = K.define_scope(include=["**/*.py"], exclude=["a/**"], exclude_extra=["b/**"], max_bytes=10)
    return rows(spark, [("include", x) for x in scope.include] + [("exclude", x) for x in scope.exclude] + [("max_bytes", str(scope.max_bytes))], "setting string, value string")


@query("src14_older_scan", f"WITH {_LISTING} SELECT path FROM l WHERE doc_id % 10 IN (1, 2, 3, 4) AND NOT is_link")
def _(spark, sf_dir):
    return K.scan_older(_listing(spark, sf_dir))


@query("src15_full_language", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'c' WHEN 2 THEN 'cpp' WHEN 3 THEN 'typescript' WHEN 4 THEN 'kotlin' ELSE 'unknown' END AS language FROM documents")
def _(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("a.rs", "a.H", "b/a.hpp", "a.tsx", "a.b.kt", "Makefile")])
    return table(spark, sf_dir, "documents").select("doc_id", S.full_language(F.get(ends, (F.col("doc_id") % 6).cast("int"))).alias("language"))


# stores and writes


def _module(spark, key: str) -> DataFrame:
    return rows(spark, [("MODULE", f"{key}:MODULE:new", key, {"id": f"{key}:MODULE:new", "name": "new"})], W.NODE)


@query("snk1_store", TREE + " SELECT label, count(*) AS n FROM (SELECT label FROM n WHERE file IS NULL OR file <> 'src1/en/1.txt' UNION ALL SELECT 'MODULE' UNION ALL SELECT type FROM e WHERE a <> 'src1/en/1.txt:MODULE:1.txt') GROUP BY 1")
def _(spark, sf_dir):
    store = W.Store(spark, folder(spark, "store"), "g")
    store.save(*filesystem(spark, sf_dir))
    for _ in range(2):  # a second time changes nothing
        store.write_delta({"MODULE": _module(spark, "src1/en/1.txt")}, {}, "src1/en/1.txt")
    nodes, edges = store.read()
    return nodes.select("label").unionByName(edges.select(F.col("type").alias("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query("snk2_null_store", "SELECT CAST(25 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges, CAST(2 AS BIGINT) AS operations")
@query("wr14_report", "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS edges, CAST(2 AS BIGINT) AS operations FROM nation")
def _(spark, sf_dir):
    tags = table(spark, sf_dir, "nation").select(F.lit("TAG").alias("label"), F.col("n_name").alias("key"), F.lit(None).cast("string").alias("file"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"), F.lit(0).alias("seq"))
    told = W.NullStore().write_delta({"TAG": tags}, {}, "f")
    return rows(spark, [(told["nodes"], told["edges"], told["operations"])], "nodes long, edges long, operations long")


@query("wr1_plan_delta", TREE + " SELECT label, count(*) AS n FROM (SELECT label FROM n WHERE file IS NULL OR file <> 'src1/en/1.txt' UNION ALL SELECT 'MODULE' UNION ALL SELECT 'SYMBOL') GROUP BY 1")
def _(spark, sf_dir):
    symbol = rows(spark, [("SYMBOL", "new", None, {"fqn": "new"}, 0), ("SYMBOL", "en", None, {"fqn": "en"}, 0)], W.NODE + ", seq int")
    steps = W.plan_delta({"MODULE": _module(spark, "src1/en/1.txt"), "SYMBOL": symbol}, {}, "src1/en/1.txt")
    return W.apply_plan(*filesystem(spark, sf_dir), steps)[0].groupBy("label").agg(F.count("*").alias("n"))


_ENDS = {"DIRECTORY": "path", "FILE": "path", "SYMBOL": "fqn", "COMMUNITY": "id", "TAG": "name", "META_DATA": "refused"} | dict.fromkeys(("MODULE", "TYPE_DECL", "METHOD", "PARAM", "MEMBER", "CALL", "IMPORT", "UNKNOWN"), "id")


@query("wr6_endpoint", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _ENDS.items()) + ") t(label, property)")
def _(spark, sf_dir):
    from ..schema import NODE_SPECS

    def of(label: str) -> str:
        try:
            return W.endpoint(label)
        except ValueError:
            return "refused"

    return rows(spark, [(k, of(k)) for k in NODE_SPECS], "label string, property string")


@query("wr7_chunks", "SELECT (l_orderkey * 8 + l_linenumber) // 5000 AS chunk, count(*) AS rows FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(W.chunk_of(place).alias("chunk")).agg(F.count("*").alias("rows"))


@query("wr8_filesystem", TREE + """, m AS (SELECT label, CASE WHEN label IN ('FILE', 'DIRECTORY') AND (key = 'src3' OR starts_with(key, 'src3/')) THEN 'lib' || substr(key, 5) ELSE key END AS key, file FROM n WHERE file IS NULL OR NOT starts_with(file, 'src3/'))
SELECT label, key FROM m WHERE NOT (label IN ('FILE', 'DIRECTORY') AND (key = 'src2' OR starts_with(key, 'src2/'))) AND NOT coalesce(starts_with(file, 'src2/'), false) UNION SELECT * FROM (VALUES ('FILE', 'new/x/y.py'), ('DIRECTORY', 'new'), ('DIRECTORY', 'new/x')) t""")
def _(spark, sf_dir):
    new = rows(spark, [("new/x/y.py", "y.py")], "path string, name string")
    return W.write_filesystem(*filesystem(spark, sf_dir), files=new, removals=[("src2", True)], moves=[("src3", "lib")])[0].select("label", "key")


@query("wr13_procedures", "SELECT * FROM (VALUES ('label', 'REGION'), ('label', 'NATION'), ('label', 'PLACE'), ('label', 'CUSTOMER'), ('label', 'SUPPLIER'), ('label', 'PARTY'), ('label', 'PART'), ('label', 'ORDER'), ('type', 'IN_REGION'), ('type', 'IN_NATION'), ('type', 'PLACED'), ('type', 'CONTAINS_ITEM'), ('type', 'SUPPLIED_BY'), ('type', 'HAS'), ('index', 'REGION'), ('index', 'NATION'), ('index', 'CUSTOMER'), ('index', 'ORDER'), ('constraint', 'CUSTOMER')) t(kind, name)")
def _(spark, sf_dir):
    g = star(spark, sf_dir)
    calls = (("label", "CALL db.labels() YIELD label"), ("type", "CALL db.relationshipTypes() YIELD relationshipType"), ("index", "CALL db.indexes() YIELD label"), ("constraint", "CALL db.constraints() YIELD label"))
    parts = [run(g, spark, text).toDF("name").select(F.lit(kind).alias("kind"), "name") for kind, text in calls]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("wr15_administration", "SELECT * FROM (VALUES ('before', 'a,b'), ('after', 'b'), ('metadata', '2')) t(what, value)")
def _(spark, sf_dir):
    at = folder(spark, "admin")
    a, b = W.Store(spark, at, "a"), W.open_store(spark, at, "b")
    a.bootstrap()
    before = ",".join(a.graphs())
    a.drop()
    return rows(spark, [("before", before), ("after", ",".join(b.graphs())), ("metadata", b.configuration()["metadata"]["schema_version"])], "what string, value string")


_TEXTS = ("MATCH (n) RETURN n", "CREATE (n:X) RETURN n", "MATCH (n) SET n.x = 1", "MATCH (n) DELETE n", "MERGE (n:X) RETURN n", "MATCH (n) REMOVE n.x", "MATCH (n:NATION) WHERE n.name = 'CREATE' RETURN n.id AS id")


@query("wr16_read_only", "SELECT * FROM (VALUES (0, false), (1, true), (2, true), (3, true), (4, true), (5, true), (6, false)) t(query, refused)")
def _(spark, sf_dir):
    def refused(text: str) -> bool:
        try:
            parse(text)
        except ReadOnlyError:
            return True
        return False

    return rows(spark, [(i, refused(x)) for i, x in enumerate(_TEXTS)], "query int, refused boolean")


@query("wr19_update", TREE + " SELECT label, key, file, CASE WHEN key = 'src1' THEN 'renamed' ELSE name END AS name FROM n")
def _(spark, sf_dir):
    nodes, _ = filesystem(spark, sf_dir)
    return _nodes(W.update_node(nodes, "src1", {"name": "renamed", "label": "no", "id": "no"}))


@query("wr20_replace_file", TREE + " SELECT label, key FROM n WHERE file IS NULL OR file <> 'src1/en/1.txt' UNION ALL SELECT 'MODULE', 'src1/en/1.txt:MODULE:new'")
def _(spark, sf_dir):
    nodes, edges = filesystem(spark, sf_dir)
    return W.replace_file(nodes, edges, "src1/en/1.txt", _module(spark, "src1/en/1.txt"), edges.where("false"))[0].select("label", "key")


@query("wr21_remove_keys", TREE + ", g AS (SELECT path FROM f WHERE doc_id % 4 = 0) SELECT 'node' AS part, count(*) AS n FROM n WHERE key NOT IN (FROM g) UNION ALL SELECT 'edge', count(*) FROM e WHERE b NOT IN (FROM g) UNION ALL SELECT 'cleared', 0")
def _(spark, sf_dir):
    nodes, edges = filesystem(spark, sf_dir)
    left, links = W.remove_keys(nodes, edges, files(spark, sf_dir).where("doc_id % 4 = 0").select(F.col("path").alias("key")))
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(left, "node").union(count(links, "edge")).union(count(W.clear(left, links)[0], "cleared"))


@query("wr23_reconnect", "SELECT n_name AS orphan, 'new ' || n_name AS parent FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'other ' || n_name FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    i = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    orphans = n.select(F.col("n_name").alias("key"), F.concat(F.lit("x"), i).alias("name"), F.when(i % 2 == 0, F.array(F.concat(F.lit("c"), i), F.lit("d"))).otherwise(none).alias("children"))
    by_children = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("new "), "n_name").alias("key"), F.lit("same").alias("name"), F.array(F.lit("d"), F.concat(F.lit("c"), i)).alias("children"))
    by_name = n.where("n_nationkey % 2 = 1").select(F.concat(F.lit("other "), "n_name").alias("key"), F.concat(F.lit("x"), i).alias("name"), none.alias("children"))
    return W.reconnect(orphans, by_children.unionByName(by_name))


@query("wr25_rename", TREE + " SELECT type, CASE WHEN a = 'src3' OR starts_with(a, 'src3/') THEN 'moved' || substr(a, 5) ELSE a END AS a, CASE WHEN b = 'src3' OR starts_with(b, 'src3/') THEN 'moved' || substr(b, 5) ELSE b END AS b FROM e WHERE NOT (type = 'DEFINES' AND starts_with(a, 'src3/'))")
def _(spark, sf_dir):
    # the move itself, and the parent's link to the new name
    return _edges(W.write_filesystem(*filesystem(spark, sf_dir), moves=[("src3", "moved")])[1])


@query("gt17_contained", TREE + " SELECT regexp_replace('lib' || substr(key, 5), '/[^/]*$', '') AS from_key, 'lib' || substr(key, 5) AS to_key FROM n WHERE label IN ('FILE', 'DIRECTORY') AND starts_with(key, 'src3/')")
def _(spark, sf_dir):
    return W.contained(filesystem(spark, sf_dir)[0], "src3", "lib")


# outputs


@query("snk4_table", "WITH w AS (SELECT max(length(CAST(n_nationkey AS VARCHAR)))::INTEGER AS a FROM nation) SELECT 0 AS place, 'id  name' AS line UNION ALL SELECT (n_nationkey + 1)::INTEGER, rpad(CAST(n_nationkey AS VARCHAR), a, ' ') || '  ' || n_name FROM nation, w")
def _(spark, sf_dir):
    text = O.format_table(table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return rows(spark, list(enumerate(text.splitlines())), "place int, line string")


@query("snk3_json_nulls", """SELECT '{"id":' || c_custkey || ',"segment":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS line FROM customer""")
def _(spark, sf_dir):
    return O.json_lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")))


@query("snk5_schema", "SELECT * FROM (VALUES ('nodes', 14), ('edges', 14), ('indexes', 5), ('constraints', 1)) t(part, n)")
def _(spark, sf_dir):
    part = F.get_json_object
    text = rows(spark, [(to_json(),)], "j string")
    keys = lambda c, p: F.size(F.json_object_keys(part(c, f"$.{p}")))
    listed = F.array(*[F.struct(F.lit(p).alias("part"), n.alias("n")) for p, n in [(p, keys("j", p)) for p in ("nodes", "edges")] + [(p, F.json_array_length(part("j", f"$.{p}"))) for p in ("indexes", "constraints")]])
    return text.select(F.explode(listed).alias("x")).select("x.*")


@query("snk6_graphml", "SELECT 'node' AS part, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'edge', count(*) FROM nation UNION ALL SELECT 'frame', 2")
def _(spark, sf_dir):
    at = folder(spark, "graphml")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = lambda c, kind: F.concat(F.lit(f"{kind}<"), c)
    nodes = n.select(F.lit("NATION").alias("label"), key("n_nationkey", "n").alias("key")).union(r.select(F.lit("REGION"), key("r_regionkey", "r")))
    O.graphml(nodes, n.select(F.lit("IN").alias("type"), key("n_nationkey", "n").alias("from_key"), key("n_regionkey", "r").alias("to_key")), at)
    line = F.col("value")
    part = F.when(line.rlike('^<node id="[nr]&lt;[0-9]+">'), "node").when(line.rlike('^<edge source="n&lt;[0-9]+" target="r&lt;[0-9]+">'), "edge").otherwise("frame")
    return spark.read.text(at).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


_LABELS = "DIRECTORY FILE MODULE TYPE_DECL METHOD PARAM MEMBER CALL IMPORT SYMBOL COMMUNITY TAG UNKNOWN META_DATA".split()


@query("snk8_document", "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _LABELS) + ") t(label)")
def _(spark, sf_dir):
    text = document("a <!-- s:begin --> old <!-- s:end --> b", "s", tables())
    first = text[: text.index("| type |")]
    return rows(spark, [(line.split("|")[1].strip(),) for line in first.splitlines() if line.startswith("| ") and "| key |" not in line], "label string")


@query("fn10_query_value", r"""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"a\\b\"' || n_name || '\n"' ELSE '"' || n_nationkey || '"' END AS value FROM nation""")
def _(spark, sf_dir):
    i = F.col("n_nationkey")
    value = F.when(i % 3 == 1, F.concat(F.lit('a\\b"'), "n_name", F.lit("\n"))).when(i % 3 == 2, i.cast("string"))
    return table(spark, sf_dir, "nation").select(i.alias("id"), N.query_value(value).alias("value"))


@query("fn11_parameters", """SELECT 'CYPHER a=1 b="x\\"y" c=[true, null] d={k: 2.5} ' AS prefix""")
def _(spark, sf_dir):
    return rows(spark, [(N.parameter_prefix({"a": 1, "b": 'x"y', "c": [True, None], "d": {"k": 2.5}}),)], "prefix string")


@query("ag6_scalar", "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS none FROM customer")
def _(spark, sf_dir):
    g = star(spark, sf_dir)
    return rows(spark, [(scalar(g, spark, "MATCH (c:CUSTOMER) RETURN count(c) AS n"), scalar(g, spark, "MATCH (c:CUSTOMER {id: -1}) RETURN c.id AS id"))], "customers long, none long")


# functions and extraction


@query("prj20_list_comprehension", "SELECT n_nationkey::BIGINT AS id, 1 AS n FROM nation UNION ALL SELECT r_regionkey, 1 FROM region")
def _(spark, sf_dir):
    return run(star(spark, sf_dir), spark, "MATCH (n:PLACE) RETURN n.id AS id, size([l IN labels(n) WHERE l <> 'PLACE']) AS n")


@query("fn7_paths", "SELECT 1 AS hops, 2 AS nodes, 'NATION' AS label, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 2, 3, 'CUSTOMER', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(spark, sf_dir):
    return run(star(spark, sf_dir), spark, "MATCH p = (r:REGION {id: 2})-[:HAS*1..2]->(x) RETURN length(p) AS hops, size(nodes(p)) AS nodes, labels(x)[0] AS label, count(*) AS n")


@query("fn14_docstring_head", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Part ' || p_partkey WHEN 1 THEN 'one line' WHEN 2 THEN 'raw' END AS head FROM part")
def _(spark, sf_dir):
    i = F.col("p_partkey")
    text = F.when(i % 4 == 0, F.concat(F.lit('"""\n  Part '), i, F.lit('\n\n  More.\n"""'))).when(i % 4 == 1, F.lit("'one line'")).when(i % 4 == 2, F.lit("r'''raw\nx'''")).otherwise(F.lit('""""""'))
    return table(spark, sf_dir, "part").select(i.alias("id"), M.docstring_head(text).alias("head"))


@query("fn17_visibility", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'protected' ELSE 'public' END AS python, CASE p_partkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS typescript FROM part")
def _(spark, sf_dir):
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), M.python_visibility(pick("__x", "_x", "__init__", "x")).alias("python"), M.typescript_visibility(pick("private static", "readonly protected", "public", "")).alias("typescript"))


@query("fn18_weight", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 4.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 WHEN 3 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM part")
def _(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in ("METHOD", "DIRECTORY", "LITERAL", "BLOCK", "SYMBOL")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), D.weight(F.get(labels, (F.col("p_partkey") % 5).cast("int"))).alias("weight"))


@query("fn19_truncation", "SELECT doc_id, CAST(length(substr(text, 1, 256)) AS INTEGER) AS code, substr(text, 1, 64) AS name FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(Y.shown_code(F.col("text"))).alias("code"), Y.shown_name(F.col("text")).alias("name"))


@query("fn22_relative", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 1, 2) AS relative FROM part")
def _(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("./a", "../b", "..", ".hidden")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.is_relative(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("relative"))


def _sources(spark, sf_dir) -> DataFrame:
    """A Python file for each part: an import, a class with a method, a function that calls, and a variable."""
    i = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import os.path\nLIMIT = 10\nclass C"), i, F.lit(':\n    """Of a part."""\n    size: int = 1\n    async def go(self, n: int = 2) -> str:\n        return str(n)\ndef f'), i, F.lit("():\n    g()\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), i, F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))


@query("ex2_python", "SELECT 'p/' || p_partkey || '.py' AS file, * FROM (SELECT p_partkey FROM part), LATERAL (VALUES ('C' || p_partkey, NULL, NULL, 'Of a part.'), ('go', 'go(self, n: int) -> str', 'true', NULL), ('f' || p_partkey, 'f' || p_partkey || '()', 'false', NULL)) t(name, signature, async, docstring)".replace("*", "name, signature, async, docstring", 1))
def _(spark, sf_dir):
    p = F.col("props")
    return E.extract(_sources(spark, sf_dir))[0].where("label in ('METHOD', 'TYPE_DECL')").select("file", p["name"].alias("name"), p["signature"].alias("signature"), p["async"].alias("async"), p["docstring_head"].alias("docstring"))


@query("ex3_typescript", "SELECT 's/' || s_suppkey || '.tsx' AS file, label, name, kind FROM supplier, (VALUES ('TYPE_DECL', 'A', NULL), ('MEMBER', 'x', 'number'), ('METHOD', 'get', 'getter'), ('METHOD', 'run', 'method'), ('METHOD', 'top', 'function'), ('MEMBER', 'c', NULL)) t(label, name, kind)")
def _(spark, sf_dir):
    text = "export class A { private x: number = 1; get get(): number { return this.x } async run(a: string) { /* } */ } }\nfunction* top() {}\nexport const c = () => 1;\ninterface I {}\n"
    found = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), "s_suppkey", F.lit(".tsx")).alias("path"), F.lit("tsx").alias("language"), F.lit(text).alias("text"))
    p = F.col("props")
    return E.extract(found)[0].where("label in ('METHOD', 'TYPE_DECL', 'MEMBER')").select("file", "label", p["name"].alias("name"), F.when(F.col("label") == "METHOD", p["kind"]).when(F.col("label") == "MEMBER", p["type_text"]).alias("kind"))


@query("ex4_unsupported", "SELECT 'unsupported language' AS kind, 'javascript' AS language, min('s/' || s_suppkey || '.js') AS first, count(*) AS files FROM supplier UNION ALL SELECT 'node', 'MODULE', NULL, count(*) FROM supplier")
def _(spark, sf_dir):
    path = F.concat(F.lit("s/"), "s_suppkey", F.lit(".js"))
    found = table(spark, sf_dir, "supplier").select(path.alias("path"), S.language(path).alias("language"), F.lit("class A {}\nfunction f() {}\n").alias("text"))
    nodes = E.extract(found)[0].groupBy("label").agg(F.count("*").alias("files"))
    return E.warnings(found).unionByName(nodes.select(F.lit("node").alias("kind"), F.col("label").alias("language"), F.lit(None).cast("string").alias("first"), "files"))


@query("ex7_node_map", "SELECT label, name, count * c AS n FROM (SELECT count(*) AS c FROM part), (VALUES ('METHOD', 'go', 1), ('METHOD_PARAMETER_IN', 'self', 1), ('METHOD_PARAMETER_IN', 'n', 1), ('CALL', 'str', 1), ('CALL', 'g', 1), ('LOCAL', 'LIMIT', 1), ('LOCAL', 'size', 1)) t(label, name, count)")
def _(spark, sf_dir):
    tree = Y.syntax_tree(_sources(spark, sf_dir))
    wanted = F.col("label").isin("METHOD", "METHOD_PARAMETER_IN", "CALL", "LOCAL") & ~F.coalesce(F.col("code").rlike("^import|^def f"), F.lit(False))
    return tree.where(wanted).groupBy("label", "name").agg(F.count("*").alias("n"))


@query("ex8_properties", "SELECT 'p/' || p_partkey || '.py' AS file, 'g()' AS code, 9 AS line, 4 AS col FROM part")
def _(spark, sf_dir):
    return Y.syntax_tree(_sources(spark, sf_dir)).where("label = 'CALL' and name = 'g'").select("file", "code", "line", "col")


@query("ex9_captures", "SELECT 'p/' || p_partkey || '.py' AS file, capture, CASE name WHEN 'C' THEN name || p_partkey WHEN 'f' THEN name || p_partkey ELSE name END AS name, line FROM part, (VALUES ('import', NULL, 1), ('definition.variable', 'LIMIT', 2), ('definition.class', 'C', 3), ('definition.variable', 'size', 5), ('definition.function', 'go', 6), ('definition.function', 'f', 8)) t(capture, name, line)")
def _(spark, sf_dir):
    return Y.captures(Y.syntax_tree(_sources(spark, sf_dir)), ("definition.function", "definition.class", "definition.variable", "import"))


@query("ex10_symbols", "SELECT 'p/' || p_partkey || '.py' AS file, 'go' AS name, 'METHOD' AS kind, 6 AS line FROM part")
def _(spark, sf_dir):
    return Y.find_symbol(Y.symbols(Y.syntax_tree(_sources(spark, sf_dir))), "go")


@query("ex11_changed_files", f"WITH {FILES} SELECT path FROM f WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def _(spark, sf_dir):
    f = files(spark, sf_dir).withColumnRenamed("hash", "content_hash")
    known = f.where("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return E.changed_files(f, known).select("path")


@query("snk9_snapshots", "SELECT 'p/' || p_partkey || '.py' AS file, 9 AS first, 'LITERAL' AS label FROM part")
def _(spark, sf_dir):
    text = F.concat(F.lit("\n" * 8), F.lit("12 + f("), "p_partkey", F.lit(")\n"))
    found = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))
    node = F.get(F.from_json("tree", "array<struct<line:int,label:string>>"), F.lit(0))
    return Y.snapshot(Y.syntax_tree(found)).select("file", node["line"].alias("first"), node["label"].alias("label"))


# control flow of one shape for each size of part

#: rows (id, parent, order, label, code) below the method's block ``b``, and the flow that they give
SHAPES = {
    "cf2_sequence": ([("x", "b", 1, "CALL", ""), ("y", "b", 2, "LOCAL", ""), ("z", "b", 3, "IDENTIFIER", "")], "m>x x>y y>z z>m:RETURN"),
    "cf3_return": ([("x", "b", 1, "CALL", ""), ("r", "b", 2, "RETURN", ""), ("y", "b", 3, "CALL", "")], "m>x x>r r>m:RETURN"),
    "cf4_if": ([("i", "b", 1, "CONTROL_STRUCTURE", "if c"), ("c", "i", 0, "IDENTIFIER", "c"), ("t", "i", 1, "BLOCK", ""), ("x", "t", 0, "CALL", ""), ("e", "i", 2, "BLOCK", ""), ("y", "e", 0, "CALL", ""), ("z", "b", 2, "CALL", "")], "m>i i>c c>x:TRUE c>y:FALSE x>z y>z z>m:RETURN"),
    "cf5_loops": ([("w", "b", 1, "CONTROL_STRUCTURE", "while c"), ("c", "w", 0, "IDENTIFIER", "c"), ("t", "w", 1, "BLOCK", ""), ("x", "t", 0, "CALL", ""), ("d", "b", 2, "CONTROL_STRUCTURE", "do"), ("u", "d", 0, "BLOCK", ""), ("y", "u", 0, "CALL", ""), ("k", "d", 1, "IDENTIFIER", "k")], "m>w w>c c>x:TRUE x>w:LOOP_BACK c>d:FALSE d>y y>k k>d:LOOP_BACK k>m:RETURN:FALSE"),
    "cf6_switch_try": ([("s", "b", 1, "CONTROL_STRUCTURE", "switch (c)"), ("p", "s", 0, "BLOCK", "case 1"), ("x", "p", 0, "CALL", ""), ("q", "s", 1, "BLOCK", "default"), ("y", "q", 0, "CALL", ""), ("t", "b", 2, "CONTROL_STRUCTURE", "try"), ("h", "t", 0, "BLOCK", ""), ("z", "h", 0, "CALL", ""), ("g", "t", 1, "BLOCK", ""), ("v", "g", 0, "CALL", "")], "m>s s>x:CASE s>y:CASE x>t y>t t>z t>v z>m:RETURN v>m:RETURN"),
    "cf7_kinds": ([("f", "b", 1, "CONTROL_STRUCTURE", "for x in y"), ("t", "f", 0, "BLOCK", ""), ("x", "t", 0, "CALL", ""), ("i", "b", 2, "CONTROL_STRUCTURE", "elif z"), ("u", "i", 0, "BLOCK", ""), ("y", "u", 0, "CALL", ""), ("o", "b", 3, "CONTROL_STRUCTURE", "with a"), ("n", "o", 0, "BLOCK", ""), ("z", "n", 0, "CALL", "")], "m>f f>x:TRUE x>f:LOOP_BACK f>i:FALSE i>y:TRUE y>o i>o:FALSE o>z z>m:RETURN"),
}


def _shape_sql(flow: str) -> str:
    """The flow's edges for every part; a node is named by the part and its id, the method by the part alone."""
    edges = []
    for e in flow.split():
        a, _, b = e.partition(">")
        b, _, kind = b.partition(":") if not b.startswith("m:RETURN") else ("m:RETURN", "", b.removeprefix("m:RETURN").removeprefix(":"))
        edges.append((a, b, kind or "FALL_THROUGH"))
    name = lambda c: f"CASE {c} WHEN 'm' THEN 'm' || p_partkey WHEN 'm:RETURN' THEN 'm' || p_partkey || ':RETURN' ELSE 'm' || p_partkey || ':' || {c} END"
    return f"SELECT 'm' || p_partkey AS method, {name('a')} AS src, {name('b')} AS dst, kind FROM part, (VALUES {', '.join(map(str, edges))}) t(a, b, kind)"


def _shape(name: str):
    def f(spark, sf_dir):
        m = F.concat(F.lit("m"), "p_partkey")
        named = lambda x: m if x == "m" else F.concat(m, F.lit(f":{x}"))
        none = F.lit(None).cast("string")
        below = [("m", None, 0, "METHOD", ""), ("b", "m", 0, "BLOCK", ""), *SHAPES[name][0]]
        parts = F.array(*[F.struct(named(i).alias("id"), (none if p is None else named(p)).alias("parent"), F.lit(o).alias("ord"), F.lit(label).alias("label"), F.lit(text).alias("code"), none.alias("control")) for i, p, o, label, text in below])
        return L.control_flow(table(spark, sf_dir, "part").select(m.alias("method"), F.explode(parts).alias("r")).select("method", "r.*"))

    return f


for _name, (_, _flow) in SHAPES.items():
    QUERIES[_name], SQL[_name] = _shape(_name), _shape_sql(_flow)


# resolution and reconciliation


@query("rs2_python_candidates", "SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'a/x/m' || c_custkey || '.py,a/x/m' || c_custkey || '/__init__.py' ELSE 'q/m' || c_custkey || '.py,q/m' || c_custkey || '/__init__.py,src/q/m' || c_custkey || '.py,src/q/m' || c_custkey || '/__init__.py' END AS candidates FROM customer")
def _(spark, sf_dir):
    i = F.col("c_custkey")
    module = F.concat(F.when(i % 2 == 0, F.lit("x.m")).otherwise(F.lit("q.m")), i)
    found = R.python_candidates(F.lit("a/b/f.py"), module, F.when(i % 2 == 0, 2).otherwise(0))
    return table(spark, sf_dir, "customer").select(i.alias("id"), F.array_join(found, ",").alias("candidates"))


@query("rs3_typescript_candidates", "SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'a/m' || c_custkey || '.ts' END AS second, CASE c_custkey % 2 WHEN 0 THEN 9 ELSE 0 END AS n FROM customer")
def _(spark, sf_dir):
    i = F.col("c_custkey")
    found = R.typescript_candidates(F.lit("a/b/f.ts"), F.concat(F.when(i % 2 == 0, F.lit("../m")).otherwise(F.lit("m")), i))
    return table(spark, sf_dir, "customer").select(i.alias("id"), F.get(found, F.lit(1)).alias("second"), F.size(found).alias("n"))


@query("rs4_clear_stale", "SELECT l_returnflag AS type, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_suppkey % 3 = 0) GROUP BY 1")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_partkey").alias("dst"))
    changed = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("path"))
    return R.clear_stale(edges, changed, ("R",)).groupBy("type").agg(F.count("*").alias("n"))


@query("rs6_resolve_again", "SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 OR c_nationkey % 5 = 1 THEN 'new' ELSE 'old' END || c_nationkey AS definition FROM customer")
def _(spark, sf_dir):
    # each customer calls its nation's function; nations divisible by five changed, and the next ones import them
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    file = lambda k: F.concat(F.lit("n"), k)
    calls = c.select(F.col("c_custkey").alias("id"), file("c_nationkey").alias("file"), F.lit("own").alias("callee"))
    links = n.where("n_nationkey % 5 = 1").select(file("n_nationkey").alias("src"), file(F.col("n_nationkey") - 1).alias("dst"))
    resolved = calls.select("id", "file", F.concat(F.lit("old"), F.substring("file", 2, 9)).alias("definition"), F.lit("local").alias("how"))
    definitions = n.select(file("n_nationkey").alias("file"), F.lit("own").alias("name"), F.concat(F.lit("new"), "n_nationkey").alias("definition"))
    imports = rows(spark, [], "file string, alias string, target string")
    changed = n.where("n_nationkey % 5 = 0").select(file("n_nationkey").alias("path"))
    return R.resolve_again(changed, links, calls, imports, definitions, resolved).select("id", "definition")


_STATES = "CASE WHEN doc_id % 7 = 0 THEN 'add' WHEN doc_id % 11 = 0 THEN 'delete' WHEN {} THEN 'update' END"


@query("rc2_strategies", "SELECT how, action, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{how}' AS how, {_STATES.format(test)} AS action FROM documents WHERE NOT (doc_id % 77 = 0)" for how, test in (("hash", "doc_id % 3 = 0"), ("time", "doc_id % 5 = 0"), ("hybrid", "doc_id % 15 = 0"))) + ") WHERE action IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path", "hash", F.col("loc").alias("modified"))
    new = f.withColumn("modified", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("modified"))).withColumn("hash", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("hash")))
    parts = [D.reconcile(f.where("doc_id % 7 <> 0"), new.where("doc_id % 11 <> 0"), how).groupBy("action").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "action", "n") for how in ("hash", "time", "hybrid")]
    return parts[0].union(parts[1]).union(parts[2])


@query("rc4_root", TREE + " SELECT 'DIRECTORY' AS label, key, NULL AS parent FROM n WHERE label = 'DIRECTORY' AND key = 'top' UNION ALL SELECT 'DIRECTORY', 'top', NULL UNION ALL SELECT 'HAS_ENTRY', path, 'top' FROM d WHERE path IN ('src1', 'src2')")
def _(spark, sf_dir):
    nodes, edges = W.ensure_root(*filesystem(spark, sf_dir), "top", ["src1", "src2", "nowhere"])
    made = nodes.where("key = 'top'").select("label", "key", F.lit(None).cast("string").alias("parent"))
    return made.unionByName(edges.where("from_key = 'top'").select(F.col("type").alias("label"), F.col("to_key").alias("key"), F.col("from_key").alias("parent")))


@query("df5_has_changes", "SELECT * FROM (VALUES ('same', false), ('other', true)) t(against, changes)")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = [(k, D.has_changes(D.diff(n, m, ["n_nationkey"], ["n_name"]))) for k, m in (("same", n), ("other", n.where("n_nationkey <> 3")))]
    return rows(spark, found, "against string, changes boolean")


@query("sm1_change_source", "SELECT source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, source AS parent FROM documents WHERE doc_id % 4 <> 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*[F.lit(x) for x in ("created", "deleted", "changed", "moved")]), (F.col("doc_id") % 4).cast("int"))
    events = d.select(kind.alias("kind"), F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.lit("h").alias("hash"))
    return C.entries_of(events).select("path", "name", "parent")


# quality


@query("tq9_prototype_pollution", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 12 = 1")
def _(spark, sf_dir):
    i = F.col("p_partkey")
    target = F.get(F.array(*[F.lit(x) for x in ("a.__proto__.x", "o[key]", "o['fixed']", "o.plain")]), (i % 4).cast("int"))
    p = table(spark, sf_dir, "part")
    return T.prototype_pollution(p.select(i.alias("id"), target.alias("target")), p.where("p_partkey % 3 = 1").select(i.alias("id"))).select("id")


@query("tq10_insecure_randomness", "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0")
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("method"), F.when(F.col("l_returnflag") == "R", "random.randint").otherwise("secrets.choice").alias("name"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method"), F.when(F.col("s_suppkey") % 2 == 0, "makeToken").otherwise("shuffle").alias("name"))
    return T.insecure_randomness(calls, names).select("id")


@query("tq11_empty_catch", "SELECT 'c' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    i = F.col("p_partkey")
    row = lambda id_, parent, label, code: F.struct(F.concat(F.lit(id_), i).alias("id"), F.concat(F.lit(parent), i).alias("parent"), F.lit(label).alias("label"), F.lit(code).alias("code"))
    catch = [row("c", "m", "CONTROL_STRUCTURE", "catch (e)"), row("b", "c", "BLOCK", "")]
    inner = F.when(i % 3 == 0, F.array(*catch, row("k", "b", "COMMENT", "// nothing"))).otherwise(F.array(*catch, row("k", "b", "CALL", "log(e)")))
    return T.empty_catches(table(spark, sf_dir, "part").select(F.explode(inner).alias("r")).select("r.*")).select("id")


@query("gt11_strong_components", "SELECT n_nationkey::BIGINT AS node, (n_nationkey // 5 * 5 + 3)::BIGINT AS component FROM nation WHERE n_nationkey % 5 < 4")
def _(spark, sf_dir):
    # of each five nations four make a circle, which the fifth leads into
    i = F.col("n_nationkey").cast("long")
    n = table(spark, sf_dir, "nation")
    ring = n.where("n_nationkey % 5 < 4").select(i.alias("src"), (i - i % 5 + (i % 5 + 1) % 4).alias("dst"))
    return V.strong_components(ring.union(n.where("n_nationkey % 5 = 4").select(i.alias("src"), (i - 4).alias("dst"))))
