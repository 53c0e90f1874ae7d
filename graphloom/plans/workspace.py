"""Registered queries of sources, paths, extraction and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cypher import explain
from ..sources import extract as E
from ..sources import outputs as O
from ..sources import paths as S
from .algebra import FILES, files
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


@query("src3_load", f"WITH {FILES} SELECT path, name, parent, language, hash, loc FROM f")
def _(spark, sf_dir):
    return files(spark, sf_dir).drop("doc_id")


@query("src6_glob", f"WITH {FILES} SELECT path FROM f WHERE regexp_full_match(path, 'src[0-9]/(.*/)?[^/]*[.]txt') OR regexp_full_match(path, '(.*/)?de/.*')")
def _(spark, sf_dir):
    return files(spark, sf_dir).where(S.matches(F.col("path"), ("/src?/**/*.txt", "de/**"))).select("path")


@query("src7_paths", f"WITH {FILES} SELECT path, name AS base, parent, './' || split_part(path, '/', 1) || '/' || parent AS above FROM f")
def _(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", S.base_name(p).alias("base"), S.parent(p).alias("parent"), F.array_join(S.ancestors(p), "/").alias("above"))


@query("src8_grammar", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'tsx' WHEN 2 THEN 'python' WHEN 3 THEN NULL ELSE NULL END AS language, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'unknown' ELSE 'go' END AS full_language FROM documents")
def _(spark, sf_dir):
    ends = F.element_at(F.array(F.lit("a.b.MTS"), F.lit("x.tsx"), F.lit("m.Py"), F.lit(".py"), F.lit("z.go")), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("d.py/"), ends)
    return table(spark, sf_dir, "documents").select("doc_id", S.language(path).alias("language"), S.full_language(path).alias("full_language"))


@query("fn12_range", "SELECT l_orderkey AS id, l_linenumber || ':' || l_suppkey || '-' || (l_linenumber + 1) || ':' || l_partkey AS range FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), S.range_text(F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_linenumber") + 1, F.col("l_partkey")).alias("range"))


@query("fn13_node_id", f"WITH {FILES} SELECT path || ':PARAM:' || language || '/' || name || CASE WHEN doc_id % 2 = 0 THEN ':' || doc_id ELSE '' END AS id FROM f")
def _(spark, sf_dir):
    return files(spark, sf_dir).select(S.node_id(F.col("path"), "PARAM", F.array("language", "name"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))).alias("id"))


def _sources(spark, sf_dir):
    """A Python file for each part and a TypeScript one for each supplier."""
    i = F.col("p_partkey").cast("string")
    py = F.concat(F.lit("X"), i, F.lit(" = 1\n\nclass C"), i, F.lit(":\n    def m(self, a: int, b=2):\n        y = a\n        return y\n\n@deco\ndef hidden():\n    pass\n\ndef _f"), i, F.lit("(*args):\n    return 1\n"))
    j = F.col("s_suppkey").cast("string")
    ts = F.concat(F.lit("export class S"), j, F.lit(" {\n  private n: number = 1;\n  go(x: string, { y }): void { if (x) { return; } }\n}\ninterface I {}\nexport async function f"), j, F.lit("(a?: Map<string, number>) { return \"}\"; }\n"))
    a = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), i, F.lit(".py")).alias("path"), F.lit("python").alias("language"), py.alias("text"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), j, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), ts.alias("text")))


_PY = ", ".join(f"('{kind}', '{scope}', '{suffix}')" for kind, scope, suffix in (("MODULE", "@.py", ""), ("MEMBER", "X@", ""), ("TYPE_DECL", "C@", ""), ("METHOD", "C@/m", ""), ("PARAM", "C@/m/self", ":0"), ("PARAM", "C@/m/a", ":1"), ("PARAM", "C@/m/b", ":2"), ("METHOD", "_f@", ""), ("PARAM", "_f@/args", ":0")))
_TS = ", ".join(f"('{kind}', '{scope}', '{suffix}')" for kind, scope, suffix in (("MODULE", "@.ts", ""), ("TYPE_DECL", "S@", ""), ("MEMBER", "S@/n", ""), ("METHOD", "S@/go", ""), ("PARAM", "S@/go/x", ":0"), ("METHOD", "f@", ""), ("PARAM", "f@/a", ":0")))


@query("ex1_declarations", f"SELECT kind AS label, 'p/' || p_partkey || '.py:' || kind || ':' || replace(scope, '@', CAST(p_partkey AS VARCHAR)) || suffix AS key FROM part, (VALUES {_PY}) t(kind, scope, suffix) UNION ALL SELECT kind, 's/' || s_suppkey || '.ts:' || kind || ':' || replace(scope, '@', CAST(s_suppkey AS VARCHAR)) || suffix FROM supplier, (VALUES {_TS}) t(kind, scope, suffix)")
def _(spark, sf_dir):
    return E.extract(_sources(spark, sf_dir))[0].select("label", "key")


@query("ex5_edges", "SELECT type, from_label, to_label, sum(n)::BIGINT AS n FROM (SELECT count(*) AS c FROM part), (SELECT count(*) AS s FROM supplier), LATERAL (VALUES ('DECLARES', 'MODULE', 'MEMBER', c), ('DECLARES', 'MODULE', 'TYPE_DECL', c + s), ('DECLARES', 'MODULE', 'METHOD', c + s), ('DECLARES', 'TYPE_DECL', 'METHOD', c + s), ('DECLARES', 'TYPE_DECL', 'MEMBER', s), ('HAS_PARAM', 'METHOD', 'PARAM', 4 * c + 2 * s)) t(type, from_label, to_label, n) GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return E.extract(_sources(spark, sf_dir))[1].groupBy("type", "from_label", "to_label").agg(F.count("*").alias("n"))


@query("fn15_signature", "SELECT 'p/' || p_partkey || '.py' AS file, unnest(['m(self, a: int, b)', '_f' || p_partkey || '(args)']) AS signature FROM part UNION ALL SELECT 's/' || s_suppkey || '.ts', unnest(['go(x: string): void', 'f' || s_suppkey || '(a: Map<string, number>)']) FROM supplier")
def _(spark, sf_dir):
    return E.extract(_sources(spark, sf_dir))[0].where("label = 'METHOD'").select("file", F.col("props")["signature"].alias("signature"))


@query("fn16_exported", "SELECT 'p/' || p_partkey || '.py' AS file, unnest(['m', '_f' || p_partkey]) AS name, unnest(['true', 'false']) AS exported FROM part UNION ALL SELECT 's/' || s_suppkey || '.ts', unnest(['go', 'f' || s_suppkey]), unnest(['false', 'true']) FROM supplier")
def _(spark, sf_dir):
    return E.extract(_sources(spark, sf_dir))[0].where("label = 'METHOD'").select("file", F.col("props")["name"].alias("name"), F.col("props")["exported"].alias("exported"))


@query("snk3_json", "SELECT '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS line FROM nation")
def _(spark, sf_dir):
    return O.json_lines(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("snk7_display", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'METHOD' AS type, substr(p_name || p_type || p_brand || p_name || p_type, 1, 40) AS code, CAST(4 AS DOUBLE) AS val FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("METHOD").alias("label"), F.concat("p_name", "p_type", "p_brand", "p_name", "p_type").alias("code"))
    return O.display(p)


@query("snk10_explain")
def _(spark, sf_dir):
    text = explain(star(spark, sf_dir), spark, "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION) WHERE c.balance > 0 RETURN n.name AS name, count(c) AS n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line int, text string")
