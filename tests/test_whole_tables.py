"""Queries take whole tables: no bound on ids, steps or lengths."""

import compare
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom import registry
from graphloom.plans import algebra, star

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def large_ids(tmp_path):
    rows = [{"doc_id": i, "text": f"{'same ' * 20}{i}", "lang": "en", "source": "s", "n_chars": 100} for i in (1, 6, 99_999, *range(100_000, 100_024))]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["df2_node_changed", "df3_patch"])
def test_large_document_ids(spark, large_ids, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{large_ids}/documents.parquet')")
    assert compare.differences(QUERIES[name](spark, large_ids), con, SQL[name]) == ""


def test_whole_texts_are_compared(spark, large_ids):
    old, _ = algebra._typed(spark, large_ids)
    assert {r["key"]: r["code"] for r in old.collect()}[100_003] == "same " * 20 + "100003"


def suppliers(tmp_path, ids) -> str:
    rows = [{"s_suppkey": i, "s_name": f"S{i}", "s_nationkey": 1, "s_acctbal": 0.0} for i in ids]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("s_suppkey", pa.int64()), ("s_name", pa.string()), ("s_nationkey", pa.int32()), ("s_acctbal", pa.float64())])), tmp_path / "supplier.parquet")
    return str(tmp_path)


def flows(ids) -> dict:
    """The shortest, then least simple path from each source to each sink (without sanitizers), depth first over all."""
    step = {}
    for a in ids:
        o = a % star.UNIT
        called = [a + o + 1] * (2 * o + 1 < star.UNIT) + [a + o + 2] * (2 * o + 2 < star.UNIT) + [a - o + o // 4] * (a % 3 == 0 and o > 0)
        step[a] = [b for b in called if b in ids]
    best: dict = {}

    def walk(path):
        for b in step[path[-1]]:
            if b in path:
                continue
            now = [*path, b]
            kind = {8: "SQL_INJECTION", 2: "DESERIALIZATION"}.get(b % 10)
            if kind:
                at = (path[0], b, kind)
                best[at] = min(best.get(at, (len(now), now)), (len(now), now))
            walk(now)

    for a in ids:
        if a % 10 == 3:
            walk([a])
    return {k: ">".join(map(str, p)) for k, (_, p) in best.items()}


def taint(spark, sf_dir) -> dict:
    return {(r["source"], r["sink"], r["class"]): r["path"] for r in QUERIES["tq2_taint"](spark, sf_dir).collect()}


def test_taint_beyond_the_first_suppliers(spark, tmp_path):
    ids = [i for i in range(1, 330) if i % 10 != 5]
    want = flows(ids)
    assert max(a for a, _, _ in want) > 200
    sf_dir = suppliers(tmp_path, ids)
    assert taint(spark, sf_dir) == want
    steps = {(int(a), int(b), k) for p in want.values() for k, (a, b) in enumerate(zip(p.split(">"), p.split(">")[1:]), 1)}
    assert {tuple(r) for r in QUERIES["tq14_flow_edges"](spark, sf_dir).select("src", "dst", "hop").collect()} == steps
    assert {(r["source"], r["sink"], r["class"]): r["hops"] for r in QUERIES["tq13_findings"](spark, sf_dir).collect()} == {k: p.count(">") for k, p in want.items()}


def test_communities_beyond_the_first_suppliers(spark, tmp_path):
    assert QUERIES["gt15_communities"](spark, suppliers(tmp_path, range(300, 360))).agg({"size": "sum"}).first()[0] >= 45


def test_long_taint_flows(spark):
    from graphloom.operators import taint as T

    n = 15
    names = ["os.environ.get", *["f"] * (n - 2), "cursor.execute"]
    nodes = spark.createDataFrame([(i, "python", x) for i, x in enumerate(names)], "id long, language string, name string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(5, 2)], "src long, dst long")
    found = T.propagate(T.tag(nodes), edges)
    assert [(r["source"], r["sink"], r["path"]) for r in found.collect()] == [(0, n - 1, list(range(n)))]
    assert {tuple(r) for r in T.flow_edges(found).collect()} == {(i, i + 1, i + 1) for i in range(n - 1)}


@pytest.mark.parametrize("name", ["jn14_stem_fallback", "jn13_candidates"])
def test_imports_are_not_broadcast(spark, small, name):
    """Exploded candidates and composed paths are far larger than their columns, by which Spark would broadcast them at 60 times sf0.1."""
    df = QUERIES[name](spark, small)
    assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_stem_fallback_comes_last(spark):
    from graphloom.passes import resolve as R

    files = spark.createDataFrame([("a/x.py",), ("b/X.ts",), ("b/y.py",), ("b/y.py",)], "path string")
    imports = spark.createDataFrame([(1, "f", "p.x", ["no.py", "b/y.py", "a/x.py"]), (2, "f", "p.X", ["no.py"]), (3, "g", "q/y", []), (4, "g", "Y", None), (5, "g", "none", ["no.py"]), (6, "g", None, ["b/X.ts"]), (7, "g", None, None)], "id int, file string, module string, candidates array<string>")
    found = lambda fallback: sorted(tuple(r) for r in R.resolve_imports(imports, files, fallback).select("id", "file", "target").collect())
    assert found(False) == [(1, "f", "b/y.py"), (6, "g", "b/X.ts")]
    assert found(True) == [(1, "f", "b/y.py"), (2, "f", "a/x.py"), (3, "g", "b/y.py"), (4, "g", "b/y.py"), (6, "g", "b/X.ts")]
