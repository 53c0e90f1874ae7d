"""Writes, sources, passes and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import taint, traverse, write
from graphloom.passes import flow, resolve
from graphloom.sources import extract, outputs, paths, workspace
from graphloom.streaming import changes


def node(label, key, file=None, **props):
    return (label, key, file, props)


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), write.NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, {}) for r in rows], write.EDGE)


def test_rewriting_a_file_keeps_calls_into_its_symbols(spark):
    n = nodes(spark, node("MODULE", "a:M", "a"), node("SYMBOL", "s"), node("CALL", "b:C", "b"))
    e = edges(spark, ("DEFINES", "MODULE", "a:M", "SYMBOL", "s"), ("CALLS", "CALL", "b:C", "SYMBOL", "s"))
    n, e = write.scope_delete(n, e, "a")
    assert [r["type"] for r in e.collect()] == ["CALLS"] and n.count() == 2


def test_merge_prunes_nulls_and_later_rows_win(spark):
    base = nodes(spark, node("TAG", "t", name="t", value="old"))
    rows = spark.createDataFrame([("TAG", "t", None, {"value": "new"}, 1), ("TAG", "t", None, {"value": None}, 2), ("TAG", "u", None, {"value": "x"}, 3)], write.NODE + ", seq int")
    got = {r["key"]: r["props"] for r in write.merge_nodes(base, rows).collect()}
    assert got == {"t": {"name": "t", "value": "new"}, "u": {"value": "x"}}


def test_edges_without_ends_vanish_and_equal_keys_fan_out(spark):
    n = nodes(spark, node("METHOD", "m"), node("METHOD", "m"), node("PARAM", "p"))
    e = edges(spark, ("HAS_PARAM", "METHOD", "m", "PARAM", "p"), ("HAS_PARAM", "METHOD", "x", "PARAM", "p"))
    assert write.create_edges(n, e.where("false"), e).count() == 2


def test_plans_refuse_what_is_undeclared(spark):
    rows = nodes(spark)
    with pytest.raises(ValueError):
        write.plan_delta({"NOPE": rows}, {})
    with pytest.raises(ValueError):
        write.plan_delta({}, {"HAS_ENTRY": rows})
    assert [s.kind for s in write.plan_delta({"MODULE": rows}, {"CALLS": rows}, "f")] == ["scope delete", "create nodes", "create edges"]
    with pytest.raises(ValueError):
        write.endpoint("META_DATA")


def test_store_versions(spark, tmp_path):
    store = write.Store(spark, f"file://{tmp_path}", "g")
    assert store.bootstrap() == "created" and store.bootstrap() == "matched" and store.bootstrap(1) == "mismatch"
    store.write_filesystem(files=spark.createDataFrame([("a/b/c.py", "c.py")], "path string, name string"))
    n, e = store.read()
    assert {(r["label"], r["key"]) for r in n.collect()} >= {("DIRECTORY", "."), ("DIRECTORY", "a"), ("DIRECTORY", "a/b"), ("FILE", "a/b/c.py")}
    assert e.count() == 3
    store.write_filesystem(moves=[("a/b", "z")])
    n, e = store.read()
    assert {r["key"] for r in n.where("label = 'FILE'").collect()} == {"z/c.py"}
    assert {(r["from_key"], r["to_key"]) for r in e.collect()} == {(".", "a"), (".", "z"), ("z", "z/c.py")}
    assert store.graphs() == ["g"]
    store.drop()
    assert store.graphs() == []


def test_schema_is_deterministic():
    assert schema.to_json() == schema.to_json() and len(schema.NODE_SPECS) == 14 and len(schema.EDGE_SPECS) == 14
    assert schema.struct(schema.NODE_SPECS["FILE"])["version"].nullable is False
    assert json.loads(schema.to_json())["version"] == 2
    assert "| MODULE |" in schema.document("a<!-- t:begin -->x<!-- t:end -->b", "t", schema.tables())


PYTHON = '''X = 1

class C:
    """Says hello.

    More.
    """
    p: str = "x"

    def __init__(self, p: str):
        self.p = p

    async def go(self, *a, k=1, **kw) -> int:
        def inner(): pass

def _hidden(): pass
'''


def test_python_declarations():
    rows = extract.rows_of("d/m.py", "python", PYTHON)
    keys = [r["key"] for r in rows if r["part"] == "node"]
    assert keys == ["d/m.py:MODULE:m.py", "d/m.py:MEMBER:X", "d/m.py:TYPE_DECL:C", "d/m.py:MEMBER:C/p", "d/m.py:METHOD:C/__init__", "d/m.py:PARAM:C/__init__/self:0", "d/m.py:PARAM:C/__init__/p:1", "d/m.py:METHOD:C/go", "d/m.py:PARAM:C/go/self:0", "d/m.py:PARAM:C/go/a:1", "d/m.py:PARAM:C/go/k:2", "d/m.py:PARAM:C/go/kw:3", "d/m.py:METHOD:_hidden"]
    by = {r["key"]: r["props"] for r in rows if r["part"] == "node"}
    assert by["d/m.py:TYPE_DECL:C"]["docstring_head"] == "Says hello."
    assert by["d/m.py:METHOD:C/go"]["signature"] == "go(self, a, k, kw) -> int" and by["d/m.py:METHOD:C/go"]["async"] == "true"
    assert by["d/m.py:METHOD:_hidden"]["exported"] == "false"
    assert [r["label"] for r in extract.rows_of("x.py", "python", "def (") if r["part"] == "node"] == ["MODULE", "UNKNOWN"]
    broken = "a = [\n1,\n]\n@deco\ndef skipped():\n    pass\nclass C:\n    def m(self): pass\ndef bad(:\n    pass\nasync def good(): pass\n"
    assert [r["key"] for r in extract.rows_of("x.py", "python", broken) if r["part"] == "node"] == ["x.py:MODULE:x.py", "x.py:UNKNOWN:x.py", "x.py:MEMBER:a", "x.py:TYPE_DECL:C", "x.py:METHOD:C/m", "x.py:PARAM:C/m/self:0", "x.py:METHOD:good"]
    assert [r["props"]["range"] for r in extract.rows_of("x.py", "python", broken) if r.get("label") == "METHOD"][1] == "11:0-11:22"


def test_typescript_declarations():
    text = "export const a = 1;\nconst f = (x) => { return 2 };\nabstract class Z {}\nexport class K { private n = 1; static async go(a: string, b?: number): Promise<void> { if (a) {} } get v(): number { return 1 } }\nexport default function d() {}\nfunction* g(s = 'x, y') {}\ninterface I { a: number }\n"
    rows = extract.rows_of("k.ts", "typescript", text)
    got = {(r["label"], r["key"].split(":")[2]) for r in rows if r["part"] == "node"}
    assert got == {("MODULE", "k.ts"), ("MEMBER", "a"), ("MEMBER", "f"), ("TYPE_DECL", "K"), ("MEMBER", "K/n"), ("METHOD", "K/go"), ("PARAM", "K/go/a"), ("PARAM", "K/go/b"), ("METHOD", "K/v"), ("METHOD", "g"), ("PARAM", "g/s")}


def test_workspace(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "src/b.ts": "class B {}", "node_modules/c.js": "", "README.md": "hi", "src/.hidden.py": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = workspace.walk(str(tmp_path))
    assert [p for p, _ in found.files] == ["README.md", "a.py", "src/.hidden.py", "src/b.ts"]
    assert found.counts["directoriesSkipped"] == 1 and found.counts["filesUnsupported"] == 1
    got = {r["path"]: r for r in workspace.load(spark, str(tmp_path), found).collect()}
    assert got["a.py"]["loc"] == 2 and got["README.md"]["language"] == "none" and got["src/b.ts"]["parent"] == "src" and got["src/.hidden.py"]["loc"] == 0
    (tmp_path / "src/c.js").write_text("class C {}\nfunction f() {}\n")
    store = write.Store(spark, f"file://{tmp_path}/out", "g")
    store.bootstrap()
    counts = []
    for _ in range(2):  # indexing again changes nothing
        told = workspace.index_workspace(spark, str(tmp_path), store)
        n, e = store.read()
        counts.append((sorted(map(tuple, n.groupBy("label").count().collect())), e.count(), n.select("label", "key").distinct().count()))
    assert told["files"] == 5 and counts[0] == counts[1] and sum(c for _, c in counts[0][0]) == counts[0][2]
    assert [(w["kind"], w["language"], w["files"]) for w in told["warnings"]] == [("unsupported language", "javascript", 1)]
    assert {r["label"] for r in n.where("file = 'src/c.js'").collect()} == {"MODULE"}
    (tmp_path / "src/b.ts").write_text("class B { go() {} }")
    workspace.index_workspace(spark, str(tmp_path), store)
    assert store.read()[0].where("label = 'METHOD'").count() == 1


def test_scopes_from_files_and_older_scans(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"include": ["**/*.py"], "excludeExtra": ["x/**"], "maxBytes": 5}))
    scope = workspace.scope_from(str(tmp_path / "c.json"))
    assert scope.include == ("**/*.py",) and scope.exclude[-1] == "x/**" and scope.max_bytes == 5
    (tmp_path / "d.json").write_text('{"includes": []}')
    with pytest.raises(ValueError):
        workspace.scope_from(str(tmp_path / "d.json"))
    for name in ("src/a.py", "src/.h.py", "src/node_modules/b.py", "lib/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [p for p, _ in workspace.scan_folders(str(tmp_path)).files] == ["src/a.py"]


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    store = write.open_store(spark, f"file://{tmp_path}", "g")
    rows = [node("MODULE", f"f{i}:MODULE:m", f"f{i}", name="m") for i in range(60)] + [node("SYMBOL", "s", fqn="s")]
    links = [("DEFINES", "MODULE", f"f{i}:MODULE:m", "SYMBOL", "s") for i in range(60)] + [("TARGETS", "MODULE", "f7:MODULE:m", "MODULE", "f3:MODULE:m")]
    store.save(nodes(spark, *rows), edges(spark, *links))
    before = store._manifest()
    for _ in range(2):
        store.write_delta({"MODULE": nodes(spark, node("MODULE", "f3:MODULE:new", "f3", name="new"))}, {"DEFINES": edges(spark, ("DEFINES", "MODULE", "f3:MODULE:new", "SYMBOL", "s"))}, "f3")
    after = store._manifest()
    assert sum(before["nodes"][k] != after["nodes"].get(k) for k in before["nodes"]) == 1 and sum(before["edges"][k] != after["edges"].get(k) for k in before["edges"]) <= 2
    n, e = store.read()
    assert {r["key"] for r in n.where("file = 'f3'").collect()} == {"f3:MODULE:new"} and n.count() == 61
    assert e.where("type = 'TARGETS'").isEmpty() and e.count() == 60
    store.delete_file("f3")
    assert store.read()[0].count() == 60 and store.read()[1].count() == 59
    assert store.configuration()["versions"] == [1, 2, 3, 4, 5]
    store.clear()
    assert store.read()[1].isEmpty()
    with pytest.raises(ValueError):
        write.open_store(spark, f"file://{tmp_path}", "cpg_test_x")


@pytest.mark.parametrize(("pattern", "path", "good"), [("**/a/**", "x/a/y", True), ("*.py", "d/x.py", True), ("/*.py", "d/x.py", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("**/*.ts", "x.ts", True)])
def test_globs(spark, pattern, path, good):
    assert spark.range(1).select(paths.matches(F.lit(path), (pattern,))).first()[0] is good


def test_loop_and_branch(spark):
    rows = [("m", "m", None, 0, "METHOD", None, None), ("m", "b", "m", 0, "BLOCK", None, None), ("m", "w", "b", 1, "CONTROL_STRUCTURE", "while (c)", None), ("m", "c", "w", 0, "IDENTIFIER", "c", None), ("m", "wb", "w", 1, "BLOCK", None, None), ("m", "x", "wb", 0, "CALL", None, None), ("m", "r", "b", 2, "RETURN", None, None), ("m", "dead", "b", 3, "CALL", None, None)]
    tree = spark.createDataFrame(rows, "method string, id string, parent string, ord int, label string, code string, control string")
    cfg = flow.control_flow(tree)
    got = {(r["src"], r["dst"], r["kind"]) for r in cfg.collect()}
    assert got == {("m", "w", "FALL_THROUGH"), ("w", "c", "FALL_THROUGH"), ("c", "x", "TRUE"), ("x", "w", "LOOP_BACK"), ("c", "r", "FALSE"), ("r", "m:RETURN", "FALL_THROUGH")}
    assert ("c", "x") in {(r["src"], r["dst"]) for r in flow.control_dependence(cfg).collect()}
    uses = spark.createDataFrame([("m", "w", "v", True), ("m", "x", "v", True), ("m", "r", "v", False)], "method string, id string, variable string, defines boolean")
    assert {(r["src"], r["dst"]) for r in flow.data_dependence(cfg, uses).collect()} == {("w", "r")}


def test_imports(spark):
    row = spark.createDataFrame([("from ..p.q import a, b as c",), ("import x.y, z",)], "t string").select(resolve.python_imports(F.col("t")).alias("i")).select("i.*").collect()
    assert [(r["module"], r["level"], r["names"]) for r in row] == [("p.q", 2, ["a", "b"]), ("x.y", 0, ["x.y", "z"])]
    assert spark.range(1).select(resolve.python_candidates(F.lit("a/b/m.py"), F.lit("q"), F.lit(2))).first()[0] == ["a/q.py", "a/q/__init__.py"]
    assert spark.range(1).select(resolve.typescript_candidates(F.lit("a/m.ts"), F.lit("../q"))).first()[0][1] == "q.ts"


def test_sanitizers_take_their_classes_only(spark):
    n = spark.createDataFrame([(1, "python", "os.environ.get"), (2, "python", "html.escape"), (3, "python", "c.execute"), (4, "python", "eval")], "id long, language string, name string")
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src long, dst long")
    got = taint.propagate(taint.tag(n), e).collect()
    assert {(r["source"], r["sink"], r["class"]) for r in got} == {(1, 4, "DESERIALIZATION")}


def test_circles_of_aliases(spark):
    a = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 8), (1, 2)], "src long, dst long")
    assert {(r["node"], r["root"]) for r in traverse.canonical(a).collect()} == {(9, 6), (8, 6), (7, 6), (6, 6), (1, 2)}


def test_strong_components(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    step = {}
    for x, y in pairs:
        step.setdefault(x, []).append(y)

    def reach(x):
        seen, todo = set(), list(step.get(x, []))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += step.get(y, [])
        return seen

    far = {x: reach(x) for x in range(40)}
    want = {(x, max(y for y in far[x] if x in far[y])) for x in range(40) if x in far[x]}
    got = traverse.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_communities(spark):
    import random

    rng = random.Random(2)
    pairs = [(x, y) for g in range(3) for x in range(g * 8, g * 8 + 8) for y in range(g * 8, x) if rng.random() < 0.7] + [(0, 8), (50, 51)]
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    now, before = {x: x for x in near}, None
    while True:
        new = {}
        for x, others in near.items():
            votes = {}
            for y in others:
                votes[now[y]] = votes.get(now[y], 0) + 1
            new[x] = min(votes, key=lambda c: (-votes[c], c))
        if new == now:
            break
        if new == before:
            new = {x: min(new[x], now[x]) for x in new}
            break
        before, now = now, new
    got = {r["node"]: r["community"] for r in traverse.communities(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == new


def test_dominators(spark):
    import random

    rng = random.Random(6)
    for _ in range(30):
        pairs = {(str(rng.randrange(10)), str(rng.randrange(10))) for _ in range(16)}

        def reach(without):
            seen, todo = set(), ["0"] if without != "0" else []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [b for a, b in pairs if a == x and b != without]
            return seen

        there = reach(None)
        dom = {n: {d for d in there if d != n and n not in reach(d)} for n in there}
        want = {n: next(d for d in ds if ds - {d} <= dom[d]) for n, ds in dom.items() if ds}
        assert flow._dominators(list(pairs), "0") == want


def test_long_unbounded_paths(spark):
    from graphloom import cypher
    from graphloom.graph import Edges, Graph, Nodes

    n = spark.range(20).select("id")
    g = Graph([Nodes("N", n, "id")], [Edges("E", n.where("id < 19").selectExpr("id as a", "id + 1 as b"), "N", "N", "a", "b")], "long")
    got = cypher.run(g, spark, "MATCH p = (a:N {id: 0})-[:E*]->(b:N) RETURN length(p) AS n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 20))


def test_periodic_reconcile(spark):
    import time

    kind = "path string, hash string, modified long"
    seen = []
    q = changes.reconcile_periodically(spark, lambda: spark.createDataFrame([("a", "1", 1)], kind), lambda: spark.createDataFrame([("b", "1", 1)], kind), lambda df: seen.append({tuple(r) for r in df.collect()}), heartbeat=0.5, every=3600)
    try:
        for _ in range(80):
            time.sleep(0.25)
            if seen and len(q.recentProgress) > 3:
                break
        assert seen == [{("a", "delete"), ("b", "add")}]
    finally:
        q.stop()


def test_canonical_and_cycles(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    assert {(r["node"], r["root"]) for r in traverse.canonical(a).collect()} == {(1, 3), (2, 3), (5, 6)}
    assert traverse.loops(a).count() == 0


def test_watch_and_debounce(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    event = lambda p, t, s, h: json.dumps({"workspace": "w", "path": p, "type": t, "ts": "2024-01-01T00:00:00Z", "seq": s, "hash": h})
    (folder / "1.json").write_text("\n".join([event("a", "create", 1, "x"), event("b", "create", 2, "y")]))
    run = lambda: changes.watch(changes.read_events(spark, str(folder)), f"{tmp_path}/state", f"{tmp_path}/log").awaitTermination(120)
    run()
    (folder / "2.json").write_text("\n".join([event("a", "delete", 3, None), event("c", "create", 4, "x"), event("b", "update", 5, "y")]))
    run()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {(r["batch"], r["kind"], r["path"], r["from_path"]) for r in log.collect()} == {(0, "created", "a", None), (0, "created", "b", None), (1, "moved", "c", "a")}
    q = changes.debounce(changes.read_events(spark, str(folder))).writeStream.format("memory").queryName("held").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("held").count():
                break
        assert {(r["path"], r["type"]) for r in spark.table("held").collect()} == {("a", "delete"), ("b", "update"), ("c", "create")}
    finally:
        q.stop()


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["x"])], "a int, b string, c array<string>")
    assert outputs.format_table(df).splitlines()[1].split() == ["1", '["x"]']
    assert outputs.format_table(df.where("false")) == "(0 rows)"
    outputs.graphml(nodes(spark, node("N", "a<b")), edges(spark, ("E", "N", "a<b", "N", "a<b")), f"file://{tmp_path}/g")
    text = "".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/g").collect())
    assert "a&lt;b" in text and "</graph>" in text


def test_control_flow_of_real_code(spark):
    from graphloom.sources import syntax

    text = "def f(a):\n    x = a\n    while x:\n        x = g(x)\n    if x:\n        return 1\n    return x\n"
    files = spark.createDataFrame([("m.py", "python", text), ("bad.py", "python", "def ("), ("n.ts", "typescript", "x")], "path string, language string, text string")
    tree = syntax.syntax_tree(files)
    cfg = flow.control_flow(tree.where("method is not null"))
    got = {(r["src"].split(":", 1)[1], r["dst"].split(":", 1)[1], r["kind"]) for r in cfg.collect()}
    assert ("LOCAL:4:8", "CONTROL_STRUCTURE:3:4", "LOOP_BACK") in got and ("IDENTIFIER:3:10", "LOCAL:4:8", "TRUE") in got
    assert ("RETURN:6:8", "METHOD:1:0:RETURN", "FALL_THROUGH") in got and ("IDENTIFIER:5:7", "RETURN:7:4", "FALSE") in got
    assert syntax.find_symbol(syntax.symbols(tree), "f").first()["line"] == 1
    assert syntax.tree_edges(tree).where("type = 'AST'").count() == tree.where("parent is not null").count()


def test_root_and_quality(spark):
    n, e = write.ensure_root(nodes(spark, node("DIRECTORY", "src")), edges(spark), ".", ["src", "gone"])
    assert {r["key"] for r in n.collect()} == {".", "src"} and [r["to_key"] for r in e.collect()] == ["src"]
    tree = spark.createDataFrame([("c", "m", "CONTROL_STRUCTURE", "catch (e) {}"), ("b", "c", "BLOCK", ""), ("d", "m", "CONTROL_STRUCTURE", "except E:"), ("k", "d", "CALL", "x()")], "id string, parent string, label string, code string")
    assert [r["id"] for r in taint.empty_catches(tree).collect()] == ["c"]
    calls = spark.createDataFrame([(1, "m", "Math.random"), (2, "n", "Math.random")], "id long, method string, name string")
    assert [r["id"] for r in taint.insecure_randomness(calls, spark.createDataFrame([("m", "authToken")], "method string, name string")).collect()] == [1]
    writes = spark.createDataFrame([(1, "o[key]"), (2, "o[key]"), (3, "a.__proto__"), (4, "o['k']")], "id long, target string")
    assert {r["id"] for r in taint.prototype_pollution(writes, spark.createDataFrame([(1,), (4,)], "id long")).collect()} == {1, 3}
