"""Registered queries of control flow, resolution, taint and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taint as T
from ..passes import flow as L
from ..passes import resolve as R
from .star import CODE_SQL, code, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("cf1_sequential", "SELECT conv_id AS method, turn AS src, next AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return L.sequential_flow(c.select(F.col("conv_id").alias("method"), F.col("turn").alias("id"), F.col("turn").alias("ord")))


def _tree(spark, sf_dir):
    """Conversations as methods: a block of calls, in which every third turn is an if with one call below it, every fifth a return."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("m"), "conv_id").alias("method"), "turn")
    none = F.lit(None).cast("string")
    row = lambda id_, parent, order, label, text: F.struct(id_.alias("id"), parent.alias("parent"), order.cast("int").alias("ord"), F.lit(label).alias("label"), text.alias("code"), none.alias("control"))
    m, t = F.col("method"), F.col("turn")
    block, own = F.concat(m, F.lit(":B")), F.concat(m, F.lit(":"), t)
    is_if, is_return = t % 3 == 2, t % 5 == 4
    step = F.when(is_if, F.array(row(own, block, t, "CONTROL_STRUCTURE", F.lit("if (x)")), row(F.concat(own, F.lit(":b")), own, t, "BLOCK", none), row(F.concat(own, F.lit(":c")), F.concat(own, F.lit(":b")), t, "CALL", none)))
    step = step.otherwise(F.array(F.when(is_return, row(own, block, t, "RETURN", none)).otherwise(row(own, block, t, "CALL", none))))
    head = c.select("method").distinct().select("method", F.explode(F.array(row(m, none, F.lit(0), "METHOD", none), row(block, m, F.lit(0), "BLOCK", none))).alias("r"))
    return head.unionByName(c.select("method", F.explode(step).alias("r"))).select("method", "r.*")


#: the same methods in SQL: ``s`` the steps that are reached (with the step before and after), ``e`` the flow, ``v`` the calls' variables
FLOW = """WITH RECURSIVE c AS (SELECT 'm' || conv_id AS m, turn, turn % 3 = 2 AS is_if, turn % 5 = 4 AND turn % 3 <> 2 AS is_return FROM conversations),
f AS (SELECT m, min(turn) FILTER (is_return) AS stop FROM c GROUP BY 1),
s AS (SELECT c.m, turn, is_if, c.m || ':' || turn AS own, coalesce(c.m || ':' || lag(turn) OVER w, c.m) AS prev, coalesce(c.m || ':' || lead(turn) OVER w, c.m || ':RETURN') AS nxt FROM c JOIN f USING (m) WHERE stop IS NULL OR turn <= stop WINDOW w AS (PARTITION BY c.m ORDER BY turn)),
e AS (SELECT m AS method, m AS src, own AS dst, 'FALL_THROUGH' AS kind FROM s WHERE prev = m UNION ALL SELECT m, own, nxt, CASE WHEN is_if THEN 'FALSE' ELSE 'FALL_THROUGH' END FROM s
UNION ALL SELECT m, own, own || ':c', 'TRUE' FROM s WHERE is_if UNION ALL SELECT m, own || ':c', nxt, 'FALL_THROUGH' FROM s WHERE is_if),
v AS (SELECT m AS method, m || ':' || turn || CASE WHEN is_if THEN ':c' ELSE '' END AS id, 'v' || turn % 2 AS variable, turn % 4 < 2 AS defines FROM c WHERE NOT is_return),
r AS (SELECT e.method, e.dst AS step, v.id AS definition, v.variable FROM v JOIN e ON e.src = v.id WHERE v.defines
UNION SELECT r.method, e.dst, r.definition, r.variable FROM r JOIN e ON e.src = r.step LEFT JOIN v ON v.id = r.step AND v.variable = r.variable AND v.defines WHERE v.id IS NULL)"""


@query("cf1_control_flow", FLOW + " SELECT * FROM e")
def _(spark, sf_dir):
    return L.control_flow(_tree(spark, sf_dir))


@query("cf8_blocks", FLOW + """, x AS (SELECT m AS method, m || ':' || turn AS id, turn FROM c UNION ALL SELECT m, m || ':' || turn || ':c', turn FROM c WHERE is_if),
y AS (SELECT *, lag(id) OVER (PARTITION BY method ORDER BY turn, id) AS prev FROM x),
z AS (SELECT y.method, y.id, y.turn, prev IS NULL OR id IN (SELECT dst FROM e GROUP BY dst HAVING count(*) > 1 OR bool_or(kind <> 'FALL_THROUGH')) OR prev IN (SELECT src FROM e GROUP BY src HAVING count(*) > 1) AS first FROM y)
SELECT method, id, CAST(sum(first::INTEGER) OVER (PARTITION BY method ORDER BY turn, id) AS BIGINT) AS block FROM z""")
def _(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    steps = tree.where("label in ('CALL', 'RETURN', 'CONTROL_STRUCTURE')").select("method", "id", "ord")
    return L.basic_blocks(steps, L.control_flow(tree))


@query("pd4_control_dependence", FLOW + " SELECT m AS method, own AS src, own || ':c' AS dst FROM s WHERE is_if")
def _(spark, sf_dir):
    return L.control_dependence(L.control_flow(_tree(spark, sf_dir)))


@query("pd4_post_dominators", FLOW + " SELECT m AS method, nxt AS src, own AS dst FROM s UNION ALL SELECT m, nxt, own || ':c' FROM s WHERE is_if UNION ALL SELECT m, own, m FROM s WHERE prev = m")
def _(spark, sf_dir):
    return L.dominators(L.control_flow(_tree(spark, sf_dir)), post=True)


@query("pd5_dominators", FLOW + " SELECT m AS method, prev AS src, own AS dst FROM s UNION ALL SELECT m, own, own || ':c' FROM s WHERE is_if UNION ALL SELECT m, own, nxt FROM s WHERE nxt = m || ':RETURN'")
def _(spark, sf_dir):
    return L.dominators(L.control_flow(_tree(spark, sf_dir)))


def _variables(tree):
    return tree.where("label = 'CALL'").select("method", "id", F.concat(F.lit("v"), F.col("ord") % 2).alias("variable"), (F.col("ord") % 4 < 2).alias("defines"))


@query("pd3_data_dependence", FLOW + " SELECT r.method, r.definition AS src, r.step AS dst, r.variable FROM r JOIN v ON v.id = r.step AND v.variable = r.variable AND NOT v.defines")
def _(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return L.data_dependence(L.control_flow(tree), _variables(tree))


@query("st3_reaching_sets", FLOW + " SELECT method, step, definition, variable FROM r")
def _(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return L.reaching_facts(L.control_flow(tree), _variables(tree).where("defines").select("method", "id", "variable"))


@query("pd2_nested_control", "SELECT 'm' || conv_id || ':' || turn AS src, 'm' || conv_id || ':' || turn || s AS dst FROM conversations, (VALUES (':b'), (':c')) t(s) WHERE turn % 3 = 2")
def _(spark, sf_dir):
    return L.nested_control(_tree(spark, sf_dir))


@query("pd1_reaching_def", "SELECT o_orderkey AS src, l_partkey AS dst, 'v' || l_linenumber AS variable FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 5 WHERE l_returnflag <> 'R'")
def _(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    d = o.select(F.col("o_orderkey").alias("method"), F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey") % 5).alias("name"))
    u = line.select(F.col("l_orderkey").alias("method"), F.col("l_partkey").alias("id"), F.concat(F.lit("v"), "l_linenumber").alias("name"), F.when(F.col("l_returnflag") == "R", "LOCAL").otherwise("BLOCK").alias("parent_label"))
    return L.reaching_definitions(d, u)


def _modules(spark, sf_dir):
    """Nations are packages with a module for each of their customers; each module imports one of its package and one of the root."""
    c = table(spark, sf_dir, "customer")
    files = c.select(F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".py")).alias("path"))
    texts = F.array(F.concat(F.lit("from .c"), F.col("c_custkey") + 25, F.lit(" import a, b as x")), F.concat(F.lit("import n"), "c_nationkey", F.lit(".c"), "c_custkey", F.lit(" as y")))
    rows = c.select("c_custkey", F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".py")).alias("file"), F.posexplode(texts).alias("k", "text"))
    parsed = rows.withColumn("i", R.python_imports(F.col("text"))).select((F.col("c_custkey") * 2 + F.col("k")).alias("id"), "file", "i.module", "i.level", "i.names")
    return files, parsed.withColumn("candidates", R.python_candidates(F.col("file"), F.col("module"), F.col("level")))


@query("fn20_python_imports", "SELECT c_custkey * 2 AS id, 'c' || (c_custkey + 25) AS module, CAST(1 AS INTEGER) AS level, 'a,b' AS names FROM customer UNION ALL SELECT c_custkey * 2 + 1, 'n' || c_nationkey || '.c' || c_custkey, 0, 'n' || c_nationkey || '.c' || c_custkey FROM customer")
def _(spark, sf_dir):
    return _modules(spark, sf_dir)[1].select("id", "module", "level", F.array_join("names", ",").alias("names"))


@query("fn21_typescript_imports", "SELECT n_nationkey AS id, './m' || n_nationkey AS module, 'a,c,d' AS names FROM nation")
def _(spark, sf_dir):
    text = F.concat(F.lit("import d, { a, b as c } from './m"), "n_nationkey", F.lit("';"))
    i = R.typescript_imports(text)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), i["module"].alias("module"), F.array_join(i["names"], ",").alias("names"))


@query("rs1_imports", "SELECT a.c_custkey * 2 AS id, 'n' || b.c_nationkey || '/c' || b.c_custkey || '.py' AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 AND b.c_nationkey = a.c_nationkey UNION ALL SELECT c_custkey * 2 + 1, 'n' || c_nationkey || '/c' || c_custkey || '.py' FROM customer")
@query("jn13_candidates", "SELECT a.c_custkey * 2 AS id, 'n' || b.c_nationkey || '/c' || b.c_custkey || '.py' AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 AND b.c_nationkey = a.c_nationkey UNION ALL SELECT c_custkey * 2 + 1, 'n' || c_nationkey || '/c' || c_custkey || '.py' FROM customer")
def _(spark, sf_dir):
    files, imports = _modules(spark, sf_dir)
    return R.resolve_imports(imports, files).select("id", "target")


@query("jn14_stem_fallback", "SELECT a.c_custkey * 2 AS id, 'n' || b.c_nationkey || '/c' || b.c_custkey || '.py' AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 UNION ALL SELECT c_custkey * 2 + 1, 'n' || c_nationkey || '/c' || c_custkey || '.py' FROM customer")
def _(spark, sf_dir):
    files, imports = _modules(spark, sf_dir)
    return R.resolve_imports(imports, files, stem_fallback=True).select("id", "target")


@query("rs5_calls", "SELECT l_orderkey * 10 + l_linenumber AS id, min(CASE WHEN l_returnflag = 'A' THEN 'def' || l_suppkey ELSE 'own' || l_orderkey END) AS definition FROM lineitem WHERE l_returnflag <> 'N' AND NOT (l_returnflag = 'R' AND l_orderkey % 2 = 1) GROUP BY 1 HAVING count(*) >= 1")
def _(spark, sf_dir):
    # one call for each order line: returned ones call a supplier's function by its module, others one of the own file
    line = table(spark, sf_dir, "lineitem")
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("s"), "l_suppkey", F.lit(".run"))).when(F.col("l_returnflag") == "R", F.lit("own")).otherwise(F.lit("none")).alias("callee"))
    imports = line.select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.concat(F.lit("s"), "l_suppkey").alias("alias"), F.concat(F.lit("sup"), "l_suppkey").alias("target")).distinct()
    definitions = table(spark, sf_dir, "supplier").select(F.concat(F.lit("sup"), "s_suppkey").alias("file"), F.lit("run").alias("name"), F.concat(F.lit("def"), "s_suppkey").alias("definition"))
    own = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("file"), F.lit("own").alias("name"), F.concat(F.lit("own"), "o_orderkey").alias("definition"))
    found = R.resolve_calls(calls, imports, definitions.unionByName(own))
    return found.groupBy("id").agg(F.min("definition").alias("definition"))


def _units(spark, sf_dir):
    """The cyclic graph's nodes with names by which the rules tag them."""
    i = F.col("s_suppkey")
    name = F.when(i % 10 == 3, "os.environ.get").when(i % 10 == 8, "cursor.execute").when(i % 10 == 5, "html.escape").when(i % 10 == 2, "eval").otherwise("f")
    return table(spark, sf_dir, "supplier").select(i.alias("id"), F.lit("python").alias("language"), name.alias("name"), F.concat(F.lit("c"), i).alias("code"), i.alias("line"), F.col("s_nationkey").alias("method"))


@query("tq1_tags", "SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 3 THEN 'os-environ' WHEN 8 THEN 'sqlite-execute' WHEN 5 THEN 'sql-param' ELSE 'eval' END AS rule FROM supplier WHERE s_suppkey % 10 IN (2, 3, 5, 8)")
def _(spark, sf_dir):
    return T.tag(_units(spark, sf_dir)).select("id", F.explode("tags").alias("t")).select("id", F.col("t.rule").alias("rule"))


def _flows(spark, sf_dir):
    return T.propagate(T.tag(_units(spark, sf_dir)), code(spark, sf_dir).edges[0].df.toDF("src", "dst"))


#: of all simple paths from sources to sinks the shortest, then least; a sanitizer (5) takes one of the classes
FLOWS = CODE_SQL + """, t(source, here, live, path) AS (SELECT id, id, true, [id] FROM u WHERE id % 10 = 3 UNION ALL SELECT t.source, e.b, t.live AND e.b % 10 <> 5, list_append(t.path, e.b) FROM t JOIN e ON e.a = t.here WHERE NOT list_contains(t.path, e.b) AND len(t.path) <= 20),
w AS (SELECT source, here AS sink, CASE here % 10 WHEN 8 THEN 'SQL_INJECTION' ELSE 'DESERIALIZATION' END AS class, arg_min(path, (len(path), path)) AS path FROM t WHERE here % 10 = 2 OR (here % 10 = 8 AND live) GROUP BY 1, 2, 3)"""


@query("tq2_taint", FLOWS + " SELECT source, sink, class, array_to_string(path, '>') AS path FROM w")
def _(spark, sf_dir):
    return _flows(spark, sf_dir).select("source", "sink", "class", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("tq3_backward_slice", CODE_SQL + ", t(x) AS (SELECT id FROM u WHERE id % 10 IN (2, 8) UNION SELECT e.a FROM t JOIN e ON e.b = t.x) SELECT x AS node FROM t")
def _(spark, sf_dir):
    return T.slice_from_sinks(T.tag(_units(spark, sf_dir)), code(spark, sf_dir).edges[0].df.toDF("src", "dst"), hops=200)


@query("jn17_enclosing_scope", "SELECT 'o' || o_orderkey AS id, 'n' || c_nationkey AS scope FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer")
def _(spark, sf_dir):
    from ..sources.syntax import enclosing

    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.lit("CALL").alias("label"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit("BLOCK").alias("label"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), none.alias("parent"), F.lit("METHOD").alias("label"))
    return enclosing(o.unionByName(c).unionByName(n), "METHOD")


@query("ex6_syntax_tree", "SELECT label, sum(n)::BIGINT AS n FROM (SELECT count(*) AS c FROM part), LATERAL (VALUES ('METHOD', 3 * c), ('METHOD_PARAMETER_IN', 4 * c), ('TYPE_DECL', c), ('BLOCK', 3 * c), ('LOCAL', 2 * c), ('RETURN', 2 * c), ('LITERAL', 2 * c), ('IDENTIFIER', 4 * c)) t(label, n) GROUP BY 1")
def _(spark, sf_dir):
    from ..sources.syntax import syntax_tree
    from .workspace import _sources

    return syntax_tree(_sources(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query("tq13_findings", FLOWS + " SELECT source, sink, class, 'c' || source AS source_code, 'c' || sink AS sink_code, CAST(len(path) - 1 AS INTEGER) AS hops, u.n AS method FROM w JOIN u ON u.id = sink")
def _(spark, sf_dir):
    found = T.findings(_flows(spark, sf_dir), _units(spark, sf_dir).select("id", "code", "line", "method"))
    return found.select("source", "sink", "class", "source_code", "sink_code", "hops", "method")


@query("tq15_records", FLOWS + " SELECT source, sink, class, 'c' || array_to_string(path, ',c') AS flow FROM w")
def _(spark, sf_dir):
    found = T.findings(_flows(spark, sf_dir), _units(spark, sf_dir).select("id", "code", "line", "method"))
    return found.select("source", "sink", "class", F.array_join(F.transform("flow", lambda s: s["code"]), ",").alias("flow"))


@query("tq14_flow_edges", FLOWS + ", h AS (SELECT path, unnest(range(1, len(path))) AS i FROM w) SELECT DISTINCT path[i] AS src, path[i + 1] AS dst, CAST(i AS INTEGER) AS hop FROM h")
def _(spark, sf_dir):
    return T.flow_edges(_flows(spark, sf_dir))


@query("ag11_dashboard", "SELECT CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'kept' END AS rule, CASE l_linestatus WHEN 'F' THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS findings, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept").alias("rule"), F.when(F.col("l_linestatus") == "F", "HIGH").otherwise("LOW").alias("severity"), F.col("l_orderkey").alias("file"))
    return T.dashboard(rows)


@query("tq4_dead_methods", "SELECT p_partkey AS id FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1)")
def _(spark, sf_dir):
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") <= 25).alias("exported"))
    calls = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1").select(F.col("l_partkey").alias("dst"))
    return T.dead_methods(methods, calls).select("id")


@query("tq5_complexity", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def _(spark, sf_dir):
    return T.over(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", 10)


@query("tq6_parameters", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def _(spark, sf_dir):
    return T.over(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id", 5)


@query("tq7_nesting", "SELECT 'm' || conv_id AS method, CAST(max(turn) AS INTEGER) AS depth FROM conversations GROUP BY 1 HAVING max(turn) > 4")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("m"), "conv_id").alias("m"), "turn").distinct()
    inner = c.where("turn > 0").select(F.concat("m", F.lit(":"), "turn").alias("id"), F.when(F.col("turn") == 1, F.col("m")).otherwise(F.concat("m", F.lit(":"), F.col("turn") - 1)).alias("parent"), F.lit("CONTROL_STRUCTURE").alias("label"))
    heads = c.select("m").distinct().select(F.col("m").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("METHOD").alias("label"))
    return T.deep_nesting(heads.unionByName(inner), 4)


@query("tq8_secrets", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND length(c_name) >= 8")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return T.hard_coded_secrets(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "db_Password").otherwise("name").alias("name"), F.concat(F.lit("'"), "c_name", F.lit("'")).alias("value"))).select("id")


@query("tq12_erased_types", "SELECT p_partkey AS id FROM part WHERE p_size % 4 = 0")
def _(spark, sf_dir):
    return T.erased_types(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "any[]").otherwise("anything").alias("type_text"))).select("id")
