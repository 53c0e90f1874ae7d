"""Taint analysis and quality detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import checkpointed

# Rules as (language, id, role, class, pattern, severity).
RULES = (
    ("typescript", "http-req-query", "source", "", r"^(req|request)\.(query|params|body|headers)", ""),
    ("typescript", "process-env", "source", "", r"^process\.env\.", ""),
    ("typescript", "sql-query", "sink", "SQL_INJECTION", r"\.(query|execute|run)\s*\(", "CRITICAL"),
    ("typescript", "child-process-exec", "sink", "COMMAND_INJECTION", r"^(child_process\.)?(exec|execSync|spawn|spawnSync)", "CRITICAL"),
    ("typescript", "fs-read", "sink", "PATH_TRAVERSAL", r"^fs\.(readFile|readFileSync|createReadStream)", "HIGH"),
    ("typescript", "res-send-html", "sink", "XSS", r"^(res|response)\.(send|write|end)", "HIGH"),
    ("typescript", "sql-escape", "sanitizer", "SQL_INJECTION", r"\.(escape|escapeString|parameterize)", ""),
    ("typescript", "html-encode", "sanitizer", "XSS", r"(escapeHtml|sanitize|DOMPurify\.sanitize|encodeURIComponent)", ""),
    ("typescript", "path-resolve", "sanitizer", "PATH_TRAVERSAL", r"^path\.(resolve|normalize)", ""),
    ("python", "flask-request", "source", "", r"^(request\.(args|form|json|data|files|headers))", ""),
    ("python", "django-request", "source", "", r"^(request\.GET|request\.POST|request\.body)", ""),
    ("python", "os-environ", "source", "", r"^os\.environ", ""),
    ("python", "sqlite-execute", "sink", "SQL_INJECTION", r"\.(execute|executemany|executescript)", "CRITICAL"),
    ("python", "subprocess-call", "sink", "COMMAND_INJECTION", r"^subprocess\.(call|run|Popen|check_output)", "CRITICAL"),
    ("python", "eval", "sink", "DESERIALIZATION", r"^(eval|exec|compile)$", "HIGH"),
    ("python", "pickle-loads", "sink", "DESERIALIZATION", r"^(pickle|cPickle)\.(loads|load)$", "HIGH"),
    ("python", "open-path", "sink", "PATH_TRAVERSAL", r"^(open|pathlib\.Path)$", "HIGH"),
    ("python", "requests-get", "sink", "SSRF", r"^requests\.(get|post|put|patch|delete|request)$", "HIGH"),
    ("python", "flask-render", "sink", "XSS", r"^(render_template_string|Markup)$", "HIGH"),
    ("python", "sql-param", "sanitizer", "SQL_INJECTION", r"^(re\.escape|html\.escape|bleach\.clean)", ""),
    ("python", "shlex-quote", "sanitizer", "COMMAND_INJECTION", r"^shlex\.quote$", ""),
)
CLASSES = ("SQL_INJECTION", "COMMAND_INJECTION", "PATH_TRAVERSAL", "XSS", "DESERIALIZATION", "SSRF")


def tag(nodes: DataFrame, rules=RULES, language: str = "language", name: str = "name") -> DataFrame:
    """``nodes`` with ``tags``, an array of (rule, role, class, severity): one pass, the patterns are literals of the plan."""
    found = [F.when((F.col(language) == lang) & F.col(name).rlike(pattern), F.array(F.struct(F.lit(i).alias("rule"), F.lit(role).alias("role"), F.lit(kind).alias("class"), F.lit(severity).alias("severity")))) for lang, i, role, kind, pattern, severity in rules]
    empty = F.array().cast("array<struct<rule:string,role:string,class:string,severity:string>>")
    return nodes.withColumn("tags", F.concat(*[F.coalesce(x, empty) for x in found]))


def has_role(role: str) -> Column:
    return F.exists("tags", lambda t: t["role"] == role)


def classes_of(role: str) -> Column:
    return F.transform(F.filter("tags", lambda t: t["role"] == role), lambda t: t["class"])


def propagate(tagged: DataFrame, edges: DataFrame, hops: int = 20) -> DataFrame:
    """``source, sink, class, path``: flows from sources to sinks along ``edges`` (``src, dst``) within ``hops``.

    A sanitizer on the way takes the classes that it covers; a flow ends when none is left.  No node
    occurs twice in a path; of several paths the shortest, then least, is told.
    """
    roles = checkpointed(tagged.select("id", has_role("source").alias("is_source"), classes_of("sink").alias("sinks"), classes_of("sanitizer").alias("cleans")))
    step = edges.select("src", "dst").distinct()
    all_ = F.array(*[F.lit(c) for c in CLASSES])
    now = roles.where("is_source").select(F.col("id").alias("source"), F.col("id").alias("at"), all_.alias("live"), F.array("id").alias("path"))
    found = []
    for _ in range(hops):
        nxt = now.join(step, now["at"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).drop("at", "src").join(roles, F.col("dst") == roles["id"])
        nxt = nxt.select("source", F.col("dst").alias("at"), F.array_except("live", "cleans").alias("live"), F.concat("path", F.array("dst")).alias("path"), "sinks").where(F.size("live") > 0)
        # of the ways to one node with the same live classes one is enough
        nxt = nxt.groupBy("source", "at", F.sort_array("live").alias("live")).agg(F.min("path").alias("path"), F.first("sinks").alias("sinks"))
        nxt = checkpointed(nxt)
        if nxt.isEmpty():
            break
        found.append(nxt.select("source", F.col("at").alias("sink"), F.explode(F.array_intersect("live", "sinks")).alias("class"), "path"))
        now = nxt.drop("sinks")
    if not found:
        return now.select("source", F.col("at").alias("sink"), F.lit("").alias("class"), "path").limit(0)
    return reduce(DataFrame.unionByName, found).groupBy("source", "sink", "class").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))


def slice_from_sinks(tagged: DataFrame, edges: DataFrame, hops: int = 20) -> DataFrame:
    """``node``: what leads to a sink within ``hops``, the sinks included."""
    from .traverse import reachable, reverse

    sinks = tagged.where(has_role("sink")).select(F.col("id").alias("node"))
    return reachable(sinks, reverse(edges.select("src", "dst")), hops).unionByName(sinks).distinct()


def findings(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One nested record for each flow: class, summaries of both ends, ordered steps (``nodes``: ``id, code, line, method``)."""
    steps = flows.select("source", "sink", "class", F.posexplode("path").alias("ord", "id")).join(nodes, "id", "left")
    flow = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "code", "line"))), lambda s: F.struct(s["id"].alias("id"), s["code"].alias("code"), s["line"].alias("line")))
    made = steps.groupBy("source", "sink", "class").agg(flow.alias("flow"), F.max_by("method", "ord").alias("method"))
    return made.withColumns({"source_code": F.element_at("flow", 1)["code"], "sink_code": F.element_at("flow", -1)["code"], "hops": F.size("flow") - 1})


def flow_edges(flows: DataFrame) -> DataFrame:
    """``src, dst, hop``: the steps of the flows as edges."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst"), i.alias("hop")))
    return flows.select(F.explode(pairs).alias("e")).select("e.*").distinct()


def dashboard(found: DataFrame) -> DataFrame:
    """Count and files by rule and severity, the worst first."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files")).orderBy(rank, F.desc("findings"), "rule")


# Quality


def dead_methods(methods: DataFrame, calls: DataFrame, entry_names: tuple[str, ...] = ("main", "__init__", "constructor")) -> DataFrame:
    """Methods (``id, name, exported``) without a call into them that are neither entries nor exported."""
    return methods.where(~F.col("name").isin(*entry_names) & ~F.col("exported")).join(calls.select(F.col("dst").alias("id")), "id", "left_anti")


def over(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``key, n`` of the keys with more than ``most`` rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def deep_nesting(tree: DataFrame, most: int = 6) -> DataFrame:
    """``method, depth``: methods whose control structures nest deeper than ``most`` (``id, parent, label``)."""
    kept = tree.where(F.col("label").isin("METHOD", "CONTROL_STRUCTURE", "BLOCK")).select("id", "parent", "label")
    now = kept.where("label = 'METHOD'").select(F.col("id").alias("method"), "id", F.lit(0).alias("depth"))
    deepest = None
    while True:
        below = kept.where("label <> 'METHOD'").select(F.col("id").alias("child"), "parent", "label")
        now = checkpointed(now.join(below, now["id"] == below["parent"]).select("method", F.col("child").alias("id"), (F.col("depth") + (F.col("label") == "CONTROL_STRUCTURE").cast("int")).alias("depth")))
        if now.isEmpty():
            break
        deepest = now if deepest is None else deepest.unionByName(now)
    return (now if deepest is None else deepest).groupBy("method").agg(F.max("depth").alias("depth")).where(F.col("depth") > most)


SECRET_NAME = r"(?i).*(password|passwd|secret|token|api_?key|private_?key).*"


def hard_coded_secrets(assignments: DataFrame, least: int = 8) -> DataFrame:
    """Assignments (``id, name, value``) of a literal text to a name that sounds secret."""
    return assignments.where(F.col("name").rlike(SECRET_NAME) & F.col("value").rlike("^['\"].{%d,}['\"]$" % least))


def insecure_randomness(calls: DataFrame, contexts: DataFrame) -> DataFrame:
    """Calls (``id, method, name``) of weak generators in methods (``method, name``) that sound secret."""
    weak = calls.where(F.col("name").rlike(r"^(?:Math\.random|random\.(?:random|randint|choice))$"))
    return weak.join(contexts.where(F.col("name").rlike(SECRET_NAME)).select("method"), "method", "left_semi")


def prototype_pollution(assignments: DataFrame, tainted: DataFrame) -> DataFrame:
    """Assignments (``id, target``) by a computed key that taint reaches, or to a prototype."""
    named = F.col("target").rlike(r"(?:__proto__|\.prototype\b|\.constructor\b)")
    computed = assignments.where(F.col("target").rlike(r"\[[^'\"\d\]][^\]]*\]")).join(tainted.select("id"), "id", "left_semi")
    return assignments.where(named).unionByName(computed).distinct()


def empty_catches(tree: DataFrame) -> DataFrame:
    """Catch blocks without a step below them (``id, parent, label, code``)."""
    catches = tree.where(F.col("code").rlike(r"^\s*(?:catch|except)"))
    real = tree.where("label not in ('BLOCK', 'COMMENT', 'METHOD_PARAMETER_IN')").select(F.col("parent").alias("id"))
    inner = tree.where("label = 'BLOCK'").select(F.col("id").alias("block"), F.col("parent").alias("id")).join(real.withColumnRenamed("id", "block"), "block", "left_semi").select("id")
    return catches.join(real.unionByName(inner), "id", "left_anti")


def erased_types(members: DataFrame) -> DataFrame:
    """Members and parameters (``id, type_text``) of type any."""
    return members.where(F.col("type_text").rlike(r"^(?:any|Any|typing\.Any)(?:\[\])?$"))
