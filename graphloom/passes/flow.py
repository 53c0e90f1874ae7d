"""Control flow of methods, and what follows from it: dominators, control dependence, reaching definitions.

The syntax tree of a method is nested, so its control flow is built by one function for each method
(over batches of nodes sorted by method); everything after that is relational or runs in the same way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: labels that are steps of their own; the others are passed through
STEPS = {"CALL", "RETURN", "CONTROL_STRUCTURE", "IDENTIFIER", "LITERAL", "BLOCK", "LOCAL"}
RETURN_ORDER = 9999
CFG = "method string, src string, dst string, kind string"


def control_kind(code: str, given: str | None) -> str:
    """The kind of a control structure: as given, or by how its text begins."""
    text = (given or code or "").strip().lower()
    for kind, starts in (("if", ("if", "elif")), ("do", ("do",)), ("loop", ("while", "for")), ("switch", ("switch", "match")), ("try", ("try",))):
        if text.startswith(starts):
            return kind
    return "other"


def method_flow(method: str, nodes: dict[str, dict], children: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """``src, dst, kind`` of the control flow of one method, from its start to its return node."""
    out: list[tuple[str, str, str]] = []
    end = f"{method}:RETURN"

    def link(sources: list[tuple[str, str]], to: str) -> None:
        out.extend((a, to, kind) for a, kind in sources)

    def follow(ids: list[str], sources: list[tuple[str, str]]) -> list[tuple[str, str]]:
        for i in ids:
            sources = step(i, sources)
        return sources

    def step(i: str, sources: list[tuple[str, str]]) -> list[tuple[str, str]]:
        label, below = nodes[i]["label"], children.get(i, [])
        if label == "METHOD_PARAMETER_IN" or not sources:  # nothing leads to what follows a return
            return sources
        if label == "BLOCK":
            return follow(below, sources)
        if label == "RETURN":
            link(sources, i)
            out.append((i, end, "FALL_THROUGH"))
            return []
        if label == "CONTROL_STRUCTURE":
            return control(i, below, sources)
        if label in STEPS:
            link(sources, i)
            return [(i, "FALL_THROUGH")]
        return follow(below, sources)

    def control(i: str, below: list[str], sources: list[tuple[str, str]]) -> list[tuple[str, str]]:
        kind = control_kind(nodes[i].get("code") or "", nodes[i].get("control"))
        link(sources, i)
        here = [(i, "FALL_THROUGH")]
        tests = [b for b in below if nodes[b]["label"] not in ("BLOCK", "CONTROL_STRUCTURE", "RETURN")]
        bodies = [b for b in below if b not in tests]
        if kind == "if":
            last = follow(tests, here)
            exits = []
            for k, b in enumerate(bodies):
                exits += step(b, [(a, "TRUE" if not k else "FALSE") for a, _ in last])
            return exits + ([(a, "FALSE") for a, _ in last] if len(bodies) < 2 else [])
        if kind == "loop":
            last = follow(tests, here)
            link([(a, "LOOP_BACK") for a, _ in follow(bodies, [(a, "TRUE") for a, _ in last])], i)
            return [(a, "FALSE") for a, _ in last]
        if kind == "do":
            last = follow(tests, follow(bodies, here))
            link([(a, "LOOP_BACK") for a, _ in last], i)
            return [(a, "FALSE") for a, _ in last]
        if kind == "switch":
            exits, default = [], False
            for b in below:
                default |= (nodes[b].get("code") or "").strip().lower().startswith(("default", "case _"))
                exits += step(b, [(i, "CASE")])
            return exits if default else exits + here
        if kind == "try":
            return [x for b in below for x in step(b, here)] or here
        return follow(below, here)

    top = children.get(method, [])
    block = next((c for c in top if nodes[c]["label"] == "BLOCK"), None)
    body = children.get(block, []) if block else [c for c in top if nodes[c]["label"] != "METHOD_PARAMETER_IN"]
    link(follow(body, [(method, "FALL_THROUGH")]), end)
    return out


def _by_method(df: DataFrame, compute: Callable[[str, list[dict]], list[tuple]], kind: str) -> DataFrame:
    """``compute(method, rows)`` for each method; a batch holds many methods, of which one at a time is in memory as rows."""
    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.string()] * len(names)

    def table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        method, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["method"] != method:
                    if held:
                        out += [(method, *x) for x in compute(method, held)]
                    method, held = row["method"], []
                held.append(row)
            yield table(out)
        if held:
            yield table([(method, *x) for x in compute(method, held)])

    return df.where("method is not null").repartition("method").sortWithinPartitions("method").mapInArrow(run, kind)


def control_flow(tree: DataFrame) -> DataFrame:
    """``method, src, dst, kind`` of ``method, id, parent, ord, label, code, control`` (a method's nodes, itself included)."""
    def compute(method: str, rows: list[dict]):
        nodes = {r["id"]: r for r in rows}
        below = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r["ord"] is None, r["ord"], r["id"])):
            if r["parent"] in nodes and r["id"] != method:
                below[r["parent"]].append(r["id"])
        return method_flow(method, nodes, below)

    return _by_method(tree.select("method", "id", "parent", "ord", "label", F.substring("code", 1, 64).alias("code"), "control"), compute, CFG)


def sequential_flow(steps: DataFrame) -> DataFrame:
    """The control flow of straight-line bodies, relationally: ``method, src, dst`` of ``method, id, ord``."""
    w = Window.partitionBy("method").orderBy("ord", "id")
    return steps.select("method", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")


def basic_blocks(steps: DataFrame, flow: DataFrame) -> DataFrame:
    """``method, id, block``: blocks begin at the first step, at targets of jumps and joins, and after branches.

    ``steps``: ``method, id, ord``; ``flow``: ``method, src, dst, kind``.
    """
    joins = flow.groupBy("method", F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max((F.col("kind") != "FALL_THROUGH").cast("int")).alias("jump")).where("n > 1 or jump = 1").select("method", "id")
    after = flow.groupBy("method", "src").agg(F.count("*").alias("n")).where("n > 1").select("method", F.col("src").alias("prev"), F.lit(1).alias("branch"))
    w = Window.partitionBy("method").orderBy("ord", "id")
    s = steps.withColumn("prev", F.lag("id").over(w)).join(joins.withColumn("lead", F.lit(1)), ["method", "id"], "left").join(after, ["method", "prev"], "left")
    first = F.col("prev").isNull() | F.col("lead").isNotNull() | F.col("branch").isNotNull()
    return s.withColumn("first", first.cast("int")).withColumn("block", F.sum("first").over(w)).select("method", "id", "block")


def _dominators(edges: list[tuple[str, str]], root: str) -> dict[str, str]:
    """The immediate dominator of each node that the root leads to (but the root), by intersecting paths up the tree in reverse postorder."""
    after, before = defaultdict(list), defaultdict(list)
    for a, b in sorted(edges):
        after[a].append(b)
        before[b].append(a)
    order, seen, todo = [], {root}, [(root, iter(after[root]))]
    while todo:
        n, rest = todo[-1]
        if (m := next((x for x in rest if x not in seen), None)) is None:
            order.append(n)
            todo.pop()
        else:
            seen.add(m)
            todo.append((m, iter(after[m])))
    at = {n: i for i, n in enumerate(order)}
    up = {root: root}
    moved = True
    while moved:
        moved = False
        for n in reversed(order[:-1]):
            new = None
            for p in before[n]:
                if p in up:
                    x, y = p, new
                    while y is not None and x != y:
                        if at[x] < at[y]:
                            x = up[x]
                        else:
                            y = up[y]
                    new = x
            if up.get(n) != new:
                up[n], moved = new, True
    del up[root]
    return up


def dominators(flow: DataFrame, post: bool = False) -> DataFrame:
    """``method, src, dst``: ``src`` is the immediate (post-)dominator of ``dst``; the whole relation is what these edges lead to."""
    def compute(method: str, rows: list[dict]):
        edges = [(r["dst"], r["src"]) if post else (r["src"], r["dst"]) for r in rows]
        return [(d, n) for n, d in sorted(_dominators(edges, f"{method}:RETURN" if post else method).items())]

    return _by_method(flow.select("method", "src", "dst"), compute, "method string, src string, dst string")


def control_dependence(flow: DataFrame) -> DataFrame:
    """``method, src, dst``: ``dst`` runs depending on the branch taken at ``src``: what lies on the post-dominator tree between a branch's target and the branch."""
    def compute(method: str, rows: list[dict]):
        edges = [(r["src"], r["dst"]) for r in rows]
        up = _dominators([(b, a) for a, b in edges], f"{method}:RETURN")
        out = set()
        for a, b in edges:
            while b is not None and b != up.get(a):
                out.add((a, b))
                b = up.get(b)
        return sorted(out)

    return _by_method(flow.select("method", "src", "dst"), compute, "method string, src string, dst string")


def reaching_facts(flow: DataFrame, definitions: DataFrame) -> DataFrame:
    """``method, step, definition, variable``: the definitions that hold before each step, by set algebra: what the steps before hold or
    generate, less what they kill.  Each round takes only new facts further.

    ``definitions``: ``method, id, variable``.
    """
    from ..operators.iterate import checkpointed

    step = flow.select("method", F.col("src").alias("at"), "dst")
    keys = ["method", "at", "definition", "variable"]
    kills = definitions.select("method", F.col("id").alias("at"), "variable")
    front = definitions.select("method", F.col("id").alias("at"), F.col("id").alias("definition"), "variable").join(step, ["method", "at"])
    front = seen = checkpointed(front.select("method", F.col("dst").alias("at"), "definition", "variable").distinct())
    while not front.isEmpty():
        after = front.join(kills, ["method", "at", "variable"], "left_anti").join(step, ["method", "at"])
        front = checkpointed(after.select("method", F.col("dst").alias("at"), "definition", "variable").distinct().join(seen, keys, "left_anti"))
        seen = seen.unionByName(front)
    return seen.select("method", F.col("at").alias("step"), "definition", "variable")


def data_dependence(flow: DataFrame, uses: DataFrame) -> DataFrame:
    """``method, src, dst, variable``: a definition that reaches a use over the control flow without another one between.

    ``uses``: ``method, id, variable, defines`` (whether the step defines or uses the variable).
    """
    both = flow.select("method", "src", "dst", F.lit(None).cast("string").alias("variable"), F.lit(None).cast("boolean").alias("defines")).unionByName(uses.select("method", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "variable", "defines"))

    def compute(method: str, rows: list[dict]):
        steps, gen, used = defaultdict(set), defaultdict(set), defaultdict(set)
        for r in rows:
            if r["variable"] is None:
                steps[r["src"]].add(r["dst"])
            else:
                (gen if r["defines"] else used)[r["src"]].add(r["variable"])
        reach = defaultdict(set)  # before each step
        todo = [n for n in steps]
        while todo:
            n = todo.pop()
            after = {(d, v) for d, v in reach[n] if v not in gen[n]} | {(n, v) for v in gen[n]}
            for m in steps[n]:
                if not after <= reach[m]:
                    reach[m] |= after
                    todo.append(m)
        return sorted((d, n, v) for n, names in used.items() for d, v in reach[n] if v in names)

    return _by_method(both, compute, "method string, src string, dst string, variable string")


def reaching_definitions(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """``src, dst, variable`` without regard to order: equal names within a method.

    ``definitions``: ``method, id, name``; ``uses``: ``method, id, name, parent_label``; a use right below a LOCAL is part of its definition.
    """
    d = definitions.select("method", "name", F.col("id").alias("src"))
    u = uses.where("parent_label is null or parent_label <> 'LOCAL'").select("method", "name", F.col("id").alias("dst"))
    return d.join(u, ["method", "name"]).select("src", "dst", F.col("name").alias("variable"))


def nested_control(tree: DataFrame) -> DataFrame:
    """``src, dst``: control structures and what lies below them, through blocks, to the next control structure or method."""
    from ..operators.iterate import checkpointed

    below = tree.select(F.col("parent").alias("at"), F.col("id").alias("dst"), F.col("label").alias("dst_label")).where("parent is not null")
    front = tree.where("label = 'CONTROL_STRUCTURE'").select(F.col("id").alias("src"), F.col("id").alias("at"))
    out = None
    while True:
        step = checkpointed(front.join(below, "at").where("dst_label <> 'METHOD'").select("src", "dst", "dst_label"))
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        front = step.where("dst_label = 'BLOCK'").select("src", F.col("dst").alias("at"))
    return (step if out is None else out).select("src", "dst")
