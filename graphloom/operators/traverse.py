"""Graph traversals on plain edge tables ``src, dst`` (and ``type``, ``variable``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import checkpointed


def reachable(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node``: what one edge or more lead to from ``starts`` (``node``); the starts themselves only through a cycle."""
    step = edges.select("src", "dst")
    front, seen, hops = starts.select("node").distinct(), None, 0
    while most is None or hops < most:
        new = front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(new if seen is None else new.join(seen, "node", "left_anti"))
        hops += 1
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
    return front if seen is None else seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst`` for all pairs that a path connects."""
    step = edges.select("src", "dst").distinct()
    front = seen = checkpointed(step)
    while not front.isEmpty():
        new = front.join(step.withColumnsRenamed({"src": "mid", "dst": "end"}), F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct()
        front = checkpointed(new.join(seen, ["src", "dst"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def backward_slice(starts: DataFrame, edges: DataFrame, variable: str | None = None) -> DataFrame:
    """What the starts depend on over data and control edges, with the starts; ``variable`` limits the data edges."""
    kept = edges.where(F.col("type").isin("DDG", "CDG", "REACHING_DEF"))
    if variable is not None:
        kept = kept.where((F.col("type") == "CDG") | (F.col("variable") == variable))
    return reachable(starts, reverse(kept)).unionByName(starts.select("node")).distinct()


def forward_slice(starts: DataFrame, edges: DataFrame) -> DataFrame:
    return reachable(starts, edges.where(F.col("type").isin("DDG", "CDG", "REACHING_DEF"))).unionByName(starts.select("node")).distinct()


def impact(starts: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """``file, statements``: the files (``node, file``) that a forward slice touches."""
    return forward_slice(starts, edges).join(files, "node").groupBy("file").agg(F.count("*").alias("statements"))


def dead(nodes: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no entry reaches."""
    return nodes.select("node").join(reachable(entries, edges), "node", "left_anti").join(entries.select("node"), "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge into or out of them go, and so on."""
    now, n = checkpointed(edges), None
    while n != (n := now.count()):
        into, out = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        now = checkpointed(now.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
    return now


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's greatest label among those of the nodes that lead to it; only what changed goes on."""
    now = front = labels
    while True:
        told = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("told"))
        new = checkpointed(now.join(told, "node", "left").select("node", F.greatest("label", F.coalesce("told", "label")).alias("label"), (F.col("told") > F.col("label")).alias("moved")))
        front, now = new.where("moved").select("node", "label"), new.select("node", "label")
        if front.isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the nodes on cycles, by the greatest node of their strongly connected component.

    What leads into no cycle or comes from none is trimmed; then, by turns, each node is coloured by the greatest node that
    leads to it, and the nodes of a colour that lead back to that node are its component.  Work is linear in the
    edges for each round, and pairs of nodes are never listed.
    """
    step = edges.select("src", "dst").distinct()
    own = checkpointed(step.where("src = dst").select(F.col("src").alias("node")))
    left, found = _trimmed(step.where("src <> dst")), None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), left)
        at, to = colour.toDF("src", "colour"), colour.toDF("dst", "to_colour")
        same = checkpointed(left.join(at, "src").join(to, "dst").where("colour = to_colour").select("src", "dst"))
        roots = colour.where("node = label").select("node")
        back = reachable(roots, reverse(same)).unionByName(roots).distinct()
        part = checkpointed(back.join(colour, "node").select("node", F.col("label").alias("component")))
        found = part if found is None else found.unionByName(part)
        rest = left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = _trimmed(rest.select("src", "dst"))
    alone = own.select("node", F.col("node").alias("component"))
    if found is None:
        return alone
    many = found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")
    return many.unionByName(alone.join(many, "node", "left_anti"))


def loops(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle."""
    return strong_components(edges).select("node")


def dependents(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that import a changed one, without the changed ones."""
    return imports.join(changed.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(changed.select("node"), "node", "left_anti")


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def canonical(aliases: DataFrame) -> DataFrame:
    """``node, root``: the end of each chain of aliases (``src`` is an alias of ``dst``), by pointer jumping; of several targets the smallest counts.

    Aliases that lead into a circle have its smallest node as their root.
    """
    now = checkpointed(aliases.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root"), F.min("dst").alias("least")))
    rounds = now.count().bit_length() + 1  # each doubles the way gone; longer ones go in a circle
    for _ in range(rounds):
        far = now.select(F.col("node").alias("root"), F.col("root").alias("far"), F.col("least").alias("far_least"))
        now = checkpointed(now.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.least("least", "far_least").alias("least"), F.col("far").isNotNull().alias("moved")))
        moved = now.where("moved")
        now = now.drop("moved")
        if moved.isEmpty():
            return now.select("node", "root")
    circle = now.select(F.col("node").alias("root"), F.col("least").alias("end"))
    return now.select("node", "root").join(circle, "root", "left").select("node", F.coalesce("end", "root").alias("root"))


def targets(calls: DataFrame, defines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``call, definition``: resolved calls (``src, dst, status``) over the canonical symbol to what defines it (``src, dst``)."""
    roots = canonical(aliases)
    over = lambda df, c: df.join(roots, df[c] == roots["node"], "left").withColumn("symbol", F.coalesce("root", c)).drop("node", "root")
    c = over(calls.where("status = 'resolved'"), "dst").select(F.col("src").alias("call"), "symbol")
    d = over(defines, "dst").select(F.col("src").alias("definition"), "symbol")
    return c.join(d, "symbol").select("call", "definition").distinct()


def rollup(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst``: the files between which pairs (``call, definition``) lead, without a file to itself."""
    a = files.select(F.col("node").alias("call"), F.col("file").alias("src"))
    b = files.select(F.col("node").alias("definition"), F.col("file").alias("dst"))
    return pairs.join(a, "call").join(b, "definition").where("src <> dst").select("src", "dst").distinct()


def communities(edges: DataFrame) -> DataFrame:
    """``node, community`` by synchronous label propagation over undirected edges, until nothing changes; ties go to the smaller label.

    Such a propagation comes to rest or alternates between two states (edges have no direction); of two the smaller label is taken.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    both = checkpointed(both.toDF("src", "dst"))
    now = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    before = None
    while True:
        votes = both.join(now, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("c"))
        new = checkpointed(best.select(F.col("src").alias("node"), F.col("c").alias("community")))
        if new.join(now, ["node", "community"], "left_anti").isEmpty():
            return new
        if before is not None and new.join(before, ["node", "community"], "left_anti").isEmpty():
            return new.join(now.withColumnRenamed("community", "other"), "node").select("node", F.least("community", "other").alias("community"))
        before, now = now, new


def community_summary(members: DataFrame, edges: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """Size, cohesion (the share of edges that stay inside) and the most frequent names of each community."""
    at = members.withColumnRenamed("node", "src").withColumnRenamed("community", "a")
    to = members.withColumnRenamed("node", "dst").withColumnRenamed("community", "b")
    inside = edges.join(at, "src").join(to, "dst").groupBy("a").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("cohesion"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    words = members.join(names, "node").groupBy("community", "name").count().groupBy("community").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "name"))), lambda x: x["name"]), 1, most).alias("names"))
    return size.join(inside, size["community"] == inside["a"], "left").drop("a").join(words, "community", "left").withColumn("label_hint", F.array_join("names", ", ")).drop("names")
