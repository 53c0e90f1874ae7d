"""From syntax trees to DataFrames.

The bindings of a query are a DataFrame whose columns are, for a node variable ``v``, ``v__key``,
``v__label`` and only those properties ``v__p_name`` that the query names, so Catalyst prunes the rest at
the scan.  MATCH joins edges and then nodes; a node table is left out when nothing of it is needed, as
an edge always has its ends.  Optional and existence patterns are compiled from the distinct
bound keys and joined left, semi or anti.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Edges, Graph, Nodes, string_map
from ..operators.iterate import checkpointed
from . import parser as P
from .parser import CypherError


@dataclass
class Var:
    kind: str  # node, edge, path, value
    columns: list[str] = field(default_factory=list)
    tables: list = field(default_factory=list)


@dataclass
class Frame:
    df: DataFrame | None
    vars: dict[str, Var] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [c for v in self.vars.values() for c in v.columns]


def conjuncts(e) -> list:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, P.Op) and e.op == "and" else [] if e is None else [e]


def has(e, kind) -> bool:
    return any(isinstance(x, kind) for x in P.walk(e))


def is_aggregate(e) -> bool:
    return any(isinstance(x, P.Call) and x.name in P.AGGREGATES for x in P.walk(e))


def names(e) -> set[str]:
    return {x.name for x in P.walk(e) if isinstance(x, P.Name)} | {x.of for x in P.walk(e) if isinstance(x, P.HasLabels)}


class Compiler:
    def __init__(self, graph: Graph, spark: SparkSession, params: dict):
        self.graph, self.spark, self.params = graph, spark, params
        self.needed: dict[str, set[str]] = defaultdict(set)
        self.whole: set[str] = set()
        self.fresh = 0

    # what the query uses

    def survey(self, clauses: list) -> None:
        """Properties by variable name, and variables used as a whole."""
        for x in P.walk(tuple(clauses)):
            if isinstance(x, P.Prop) and isinstance(x.of, P.Name):
                self.needed[x.of.name].add(x.name)
        renamed = {alias: e.name for c in clauses if isinstance(c, P.Project) for e, alias in c.items if isinstance(e, P.Name)}
        for alias, name in renamed.items():
            self.needed[name] |= self.needed[alias]
        last = clauses[-1]
        if isinstance(last, P.Project):
            self.whole |= {e.name for e, _ in last.items if isinstance(e, P.Name)}
        for x in P.walk(tuple(clauses)):
            if isinstance(x, P.Call) and x.name in ("keys", "properties", "collect"):
                self.whole |= {a.name for a in x.args if isinstance(a, P.Name)}

    def run(self, clauses: list) -> DataFrame:
        self.survey(clauses)
        frame = Frame(None)
        for i, clause in enumerate(clauses):
            if isinstance(clause, P.Match):
                rest = clauses[i + 1 :]
                loose = self.loose(clause, rest)
                frame = self.optional(frame, clause, loose) if clause.optional else self.filtered(self.match(frame, clause.patterns, loose), clause.where)
            elif isinstance(clause, P.Unwind):
                frame = self.unwind(frame, clause)
            elif isinstance(clause, P.Project):
                frame = self.project(frame, clause)
            else:
                frame = self.procedure(clause)
        out = frame.df
        return out.select(*[F.col(c).alias(n) for n, v in frame.vars.items() for c in v.columns])

    def loose(self, clause: P.Match, rest: list) -> set[str] | None:
        """The names used afterwards, if multiplicities do not matter there; else None."""
        after = next((c for c in rest if isinstance(c, P.Project)), None)
        if after is None or any(p.path for p in clause.patterns):
            return None
        calls = [x for e, _ in after.items for x in P.walk(e) if isinstance(x, P.Call) and x.name in P.AGGREGATES]
        if after.distinct and not calls or calls and all(c.distinct or c.name in ("min", "max") for c in calls):
            return names(tuple(rest)) | names(clause.where) | {a for c in rest if isinstance(c, P.Match) for p in c.patterns for a in [n.var for n in p.nodes]}
        return None

    # nodes and edges

    def tables(self, pat: P.NodePat) -> list[Nodes]:
        return self.graph.node_tables(lambda have: all(any(x in have for x in group) for group in pat.labels))

    def property(self, table, name: str) -> Column:
        return F.col(f"`{name}`") if name in table.df.columns else F.lit(None)

    def node_df(self, var: str, tables: list[Nodes]) -> tuple[DataFrame, Var]:
        wanted = sorted(self.needed[var])
        kinds = {p: {t.df.schema[p].dataType for t in tables if p in t.df.columns} for p in wanted}
        parts = []
        for t in tables:
            props = []
            for p in wanted:
                col = self.property(t, p)
                if any(p == x.key for x in tables):
                    col = col.cast(self.graph.key_type)
                elif len(kinds[p]) > 1:
                    col = col.cast("double" if all(isinstance(k, T.NumericType) for k in kinds[p]) else "string")
                elif kinds[p]:
                    col = col.cast(next(iter(kinds[p])))
                props.append(col.alias(f"{var}__p_{p}"))
            cols = [F.col(t.key).cast(self.graph.key_type).alias(f"{var}__key"), F.lit(t.label).alias(f"{var}__label"), *props]
            if var in self.whole:
                cols.append(string_map(t.df).alias(f"{var}__map"))
            parts.append(t.df.select(*cols))
        if not parts:
            raise CypherError(f"no node can match ({var})")
        df = reduce(DataFrame.unionByName, parts)
        return df, Var("node", df.columns, tables)

    def scan(self, pat: P.NodePat) -> Frame:
        df, var = self.node_df(pat.var, self.tables(pat))
        return Frame(df, {pat.var: var})

    def with_props(self, frame: Frame, pat) -> Frame:
        df = frame.df
        for key, value in pat.props:
            df = df.where(F.col(f"{pat.var}__p_{key}") == self.expr(value, frame))
        return Frame(df, frame.vars)

    def edge_df(self, var: str, rel: P.RelPat, near: list[Nodes], far: list[Nodes]) -> tuple[DataFrame, list[str], list[Nodes], bool]:
        """Oriented edges ``near, near_label, far, far_label, type, id`` and properties."""
        near_by, far_by = {t.label: t for t in near}, {t.label: t for t in far}
        wanted = sorted(self.needed[var])
        parts, far_labels, near_labels = [], set(), set()

        def add(e: Edges, a: str, b: str, a_key: str, b_key: str) -> None:
            if a in near_by and b in far_by:
                far_labels.add(b)
                near_labels.add(a)
                ident = F.xxhash64(F.lit(e.type), F.lit(e.source), *[F.col(c) for c in e.id or (e.source_key, e.target_key)])
                props = [self.property(e, p).alias(f"{var}__p_{p}") for p in wanted]
                parts.append(e.df.select(F.col(a_key).cast(self.graph.key_type).alias(f"{var}__near"), F.lit(a).alias(f"{var}__near_label"), F.col(b_key).cast(self.graph.key_type).alias(f"{var}__far"), F.lit(b).alias(f"{var}__far_label"), F.lit(e.type).alias(f"{var}__type"), ident.alias(f"{var}__id"), *props))

        for e in self.graph.edge_tables(list(rel.types)):
            if rel.direction in ("out", "both"):
                add(e, e.source, e.target, e.source_key, e.target_key)
            if rel.direction in ("in", "both"):
                add(e, e.target, e.source, e.target_key, e.source_key)
        if not parts:
            kind = self.graph.key_type
            empty = self.spark.createDataFrame([], f"`{var}__near` {kind}, `{var}__near_label` string, `{var}__far` {kind}, `{var}__far_label` string, `{var}__type` string, `{var}__id` long" + "".join(f", `{var}__p_{p}` string" for p in wanted))
            return empty, [], far[:1], False
        return reduce(DataFrame.unionByName, parts), sorted(near_labels), [far_by[x] for x in sorted(far_labels)], len(near_labels) > 1 or len(near) > 1

    # patterns

    def match(self, frame: Frame, patterns: tuple, loose: set[str] | None) -> Frame:
        used: list[str] = []
        for pattern in patterns:
            for n in pattern.nodes:
                self.needed[n.var] |= {k for k, _ in n.props}
            for r in pattern.rels:
                self.needed[r.var] |= {k for k, _ in r.props}
            frame = self.path(frame, pattern, used, loose)
        return frame

    def path(self, frame: Frame, pattern: P.Pattern, used: list[str], loose) -> Frame:
        at = next((i for i, n in enumerate(pattern.nodes) if n.var in frame.vars), None)
        if at is None:
            at = 0
            new = self.with_props(self.scan(pattern.nodes[0]), pattern.nodes[0])
            frame = new if frame.df is None else Frame(frame.df.crossJoin(new.df), frame.vars | new.vars)
        else:
            frame = self.relabel(self.with_props(frame, pattern.nodes[at]), pattern.nodes[at])
        flip = {"in": "out", "out": "in", "both": "both"}
        hops = [(pattern.nodes[i], pattern.rels[i], pattern.nodes[i + 1]) for i in range(at, len(pattern.rels))]
        hops += [(pattern.nodes[i + 1], replace(pattern.rels[i], direction=flip[pattern.rels[i].direction]), pattern.nodes[i]) for i in reversed(range(at))]
        for here, rel, there in hops:
            frame = self.many(frame, here, rel, there, pattern.path, loose) if rel.many else self.hop(frame, here, rel, there, used)
        if pattern.path and pattern.path not in frame.vars:
            nodes = F.array(*[F.struct(F.col(f"{n.var}__label").alias("label"), F.col(f"{n.var}__key").alias("key")) for n in pattern.nodes])
            frame = Frame(frame.df.withColumn(f"{pattern.path}__nodes", nodes), frame.vars | {pattern.path: Var("path", [f"{pattern.path}__nodes"])})
        return frame

    def relabel(self, frame: Frame, pat: P.NodePat) -> Frame:
        """A bound node that a pattern gives (further) labels."""
        var = frame.vars[pat.var]
        if pat.labels and var.kind == "node":
            kept = [t for t in var.tables if all(any(x in t.labels for x in group) for group in pat.labels)]
            if len(kept) < len(var.tables):
                frame = Frame(frame.df.where(F.col(f"{pat.var}__label").isin([t.label for t in kept])), frame.vars | {pat.var: Var("node", var.columns, kept)})
        return frame

    def hop(self, frame: Frame, here: P.NodePat, rel: P.RelPat, there: P.NodePat, used: list[str]) -> Frame:
        bound = there.var in frame.vars
        far = [t for t in self.tables(there) if not bound or t in frame.vars[there.var].tables]
        edges, _, far, mixed = self.edge_df(rel.var, rel, frame.vars[here.var].tables, far)
        r = rel.var
        for key, value in rel.props:
            edges = edges.where(F.col(f"{r}__p_{key}") == self.expr(value, frame))
        on = [F.col(f"{here.var}__key") == F.col(f"{r}__near")]
        if mixed:
            on.append(F.col(f"{here.var}__label") == F.col(f"{r}__near_label"))
        if bound:
            on.append(F.col(f"{there.var}__key") == F.col(f"{r}__far"))
            if len(far) > 1 or len(frame.vars[there.var].tables) > 1:
                on.append(F.col(f"{there.var}__label") == F.col(f"{r}__far_label"))
        df = frame.df.join(edges, reduce(Column.__and__, on))
        for other in used:  # an edge occurs once in a match
            df = df.where(F.col(f"{other}__id") != F.col(f"{r}__id"))
        used.append(r)
        columns = [f"{r}__type", f"{r}__id", *[f"{r}__p_{p}" for p in sorted(self.needed[r])]]
        out = Frame(df.drop(f"{r}__near", f"{r}__near_label"), frame.vars | {r: Var("edge", columns)})
        return Frame(out.df.drop(f"{r}__far", f"{r}__far_label"), out.vars) if bound else self.arrive(out, r, there, far)

    def arrive(self, frame: Frame, r: str, there: P.NodePat, far: list[Nodes]) -> Frame:
        """Bind the node at the far end of an edge; its table is read only for what is needed of it."""
        v, df = there.var, frame.df
        extra = {p for p in self.needed[v] if any(p != t.key for t in far)}
        if extra or v in self.whole:
            nodes, var = self.node_df(v, far)
            on = F.col(f"{r}__far") == F.col(f"{v}__key")
            if len(far) > 1:
                on &= F.col(f"{r}__far_label") == F.col(f"{v}__label")
            df = df.join(nodes, on).drop(f"{r}__far", f"{r}__far_label")
        else:
            df = df.withColumnsRenamed({f"{r}__far": f"{v}__key", f"{r}__far_label": f"{v}__label"})
            columns = [f"{v}__key", f"{v}__label"]
            for p in sorted(self.needed[v]):
                df = df.withColumn(f"{v}__p_{p}", F.col(f"{v}__key"))
                columns.append(f"{v}__p_{p}")
            var = Var("node", columns, far)
        return self.with_props(Frame(df, frame.vars | {v: var}), there)

    def many(self, frame: Frame, here: P.NodePat, rel: P.RelPat, there: P.NodePat, path: str | None, loose) -> Frame:
        """A path of several edges: reachability where multiplicities do not matter, else enumeration of trails."""
        everything = self.tables(P.NodePat("", (), (), False))
        edges, _, _, _ = self.edge_df(rel.var, rel, everything, everything)
        r, low = rel.var, 1 if rel.low is None else rel.low
        edges = edges.select(F.col(f"{r}__near").alias("e_near"), F.col(f"{r}__near_label").alias("e_near_label"), F.col(f"{r}__far").alias("e_far"), F.col(f"{r}__far_label").alias("e_far_label"), F.col(f"{r}__id").alias("e_id"))
        start = [f"{here.var}__key", f"{here.var}__label"]
        starts = frame.df.select(F.col(start[0]).alias("s_key"), F.col(start[1]).alias("s_label")).distinct()
        far = self.tables(there)
        if loose is not None and low <= 1 and not path:
            alone = here.var not in loose and set(frame.vars) == {here.var} and there.var not in frame.vars
            pairs = self.reach(starts, edges, rel.high, keep=not alone)
            if low == 0:
                pairs = pairs.union(starts.select(*([] if alone else ["s_key", "s_label"]), F.col("s_key").alias("far"), F.col("s_label").alias("far_label"))).distinct()
        else:
            alone, pairs = False, self.trails(starts, edges, low, rel.high)
        labels = [t.label for t in far]
        if len(labels) < len(everything):
            pairs = pairs.where(F.col("far_label").isin(labels))
        pairs = pairs.withColumnsRenamed({"far": f"{r}__far", "far_label": f"{r}__far_label"})
        if alone:
            out = Frame(pairs, {})
        else:
            on = (F.col(start[0]) == F.col("s_key")) & (F.col(start[1]) == F.col("s_label"))
            out = Frame(frame.df.join(pairs, on).drop("s_key", "s_label"), dict(frame.vars))
        if path:
            out = Frame(out.df.withColumnRenamed("nodes", f"{path}__nodes"), out.vars | {path: Var("path", [f"{path}__nodes"])})
        elif "nodes" in out.df.columns:
            out = Frame(out.df.drop("nodes"), out.vars)
        if there.var in frame.vars:
            same = (F.col(f"{there.var}__key") == F.col(f"{r}__far")) & (F.col(f"{there.var}__label") == F.col(f"{r}__far_label"))
            return Frame(out.df.where(same).drop(f"{r}__far", f"{r}__far_label"), out.vars)
        return self.arrive(out, r, there, far)

    def reach(self, starts: DataFrame, edges: DataFrame, high: int | None, keep: bool) -> DataFrame:
        """Distinct pairs of a start and a node that one edge or more lead to (or only the nodes)."""
        keys = ["s_key", "s_label"] if keep else []
        pairs = ["far", "far_label"]
        now = starts.select(F.col("s_key").alias("far"), F.col("s_label").alias("far_label"), *keys)
        seen, hops = None, 0
        while high is None or hops < high:
            step = now.join(edges, (F.col("far") == F.col("e_near")) & (F.col("far_label") == F.col("e_near_label"))).select(F.col("e_far").alias("far"), F.col("e_far_label").alias("far_label"), *keys).distinct()
            now = checkpointed(step if seen is None else step.join(seen, [*keys, *pairs], "left_anti"))
            hops += 1
            if now.isEmpty():
                break
            seen = now if seen is None else seen.unionByName(now)
        return (now if seen is None else seen).select(*keys, *pairs)

    def trails(self, starts: DataFrame, edges: DataFrame, low: int, high: int | None) -> DataFrame:
        """Every path without a repeated edge, with its nodes; without a bound until no path can be made longer."""
        def node(key, label):
            return F.struct(F.col(label).alias("label"), F.col(key).alias("key"))

        now = starts.select("s_key", "s_label", F.col("s_key").alias("far"), F.col("s_label").alias("far_label"), F.array(node("s_key", "s_label")).alias("nodes"), F.array().cast("array<long>").alias("ids"))
        out = [now] if low == 0 else []
        for hops in count(1) if high is None else range(1, high + 1):
            now = now.join(edges, (F.col("far") == F.col("e_near")) & (F.col("far_label") == F.col("e_near_label")) & ~F.array_contains("ids", F.col("e_id")))
            now = now.select("s_key", "s_label", F.col("e_far").alias("far"), F.col("e_far_label").alias("far_label"), F.concat("nodes", F.array(node("e_far", "e_far_label"))).alias("nodes"), F.concat("ids", F.array("e_id")).alias("ids"))
            if high is None or hops > 3:
                now = checkpointed(now)
                if now.isEmpty():
                    break
            if hops >= low:
                out.append(now)
        return reduce(DataFrame.unionByName, out or [now.limit(0)]).drop("ids")

    # optional and existence patterns

    def bound(self, frame: Frame, patterns: tuple, where) -> list[str]:
        inside = {n.var for p in patterns for n in p.nodes} | names(where)
        return [v for v in frame.vars if v in inside]

    def sub(self, frame: Frame, patterns: tuple, where, loose) -> tuple[Frame, list[str]]:
        """The patterns matched from the distinct bound values of the frame."""
        held = self.bound(frame, patterns, where)
        keys = [c for v in held for c in frame.vars[v].columns if not c.endswith("__map")]
        start = Frame(frame.df.select(*keys).distinct() if keys else None, {v: Var(frame.vars[v].kind, [c for c in frame.vars[v].columns if c in keys], frame.vars[v].tables) for v in held})
        return self.filtered(self.match(start, patterns, loose), where), keys

    def optional(self, frame: Frame, clause: P.Match, loose) -> Frame:
        if frame.df is None:
            raise CypherError("a query cannot begin with OPTIONAL MATCH")
        sub, keys = self.sub(frame, clause.patterns, clause.where, loose)
        new = {v: x for v, x in sub.vars.items() if v not in frame.vars}
        right = sub.df.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[c for x in new.values() for c in x.columns])
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]) if keys else F.lit(True)
        return Frame(frame.df.join(right, on, "left").drop(*[f"o_{k}" for k in keys]), frame.vars | new)

    def exists(self, frame: Frame, e: P.Exists, how: str, flag: str | None = None) -> Frame:
        sub, keys = self.sub(frame, e.patterns, e.where, names(tuple(e.patterns)) | set(frame.vars))
        right = sub.df.select(*[F.col(k).alias(f"x_{k}") for k in keys]).distinct()
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys])
        if flag:
            df = frame.df.join(right.withColumn(flag, F.lit(True)), on, "left").drop(*[f"x_{k}" for k in keys])
            return Frame(df.withColumn(flag, F.coalesce(flag, F.lit(False))), frame.vars)
        return Frame(frame.df.join(right, on, how), frame.vars)

    def filtered(self, frame: Frame, where) -> Frame:
        parts = conjuncts(where)
        for e in [e for e in parts if not has(e, P.Exists)]:
            frame = Frame(frame.df.where(self.expr(e, frame)), frame.vars)
        for e in [e for e in parts if has(e, P.Exists)]:
            if isinstance(e, P.Exists):
                frame = self.exists(frame, e, "left_semi")
            elif isinstance(e, P.Op) and e.op == "not" and isinstance(e.args[0], P.Exists):
                frame = self.exists(frame, e.args[0], "left_anti")
            else:
                flags = {}
                for x in P.walk(e):
                    if isinstance(x, P.Exists) and x not in flags:
                        self.fresh += 1
                        flags[x] = f"x__{self.fresh}"
                        frame = self.exists(frame, x, "", flags[x])
                frame = Frame(frame.df.where(self.expr(e, frame, flags=flags)).drop(*flags.values()), frame.vars)
        return frame

    # projections

    def unwind(self, frame: Frame, clause: P.Unwind) -> Frame:
        base = frame.df if frame.df is not None else self.spark.range(1).select()
        items = self.expr(clause.expr, frame)
        return Frame(base.withColumn(f"{clause.var}__val", F.explode(items)), frame.vars | {clause.var: Var("value", [f"{clause.var}__val"])})

    def project(self, frame: Frame, clause: P.Project) -> Frame:
        if frame.df is None:
            frame = Frame(self.spark.range(1).select(), {})
        items = [(P.Name(v), v) for v in frame.vars if not v.startswith("_")] if clause.star else []
        items += list(clause.items)
        if len({a for _, a in items}) < len(items):
            raise CypherError("a column is named twice")
        out: dict[str, Var] = {}
        keys: list[Column] = []
        totals: list[Column] = []
        for e, alias in items:
            if isinstance(e, P.Name) and e.name in frame.vars and frame.vars[e.name].kind != "value" and not clause.last:
                var = frame.vars[e.name]
                new = [alias + c[len(e.name) :] for c in var.columns]
                keys += [F.col(c).alias(n) for c, n in zip(var.columns, new)]
                out[alias] = Var(var.kind, new, var.tables)
            else:
                column = re.sub(r"\W", "_", alias) + f"_{len(out)}__val"
                (totals if is_aggregate(e) else keys).append(self.expr(e, frame).alias(column))
                out[alias] = Var("value", [column])
        order, hidden = [], []
        for i, (e, down) in enumerate(clause.order):
            same = next((a for x, a in items if x == e or isinstance(e, P.Name) and e.name == a), None)
            if same is not None:
                col = out[same].columns[0]
            elif totals or clause.distinct:
                col = self.expr(e, Frame(None, out))
            else:
                later = {**frame.vars, **{a: v for a, v in out.items() if v.kind == "value"}}
                try:
                    hidden.append(self.expr(e, frame).alias(f"order__{i}"))
                    col = f"order__{i}"
                except CypherError:
                    col = self.expr(e, Frame(None, later))
            order.append((F.col(col) if isinstance(col, str) else col, down))
        if totals:
            # maps cannot be grouped by: they follow from the key
            maps = [k for k in keys if k._jc.toString().endswith("__map")]
            plain = [k for k in keys if k not in maps] if maps else keys
            df = frame.df.groupBy(*plain).agg(*totals, *[F.first(m).alias(m._jc.toString()) for m in maps])
        else:
            df = frame.df.select(*keys, *hidden)
        if clause.distinct:
            df = df.dropDuplicates([c for c in df.columns if not c.endswith("__map")])
        if order:
            df = df.orderBy(*[c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in order])
        if clause.skip is not None:
            df = df.offset(self.constant(clause.skip))
        if clause.limit is not None:
            df = df.limit(self.constant(clause.limit))
        df = df.drop(*[f"order__{i}" for i in range(len(clause.order))])
        return self.filtered(Frame(df, out), clause.where)

    def procedure(self, clause: P.Procedure) -> Frame:
        g = self.graph
        rows = {
            "db.labels": (["label"], sorted({(x,) for n in g.nodes for x in n.labels})),
            "db.relationshiptypes": (["relationshipType"], sorted({(e.type,) for e in g.edges})),
            "db.indexes": (["label", "property"], sorted(g.indexes)),
            "db.constraints": (["label", "property"], sorted(g.constraints)),
        }.get(clause.name.lower())
        if rows is None:
            raise CypherError(f"unknown procedure {clause.name}")
        columns, data = rows
        df = self.spark.createDataFrame(data, ", ".join(f"{c}__val string" for c in columns))
        wanted = clause.yields or columns
        return Frame(df.select(*[f"{c}__val" for c in wanted]), {c: Var("value", [f"{c}__val"]) for c in wanted})

    # expressions

    def constant(self, e):
        if isinstance(e, P.Lit):
            return e.value
        if isinstance(e, P.Param):
            return self.param(e.name)
        raise CypherError("a constant is needed")

    def param(self, name: str):
        if name not in self.params:
            raise CypherError(f"no value for ${name}")
        return self.params[name]

    def literal(self, value) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[self.literal(x) for x in value])
        if isinstance(value, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in value.items()])
        return F.lit(value)

    def entity(self, name: str, frame: Frame) -> Column:
        var = frame.vars[name]
        if var.kind == "value":
            return F.col(var.columns[0])
        if var.kind == "node":
            parts = [F.col(f"{name}__label").alias("label"), F.col(f"{name}__key").alias("key")]
            parts += [F.col(f"{name}__map").alias("props")] if f"{name}__map" in var.columns else []
            return F.when(F.col(f"{name}__key").isNotNull(), F.struct(*parts))
        if var.kind == "edge":
            return F.when(F.col(f"{name}__id").isNotNull(), F.struct(F.col(f"{name}__type").alias("type"), F.col(f"{name}__id").alias("id")))
        return F.col(f"{name}__nodes")

    def is_string(self, e, frame: Frame, env: dict) -> bool:
        if isinstance(e, P.Lit):
            return isinstance(e.value, str)
        if isinstance(e, P.Op) and e.op == "+":
            return any(self.is_string(a, frame, env) for a in e.args)
        if frame.df is None or env:
            return False
        try:
            return isinstance(frame.df.select(self.expr(e, frame)).schema[0].dataType, T.StringType)
        except Exception:  # an aggregate, or no column of the present frame
            return False

    def expr(self, e, frame: Frame, env: dict | None = None, flags: dict | None = None) -> Column:
        env, flags = env or {}, flags or {}
        sub = lambda x: self.expr(x, frame, env, flags)
        if isinstance(e, P.Lit):
            return F.lit(e.value)
        if isinstance(e, P.Param):
            return self.literal(self.param(e.name))
        if isinstance(e, P.Name):
            if e.name in env:
                return env[e.name]
            if e.name not in frame.vars:
                raise CypherError(f"unknown name {e.name}")
            return self.entity(e.name, frame)
        if isinstance(e, P.Prop):
            return self.prop(e, frame, env, flags)
        if isinstance(e, P.Exists):
            if e not in flags:
                raise CypherError("patterns are conditions of WHERE only")
            return F.col(flags[e])
        if isinstance(e, P.Op):
            return self.operation(e, frame, env, flags)
        if isinstance(e, P.HasLabels):
            have = {t.label: set(t.labels) for t in frame.vars[e.of].tables}
            good = [x for x, all_ in have.items() if all(any(y in all_ for y in group) for group in e.labels)]
            return F.col(f"{e.of}__label").isin(good) if good else F.lit(False)
        if isinstance(e, P.Case):
            out = None
            for when, then in e.whens:
                test = sub(when) if e.subject is None else sub(e.subject) == sub(when)
                out = F.when(test, sub(then)) if out is None else out.when(test, sub(then))
            return out.otherwise(sub(e.default))
        if isinstance(e, P.ListOf):
            return F.array(*[sub(x) for x in e.items])
        if isinstance(e, P.MapOf):
            return F.struct(*[sub(x).alias(k) for k, x in e.items])
        if isinstance(e, P.Index):
            at = sub(e.at)
            return F.get(sub(e.of), F.when(at < 0, F.size(sub(e.of)) + at).otherwise(at).cast("int"))
        if isinstance(e, P.ListFn):
            items = sub(e.items)
            test = lambda x: self.expr(e.where, frame, env | {e.var: x}, flags)
            if e.kind == "any":
                return F.exists(items, test)
            if e.kind == "all":
                return F.forall(items, test)
            if e.kind == "none":
                return ~F.exists(items, test)
            if e.where is not None:
                items = F.filter(items, test)
            return items if e.value is None else F.transform(items, lambda x: self.expr(e.value, frame, env | {e.var: x}, flags))
        if isinstance(e, P.Call):
            return self.call(e, frame, env, flags)
        raise CypherError(f"cannot compile {e}")

    def prop(self, e: P.Prop, frame: Frame, env: dict, flags: dict) -> Column:
        if isinstance(e.of, P.Name) and e.of.name not in env:
            if e.of.name not in frame.vars:
                raise CypherError(f"unknown name {e.of.name}")
            var = frame.vars[e.of.name]
            if var.kind in ("node", "edge"):
                if (column := f"{e.of.name}__p_{e.name}") not in var.columns:
                    raise CypherError(f"{e.of.name}.{e.name} is not at hand here")
                return F.col(column)
        keys = {t.key for t in self.graph.nodes} if isinstance(e.of, P.Name) and e.of.name in env else ()
        return self.expr(e.of, frame, env, flags).getField("key" if e.name in keys else e.name)

    def operation(self, e: P.Op, frame: Frame, env: dict, flags: dict) -> Column:
        sub = lambda x: self.expr(x, frame, env, flags)
        a = sub(e.args[0])
        if e.op == "not":
            return ~a
        if e.op in ("null", "notnull"):
            return a.isNull() if e.op == "null" else a.isNotNull()
        if e.op == "minus":
            return -a
        right = e.args[1]
        if e.op == "in":
            values = [x.value for x in right.items] if isinstance(right, P.ListOf) and all(isinstance(x, P.Lit) for x in right.items) else self.param(right.name) if isinstance(right, P.Param) else None
            return F.array_contains(sub(right), a) if values is None else a.isin(*values) if values else F.lit(False)
        if e.op == "=~":
            pattern = right.value if isinstance(right, P.Lit) else self.param(right.name) if isinstance(right, P.Param) else None
            if pattern is None:
                raise CypherError("a pattern is a constant")
            return a.rlike(f"^(?:{pattern})$")
        b = sub(right)
        if e.op == "+" and (self.is_string(e.args[0], frame, env) or self.is_string(right, frame, env)):
            return F.concat(a.cast("string"), b.cast("string"))
        return {
            "and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b), "contains": lambda: a.contains(b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[e.op]()

    def call(self, e: P.Call, frame: Frame, env: dict, flags: dict) -> Column:
        args, first = e.args, e.args[0] if e.args else None
        name_of = first.name if isinstance(first, P.Name) and first.name in frame.vars and first.name not in env else None
        kind = frame.vars[name_of].kind if name_of else None
        if e.name in P.AGGREGATES:
            if e.name == "count":
                if kind in ("node", "edge"):
                    cols = [F.col(f"{name_of}__key"), F.col(f"{name_of}__label")] if kind == "node" else [F.col(f"{name_of}__id")]
                    if kind == "node" and len(frame.vars[name_of].tables) == 1:
                        cols = cols[:1]
                    return F.count_distinct(*cols) if e.distinct else F.count(cols[0])
                col = self.expr(first, frame, env, flags)
                return F.count_distinct(col) if e.distinct else F.count(col)
            col = self.expr(first, frame, env, flags)
            if e.name == "collect":
                if e.distinct:
                    return F.sort_array(F.collect_set(col))
                if e.order:
                    if any(down for _, down in e.order) and not all(down for _, down in e.order):
                        raise CypherError("an ordered collect goes one way")
                    rows = F.collect_list(F.struct(*[self.expr(o, frame, env, flags).alias(f"o{i}") for i, (o, _) in enumerate(e.order)], col.alias("x")))
                    return F.transform(F.sort_array(rows, asc=not e.order[0][1]), lambda r: r["x"])
                return F.collect_list(col)
            return {"sum": F.sum_distinct if e.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](col)
        if e.name == "type":
            return F.col(f"{name_of}__type")
        if e.name == "labels":
            pairs = [x for t in frame.vars[name_of].tables for x in (F.lit(t.label), F.array(*[F.lit(y) for y in t.labels]))]
            return F.element_at(F.create_map(*pairs), F.col(f"{name_of}__label"))
        if e.name == "keys":
            return F.sort_array(F.map_keys(F.col(f"{name_of}__map")))
        if e.name == "properties":
            return F.col(f"{name_of}__map")
        if e.name in ("id", "key") and kind == "node":
            return F.col(f"{name_of}__key")
        if e.name == "nodes":
            return F.col(f"{name_of}__nodes")
        if e.name == "length" and kind == "path":
            return F.size(f"{name_of}__nodes") - 1
        cols = [self.expr(a, frame, env, flags) for a in args]
        if e.name in ("size", "length"):
            text = isinstance(first, (P.Lit, P.Prop)) or isinstance(first, P.Call) and first.name in ("substring", "tolower", "toupper", "trim", "tostring") or self.is_string(first, frame, env)
            if isinstance(first, P.Prop) and frame.df is not None and not env:
                text = not isinstance(frame.df.select(cols[0]).schema[0].dataType, (T.ArrayType, T.MapType))
            return F.length(cols[0]) if text else F.size(cols[0])
        if e.name == "substring":
            return cols[0].substr(cols[1] + 1, cols[2] if len(cols) > 2 else F.length(cols[0]))
        if e.name == "range":
            return F.sequence(*cols)
        simple = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "coalesce": F.coalesce, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "reverse": F.reverse, "head": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.element_at(c, -1), "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "tofloat": lambda c: c.cast("double"), "split": lambda c, d: F.split(c, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), "replace": F.replace}
        if e.name not in simple:
            raise CypherError(f"unknown function {e.name}")
        return simple[e.name](*cols)


def run(graph: Graph, spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """The result of a reading query."""
    return Compiler(graph, spark, params or {}).run(P.parse(query))


def explain(graph: Graph, spark: SparkSession, query: str, params: dict | None = None, mode: str = "formatted") -> str:
    """The plan's text; the query itself is not run (frontier loops are)."""
    df = run(graph, spark, query, params)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def scalar(graph: Graph, spark: SparkSession, query: str, params: dict | None = None):
    """The first column of the first row; 0 if there is none."""
    row = run(graph, spark, query, params).first()
    return 0 if row is None else row[0]
