"""Graph mutations as DataFrame algebra, on a generic form.

Nodes are ``label, key, file, props`` (``file`` is null for labels that no file owns; ``props`` a map of
strings), edges ``type, from_label, from_key, to_label, to_key, props``.  Every function gives the new tables;
:class:`Store` keeps versions of them in a folder and swaps the current one as a whole.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CONSTRAINTS, EDGE_SPECS, INDEXES, NODE_SPECS, VERSION

NODE = "label string, key string, file string, props map<string,string>"
EDGE = "type string, from_label string, from_key string, to_label string, to_key string, props map<string,string>"
ENDS = (("from_label", "from_key"), ("to_label", "to_key"))


def inside(column, path: str, itself: bool = True) -> Column:
    """Whether a path lies below ``path`` (or is it)."""
    below = F.col(column).startswith(path + "/")
    return below | (F.col(column) == path) if itself else below


def without_ends(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is among ``gone`` (``label, key``)."""
    gone = gone.select("label", "key").distinct()
    for label, key in ENDS:
        edges = edges.join(gone.select(F.col("label").alias(label), F.col("key").alias(key)), [label, key], "left_anti")
    return edges.select("type", "from_label", "from_key", "to_label", "to_key", "props")


def remove_nodes(nodes: DataFrame, edges: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy a condition go, with the edges at them."""
    which = F.coalesce(which, F.lit(False))
    return nodes.where(~which), without_ends(edges, nodes.where(which))


def scope_delete(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """What a file owns goes; identities (symbols, tags) and other files' edges into them stay."""
    return remove_nodes(nodes, edges, F.col("file") == file)


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``files`` (``path``) own goes, as by :func:`scope_delete` of each, and the new rows come; so doing it twice changes nothing."""
    owned = nodes.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(nodes.columns)
    left = nodes.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select(nodes.columns)
    return create_nodes(left, new_nodes), without_ends(edges, owned).unionByName(new_edges.select(edges.columns))


def create_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows are added as they are, duplicates too."""
    return nodes.unionByName(rows.select(nodes.columns))


def _pruned(props) -> Column:
    return F.map_filter(props, lambda _, v: v.isNotNull())


def _last_values(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the properties of its rows, of each property the last value that is not null (of equal ``order`` the greatest value)."""
    one = rows.select(*keys, order, F.explode_outer(_pruned("props")).alias("name", "value"))
    one = one.groupBy(*keys, "name").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("new"))


def merge_nodes(nodes: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert on label and key: present properties replace, absent and null ones never erase; later rows win."""
    new = _last_values(rows, ["label", "key"], order)
    files = rows.groupBy("label", "key").agg(F.max_by("file", F.struct(order, "file")).alias("new_file"))
    both = nodes.join(new.join(files, ["label", "key"]), ["label", "key"], "full_outer")
    props = F.map_zip_with(F.coalesce("props", F.create_map().cast("map<string,string>")), F.coalesce("new", F.create_map().cast("map<string,string>")), lambda _, old, now: F.coalesce(now, old))
    return both.select("label", "key", F.coalesce("new_file", "file").alias("file"), props.alias("props"))


def join_ends(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Edge rows whose ends both exist; equal keys fan out, others vanish."""
    ends = nodes.select("label", "key")
    for label, key in ENDS:
        rows = rows.join(ends.select(F.col("label").alias(label), F.col("key").alias(key)), [label, key])
    return rows


def create_edges(nodes: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.unionByName(join_ends(nodes, rows).select(edges.columns))


def merge_edges(nodes: DataFrame, edges: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each type and pair of ends; its properties are merged like a node's."""
    keys = ["type", "from_label", "from_key", "to_label", "to_key"]
    new = _last_values(join_ends(nodes, rows), keys, order)
    both = edges.join(new, keys, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    return both.select(*keys, F.map_zip_with(F.coalesce("props", empty), F.coalesce("new", empty), lambda _, old, now: F.coalesce(now, old)).alias("props"))


def endpoint(label: str) -> str:
    """The property that an end of this label is matched by: id for what files own, else the label's key."""
    spec = NODE_SPECS[label]
    if not spec.key:
        raise ValueError(f"{label} has no key and cannot be an end")
    return "id" if spec.cpg else spec.key


@dataclass(frozen=True)
class Step:
    """One operation of a plan: its kind, the label or type, and its rows."""

    kind: str
    of: str
    rows: DataFrame | None = None


def plan_delta(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], file: str | None = None) -> list[Step]:
    """The operations of a delta: scope delete, then nodes by label, then edges by type.  Undeclared ones raise."""
    steps = [Step("scope delete", file)] if file else []
    for label, rows in nodes.items():
        if label not in NODE_SPECS:
            raise ValueError(f"undeclared label {label}")
        if NODE_SPECS[label].write == "overlay":
            raise ValueError(f"{label} is written by overlay jobs only")
        steps.append(Step("merge nodes" if NODE_SPECS[label].write == "merge" else "create nodes", label, rows))
    for kind, rows in edges.items():
        if kind not in EDGE_SPECS:
            raise ValueError(f"undeclared edge type {kind}")
        if EDGE_SPECS[kind].write in ("overlay", "move"):
            raise ValueError(f"{kind} is not written by deltas")
        steps.append(Step("merge edges" if EDGE_SPECS[kind].write == "merge" else "create edges", kind, rows))
    return steps


def apply_plan(nodes: DataFrame, edges: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    for s in steps:
        if s.kind == "scope delete":
            nodes, edges = scope_delete(nodes, edges, s.of)
        elif s.kind == "create nodes":
            nodes = create_nodes(nodes, s.rows)
        elif s.kind == "merge nodes":
            nodes = merge_nodes(nodes, s.rows)
        elif s.kind == "create edges":
            edges = create_edges(nodes, edges, s.rows)
        else:
            edges = merge_edges(nodes, edges, s.rows)
    return nodes, edges


def chunk_of(order: Column, rows: int = 5000) -> Column:
    """The number of the chunk that a row's place (from 0) falls into."""
    return F.floor(order / rows).cast("long")


# The file system


def remove_path(nodes: DataFrame, edges: DataFrame, path: str, directory: bool) -> tuple[DataFrame, DataFrame]:
    """A file with what it owns, or a directory with all below it, goes with the edges at them."""
    own = F.col("label").isin("FILE", "DIRECTORY")
    if directory:
        return remove_nodes(nodes, edges, inside("file", path, False) | (own & inside("key", path)))
    return remove_nodes(nodes, edges, (F.col("file") == path) | ((F.col("label") == "FILE") & (F.col("key") == path)))


def moved_path(column, old: str, new: str) -> Column:
    """A path with its leading ``old`` replaced by ``new`` where it lies at or below ``old``."""
    return F.when(inside(column, old), F.concat(F.lit(new), F.substring(F.col(column), len(old) + 1, 1 << 30))).otherwise(F.col(column))


def move_path(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """A file or directory moves: what files own below the old path goes (it is extracted anew), paths are
    rewritten in nodes and in the ends of edges, the link from the old parent goes, the moved node gets its new name."""
    nodes, edges = remove_nodes(nodes, edges, inside("file", old))
    own = F.col("label").isin("FILE", "DIRECTORY") & inside("key", old)
    name = F.when(F.col("key") == old, F.lit(new.rpartition("/")[2])).otherwise(F.col("props")["name"])
    path = moved_path("key", old, new)
    renamed = F.map_concat(F.map_filter("props", lambda k, _: ~k.isin("name", "path")), F.create_map(F.lit("name"), name, F.lit("path"), path))
    nodes = nodes.select("label", F.when(own, path).otherwise(F.col("key")).alias("key"), "file", F.when(own, renamed).otherwise(F.col("props")).alias("props"))
    edges = edges.where(~((F.col("type") == "HAS_ENTRY") & (F.col("to_key") == old)))
    on = {k: F.when(F.col(label).isin("FILE", "DIRECTORY"), moved_path(k, old, new)).otherwise(F.col(k)) for label, k in ENDS}
    return nodes, edges.withColumns(on)


def entries(paths: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """Of files' paths: all directories above them (root ``.`` included), and the links ``parent, child, kind``."""
    from ..sources.paths import ancestors, parent

    dirs = paths.select(F.explode(ancestors(F.col(column))).alias("path")).distinct()
    links = dirs.where("path <> '.'").select(parent(F.col("path")).alias("parent"), F.col("path").alias("child"), F.lit("DIRECTORY").alias("kind"))
    files = paths.select(parent(F.col(column)).alias("parent"), F.col(column).alias("child"), F.lit("FILE").alias("kind")).distinct()
    return dirs, links.unionByName(files)


def write_filesystem(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, removals=(), moves=()) -> tuple[DataFrame, DataFrame]:
    """In order: moves, removals, directories, files, links.  ``files``: ``path`` and properties; ``removals``: (path, is
    directory) pairs; ``moves``: (old, new) pairs."""
    for old, new in moves:
        nodes, edges = move_path(nodes, edges, old, new)
    for path, directory in removals:
        nodes, edges = remove_path(nodes, edges, path, directory)
    known = files.select("path") if files is not None else nodes.where("false").select(F.col("key").alias("path"))
    moved = nodes.where("label = 'FILE'").select(F.col("key").alias("path")) if moves else nodes.where("false").select(F.col("key").alias("path"))
    dirs, links = entries(known.unionByName(moved).distinct())
    none = F.lit(None).cast("string")
    named = F.create_map(F.lit("name"), F.substring_index("path", "/", -1), F.lit("path"), F.col("path"), F.lit("status"), F.lit("ready"))
    nodes = merge_nodes(nodes, dirs.select(F.lit("DIRECTORY").alias("label"), F.col("path").alias("key"), none.alias("file"), named.alias("props"), F.lit(0).alias("seq")))
    if files is not None:
        props = F.create_map(*[x for c in files.columns for x in (F.lit(c), F.col(c).cast("string"))])
        nodes = merge_nodes(nodes, files.select(F.lit("FILE").alias("label"), F.col("path").alias("key"), none.alias("file"), props.alias("props"), F.lit(0).alias("seq")))
    rows = links.select(F.lit("HAS_ENTRY").alias("type"), F.lit("DIRECTORY").alias("from_label"), F.col("parent").alias("from_key"), F.col("kind").alias("to_label"), F.col("child").alias("to_key"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq"))
    return nodes, merge_edges(nodes, edges, rows)


def ensure_root(nodes: DataFrame, edges: DataFrame, root: str, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """The root directory, if it is not there, and links from it to those watched folders that are."""
    spark = nodes.sparkSession
    made = spark.createDataFrame([("DIRECTORY", root, None, {"name": root, "path": root, "status": "ready"})], NODE)
    nodes = nodes.unionByName(made.join(nodes.select("label", "key"), ["label", "key"], "left_anti").select(nodes.columns))
    links = spark.createDataFrame([("HAS_ENTRY", "DIRECTORY", root, "DIRECTORY", f, {}, 0) for f in folders if f != root], EDGE + ", seq int")
    return nodes, merge_edges(nodes, edges, links)


# The full (positional) profile


def create_missing(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose key no node has, added; nothing is updated."""
    return nodes.unionByName(rows.join(nodes.select("key"), "key", "left_anti").dropDuplicates(["key"]).select(nodes.columns))


def merge_variable_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """One edge for each pair of ends, type and ``variable``."""
    both = edges.unionByName(rows.select(edges.columns))
    return both.withColumn("variable", F.col("props")["variable"]).dropDuplicates(["from_key", "to_key", "type", "variable"]).drop("variable")


def update_node(nodes: DataFrame, key: str, props: dict[str, str]) -> DataFrame:
    """Set properties of one node, not its key or label."""
    new = F.create_map(*[x for k, v in props.items() if k not in ("id", "label") for x in (F.lit(k), F.lit(v))]).cast("map<string,string>")
    merged = F.map_zip_with("props", new, lambda _, old, now: F.coalesce(now, old))
    return nodes.withColumn("props", F.when(F.col("key") == key, merged).otherwise(F.col("props")))


def replace_file(nodes: DataFrame, edges: DataFrame, file: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file's nodes replaced; edges of other files into keys that remain are kept."""
    gone = nodes.where((F.col("file") == file) & ~F.col("label").isin("FILE", "DIRECTORY"))
    lost = gone.select("label", "key").join(new_nodes.select("label", "key"), ["label", "key"], "left_anti")
    own = gone.select(F.col("label").alias("from_label"), F.col("key").alias("from_key"))
    edges = without_ends(edges.join(own, ["from_label", "from_key"], "left_anti"), lost)
    nodes = nodes.join(gone.select("label", "key"), ["label", "key"], "left_anti").select(nodes.columns)
    return create_nodes(nodes, new_nodes), edges.unionByName(new_edges.select(edges.columns))


def remove_keys(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of some keys (``key``) go, with the edges at them; one anti join, however many they are."""
    gone = nodes.join(keys.select("key").distinct(), "key", "left_semi").select(nodes.columns)
    return nodes.join(keys.select("key").distinct(), "key", "left_anti").select(nodes.columns), without_ends(edges, gone)


def clear(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nothing is left but the graph's metadata."""
    return nodes.where("label = 'META_DATA'"), edges.where("false")


def contained(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """``from_key, to_key`` of CONTAINS edges below a moved folder: each file or directory with its parent, by their new paths."""
    own = nodes.where(F.col("label").isin("FILE", "DIRECTORY") & inside("key", old)).select(moved_path("key", old, new).alias("to_key"))
    return own.select(F.regexp_replace("to_key", "/[^/]*$", "").alias("from_key"), "to_key").where("from_key <> to_key")


def soft_delete(nodes: DataFrame, which: Column, at: float) -> DataFrame:
    marked = F.map_concat(F.map_filter("props", lambda k, _: k != "isSoftDeleted"), F.create_map(F.lit("isSoftDeleted"), F.lit(str(at))))
    return nodes.withColumn("props", F.when(which, marked).otherwise(F.col("props")))


def revive(nodes: DataFrame, which: Column) -> DataFrame:
    return nodes.withColumn("props", F.when(which, F.map_filter("props", lambda k, _: k != "isSoftDeleted")).otherwise(F.col("props")))


def sweep(nodes: DataFrame, edges: DataFrame, now: float, after: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Nodes that were marked deleted more than ``after`` seconds ago go."""
    return remove_nodes(nodes, edges, F.col("props")["isSoftDeleted"].cast("double") < now - after)


def reconnect(orphans: DataFrame, candidates: DataFrame) -> DataFrame:
    """``orphan, parent``: orphans (``key, name, children``) matched to candidates (``key, name, children``) by equal
    children, else by a name that only one candidate and one orphan have."""
    by_children = orphans.join(candidates.select(F.col("key").alias("parent"), F.sort_array("children").alias("c")), F.sort_array("children") == F.col("c")).where(F.size("children") > 0).groupBy(F.col("key").alias("orphan")).agg(F.min("parent").alias("parent"))
    rest = orphans.join(by_children, orphans["key"] == by_children["orphan"], "left_anti")
    one = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n = 1")
    by_name = one(rest).select(F.col("key").alias("orphan"), "name").join(one(candidates).select(F.col("key").alias("parent"), "name"), "name")
    return by_children.unionByName(by_name.select("orphan", "parent"))


def update_incrementally(nodes: DataFrame, edges: DataFrame, removed: DataFrame, modified: DataFrame, added: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed keys go, modified nodes are replaced and lose their edges, added ones and the new edges come."""
    gone = removed.select("label", "key").unionByName(modified.select("label", "key"))
    left = nodes.join(gone, ["label", "key"], "left_anti").select(nodes.columns)
    nodes = create_nodes(create_nodes(left, modified), added)
    return nodes, create_edges(nodes, without_ends(edges, gone), new_edges)


# Stored graphs


#: parts of a stored graph that are rewritten by themselves
BUCKETS = 16


def bucket(own: Column) -> Column:
    return F.pmod(F.xxhash64(own), F.lit(BUCKETS)).cast("int")


def node_bucket() -> Column:
    """Nodes that a file owns lie together."""
    return bucket(F.coalesce("file", "key"))


def edge_bucket() -> Column:
    """Edges lie with the file (or key) that they start in: keys of nodes that a file owns begin with its path."""
    file = F.regexp_extract("from_key", r"^(.*?):[A-Z_]+:", 1)
    return bucket(F.when(file != "", file).otherwise(F.col("from_key")))


class Store:
    """Named graphs as versions of their tables below a folder; a version becomes current when its manifest is written.

    A version's manifest names, for each bucket of nodes and of edges, the folder that holds it; a change rewrites the buckets
    that it touches and names the old folders for the others.
    """

    def __init__(self, spark: SparkSession, folder: str, graph: str = "graph"):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{graph}"
        self.folder = folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v") and fs.exists(self._fs(f"{f.getPath()}/_CURRENT")[1])) if fs.exists(p) else []

    def _manifest(self) -> dict[str, dict[str, str]]:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.path)
        fs, p = self._fs(f"{self.path}/v{versions[-1]}/_CURRENT")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bootstrap(self, version: int = VERSION) -> str:
        """``created``, ``matched`` or ``mismatch``; a mismatch is only told."""
        if not self._versions():
            self.save(self.spark.createDataFrame([("META_DATA", "", None, {"schema_version": str(version)})], NODE), self.spark.createDataFrame([], EDGE))
            return "created"
        return "matched" if self.metadata().get("schema_version") == str(version) else "mismatch"

    def metadata(self) -> dict:
        row = self.read()[0].where("label = 'META_DATA'").first()
        return dict(row["props"]) if row else {}

    def configuration(self) -> dict:
        """What the stored graph is made of: its schema version, metadata, buckets and versions."""
        manifest = self._manifest()
        return {"schema_version": VERSION, "metadata": self.metadata(), "buckets": {k: sorted(map(int, v)) for k, v in manifest.items()}, "versions": self._versions()}

    def _read(self, part: str, buckets=None) -> DataFrame:
        kind = NODE if part == "nodes" else EDGE
        paths = sorted(f"{self.path}/{at}" for k, at in self._manifest()[part].items() if buckets is None or int(k) in buckets)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self) -> tuple[DataFrame, DataFrame]:
        return self._read("nodes"), self._read("edges")

    def save(self, nodes: DataFrame | None, edges: DataFrame | None, touched: dict[str, set[int]] | None = None) -> int:
        """Write the next version, then make it current; readers of the old one are not disturbed.

        With ``touched`` the rows are those of the given buckets only; the other buckets stay as they are.
        """
        versions = self._versions()
        version = max(versions, default=0) + 1
        manifest = self._manifest() if versions and touched is not None else {"nodes": {}, "edges": {}}
        for part, rows, of in (("nodes", nodes, node_bucket()), ("edges", edges, edge_bucket())):
            if touched is not None:
                manifest[part] = {k: v for k, v in manifest[part].items() if int(k) not in touched[part]}
                if not touched[part]:
                    continue
            at = f"v{version}/{part}"
            rows.withColumn("bucket", of).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")
            fs, p = self._fs(f"{self.path}/{at}")
            names = [f.getPath().getName() for f in fs.listStatus(p)]
            manifest[part] |= {n.removeprefix("bucket="): f"{at}/{n}" for n in names if n.startswith("bucket=")}
        fs, p = self._fs(f"{self.path}/v{version}/_CURRENT")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        return version

    @staticmethod
    def _buckets(rows: DataFrame, of: Column) -> set[int]:
        return {r[0] for r in rows.select(of).distinct().collect()}  # no more than BUCKETS

    def _change(self, files: DataFrame, nodes: list[Step], edges: list[Step]) -> int:
        """Remove what ``files`` (``path``) own, then apply steps; only the buckets that this touches are read whole and written."""
        old, links = self.read()
        gone = old.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("label", "key")
        ends = [links.join(gone.select(F.col("label").alias(x), F.col("key").alias(y)).distinct(), [x, y], "left_semi").select("from_key") for x, y in ENDS]
        at_gone = ends[0].union(ends[1])
        touched = {"nodes": self._buckets(files.select(F.col("path").alias("file"), F.lit("").alias("key")), node_bucket()), "edges": self._buckets(at_gone, edge_bucket())}
        for part, steps, of in (("nodes", nodes, node_bucket()), ("edges", edges, edge_bucket())):
            for s in steps:
                touched[part] |= self._buckets(s.rows, of)
        own = self._read("nodes", touched["nodes"]).join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select("label", "key", "file", "props")
        for s in nodes:
            own = (create_nodes if s.kind == "create nodes" else merge_nodes)(own, s.rows)
        every = own.select("label", "key").unionByName(self._read("nodes", set(range(BUCKETS)) - touched["nodes"]).select("label", "key"))
        kept = without_ends(self._read("edges", touched["edges"]), gone)
        for s in edges:
            kept = (create_edges if s.kind == "create edges" else merge_edges)(every, kept, s.rows)
        return self.save(own, kept, touched)

    def _files(self, *paths: str) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")

    def write_delta(self, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], file: str | None = None) -> dict:
        """The counts are those of the delta, not of its effects."""
        steps = plan_delta(nodes, edges, file)
        self._change(self._files(*[file] if file else []), [s for s in steps if s.kind.endswith("nodes")], [s for s in steps if s.kind.endswith("edges")])
        return report(nodes, edges, steps)

    def replace_files(self, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
        """What ``files`` (``path``) own is replaced by the given rows."""
        return self._change(files, [Step("create nodes", "", nodes)], [Step("create edges", "", edges)])

    def delete_file(self, file: str) -> int:
        return self._change(self._files(file), [], [])

    def clear(self) -> int:
        return self.save(*clear(*self.read()))

    def write_filesystem(self, **changes) -> int:
        return self.save(*write_filesystem(*self.read(), **changes))

    def graphs(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def catalog(self) -> dict[str, list]:
        nodes, edges = self.read()
        return {"labels": sorted(r[0] for r in nodes.select("label").distinct().collect()), "types": sorted(r[0] for r in edges.select("type").distinct().collect()), "indexes": list(INDEXES), "constraints": list(CONSTRAINTS)}


#: Fixed value: graphs of this prefix belong to tests.
TEST_PREFIX = "cpg_test_"


def open_store(spark: SparkSession, folder: str, graph: str, bootstrap: bool = True) -> Store:
    """A store for real data; a graph that belongs to tests is refused, whatever the settings."""
    if graph.startswith(TEST_PREFIX):
        raise ValueError(f"the prefix {TEST_PREFIX} is kept for tests: {graph}")
    store = Store(spark, folder, graph)
    if bootstrap:
        store.bootstrap()
    return store


class NullStore:
    """Counts what would be written."""

    def write_delta(self, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], file: str | None = None) -> dict:
        return report(nodes, edges, plan_delta(nodes, edges, file))


def report(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], steps: list[Step]) -> dict:
    return {"nodes": sum(d.count() for d in nodes.values()), "edges": sum(d.count() for d in edges.values()), "operations": len(steps), "at": int(time.time())}


def to_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True)
