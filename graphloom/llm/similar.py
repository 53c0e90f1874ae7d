"""Near-duplicates by the share of word shingles that two texts have in common: SimHash with an exact check.

Candidates are the links of the SimHash operator, with fingerprints of shingles of the wanted length, and
besides texts that share a band of MinHash values: at a share of 0.8 two fingerprints differ in about ten of 64 bits,
so an index of at most three finds under one in a hundred such pairs, and an index of more bits would look at
most of all pairs.  Bands are so many that a pair at 0.8 is missed with a chance below 1 in 10,000.  All candidates that hang
together meet in one task with their texts, where each link is checked by its exact share (Jaccard) before it counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, give_back, id_and_text, kept, map_batches, stored
from .simhash import components, links, majority, shingle_hashes

#: a pair at 0.8 meets in no band with a chance of (1 - 0.8 ** ROWS) ** BANDS = 0.00006
BANDS, ROWS = 32, 6
#: shingles whose MinHash values are made at once
BLOCK = 2048

_RNG = np.random.default_rng(23)
_MIX, _ODD = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingles(text: str, words: int = 5) -> tuple[int, bytes, np.ndarray]:
    """XXH64 of the words, the fingerprint, and the distinct XXH64 of their shingles in order (one shingle if there are too few words)."""
    found = text.encode().lower().split()
    digests = shingle_hashes(found, words)
    return xxhash.xxh64_intdigest(b" ".join(found), 43), majority(digests) if found else bytes(8), np.unique(np.frombuffer(digests, ">u8").astype("<u8"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for start in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[None, start : start + BLOCK] ^ _MIX) * _ODD).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Index pairs (a spanning forest) that connect what pairs with a share of ``least`` or more connect."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, starts[1:])
    mark = np.zeros(len(codes), bool)
    left, links = np.arange(len(sets)), []
    held, at, flat = left, starts, codes
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            if 2 * len(left) <= len(held):
                held, flat = left, np.concatenate([own[j] for j in left])
                at = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
            mark[own[i]] = True
            both = np.add.reduceat(mark[flat], at, dtype=np.int64)[np.searchsorted(held, left)]
            mark[own[i]] = False
            near = both >= least * (sizes[i] + sizes[left] - both) - 1e-9
            new = left[near].tolist()
            links += [(i, j) for j in new]
            todo += new
            left = left[~near]
    return links


def _rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, raw, node, fp, keys, text`` of every text; equal words have equal nodes, equal texts equal hashes ``raw``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept("simhash")
        found = [(n, f, band_keys(h)) for n, f, h in (shingles(t, words) for t in batch.column(1).to_pylist())]
        nodes = pa.array(np.array([n for n, _, _ in found], "u8").view("i8"))
        fps = pa.array(np.frombuffer(b"".join(f for _, f, _ in found), ">i8").astype("<i8"))
        keys = pa.array([k for _, _, k in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nodes, fps, keys, batch.column(1)], ["doc_id", "raw", "node", "fp", "keys", "text"])

    given = id_and_text(docs, id_col, text_col).withColumn("raw", F.xxhash64("text"))
    return map_batches(given, run, "doc_id long, raw long, node long, fp long, keys array<long>, text string")


def _meetings(batches):
    """Over rows sorted by key: each member of a key with the key's first one."""
    last, first = None, None
    for batch in batches:
        a, b = [], []
        for key, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                last, first = key, node
            elif node != first:
                a.append(first)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(words: int, least: float):
    """Over rows sorted by root: the links among each root's members."""

    def run(batches):
        last, nodes, sets = None, [], []
        kept("simhash")

        def flush() -> pa.RecordBatch:
            pairs = similar_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for root, node, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if root != last:
                    yield flush()
                    last, nodes, sets = root, [], []
                nodes.append(node)
                sets.append(shingles(text, words)[2])
        yield flush()
        nodes, sets = [], []
        give_back()

    return run


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes whose fingerprints differ in at most three bits, as far as it takes to connect them all."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "similar-fingerprints")
    equal = attach(nodes.select("fp", "node"), heads, ["fp"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    found = links(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_head")) for x in "ab"]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return equal.union(near).where("a <> b")


def _classes(docs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (:func:`_rows`), and ``node, root, n`` of each distinct text: equal roots are linked; ``n`` rows have the text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(_rows(docs, words, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "similar")
    # equal texts are one node, with one row to stand for it
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.count("*").alias("n")), "similar-nodes")
    keys = rows.select("row", "node", "keys").join(nodes.select("row"), "row", "left_semi")
    bands = keys.select(F.explode("keys").alias("key"), "node").repartition(parts, "key").sortWithinPartitions("key", "node")
    met = components(bands.mapInArrow(_meetings, "a long, b long").union(_fingerprint_links(nodes)).distinct())
    met = met.unionByName(met.select(F.col("root").alias("node"), "root")).distinct()
    asked = nodes.select("node", "row").join(met, "node").select("row", "root", "node")
    sets = asked.join(rows.select("row", "text"), "row").select("root", "node", "text").repartition(parts, "root").sortWithinPartitions("root", "node")
    found = components(sets.mapInArrow(_verified(words, least), "a long, b long"))
    return rows, stored(nodes.select("node", "n").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n"), "similar-roots")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row.

    Links join texts that have a share of ``least`` or more of their distinct shingles in common (of all
    that either has); ``component_id`` is the smallest ``doc_id`` reachable.  Case of ASCII letters and white space
    do not count.  Null and empty texts are equal; a text of up to ``words`` words is one shingle; an empty
    table gives no rows; rows with a null id are returned, but name no component; other columns are not read.
    """
    rows, classes = _classes(docs, words, least, id_col, text_col)
    at = attach(rows.select("doc_id", "node"), classes, ["node"]).select("doc_id", "root")
    roots = stored(at.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "similar-components")
    return attach(at, roots, ["root"]).select("doc_id", "component_id")


def distinct_texts(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each group that :func:`near_duplicates` links.

    It is the row with the smallest id; rows without an id stay only where their group has none with one.  Rows are told apart by id and text, so of
    different texts under one id (or without one) each is judged by itself, and of repeated rows one stays, any one where only other
    columns differ.  Null texts are one group with empty ones; an empty table gives no rows.
    """
    own = lambda c: F.coalesce(c.cast("long"), F.lit(2**63 - 1))
    rows, classes = _classes(docs, words, least, id_col, text_col)
    at = attach(rows.select(own(F.col("doc_id")).alias("own"), "raw", "node"), classes, ["node"]).select("own", "raw", "root")
    first = stored(at.groupBy("root").agg(F.min("own").alias("own"), F.count("*").alias("n")), "similar-first")
    # of several texts of the group under that id, the one with the least hash
    stay = attach(at, first.withColumnRenamed("own", "first"), ["root"]).where("own = first").groupBy("root", "own").agg(F.min("raw").alias("raw")).select("own", "raw")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), own(docs[id_col]).alias("own"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("raw"))
    one = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("own", "raw").orderBy(F.lit(0)))).where("copy = 1")
    return one.join(stay, ["own", "raw"], "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])
