"""SimHash near-duplicates by one-wildcard segment variants.

Two 64-bit fingerprints that differ in at most three bits have, among two 32-bit segments,
one that differs in at most one bit.  So each distinct fingerprint is indexed under every
segment with one bit blanked (64 keys), rows with equal keys meet, and the pairs are verified.
A key with very many fingerprints is refined by the same rule on the other segment's halves,
which bounds any group by its 18 free bits.  Groups hand on a spanning forest of
their verified links, never all pairs; components come from alternating star contraction.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, id_and_text, kept, map_batches, stored

#: members of a key above which it is refined, and of a refined key above which neighbours are looked up
CROWDED = 1024


def shingle_hashes(found: list[bytes], words: int, seed: int = 42) -> bytes:
    """XXH64 (big-endian) of each shingle of lower-case words, repeats included; of the whole sequence if there are fewer."""
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_digest(line, seed)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *[e + 1 for e in ends]]
    return b"".join(map(xxhash.xxh64_digest, [line[a:b] for a, b in zip(starts, ends[words - 1 :])], repeat(seed)))


def majority(digests: bytes) -> bytes:
    """Eight bytes: the bits set in over half of the hashes."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprint(text: str, words: int = 3, seed: int = 42) -> bytes:
    """The bits set in over half of the shingles' XXH64; zero without words."""
    found = text.encode().lower().split()
    return majority(shingle_hashes(found, words, seed)) if found else bytes(8)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept("simhash")
        bits = b"".join([fingerprint(t, words) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(bits, ">i8").astype("<i8"))], ["doc_id", "fp"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def forest_links(fps: np.ndarray, bits: int = 3) -> list[tuple[int, int]]:
    """Index pairs (a spanning forest) that connect what links of at most ``bits`` differing bits connect.

    Every member is reached once.  Small groups compare a member with those not reached yet;
    for large ones its neighbours within the bits that vary at all are looked up,
    so work stays in proportion to the members.
    """
    n, links = len(fps), []
    if n <= 4 * CROWDED:
        left = np.arange(n)
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i = todo.pop()
                near = np.bitwise_count(fps[left] ^ fps[i]) <= bits
                if near.any():
                    new = left[near].tolist()
                    links += [(i, j) for j in new]
                    todo += new
                    left = left[~near]
        return links
    order = np.argsort(fps, kind="stable")
    ranked = fps[order]
    varies = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [1 << k for k in range(64) if varies >> k & 1]
    masks = [np.uint64(sum(flip)) for some in range(1, bits + 1) for flip in combinations(free, some)]
    fresh = np.ones(n, bool)
    for start in range(n):
        if not fresh[start]:
            continue
        fresh[start] = False
        front = np.array([start])
        while len(front):
            reached = []
            for mask in masks:
                at = np.minimum(np.searchsorted(ranked, ranked[front] ^ mask), n - 1)
                hit = (ranked[at] == ranked[front] ^ mask) & fresh[at]
                new, first = np.unique(at[hit], return_index=True)
                fresh[new] = False
                links += zip(order[front[hit][first]].tolist(), order[new].tolist())
                reached.append(new)
            front = np.concatenate(reached)
    return links


def _by_runs(crowded: int | None):
    """A function over batches sorted by key: links within each key's members, or the members if there are too many.

    Members of a key beyond ``crowded`` are handed on as they come, so no key is held whole.
    """

    def run(batches):
        key_kept, kept, held, over = None, [], 0, False

        def flush(out: list):
            if not kept:
                return
            fps = np.unique(np.concatenate(kept)) if len(kept) > 1 else np.unique(kept[0])
            if over or (crowded and len(fps) > crowded):
                out += [(f, f, key_kept) for f in fps.astype(np.int64).tolist()]
                return
            if len(fps) < 2:
                return
            signed = fps.astype(np.int64)
            out += [(int(signed[i]), int(signed[j]), None) for i, j in forest_links(fps)]

        def table(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "crowd"])

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            # runs of one row, the usual case, need no work unless they join a neighbouring batch
            sizes, out = np.diff(cuts), []
            wanted = sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()})
            fp = fp.astype(np.int64).view(np.uint64)
            for r in wanted:
                part, this = fp[cuts[r] : cuts[r + 1]], int(key[cuts[r]])
                if key_kept != this:
                    flush(out)
                    key_kept, kept, held, over = this, [], 0, False
                kept.append(part)
                held += len(part)
                if crowded and held > 4 * crowded:
                    over = True  # fingerprints are distinct, and so are a key's rows
                    flush(out)
                    kept, held = [], 0
            yield table(out)
        if kept:
            flush(out := [])
            yield table(out)

    return run


def _variants(above, at: int, segment, width: int) -> list:
    """A key for each blanked bit of a segment; its lowest bit tells an even place ``at`` from an odd one."""
    keys = [F.xxhash64(above, F.lit(at * width + k), segment.bitwiseAND(F.lit(~(1 << k)).cast("long"))) for k in range(width)]
    return [k.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.lit(at & 1).cast("long")) for k in keys]


def _links_of(variants: DataFrame, parts: int, crowded: int | None) -> DataFrame:
    return variants.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_by_runs(crowded), "a long, b long, crowd long")


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links of at most three bits between distinct fingerprints ``fp`` that connect all that such links connect."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp, low = F.col("fp"), F.lit(0xFFFFFFFF).cast("long")
    segments = [fp.bitwiseAND(low), F.shiftrightunsigned(fp, 32)]
    keys = [k for at, segment in enumerate(segments) for k in _variants(F.lit(32), at, segment, 32)]
    first = stored(_links_of(fps.select(F.explode(F.array(*keys)).alias("key"), "fp"), parts, CROWDED), "simhash-links")
    crowds = first.where("crowd is not null")
    out = first.where("crowd is null").select("a", "b").distinct()
    if not crowds.isEmpty():
        # the members of a crowd share one segment (even key: the low one), so the other one's halves tell them apart
        other = F.when(F.col("crowd").bitwiseAND(F.lit(1).cast("long")) == 0, F.shiftrightunsigned(F.col("a"), 32)).otherwise(F.col("a").bitwiseAND(low))
        halves = [other.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftrightunsigned(other, 16)]
        finer = [k for at, half in enumerate(halves) for k in _variants(F.col("crowd"), at, half, 16)]
        again = _links_of(crowds.select(F.explode(F.array(*finer)).alias("key"), F.col("a").alias("fp")), parts, None)
        out = out.union(stored(again, "simhash-crowds").select("a", "b")).distinct()
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node connected to each node that ``edges`` (``a, b``) names.

    Alternating large and small stars; each round is written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    sign = None
    while True:
        both = now.union(now.select("u", "v").toDF("v", "u"))
        least = both.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, both["v"] == least["x"]).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.join(least, large["v"] == least["x"]).select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        now = stored(small, "stars")
        was, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if was == sign:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Links join fingerprints with at most three differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable.  Null and empty texts have fingerprint zero and link like any other;
    equal fingerprints are one node, so groups of copies cost one row; an empty table gives no
    rows; rows with a null id are returned, but name no component (theirs is null unless
    a row with an id is reachable); other columns are not read.
    """
    rows = stored(fingerprints(docs, words, id_col, text_col), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(nodes.select("fp")))
    at = stored(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "simhash-roots")
    roots = stored(at.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "simhash-components")
    classes = stored(attach(at, roots, ["root"], n="fps").select("fp", "n", "component_id"), "simhash-classes")
    return attach(rows, classes, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
