"""Content-selected positions of texts, and what surrounds those that several texts share.

A window is a number of consecutive words.  Of the ``GRAM``-word grams of each window the one with the least
hash is selected (every one, on ties), so equal windows select the same gram wherever they stand.
Grams selected in two or more different texts are anchors; a match of a window's length always holds
an anchor's gram, and lies inside that anchor's segment: the words up to a window around the gram.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, give_back, kept, stored, sub_batches

WINDOW, GRAM = 50, 10
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode().split()


def codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` consecutive values."""
    op, step = (np.minimum if least else np.maximum), 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def grams(code: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed hash of each ``gram`` consecutive codes."""
    h = np.zeros(len(code) - gram + 1, np.uint64)
    for j in range(gram):
        h = h * _ODD + code[j : len(code) - gram + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def selected(code: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash and position of each selected gram, and where the first and last window start that select it.

    Each window selects its least gram, the leftmost on ties, so every window belongs to one gram.
    """
    if len(code) < window:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h, width = grams(code, gram), window - gram + 1
    least = _sliding(h, width, True)
    values, of = np.unique(least, return_inverse=True)
    where = np.searchsorted(values, h)
    where[where == len(values)] = 0
    at = np.flatnonzero(values[where] == h)
    places = np.sort(where[at] * len(h) + at)
    pos = places[np.searchsorted(places, of * len(h) + np.arange(len(least)))] % len(h)
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    return h[pos[first]], pos[first], first, last


def merged(spans: list) -> list[list[int]]:
    """Overlapping or touching ``[start, end)`` as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: distinct segments per shard on average, and of one anchor above which they are dealt by what surrounds it
SHARD_SEGMENTS, CROWDED = 4_000, 16_000
LAST = 2**63 - 1  # stands for a null id: no document is larger


def own_id() -> F.Column:
    return F.coalesce("doc_id", F.lit(LAST))


def _profile(window: int, gram: int):
    """A row for each text: counts, a key of its words, and its anchors."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        kept("anchors")
        for batch in batches:
            for part in sub_batches(batch, 1):
                n, key, sha, offsets, cols = [], [], [], [0], [[], [], [], []]
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    line = b" ".join(words)
                    n.append(len(words))
                    key.append(xxhash.xxh3_128_digest(line))
                    sha.append(hashlib.sha256(line).digest())
                    h, pos, first, last = selected(codes(words), window, gram)
                    for col, x in zip(cols, (h.view(np.int64), pos, first, last + window)):
                        col.append(x)
                    offsets.append(offsets[-1] + len(h))
                flat = [pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
                anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sha, pa.binary()), anchors], ["doc_id", "raw", "n_words", "text_key", "sha", "anchors"])

    return run


def profile(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``text_key, doc_id, own, n_words, sha, least, most`` of each row of ``docs`` (``doc_id, text``), and ``text_key, raw, doc,
    top, anchors`` of each row that stands for its text.

    ``own`` is the id, or :data:`LAST`; ``raw`` a hash of the whole text; ``text_key`` a 128-bit key of the words, by which texts are told
    apart (whatever their ids); ``least`` and ``most`` (``doc`` and ``top``) are the ids of the rows with the same words.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    made = rows.mapInArrow(_profile(window, gram), "doc_id long, raw long, n_words long, text_key binary, sha binary, anchors array<struct<h:long,pos:int,start:int,end:int>>")
    made = stored(made, "anchors").withColumn("own", own_id())
    classes = stored(made.groupBy("text_key").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("n")), "anchors-texts")
    profiles = stored(attach(made.drop("anchors", "raw"), classes, ["text_key"]).drop("n"), "anchors-rows")
    searched = attach(made.where(F.size("anchors") > 0).select("text_key", "own", "raw", "anchors"), classes, ["text_key"])
    return profiles, searched.where("own = least").select("text_key", "raw", F.col("least").alias("doc"), F.col("most").alias("top"), "anchors")


CUT = "seg binary, h long, at int, len int, words binary, sides array<long>, doc long, top long, raw long, text_key binary, starts array<int>"


def _cut(half: int):
    """The segments' words, from the texts: one row for equal segments of a text, with all their places.

    ``sides`` are keys of the ``half`` words from the anchor on and before it: a window around the anchor holds the one or the other.
    """
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, 4):
                out: list[tuple] = []
                for doc, top, raw, text_key, text, found in zip(*[c.to_pylist() for c in part.columns]):
                    words = words_of(text)
                    places: dict[tuple, list[int]] = {}
                    for x in found:
                        line = b" ".join(words[x["start"] : x["end"]])
                        places.setdefault((x["h"], x["pos"] - x["start"], line), []).append(x["start"])
                    for (h, at, line), starts in places.items():
                        pos, n = starts[0] + at, line.count(b" ") + 1
                        sides = [xxhash.xxh64_intdigest(b"R" + b" ".join(words[pos : pos + half])) - 2**63] if n - at >= half else []
                        sides += [xxhash.xxh64_intdigest(b"L" + b" ".join(words[pos - half : pos])) - 2**63] if at >= half else []
                        seg = xxhash.xxh3_128_digest(line, seed=at)
                        out.append((seg, h, at, n, line, sides, doc, top, raw, text_key, starts))
                cols = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in CUT.split(", ")])

    return run


def segments(docs: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """A row (:data:`CUT`) for each distinct segment of each distinct text around the anchors that several texts select, stored.

    ``doc`` and ``top`` are the least and the largest id of the text's rows; only anchors that occur under two ids take part.
    """
    rows = stored(rows, "anchors-searched")
    selects = rows.select("doc", "top", F.explode(F.array_distinct(F.col("anchors.h"))).alias("h"))
    shared = selects.groupBy("h").agg(F.min("doc").alias("x"), F.max("top").alias("y"), F.count("*").alias("n")).where("x < y and n > 1").select("h", "n")
    anchors = rows.select("doc", "top", "raw", "text_key", F.explode("anchors").alias("a")).select("doc", "top", "raw", "text_key", "a.*")
    wanted = attach(anchors, stored(shared, "anchors-shared"), ["h"]).groupBy("doc", "raw", "text_key", "top").agg(F.collect_set(F.struct("h", "pos", "start", "end")).alias("found"))
    given = docs.select(own_id().alias("doc"), F.xxhash64("text").alias("raw"), "text")
    texts = given.join(wanted, ["doc", "raw"]).select("doc", "top", "raw", "text_key", "text", "found")
    return stored(texts.mapInArrow(_cut(window // 2), CUT), "segments")


def _windows(window: int):
    """Each window of crowded segments: ``key, seg, start, least, most``."""

    def run(batches):
        for batch in batches:
            out = []
            for seg, line, least, most in zip(*[c.to_pylist() for c in batch.columns]):
                words = line.split()
                out += [(xxhash.xxh3_128_digest(b" ".join(words[k : k + window])), seg, k, least, most) for k in range(len(words) - window + 1)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["key", "seg", "start", "least", "most"])

    return run


FOUND = "seg binary, start int, end int, first long"


def matches(cut: DataFrame, work, window: int, crowded: int = CROWDED) -> DataFrame:
    """:data:`FOUND`: what ``work`` finds among the distinct segments, which meet in shards by their anchors.

    Segments that are equal go to their shard as one row, put together before the shuffle.  Those of an anchor that has more than ``crowded``
    distinct ones meet by the words on either side of the anchor, one of which every two equal windows have in common; where
    even that is crowded they are cut down to single windows, which are equal as a whole or not at all.
    """
    reps = cut.groupBy("seg").agg(*[F.first(c).alias(c) for c in ("h", "at", "words", "sides")], F.min("doc").alias("least"), F.max("top").alias("most"))
    shards = max(1, -(-cut.count() // SHARD_SEGMENTS))
    columns = ["seg", "at", "words", "least", "most"]

    def searched(rows: DataFrame, *to: str) -> DataFrame:
        placed = rows.select(F.pmod(F.xxhash64(*to), F.lit(shards)).cast("int").alias("shard"), *columns)
        parts = min(shards, 20_000)
        return placed.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "least").mapInArrow(by_shard(work), FOUND)

    crowds = stored(cut.select("h", "seg").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowded), "segments-crowds")
    if crowds.isEmpty():
        return searched(reps, "h")
    known = attach(reps, crowds, ["h"], "left")
    sides = stored(known.where("n is not null").select("h", *columns, F.explode("sides").alias("side")), "segments-sides")
    crowds = stored(sides.groupBy("h", "side").agg(F.count("*").alias("n")).where(F.col("n") > crowded), "segments-sides-crowds")
    out = searched(known.where("n is null"), "h")
    if crowds.isEmpty():
        return out.union(searched(sides, "h", "side"))
    known = attach(sides, crowds, ["h", "side"], "left")
    out = out.union(searched(known.where("n is null"), "h", "side"))
    windows = known.where("n is not null").select("seg", "words", "least", "most").distinct().mapInArrow(_windows(window), "key binary, seg binary, start int, least long, most long")
    windows = stored(windows, "segments-windows")
    equal = stored(windows.groupBy("key").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.count("*").alias("n")).where("first < last"), "segments-windows-equal")
    return out.union(attach(windows.select("key", "seg", "start"), equal, ["key"]).select("seg", "start", (F.col("start") + window).alias("end"), "first"))


def by_shard(work):
    """Apply ``work(entries)`` to each shard's rows (``seg, at, words, least, most``, by least id); it yields :data:`FOUND`."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64()))], ["seg", "start", "end", "first"])

    def run(batches):
        shard, entries = None, {}
        kept("anchors")
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                if row[0] != shard:
                    if entries:
                        yield emit(list(squeezed(work(list(entries.values())))))
                    shard, entries = row[0], {}
                entries.setdefault(row[1], row[1:])  # by both sides of a crowded anchor a segment may come twice
        if entries:
            yield emit(list(squeezed(work(list(entries.values())))))
        entries.clear()
        give_back()

    return run


def squeezed(rows):
    """Windows that follow each other in one segment as one span."""
    held = None
    for seg, a, b, first in sorted(rows):
        if held and held[0] == seg and a <= held[2]:
            held[2], held[3] = max(held[2], b), min(held[3], first)
        else:
            if held:
                yield tuple(held)
            held = [seg, a, b, first]
    if held:
        yield tuple(held)
