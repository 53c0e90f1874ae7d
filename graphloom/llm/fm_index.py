"""Substring dedup with a compressed FM-index per shard.

A shard's distinct segments form one text of word numbers.  Its Burrows-Wheeler transform is kept
in a wavelet tree (levels of packed bits with block counts).  Backward search runs over
all queries of the shard in step: an interval is extended to the left while it has another
occurrence, else it falls back to its parent interval, which gives each position's matching
statistics; matches of a window's length are reported with the smallest document that has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import attach, id_and_text, stored


class Bits:
    """Packed bits with counts before each block of 64."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 2, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Of ``text``, numbers with 0 as separator at the start and end and between its parts; matches up to ``depth`` long."""

    def __init__(self, text: np.ndarray, depth: int):
        n = self.n = len(text)
        size = int(text.max()) + 1
        ranks, step = [text.astype(np.int32)], 1
        while step < depth + 1:
            r = ranks[-1].astype(np.int64)
            key = r * (int(r.max()) + 2)
            key[: n - step] += r[step:] + 1
            _, rank = np.unique(key, return_inverse=True)
            ranks.append(rank.astype(np.int32))
            step *= 2
            if rank.max() == n - 1:
                break
        self.sa = np.argsort(ranks[-1], kind="stable")
        counts = np.bincount(text, minlength=size)
        self.bits = max(1, (size - 1).bit_length())
        level = text[self.sa - 1]  # position 0 is preceded by the last one, a separator as well
        self.levels: list[Bits] = []
        for b in reversed(range(self.bits)):
            bit = (level >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            level = np.concatenate([level[~bit], level[bit]])
        del level, bit
        self.shift = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.shift = self.shift - self._down(np.arange(size), np.zeros(size, np.int64))
        # the common length of each suffix and the one before it in order, from the ranks by length
        lcp = np.zeros(n + 1, np.int32)
        a, b = self.sa[:-1].copy(), self.sa[1:].copy()
        for k in reversed(range(len(ranks))):
            same = (a < n) & (b < n)
            same[same] = ranks[k][a[same]] == ranks[k][b[same]]
            lcp[1:n][same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        lcp[0] = lcp[n] = -1
        self.lcp = lcp.astype(np.int16) if depth < 2**14 else lcp
        self.less_before, self.less_after = (self._smaller(lcp, way).astype(np.int32) for way in (-1, 1))

    @staticmethod
    def _smaller(lcp: np.ndarray, way: int) -> np.ndarray:
        """The nearest place with a smaller value, before or after each (itself at the ends)."""
        at = np.clip(np.arange(len(lcp)) + way, 0, len(lcp) - 1)
        todo = np.flatnonzero(lcp[at] >= lcp)
        todo = todo[lcp[todo] >= 0]
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[lcp[at[todo]] >= lcp[todo]]
        return at

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` arrives below all levels of the wavelet tree, on the way of symbol ``c``."""
        for b, level in zip(reversed(range(self.bits)), self.levels):
            ones = level.rank(i)
            i = np.where(c >> b & 1, level.zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one more symbol in front."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.concatenate([self.shift[c]] * 2)
        return both[: len(c)], both[len(c) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, and the length of match that they stand for."""
        x, y = self.lcp[lo], self.lcp[hi]
        up_lo, up_hi = np.where(x >= y, self.less_before[lo], lo), np.where(y >= x, self.less_after[hi], hi)
        return up_lo, up_hi, np.maximum(np.maximum(x, y), 0)


class LeastOf:
    """Least value in ranges, by a sparse table that grows with the widest range asked for."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        while len(self.rows) <= k.max():
            step = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))
        out = np.empty(len(lo), np.int32)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.rows[level][lo[at]], self.rows[level][hi[at] - 2**level])
        return out


def matches(index: FMIndex, least: LeastOf, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, need: np.ndarray, window: int):
    """``query, start, least value`` of each window of the queries that occurs ``need`` times or more.

    ``text`` holds the queries' symbols (-1: in no indexed segment).  All queries advance in step.
    """
    lane = np.flatnonzero(lengths >= window)
    end = lengths[lane].copy()
    at = end.copy()  # the match is [at, end)
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        c = text[begins[lane] + at - 1]
        new_lo, new_hi = index.extend(np.maximum(c, 0), lo, hi)
        good = (c > 0) & (new_hi - new_lo >= need[lane])
        lo, hi, at = np.where(good, new_lo, lo), np.where(good, new_hi, hi), at - good
        full = good & (end - at == window)
        if full.any():
            out.append((lane[full], at[full], least(lo[full], hi[full])))
        # a full window goes on with its last word left off; a failed one falls back to its parent interval
        fall = ~good | full
        if fall.any():
            up_lo, up_hi, length = index.parent(lo[fall], hi[fall])
            was = end[fall] - at[fall]
            wide = np.where(full[fall], length == window - 1, True)
            empty = ~full[fall] & (was == 0)  # the word has no other occurrence: start anew before it
            at[fall] -= empty
            end[fall] = np.where(full[fall], end[fall] - 1, at[fall] + np.where(empty, 0, np.minimum(length, was)))
            lo[fall] = np.where(empty, 0, np.where(wide, up_lo, lo[fall]))
            hi[fall] = np.where(empty, index.n, np.where(wide, up_hi, hi[fall]))
        on = end >= window
        if not on.all():
            lane, end, at, lo, hi = lane[on], end[on], at[on], lo[on], hi[on]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _search(window: int):
    """The work on one shard: windows that a document with a smaller id has as well."""

    def work(entries: list[tuple]):
        ids: dict[bytes, int] = {}
        parts = [[ids.setdefault(w, len(ids) + 1) for w in line.split()] for _, _, line, _, _ in entries]
        indexed = np.fromiter((x for p in parts for x in (0, *p)), np.int32, sum(map(len, parts)) + len(parts))
        indexed = np.append(indexed, np.int32(0))
        owner = np.repeat([least for *_, least, _ in entries], [len(p) + 1 for p in parts])
        docs, rank = np.unique(np.append(owner, owner[-1]), return_inverse=True)
        index = FMIndex(indexed, max(map(len, parts)) + 1)
        least = LeastOf(rank[index.sa])
        del indexed, owner, rank
        index.sa = None
        lengths = np.array([len(p) for p in parts])
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.fromiter((x for p in parts for x in p), np.int32, int(lengths.sum()))
        lane, at, first = matches(index, least, text, begins, lengths, np.full(len(parts), 2), window)
        own = np.array([least for *_, least, _ in entries])
        smaller = docs[first] < own[lane]
        for k, a, d in zip(lane[smaller].tolist(), at[smaller].tolist(), docs[first[smaller]].tolist()):
            yield entries[k][0], a, a + window, d

    return work


def _keep(batches):
    """What is left of each text without its spans."""
    for batch in batches:
        n, kept = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = anchors.words_of(text)
            left, last, gone = [], 0, 0
            for a, b in anchors.merged([(s["start"], s["end"]) for s in spans]):
                left += words[last:a]
                last, gone = b, gone + b - a
            n.append(gone)
            kept.append(b" ".join(left + words[last:]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())], ["text_key", "gone", "kept_text", "left_sha"])


def substring_dedup(docs: DataFrame, window: int = anchors.WINDOW, crowded: int = anchors.CROWDED, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every whole text, and with ``texts`` also ``kept_text``.

    Removed is each word in a window of ``window`` consecutive words (between ASCII white space)
    whose words also start in a document with a smaller id; windows are judged on the input.
    ``kept_text`` has the other words joined by one space, null where nothing is removed.
    Null and empty texts have no words; rows are told apart by their words, so several texts under one id are judged each by itself
    and keep each other, as repeated rows do; rows without an id count as
    larger than any and keep each other; an empty table gives no rows; other columns are not read.

    Of texts with equal words only the one with the smallest id is searched, and of equal segments one: the others lose all their
    words if they have a window.  A search runs inside the shards of the anchors.
    """
    given = id_and_text(docs, id_col, text_col)
    profiles, searched = anchors.profile(given, window)
    cut = anchors.segments(given, searched, window)
    found = anchors.matches(cut, _search(window), window, crowded)
    found = found.groupBy("seg").agg(F.collect_set(F.struct("start", "end", "first")).alias("found"))
    equal = cut.groupBy("seg").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("len").alias("len"), F.count("*").alias("n"))
    known = stored(equal.join(found, "seg", "left").where("least < most or found is not null"), "dedup-segments")
    members = attach(cut.select("seg", "doc", "raw", "text_key", "starts"), known, ["seg"])
    at = lambda start, a, b: F.struct((start + a).alias("start"), (start + b).alias("end"))
    whole = F.transform("starts", lambda x: at(x, F.lit(0), F.col("len")))
    own = F.flatten(F.transform("starts", lambda x: F.transform(F.filter("found", lambda s: s["first"] < F.col("doc")), lambda s: at(x, s["start"], s["end"]))))
    spans = members.select("doc", "raw", "text_key", F.explode(F.when(F.col("doc") > F.col("least"), whole).otherwise(own)).alias("s"))
    by_text = spans.groupBy("doc", "raw", "text_key").agg(F.collect_set("s").alias("spans"))
    rows = given.select(anchors.own_id().alias("doc"), F.xxhash64("text").alias("raw"), "text")
    changed = rows.join(by_text, ["doc", "raw"]).select("text_key", "text", "spans")
    kind = "text_key binary, gone long, kept_text string, left_sha string"
    kept = changed.mapInArrow(_keep, kind).select("text_key", "gone", "left_sha", *["kept_text"] * texts).dropDuplicates(["text_key"])
    copy, sha = F.col("own") > F.col("least"), F.lower(F.hex("sha"))
    out = lambda df, gone, left, text: df.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), left.alias("kept_sha256"), *[text.alias("kept_text")] * texts)
    none = F.lit(None).cast("string")
    first = profiles.where((F.col("n_words") >= window) & ~copy).join(kept, "text_key", "left")
    return (
        out(first, F.coalesce("gone", F.lit(0)), F.coalesce("left_sha", sha), F.col("kept_text") if texts else none)
        .union(out(profiles.where(copy & (F.col("n_words") >= window)), F.col("n_words"), F.sha2(F.lit(""), 256), F.lit("")))
        .union(out(profiles.where(F.col("n_words") < window), F.lit(0), sha, none))
    )
