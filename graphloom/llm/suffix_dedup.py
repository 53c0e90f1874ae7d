"""Passages that texts share, by sparse suffix arrays.

Only suffixes that start at anchors are retained.  Each shard sorts its suffixes, compares
neighbours for their common length to the right, and extends matches to the left: for each number of
words to the left, suffixes with equal left context are neighbours in suffix order again, so a
match is found whatever other suffixes sort between its two places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import attach, id_and_text, stored


def shared_windows(left: np.ndarray, right: np.ndarray, doc: np.ndarray, last: np.ndarray, window: int):
    """``entry, words to the left, least doc`` of the windows around anchors that two documents or more have.

    ``doc`` and ``last`` are the smallest and largest document of an entry; ``left`` and ``right`` hold the word numbers (0: none) before the anchors, nearest first, and from them on.
    """
    n = len(doc)
    order = np.argsort(np.ascontiguousarray(right.astype(">u4")).view(f"S{4 * right.shape[1]}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    side = np.zeros(n, np.int64)  # class of equal left contexts of the present length
    alive = np.arange(n)
    for o in range(min(left.shape[1], window) + 1):
        need = window - o
        if o:
            word = left[alive, o - 1]
            alive, word = alive[word > 0], word[word > 0]
            if len(alive) < 2:
                return
            _, new = np.unique(side[alive] * (int(left.max()) + 1) + word.astype(np.int64), return_inverse=True)
            side[alive] = new
        if need < 1 or need > right.shape[1]:
            continue
        at = alive[np.lexsort((rank[alive], side[alive]))]
        a, b = at[:-1], at[1:]
        same = side[a] == side[b]
        # neighbours that agree on the words still needed to the right
        same[same] = (right[a[same], :need] == right[b[same], :need]).all(axis=1)
        group = np.concatenate([[0], np.cumsum(~same)])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        least, most = np.minimum.reduceat(doc[at], starts), np.maximum.reduceat(last[at], starts)
        hit = (least < most)[group] & (right[at, need - 1] > 0)
        yield at[hit], o, least[group[hit]]
        # only suffixes that still share their left context with another can match with more of it
        first = np.concatenate([[True], side[a] != side[b]])
        sizes = np.diff(np.concatenate([np.flatnonzero(first), [len(at)]]))
        alive = at[np.repeat(sizes > 1, sizes)]


def _search(window: int):
    def work(entries: list[tuple]):
        ids: dict[bytes, int] = {}
        held = []
        for _, at, line, _, _ in entries:
            words = [ids.setdefault(w, len(ids) + 1) for w in line.split()]
            held.append((words[:at][::-1], words[at:]))
        left = np.zeros((len(held), max(1, max(len(e[0]) for e in held))), np.int32)
        right = np.zeros((len(held), max(len(e[1]) for e in held)), np.int32)
        for i, e in enumerate(held):
            left[i, : len(e[0])], right[i, : len(e[1])] = e
        for at, o, first in shared_windows(left, right[:, :window], np.array([e[3] for e in entries]), np.array([e[4] for e in entries]), window):
            for i, d in zip(at.tolist(), first.tolist()):
                begin = len(held[i][0]) - o
                yield entries[i][0], begin, begin + window, d

    return work


def _merge(batches):
    for batch in batches:
        out = []
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in anchors.merged([(s["start"], s["end"]) for s in spans]):
                out.append((doc, a, b, min(s["first"] for s in spans if a <= s["start"] < b)))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "start", "end", "first"])


def shared_passages(docs: DataFrame, window: int = anchors.WINDOW, crowded: int = anchors.CROWDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, first_doc_id``: the maximal passages of each text, in words
    (between ASCII white space; end exclusive), all of whose words lie in windows of ``window`` words that
    a text under another id has as well.

    ``first_doc_id`` is the smallest id of the documents that share a window of the passage, maybe the document's own;
    passages whose first document is another one can be removed.  Texts with equal words share all
    of them, if they have a window and different ids.  Texts without such passages have no row, nor have null, empty and
    shorter texts; different texts under one id each have their own rows, equal ones the same rows once; rows without an id take
    part after all others, as if under one last id, and have a null id; an empty table gives no rows; other columns are not read.

    Each anchor's suffixes meet in one shard, to which equal segments go as one; those of an anchor that has more than
    ``crowded`` distinct segments meet by the words on one side of it.
    """
    given = id_and_text(docs, id_col, text_col)
    profiles, searched = anchors.profile(given, window)
    cut = anchors.segments(given, searched, window)
    found = anchors.matches(cut, _search(window), window, crowded)
    found = stored(found.groupBy("seg").agg(F.collect_set(F.struct("start", "end", "first")).alias("spans")), "passages")
    equal = cut.groupBy("seg").agg(F.min("doc").alias("x"), F.max("top").alias("y"), F.first("len").alias("end"), F.count("*").alias("n"))
    # segments that several ids have are shared as a whole
    whole = F.when(F.col("x") < F.col("y"), F.array(F.struct(F.lit(0).alias("start"), F.col("end"), F.col("x").alias("first")))).otherwise(F.array())
    known = equal.join(found, "seg", "left").select("seg", "n", F.concat(whole, F.coalesce("spans", F.array())).alias("spans")).where(F.size("spans") > 0)
    members = at_places(cut, stored(known, "passages-segments"))
    spans = members.select("doc", "raw", "text_key", F.explode("spans").alias("s")).groupBy("text_key", "doc").agg(F.collect_set("s").alias("spans"))
    spans = stored(spans, "passages-texts")
    classes = profiles.where(F.col("n_words") >= window)
    alone = spans.join(classes.where("least = most").select("text_key").distinct(), "text_key", "left_semi").select("doc", "spans").mapInArrow(_merge, SPANS)
    # what the first document of equal texts shares with still smaller ones, its copies share as well
    before = spans.select("text_key", F.array_min(F.transform("spans", lambda s: s["first"])).alias("before"))
    copied = classes.where("least < most").groupBy("text_key").agg(F.min("least").alias("least"), F.first("n_words").alias("end"), F.count("*").alias("n"))
    copied = stored(copied.join(before, "text_key", "left").select("text_key", "n", "end", F.least("least", "before").alias("first")), "passages-copies")
    rows = classes.where("least < most").select("text_key", "own").distinct()
    whole = attach(rows, copied, ["text_key"]).select(F.col("own").alias("doc"), F.lit(0).cast("long").alias("start"), "end", "first")
    null = lambda c: F.when(F.col(c) != anchors.LAST, F.col(c))
    return alone.union(whole).distinct().select(null("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), null("first").alias("first_doc_id"))


SPANS = "doc long, start long, end long, first long"


def at_places(cut: DataFrame, known: DataFrame) -> DataFrame:
    """``doc, raw, text_key, spans``: the spans of ``known`` segments at all their places in the texts."""
    at = lambda start, s: F.struct((start + s["start"]).cast("long").alias("start"), (start + s["end"]).cast("long").alias("end"), s["first"].alias("first"))
    members = attach(cut.select("seg", "doc", "raw", "text_key", "starts"), known, ["seg"])
    return members.select("doc", "raw", "text_key", F.flatten(F.transform("starts", lambda x: F.transform("spans", lambda s: at(x, s)))).alias("spans"))
