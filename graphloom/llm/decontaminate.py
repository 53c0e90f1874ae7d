"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words of a text are streamed through the automaton, which tracks the longest suffix that
occurs in some item.  Wherever it reaches a window's length, the window's words are hit.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mapped, put, runs
from .common import kept, row_schema, row_struct, scratch, stored, sub_batches

WINDOW = 10
#: words of the items that one automaton holds on average, and bytes of texts that are held for several of them
AUTOMATON_WORDS, BLOCK_BYTES = 500_000, 48_000_000
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case; what is no letter, digit or byte of a longer character separates words
NORMAL = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class SuffixAutomaton:
    """Of several items' words; knows which items hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, [name for name, _ in items]
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: states to the items whose windows (of full length, or whole short items) they end
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        self.least = window
        ends: list[tuple[int, int]] = []
        texts = []
        for k, (_, words) in enumerate(items):
            ids = [self.word.setdefault(w, len(self.word)) for w in words]
            texts.append(ids)
            last = 0
            for w in ids:
                last = self.extend(last, w)
        for k, ids in enumerate(texts):
            if not ids:
                continue
            self.least = min(self.least, len(ids))
            state = length = 0
            for i, w in enumerate(ids):
                state, length = self.step(state, length, w)
                if i + 1 >= window:
                    self.full.setdefault(self.holder(state, window), set()).add(k)
            if len(ids) < window:
                at = self.holder(state, len(ids))
                self.short.setdefault(at, {}).setdefault(len(ids), set()).add(k)
        #: by state: the nearest one on its suffix path, itself included, that ends a short item (-1: none)
        self.to_short = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.to_short[s] = s if s in self.short else self.to_short[self.link[s]]

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self.split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, w, q)
        return new

    def split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state of the longest suffix that occurs, after one more word, and that suffix's length."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if (to := self.next[state].get(w)) is None:
            return 0, 0
        return to, length + 1

    def holder(self, state: int, length: int) -> int:
        """The state on the suffix path whose strings include the one of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans ``[start, end)`` of words inside occurrences of windows (merged, in order), and the items."""
        spans: list[list[int]] = []
        found: set[int] = set()
        known = bytes(map(self.word.__contains__, words))
        # a word of no item resets the automaton, so shorter stretches of known words cannot hold a window
        for run in re.finditer(b"\x01{%d,}" % self.least, known) if self.word else ():
            state = length = 0
            for i in range(run.start(), run.end()):
                state, length = self.step(state, length, self.word[words[i]])
                longest = 0
                if length >= self.window:
                    longest = self.window
                    found |= self.full.get(self.holder(state, longest), frozenset())
                at = self.to_short[state] if state else -1
                while at > 0:
                    for n, of in self.short[at].items():
                        if n <= length:
                            found |= of
                            longest = max(longest, n)
                    at = self.to_short[self.link[at]]
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, found


def build(items: DataFrame, window: int, most: int, id_col: str, text_col: str) -> list[str]:
    """The items' automata, each of about ``most`` words, built in tasks and pickled in the shared folder; their paths."""
    spark = items.sparkSession
    known = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null").distinct()
    known = stored(known.mapInArrow(_sizes, "id string, text string, n long"), "decontaminate-items")
    shards = max(1, -(-(known.agg(F.sum("n")).first()[0] or 0) // most))
    path = scratch(spark, "automata")
    placed = known.where("n > 0").select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), "id", "text")

    def run(batches):
        for shard, rows in runs(batches):
            blob = pickle.dumps(SuffixAutomaton([(name, normal_words(text)) for name, text in rows], window))
            put(f"{path}/{shard}", np.frombuffer(blob, "u1"))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    parts = min(shards, 20_000)
    made = placed.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "id", "text")
    return [f"{path}/{r['shard']}" for r in stored(made.mapInArrow(run, "shard int"), "decontaminate-built").orderBy("shard").collect()]


def _sizes(batches):
    for batch in batches:
        n = [len(normal_words(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["id", "text", "n"])


def opened(path: str) -> SuffixAutomaton:
    """An automaton; each worker process holds one at a time."""
    return kept("decontaminate", path, lambda: pickle.loads(mapped(path, "u1")))


SPANS = "array<struct<start:long,end:long>>"


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_words(text: str, spans: list[list[int]]) -> str:
    """The text without the spans of words and the separators right after them."""
    data = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(NORMAL))]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b][0] if b < len(at) else len(data)
    return b"".join([*out, data[last:]]).decode()


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS, clean: bool = False, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every whole text; with ``clean`` also ``clean_text``
    (the text without those words), and with ``carry`` the given row as struct ``row``.

    A window is ``window`` consecutive words of an item; a shorter item (not an empty one) is one window.
    ``spans`` are the merged spans of words inside occurrences of windows; ``items`` the ids (as
    strings, sorted, each once) of the items whose windows occur.  Null and empty texts have no words; null or
    empty items have no window; equal items are all named; an id that several items have is named when a window of any of them
    occurs; items without an id are left out; repeated rows are treated alike; an empty
    table gives no rows; other columns are not read.  The texts are neither shuffled nor written.  Items beyond
    ``most_words`` words make several automata, which each task asks one after the other for a block of texts.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[row_struct(docs)] * carry)
    kind = f"doc_id long, n_words long, n_hit long, spans {SPANS}, items array<string>" + ", clean_text string" * clean + f", row {row_schema(docs)}" * carry
    return given.mapInArrow(_pass(build(items, window, most_words, item_col, item_text), clean), kind)


def _pass(paths: list[str], clean: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        spans: list[list[list[int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        n = [0] * len(texts)
        for path in paths or [""]:
            automaton = opened(path) if path else None
            for i, text in enumerate(texts):
                words = normal_words(text)
                n[i] = len(words)
                if automaton:
                    s, found = automaton.hits(words)
                    if s:
                        spans[i] = merged(spans[i] + s) if spans[i] else s
                        items[i] |= {automaton.ids[k] for k in found}
        hit = [sum(b - a for a, b in s) for s in spans]
        cols = [part.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        names = ["doc_id", "n_words", "n_hit", "spans", "items"]
        if clean:
            cols, names = [*cols, pa.array([cut_words(t, s) if s else t for t, s in zip(texts, spans)], pa.string())], [*names, "clean_text"]
        if part.num_columns > 2:
            cols, names = [*cols, part.column(2)], [*names, "row"]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        if len(paths) < 2:
            for batch in batches:
                yield from map(block, sub_batches(batch, 1))
            return
        held, chars = [], 0
        for batch in batches:  # enough texts for each automaton that is read
            held.append(batch)
            chars += batch.column(1).nbytes
            if chars > BLOCK_BYTES:
                yield block(pa.concat_batches(held))
                held, chars = [], 0
        if held:
            yield block(pa.concat_batches(held))

    return run
