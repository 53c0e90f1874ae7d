"""Language identification: known words first, then ever shorter character n-grams.

Training counts all words and n-grams per language over a bounded sample of labelled rows
(``train_rows``, chosen by a hash).  The model is a set of sorted hash arrays with a row of log frequencies
for each entry, in the shared folder; workers map them, so no entry is left out for memory.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import find, hashes, mapped, put
from .common import kept, scratch, stored, sub_batches

ORDERS = (4, 3, 2, 1)
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: chunks between white space whose sums a worker remembers, and the longest of them
MEMO, LONGEST = 150_000, 64
#: entries of a shard of the model, on average
SHARD_ENTRIES = 2_000_000


def held_out(doc_id) -> F.Column:
    """Whether the rows' id is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words_of(chunk: str) -> list[str]:
    return WORD.findall(chunk.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))] if len(marked) >= n else []


class Model:
    """Log frequencies by language of words (order 0) and n-grams, in mapped shards by hash range."""

    def __init__(self, path: str, langs: list[str], bits: int, written: frozenset):
        self.path, self.langs, self.bits, self.written = path, langs, bits, written
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}, "memo": {}, "old": {}}

    def rows(self, keys: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of words or n-grams, and which are known."""
        h = hashes([k.encode() for k in keys], order)
        out, known = np.zeros((len(h), len(self.langs)), "f4"), np.zeros(len(h), bool)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s in np.unique(shard).tolist():
            if s not in self.written:
                continue
            if s not in self.open:
                self.open[s] = mapped(f"{self.path}/hash-{s}", "u8"), mapped(f"{self.path}/rows-{s}", "f4").reshape(-1, len(self.langs))
            own = np.flatnonzero(shard == s)
            at, hit = find(self.open[s][0], h[own])
            out[own[hit]], known[own[hit]] = self.open[s][1][at[hit]], True
        return out, known

    def words(self, words: list[str]) -> np.ndarray:
        """Log scores per language: of each word, or else the mean of its longest known n-grams, or else zeros."""
        out, known = self.rows(words, 0)
        left = np.flatnonzero(~known)
        for n in ORDERS:
            parts = [grams(words[i], n) for i in left.tolist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            if not sizes.sum():
                continue
            rows, hit = self.rows(list(chain.from_iterable(parts)), n)
            of = np.repeat(np.arange(len(left)), sizes)[hit]
            count = np.bincount(of, minlength=len(left))
            for k in range(len(self.langs)):
                out[left, k] = np.bincount(of, rows[hit, k], len(left)) / np.maximum(count, 1)
            left = left[count == 0]
            if not len(left):
                break
        return out

    def learn(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Sums of log scores for every chunk of some texts; few long ones are not remembered."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        now, new = {}, []
        for chunk in set(chain.from_iterable(texts)):
            value = self.memo.get(chunk) or self.old.get(chunk)
            if value is None:
                new.append(chunk)
            else:
                now[chunk] = value
        split = [words_of(c) for c in new]
        known = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        scores = self.words(list(known)) if known else np.zeros((0, len(self.langs)), "f4")
        of = np.repeat(np.arange(len(new)), [len(s) for s in split])
        at = np.array([known[w] for w in chain.from_iterable(split)], np.int64)
        sums = np.stack([np.bincount(of, scores[at, k], len(new)) for k in range(len(self.langs))], axis=1).astype("f4") if new else np.zeros((0, len(self.langs)), "f4")
        now.update(zip(new, map(bytes, sums)))
        self.memo.update((c, v) for c, v in now.items() if len(c) <= LONGEST)
        return now

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its posterior share of each text; ``und`` and 0 without letters."""
        wanted = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        chunks = [texts[i].split() for i in wanted]
        sums_of = self.learn(chunks) if wanted else {}
        out = [("und", 0.0)] * len(texts)
        for i, own in zip(wanted, chunks):
            sums = np.frombuffer(b"".join(map(sums_of.__getitem__, own)), "f4").reshape(-1, len(self.langs)).sum(axis=0, dtype="f8")
            best = int(sums.argmax())
            out[i] = self.langs[best], float(1 / np.exp(np.maximum(sums - sums[best], -700)).sum())
        return out


def opened(model: Model) -> Model:
    """One for each worker process and model, so what is mapped and remembered serves all its tasks."""
    return kept("language", model.path, lambda: model)


def _count(batches):
    """``lang, n, h, c`` of all words and n-grams."""

    def spill(words: dict[str, Counter]):
        for lang, by in words.items():
            found = {0: by} | {n: Counter() for n in ORDERS}
            for w, c in by.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        found[n][g] += c
            for n, counts in found.items():
                h = hashes([g.encode() for g in counts], n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([n] * len(counts), pa.int32()), pa.array(h, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["lang", "n", "h", "c"])

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for chunk in text.split():
                words.setdefault(lang, Counter()).update(words_of(chunk))
        if sum(map(len, words.values())) > 200_000:
            yield from spill(words)
            words = {}
    yield from spill(words)


def _write(path: str, langs: list[str], totals: dict[int, list[int]]):
    """Over rows sorted by shard and unsigned hash: the shard's arrays.

    A language's frequency is smoothed by the same amount for all of them, so that rare words do not point to languages with little text.
    """

    def run(batches):
        shard, parts = None, []

        def flush():
            h, n, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            rows = np.empty(c.shape, "f4")
            for order, total in totals.items():
                own = n == order
                rows[own] = np.log(c[own] / np.maximum(total, 1) + 0.5 / sum(total))
            put(f"{path}/hash-{shard}", h.view(np.uint64))
            put(f"{path}/rows-{shard}", rows)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

        for batch in batches:
            s, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            c = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
            for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                if len(at):
                    if shard != int(s[at[0]]):
                        if parts:
                            yield flush()
                        shard, parts = int(s[at[0]]), []
                    parts.append((h[at], n[at], c[at]))
        if parts:
            yield flush()

    return run


def train(labelled: DataFrame, train_rows: int = 20_000) -> Model:
    """A model from ``doc_id, text, lang``: rows without a text or a label are left out, equal texts of a language count once.

    ``train_rows`` bounds the sample (chosen by a hash of id and text, alike at every size); every word and n-gram of it is kept.
    Null ids, empty texts and ties are no matter; very long texts are read whole; from an empty table comes a model
    without languages, by which every text is ``und``; other columns are not read.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("at"))
    n = labelled.count()
    if n > train_rows:
        labelled = labelled.where(F.pmod("at", F.lit(2**32)) < int(train_rows / n * 2**32))
    sample = labelled.select("lang", "text").distinct()
    path = scratch(spark, "language")
    counts = sample.mapInArrow(_count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    counts = stored(counts, "language-counts")
    by_order = counts.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect()  # a row for each order and language
    entries = {r["n"]: r["entries"] for r in counts.groupBy("n").agg(F.count_distinct("h").alias("entries")).collect()}
    langs = sorted({r["lang"] for r in by_order})
    if not langs:
        return Model(path, [], 0, frozenset())
    totals = {k: [sum(r["c"] for r in by_order if (r["n"], r["lang"]) == (k, x)) for x in langs] for k in entries}
    bits = max(0, (sum(entries.values()) // SHARD_ENTRIES).bit_length())
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "c")))
    rows = counts.groupBy("n", "h").agg(by_lang.alias("by"))
    shard = (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")
    c = F.array(*[F.coalesce(F.col("by")[x], F.lit(0)).cast("double") for x in langs])
    placed = rows.select(shard.alias("shard"), "h", "n", c.alias("c")).repartitionById(1 << bits, "shard").sortWithinPartitions("shard", F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    written = frozenset(r["shard"] for r in stored(placed.mapInArrow(_write(path, langs, totals), "shard int"), "language-shards").collect())
    return Model(path, langs, bits, written)


#: letters of the texts that are scored together
CHARS = 1_000_000


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, in one narrow stage.

    Null texts, and texts without a letter, are ``und`` with score 0; repeated rows are scored each;
    an empty table gives no rows; other columns are not read.  Ties go to the first language by name.
    """

    def run(batches):
        held = opened(model)
        for batch in batches:
            for part in sub_batches(batch, 1, CHARS):
                found = held.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more, with all their columns; a null label gets the prediction.

    Rows with a null text or one without letters go; repeated rows are judged each; an empty table gives no rows.  One narrow stage.
    """
    at, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        held = opened(model)
        for batch in batches:
            for part in sub_batches(batch, at, CHARS):
                found = held.predict(part.column(at).to_pylist())
                langs = [x if x is not None else f[0] for x, f in zip(part.column(label).to_pylist(), found)]
                cols = [pa.array(langs, pa.string()) if i == label else c for i, c in enumerate(part.columns)]
                keep = pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(cols, part.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def crc_mod3(doc_id: int) -> int:
    """The remainder that decides what is held out, as :func:`held_out` has it (for tests)."""
    return zlib.crc32(str(doc_id).encode()) % 3
