"""Interpolated modified Kneser-Ney language model (two-word n-grams), counted in Spark.

The model is a set of sorted arrays in the shared folder, which workers map into memory:
word hashes with their counts and continuation counts in shards by hash range (a word's number is its
place), and n-gram keys with their counts in shards by history.  A history with very many
occurrences is dealt over several shards.  Texts are scored shard by shard: unique
n-grams of a chunk of texts go to the shard that holds them, sums for each text come back.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import find, hashes, mapped, mapped_counts, put, put_counts, runs
from .common import id_and_text, kept, scratch, stored, sub_batches

END = b"\n"  # the end token: no word holds white space
#: training tokens for an n-gram shard and words for a vocabulary shard, on average
SHARD_TOKENS, SHARD_WORDS = 4_000_000, 500_000
CHUNK_CHARS = 8_000_000
MEMO = 400_000
ALPHA = 0.1


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def mix(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return key ^ (key >> np.uint64(29))


# Arrays inside shuffled rows


def packed(keys: np.ndarray) -> bytes:
    """Ascending integers as differences of one to eight bytes."""
    gaps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    size = np.ones(len(gaps), np.uint8)
    for k in range(1, 8):
        size += gaps >= np.uint64(1) << np.uint64(8 * k)
    keep = np.arange(8)[None] < size[:, None]
    return b"".join([len(gaps).to_bytes(8, "little"), size.tobytes(), gaps.view(np.uint8).reshape(-1, 8)[keep].tobytes()])


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    size = np.frombuffer(data, np.uint8, n, 8)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[np.arange(8)[None] < size[:, None]] = np.frombuffer(data, np.uint8, offset=8 + n)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


class Vocabulary:
    """Words to numbers, over mapped shards by hash range.  ``size`` stands for unknown words, ``size + 1`` for the start."""

    def __init__(self, path: str, starts: list[int], bits: int):
        self.path, self.starts, self.bits = path, starts, bits
        self.size = starts[-1]
        self.memo: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.arrays: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, shard: int) -> np.ndarray:
        if (found := self.arrays.get((name, shard))) is None:
            path = f"{self.path}/{name}-{shard}"
            found = self.arrays[name, shard] = mapped(path, "u8") if name == "hash" else mapped_counts(path)
        return found

    def shards_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def look_up(self, words: list[bytes]) -> list[int]:
        h = hashes(words)
        out, at = np.full(len(h), self.size, np.int64), self.shards_of(h)
        for s in np.unique(at).tolist():
            own = np.flatnonzero(at == s)
            place, hit = find(self.array("hash", s), h[own])
            out[own[hit]] = self.starts[s] + place[hit]
        return out.tolist()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.memo.get, words))
        if None in found:
            missing = {w for w, x in zip(words, found) if x is None}
            if len(self.memo) > MEMO:
                self.old, self.memo = self.memo, {}
            known = {w: x for w in missing if (x := self.old.get(w)) is not None}
            rest = [w for w in missing if w not in known]
            known.update(zip(rest, self.look_up(rest)) if rest else ())
            self.memo.update(known)
            get = self.memo.get
            found = [get(w) if x is None else x for w, x in zip(words, found)]
        return np.array(found, np.int64)

    def values(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """A count for each word number; 0 beyond the known words."""
        out = np.zeros(len(numbers), np.int64)
        at = np.searchsorted(self.starts, numbers, side="right") - 1
        for s in np.unique(at).tolist():
            if s + 1 < len(self.starts):
                own = at == s
                out[own] = self.array(name, s)[numbers[own] - self.starts[s]]
        return out


def vocabulary(model: dict) -> Vocabulary:
    """One for each worker process and model."""
    return kept("kneser-ney", model["path"], lambda: Vocabulary(model["path"], model["starts"], model["bits"]))


def _count_words(batches):
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes(counts).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["h", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            if len(counts) > 1_000_000:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def _write_words(path: str):
    """Over rows sorted by shard and unsigned hash."""

    def run(batches):
        shard, parts = None, []

        def flush():
            h, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            put(f"{path}/hash-{shard}", h.view(np.uint64))
            put_counts(f"{path}/count-{shard}", c)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["shard", "n", "total"])

        for batch in batches:
            s, h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                if len(at):
                    if shard != int(s[at[0]]):
                        if parts:
                            yield flush()
                        shard, parts = int(s[at[0]]), []
                    parts.append((h[at], c[at]))
        if parts:
            yield flush()

    return run


def _pairs(vocab: Vocabulary, texts: list[str]):
    """Word numbers and histories of all tokens, and the tokens of each text."""
    numbers, sizes, line = [], [], []
    for text in texts:
        own = tokens(text)
        sizes.append(len(own))
        line += own
        if len(line) > 200_000:
            numbers.append(vocab.numbers(line))
            line = []
    numbers.append(vocab.numbers(line))
    w = np.concatenate(numbers)
    sizes = np.array(sizes, np.int64)
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = vocab.size + 1
    return w, h, sizes


def _homes(vocab: Vocabulary, heads: np.ndarray, of: np.ndarray, w: np.ndarray, model: dict) -> np.ndarray:
    """The shard of each n-gram: by its history (a place ``of`` in ``heads``), and for a frequent history by the word as well."""
    count = np.where(heads == vocab.size + 1, model["texts"], vocab.values("count", heads))
    ways = (count // model["frequent"] + 1).astype(np.uint64)
    way = mix(w.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % ways[of]
    return (mix(heads.astype(np.uint64)[of] * np.uint64(0x9E3779B97F4A7C15) + way) % np.uint64(model["shards"])).astype(np.int64)


def _by_home(home: np.ndarray):
    order = np.argsort(home, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(at):
            yield int(home[at[0]]), at


def _grams(vocab: Vocabulary, w: np.ndarray, h: np.ndarray):
    """The histories that occur, and for each n-gram its key (the history's place among them, and the word), ascending, and how often it occurs."""
    heads, of = np.unique(h, return_inverse=True)
    keys = of.astype(np.uint64) * np.uint64(vocab.size + 2) + w.astype(np.uint64)
    return heads, keys


def _sent(vocab: Vocabulary, heads: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Some of the n-grams with the histories that they need only."""
    base = np.uint64(vocab.size + 2)
    some, of = np.unique((keys // base).astype(np.int64), return_inverse=True)
    return packed(heads[some].astype(np.uint64)), packed(of.astype(np.uint64) * base + keys % base)


def _received(vocab: Vocabulary, heads: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The histories and words of n-grams as sent."""
    base, x = np.uint64(vocab.size + 2), unpacked(keys)
    return unpacked(heads).astype(np.int64)[(x // base).astype(np.int64)], (x % base).astype(np.int64)


def _count_grams(model: dict):
    def run(batches):
        vocab = vocabulary(model)
        base = np.uint64(vocab.size + 2)
        for batch in batches:
            for part in sub_batches(batch, 0, CHUNK_CHARS):
                w, h, _ = _pairs(vocab, part.column(0).to_pylist())
                heads, keys = _grams(vocab, w, h)
                keys, counts = np.unique(keys, return_counts=True)
                home = _homes(vocab, heads, (keys // base).astype(np.int64), (keys % base).astype(np.int64), model)
                rows = [(s, *_sent(vocab, heads, keys[at]), squeezed(counts[at].astype("<u4"))) for s, at in _by_home(home)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["shard", "heads", "keys", "counts"])

    return run


def _write_grams(model: dict):
    """A shard's counts as sorted arrays; gives counts of counts, and continuation counts by vocabulary shard."""

    def run(batches):
        vocab = vocabulary(model)
        base = np.uint64(vocab.size + 2)
        for shard, rows in runs(batches):
            h, w = (np.concatenate(x) for x in zip(*[_received(vocab, r[0], r[1]) for r in rows]))
            counts = np.concatenate([spread(r[2], "<u4") for r in rows])
            heads, keys = _grams(vocab, w, h)
            del h, w
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.add.reduceat(counts.astype(np.int64), first)
            put(f"{model['path']}/gram-{shard}", keys)
            put_counts(f"{model['path']}/gramcount-{shard}", counts)
            # how many different n-grams follow each history, by count 1, 2, 3 and more
            of = (keys // base).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            kinds = [np.add.reduceat((counts == k) if k < 3 else (counts >= 3), start, dtype=np.int64) for k in (1, 2, 3)]
            put(f"{model['path']}/history-{shard}", heads)
            put_counts(f"{model['path']}/kinds-{shard}", np.stack(kinds, axis=1))
            total = np.where(heads == vocab.size + 1, model["texts"], vocab.values("count", heads))
            many = np.flatnonzero(total // model["frequent"] > 0)
            parts = np.stack([heads[many], *[k[many] for k in kinds]], axis=1).astype("<i8")
            of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(keys)], "<i8")
            out = [(-1, of_counts.tobytes(), parts.tobytes())]
            w, n = np.unique((keys % base).astype(np.int64), return_counts=True)
            out += [(s, packed(w[at]), squeezed(n[at].astype("<u8"))) for s, at in _by_home(np.searchsorted(vocab.starts, w, side="right") - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["shard", "keys", "counts"])

    return run


def _write_continuations(model: dict):
    def run(batches):
        vocab = vocabulary(model)
        for shard, rows in runs(batches):
            counts = np.zeros(vocab.starts[shard + 1] - vocab.starts[shard], np.int64)
            for keys, n in rows:
                counts[unpacked(keys).astype(np.int64) - vocab.starts[shard]] += spread(n, "<u8").astype(np.int64)
            put_counts(f"{model['path']}/before-{shard}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([int((counts == k).sum()) for _ in (0,)], pa.int64()) for k in (1, 2, 3, 4)] + [pa.array([int((counts >= 3).sum())], pa.int64())], ["n1", "n2", "n3", "n4", "n3up"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken from counts of 0, 1, 2, and 3 or more, from how many n-grams occur once to four times.

    The usual estimate is not defined without n-grams that occur once or twice (then 0.5 is taken, as in absolute discounting), nor
    where no count is 3 (then 1.5); it is kept from 0.05 up to 0.05 below the next count, so that no probability becomes zero or negative.
    """
    if not n1 or not n2:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *[min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]]


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Count the n-grams of all texts; the result describes the model's files in the shared folder.

    Null and empty texts are one end token; repeated rows count each; an empty table gives a model in which every
    text has probability one; other columns, and ids, are not read.
    """
    spark = docs.sparkSession
    path = scratch(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = stored(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "kn-words")
    size = words.count()
    bits = max(0, (size // SHARD_WORDS).bit_length())
    shard = (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")
    parts = min(1 << bits, 20_000)
    made = words.select(shard.alias("shard"), "h", "c").repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    rows = sorted(stored(made.mapInArrow(_write_words(path), "shard int, n long, total long"), "kn-sizes").collect())
    sizes = {r["shard"]: r["n"] for r in rows}
    total = sum(r["total"] for r in rows)
    starts = [0]
    for s in range(1 << bits):
        starts.append(starts[-1] + sizes.get(s, 0))
    shards = max(1, -(-total // SHARD_TOKENS))
    model = {"path": path, "bits": bits, "starts": starts, "words": size, "tokens": total, "shards": shards, "texts": texts.count(), "frequent": max(1000, total // (4 * shards))}
    many = min(shards, 20_000)
    grams = texts.mapInArrow(_count_grams(model), "shard int, heads binary, keys binary, counts binary")
    told = stored(grams.repartitionById(many, F.pmod("shard", F.lit(many)).cast("int")).sortWithinPartitions("shard").mapInArrow(_write_grams(model), "shard int, keys binary, counts binary"), "kn-counts")
    of_counts, frequent = np.zeros(5, np.int64), {}
    # a row for each shard, with the parts of the frequent histories that it holds (a few for each shard)
    for r in told.where("shard = -1").toLocalIterator():
        of_counts += np.frombuffer(r["keys"], "<i8")
        for h, *kinds in np.frombuffer(r["counts"], "<i8").reshape(-1, 4).tolist():
            frequent[h] = np.add(frequent.get(h, [0, 0, 0]), kinds).tolist()
    after = told.where("shard >= 0").repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard").mapInArrow(_write_continuations(model), "n1 long, n2 long, n3 long, n4 long, n3up long")
    sums = [x or 0 for x in stored(after, "kn-continuations").groupBy().sum().first()]
    lower = discounts(*sums[:4])
    grams_seen = int(of_counts[4])
    spare = lower[1] * sums[0] + lower[2] * sums[1] + lower[3] * sums[4]
    return model | {"discounts": discounts(*of_counts[:4].tolist()), "lower": lower, "grams": grams_seen, "spare": spare, "kinds": frequent}


def _ask(model: dict):
    """Chunks of texts: a row with their base figures, and for each shard their n-grams with the texts that hold them.

    A chunk's name is its place in the input, so a task that runs again gives the same.
    """
    names = ["shard", "chunk", "docs", "base", "heads", "keys", "counts", "at"]
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        vocab = vocabulary(model)
        base_of = np.uint64(vocab.size + 2)
        scale = model["tokens"] + ALPHA * (model["words"] + 1)
        place, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in sub_batches(batch, 1, CHUNK_CHARS):
                w, h, sizes = _pairs(vocab, part.column(1).to_pylist())
                of = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(of, np.log10((vocab.values("count", w) + ALPHA) / scale), len(sizes))
                known = np.bincount(of, w < vocab.size, len(sizes))
                chunk, number = f"{place}-{number}", number + 1
                ids = pa.array(part.column(0)).to_pylist()
                ids = np.array([(0, 1) if x is None else (x, 0) for x in ids], "<i8")
                heads, key = _grams(vocab, w, h)
                order = np.argsort(key, kind="stable")
                key, of = key[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                keys, counts = key[first], np.diff(np.concatenate([first, [len(key)]]))
                home = _homes(vocab, heads, (keys // base_of).astype(np.int64), (keys % base_of).astype(np.int64), model)
                tokens_of = {s: at for s, at in _by_home(np.repeat(home, counts))}
                rows = [(s, chunk, len(sizes), None, *_sent(vocab, heads, keys[at]), squeezed(counts[at].astype("<u4")), of[tokens_of[s]].astype("<u4" if len(sizes) > 65535 else "<u2").tobytes()) for s, at in _by_home(home)]
                at = int(mix(hashes([chunk.encode()]))[0] % np.uint64(model["shards"]))
                rows.append((at, chunk, len(sizes), np.stack([base, sizes, known]).astype("<f8").tobytes(), ids.tobytes(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def probabilities(model: dict, vocab: Vocabulary, shard: int):
    """A function from histories and words (numbers) of a shard's n-grams to probabilities."""
    base = np.uint64(vocab.size + 2)
    grams, history = mapped(f"{model['path']}/gram-{shard}", "u8"), mapped(f"{model['path']}/history-{shard}", "i8")
    counts, kinds = mapped_counts(f"{model['path']}/gramcount-{shard}"), mapped_counts(f"{model['path']}/kinds-{shard}").reshape(-1, 3)
    d, lower = np.array(model["discounts"]), np.array(model["lower"])

    def run(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        before = vocab.values("before", w)
        uniform = 1 / (model["words"] + 1)
        low = (before - lower[np.minimum(before, 3)]) / model["grams"] + model["spare"] / model["grams"] * uniform if model["grams"] else np.full(len(w), uniform)
        hs, back = np.unique(h, return_inverse=True)
        place, known = find(history, hs)
        at, seen = find(grams, place[back].astype(np.uint64) * base + w.astype(np.uint64))
        seen &= known[back]
        c = np.where(seen, counts[at] if len(counts) else 0, 0).astype(np.int64)
        n = np.where(known[:, None], kinds[place], 0).astype(np.int64) if len(kinds) else np.zeros((len(hs), 3), np.int64)
        total = np.where(hs == vocab.size + 1, model["texts"], vocab.values("count", hs)).astype(float)
        for i in np.flatnonzero(total >= model["frequent"]).tolist():  # parts of these are in several shards
            n[i] = model["kinds"].get(int(hs[i]), n[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            spare = np.where(total > 0, n @ d[1:] / total, 1.0)
            direct = (c - d[np.minimum(c, 3)]) / total[back]
        return np.where(c > 0, direct, 0.0) + np.where(total[back] > 0, spare[back], 1.0) * low

    return run


def _answer(model: dict):
    def run(batches):
        vocab = vocabulary(model)
        shard = of = None
        for batch in batches:
            out = []
            for s, chunk, n, base, heads, keys, counts, at in zip(*[c.to_pylist() for c in batch.columns]):
                if base is not None:
                    out.append((chunk, base, heads))
                    continue
                if s != shard:
                    shard, of = s, probabilities(model, vocab, s)
                logs = np.repeat(np.log10(of(*_received(vocab, heads, keys))), spread(counts, "<u4"))
                sums = np.bincount(np.frombuffer(at, "<u4" if n > 65535 else "<u2"), logs, n)
                out.append((chunk, sums.astype("<f8").tobytes(), None))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["chunk", "sums", "ids"])

    return run


def _sum(batches):
    for _, rows in runs(batches):
        head, score = None, 0.0
        for sums, ids in rows:
            if ids is not None:
                head, given = np.frombuffer(sums, "<f8").reshape(3, -1), np.frombuffer(ids, "<i8").reshape(-1, 2)
            else:
                score = score + np.frombuffer(sums, "<f8")
        doc = pa.array(given[:, 0], pa.int64(), mask=given[:, 1] == 1)
        yield pa.RecordBatch.from_arrays([doc, pa.array(head[1].astype(np.int64)), pa.array(head[2].astype(np.int64)), pa.array(head[0]), pa.array(np.broadcast_to(score, len(given)).astype(float))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, perplexity`` of every whole text.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end.  ``score`` is the text's log10
    probability under the model, in which all unknown words are one; ``base_score`` that of additive
    smoothing of single words.  Null and empty texts are one end token; repeated rows are scored each; an
    empty table gives no rows; other columns are not read.
    """
    given = id_and_text(docs, id_col, text_col)
    parts = min(model["shards"], 20_000)
    asked = given.mapInArrow(_ask(model), "shard int, chunk string, docs int, base binary, heads binary, keys binary, counts binary, at binary")
    told = stored(asked.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard").mapInArrow(_answer(model), "chunk string, sums binary, ids binary"), "kn-sums")
    by_chunk = told.repartition(F.col("chunk")).sortWithinPartitions("chunk")
    out = by_chunk.mapInArrow(_sum, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
