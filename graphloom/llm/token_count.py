"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no merge can cross, each different piece is counted once per
worker (bounded memo), and a piece's count is its bytes minus the merges done.
No identifiers are produced.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import MemoTable, id_and_text, kept, map_batches

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts under one vocabulary file of ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        #: (left id, right id) -> (rank, id of both together)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.pattern = regex.compile(SPLIT)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.odd_space = re.compile(r" (?:\s|\Z)")
        self.at_space = re.compile(r" (?=\S)")
        #: by a run of the text without its leading blank, after a blank, and at the start of a text
        self.after_blank = MemoTable(lambda s: self.pieces(" " + s), MEMO)
        self.piece = MemoTable(lambda s: self.merged(s.encode()), MEMO // 4)

    def merged(self, data: bytes) -> int:
        """Tokens of one piece: pop the lowest-ranked adjacent pair until none is left."""
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        ids = [self.of_byte[b] for b in data]
        heap = [(found[0], i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue  # one of the pair has been merged meanwhile
            ids[i], ids[j] = found[1], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (found[0], h))
        return left

    def pieces(self, run: str) -> int:
        return sum(map(self.piece.__getitem__, self.pattern.findall(run)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        The pattern always cuts before a blank that stands before another character
        than white space, so runs between such blanks are independent.
        """
        if not text:
            return 0
        runs = self.at_space.split(text) if self.odd_space.search(text) else text.split(" ")
        n = self.pieces(runs[0]) + sum(map(self.after_blank.__getitem__, runs[1:]))
        self.after_blank.trim()
        self.piece.trim()
        return n

    def count(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))


def counter(path: str) -> MergeCounter:
    return kept("tokens", path, lambda: MergeCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text under the vocabulary file ``path``.

    One narrow stage without a shuffle.  Null and empty texts have 0 bytes and tokens;
    repeated rows are counted each; an empty table gives no rows; other columns are not read.
    ``path`` must exist on the executors (it comes with an installed package).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, count = batch.column(1).to_pylist(), counter(path).count
        n = [count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
