"""Exact merge-type piece encoding by backtracking, and decoding.

Encoding a run: find all vocabulary matches with an Aho-Corasick automaton, take the
longest at each position, and accept a token only if it is compatible with the one
before it, that is if merging the two tokens' characters anew yields just these two.
When no token fits, the position is marked as failed in a bit field and the last token
is shortened.  The merge result is the only sequence whose neighbours are all compatible.
"""

from __future__ import annotations

import re
import sys
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MemoTable, id_and_text, kept, sub_batches

BLANK = "▁"
MEMO = 200_000


def words32(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if sys.byteorder != "little":
        found.byteswap()
    return found.tobytes()


class PieceCodec:
    """Encoder and decoder for one model file of merge type with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.of_byte = [0] * 256
        self.text_of: dict[int, bytes] = {}
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id_of[piece], self.rank[piece] = i, -model.get_score(i)
                self.text_of[i] = piece.replace(BLANK, " ").encode()
        inner = [p for p in self.id_of if BLANK in p.lstrip(BLANK)]
        letters = {c for p in self.id_of for c in p}
        if inner or any(c not in self.id_of for c in letters):
            raise ValueError("pieces with blanks inside, or with characters that are no pieces, are not supported")
        self.find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.id_of:
            self.find.add_word(piece)
        self.find.make_automaton()
        self.longest = max(map(len, self.id_of))
        #: by each path in the automaton from its root: the longest piece on it
        self.on_path: dict[str, int] = {}
        for piece in self.id_of:
            for k in range(1, len(piece) + 1):
                self.on_path[piece[:k]] = self.id_of.get(piece[:k]) or self.on_path[piece[: k - 1]]
        self.piece = dict((i, p) for p, i in self.id_of.items())
        #: by id: characters, and the longest piece that is a proper prefix (a chain of ever shorter matches)
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.shorter = {i: next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), -1) for i, p in self.piece.items()}
        #: a run of characters that have pieces, or one that has none
        self.letters = letters
        self.known = re.compile("[{0}]+|[^{0}]+".format("".join(map(re.escape, sorted(letters)))))
        self.units = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        #: by left id (-1 for none) and right id: whether merging anew leaves them apart and whole
        self.fits: dict[int, bool] = {}
        #: text between two blanks -> (ids as bytes, decoded bytes)
        self.word = MemoTable(lambda s: self.unit(BLANK + s), MEMO)

    def merge(self, text: str) -> list[str]:
        """Merge the best-ranked adjacent pair, leftmost first, until none is left (short strings only)."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both tokens gives the two (a < 0: of b alone gives b)."""
        parts = [self.piece[i] for i in (a, b) if i >= 0]
        if len(self.fits) > 200_000:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self.merge("".join(parts)) == parts
        return found

    def run(self, text: str) -> list[int]:
        """Ids of a run of known characters."""
        n, most, longest, on_path = len(text), self.longest, self.find.longest_prefix, self.on_path
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        failed = bytearray(n + 1)
        tokens: list[int] = []
        pos, last = 0, -1
        token = on_path[text[: longest(text[:most])]]
        while True:
            while token >= 0:
                end = pos + length[token]
                if not failed[end]:
                    fit = fits.get(last << 32 | token)
                    if compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                if end == n:
                    return tokens
                pos, last = end, token
                ahead = text[pos : pos + most]
                token = on_path[ahead[: longest(ahead)]]
            else:
                failed[pos] = 1
                if not tokens:
                    raise ValueError(f"no encoding of {text[:40]!r}")
                token = tokens.pop()
                pos -= length[token]
                last = tokens[-1] if tokens else -1
                token = shorter[token]

    def unit(self, text: str) -> tuple[bytes, bytes]:
        """Ids (as little-endian bytes) and decoded bytes of a text that no token leaves."""
        ids: list[int] = []
        for part in self.known.findall(text):
            ids += self.run(part) if part[0] in self.letters else [self.of_byte[b] for b in part.encode()]
        return words32(ids), b"".join([self.text_of[i] for i in ids])

    def coded(self, text: str) -> tuple[bytes, str]:
        """Ids of a text with begin and end, as little-endian bytes, and the text decoded from them."""
        ends = [x.to_bytes(4, "little") for x in (self.bos, self.eos)]
        if not text:
            return ends[0] + ends[1], ""
        if "  " in text or text[-1] == " " or text[0] == " " or BLANK in text:
            found = [self.word[u[1:]] if u[0] == BLANK else self.unit(u) for u in self.units.findall(BLANK + text.replace(" ", BLANK))]
        else:
            found = list(map(self.word.__getitem__, text.split(" ")))
        self.word.trim()
        ids = b"".join([ends[0], *[f[0] for f in found], ends[1]])
        return ids, b"".join([f[1] for f in found])[1:].decode(errors="replace")


def codec(path: str) -> PieceCodec:
    return kept("pieces", path, lambda: PieceCodec(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every whole text under the model file ``path``.

    ``ids`` holds all ids, begin and end included, as little-endian unsigned 32-bit integers;
    ``decoded`` is the text decoded from them.  One narrow stage.  Null and empty texts give
    the begin and end ids and an empty text; repeated rows are coded each; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches):
        model = codec(path)
        for batch in batches:
            for part in sub_batches(batch, 1):
                found = [model.coded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
