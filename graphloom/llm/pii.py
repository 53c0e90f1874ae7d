"""Personal data: patterned identifiers, and terms that reveal them.

Patterned spans (mail and network addresses, card and phone numbers) are the protected
entities.  By the information-theoretic view of sanitisation a term near an entity reveals the
share ``PMI(entity; term) / IC(entity)`` of the entity's information, estimated from
co-occurrence in the corpus; terms above the threshold are sensitive too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import find as find_in
from .arrays import hashes
from .common import give_back, row_schema, row_struct, stored, sub_batches
from .common import kept as kept_for

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: a run of digits is tried from its start only, where any match begins, so long ones take linear time
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]+")

#: words on either side of an entity that may reveal it
NEAR = 6
#: letters of a term at least, different texts that must hold term and entity together, and the share of information
TERM_LETTERS, SUPPORT, SHARE = 4, 1, 0.9
#: revealing pairs (as 64-bit keys) that may be broadcast at once, and bits of the map of candidate terms
BROADCAST_PAIRS, MAP_BITS = 2_000_000, 1 << 25
#: words that a task counts before it looks which of them are wanted; half as many wanted ones are handed on
COUNTED_TERMS = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> int:
    """A signed 64-bit key of an entity's value, whatever its case and punctuation."""
    plain = value.lower() if kind in ("email", "ip") else "".join(filter(str.isdigit, value))
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()) - 2**63


def pair_key(entity: int, term: str) -> int:
    """What ``xxhash64(entity, term)`` gives in Spark."""
    return xxhash.xxh64_intdigest(term.encode(), xxhash.xxh64_intdigest(entity.to_bytes(8, "little", signed=True), 42))


def near_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, str, int, int]]:
    """``entity, term, start, end`` for the terms among the :data:`NEAR` words on either side of each span, outside all spans."""
    words = [m.span() for m in WORD.finditer(text)]
    inside: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if inside and a <= inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], b)
        else:
            inside.append([a, b])
    starts = [a for a, _ in inside]
    free = []
    for x, y in words:
        at = bisect_left(starts, y) - 1  # the last merged span that begins before the word ends
        if at < 0 or inside[at][1] <= x:
            free.append((x, y))
    ends = [y for _, y in free]
    for kind, a, b in spans:
        key = entity(kind, text[a:b])
        before, after = bisect_right(ends, a), bisect_left(free, (b, b))
        for x, y in free[max(0, before - NEAR) : before] + free[after : after + NEAR]:
            if y - x >= TERM_LETTERS:
                yield key, text[x:y].lower(), x, y


def contexts(docs: DataFrame) -> DataFrame:
    """``entity, term, text_key`` once for each text with the entity and the term near it; term "" stands for the entity alone.

    ``docs``: ``doc_id, text``.  Texts without base spans give nothing.
    """

    def run(batches):
        kept_for("pii")
        for batch in batches:
            out: list[tuple[int, str, int]] = []
            for text in batch.column(1).to_pylist():
                if spans := base_spans(text):
                    key = xxhash.xxh64_intdigest(text.encode()) - 2**63
                    pairs = {(e, t) for e, t, _, _ in near_terms(text, spans)} | {(entity(k, text[a:b]), "") for k, a, b in spans}
                    out += [(e, t, key) for e, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["entity", "term", "text_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "entity long, term string, text_key long")


def term_rows(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: the number of texts (rows) that hold each of ``terms``, over all of ``docs``, in one pass over the texts.

    Each task counts its words and keeps those whose hash is set in a bitmap of the wanted terms' hashes, which has one size however many
    those are; a join then leaves the wanted ones.
    """
    spark = docs.sparkSession
    wanted = stored(terms.select("term").distinct(), "pii-wanted")
    place = F.pmod(F.xxhash64("term"), F.lit(MAP_BITS)) + 1  # these functions count from one
    parts = wanted.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = spark.sparkContext.broadcast({r["k"]: bytes(r["bits"]) for r in parts.collect()})  # MAP_BITS bits at most

    def run(batches):
        kept_for("pii")
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        for k, part in held.value.items():
            bits[(k - 1) * len(part) : k * len(part)] = np.frombuffer(part, np.uint8)
        counts, kept = Counter(), Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update({w for w in WORD.findall(text.lower()) if len(w) >= TERM_LETTERS})
                if len(counts) + len(kept) > COUNTED_TERMS:
                    kept.update(chosen(counts, bits))
                    counts = Counter()
                    if 2 * len(kept) > COUNTED_TERMS:
                        yield rows(kept)
                        kept = Counter()
        kept.update(chosen(counts, bits))
        yield rows(kept)
        counts, kept = Counter(), Counter()
        give_back()

    def chosen(counts: Counter, bits: np.ndarray) -> dict[str, int]:
        # bucket k holds the places from (k - 1) * 32768 on, in order of their bits
        at = (hashes([w.encode() for w in counts], 42).view(np.int64) % MAP_BITS).astype(np.int64)
        return dict(compress(counts.items(), (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(wanted, "term", "left_semi")


def revealing(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``entity, term, share``: the terms that reveal an entity near them (``docs``: ``doc_id, text``).

    Pairs need ``support`` different texts (one: a term that stands in no other text tells which text it is, and so the entity); the share of information is ``PMI / IC`` over all rows:
    ``log2(c D / (n(e) n(t))) / log2(D / n(e))``.

    A term that stands near entities in more texts than the share allows it over all of them cannot reveal any, and is not counted.
    """
    found = contexts(docs).groupBy("entity", "term", "text_key").agg(F.count("*").alias("rows"))
    found = stored(found, "pii-contexts")
    pairs = found.groupBy("entity", "term").agg(F.sum("rows").alias("c"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    with_term, alone = pairs.where("term <> ''"), pairs.where("term = ''").select("entity", F.col("c").alias("ne"))
    rows = docs.count()
    if rows < 2:
        return with_term.where("false").select("entity", "term", F.lit(0.0).alias("share"))
    d = F.lit(math.log2(rows))
    near = found.where("term <> ''").select("term", "text_key").distinct().groupBy("term").agg(F.count("*").alias("near"))
    most = F.log2("c") + (1 - share) * (d - F.log2("ne"))
    likely = with_term.join(alone, "entity").join(near, "term").where((F.col("ne") < rows) & (F.log2("near") <= most + 1e-9))
    likely = stored(likely.select("entity", "term", "c", "ne"), "pii-pairs")
    told = (F.log2("c") + d - F.log2("ne") - F.log2("n")) / (d - F.log2("ne"))
    return likely.join(term_rows(docs, likely), "term").select("entity", "term", told.alias("share")).where(F.col("share") >= share)


def find(docs: DataFrame, clean: bool = False, carry: bool = False, support: int = SUPPORT, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (kind, start, end in code points) of every whole text; with ``clean`` also ``clean_text``,
    and with ``carry`` the given row as struct ``row``.

    Base kinds come first in the order email, ip, card, phone, each by start; kind ``term`` holds the words
    near an entity of the same text that reveal it (see :func:`revealing`).  In ``clean_text`` each
    base span is generalised to its kind in angle brackets and revealing terms are replaced by ``<term>``;
    texts without spans stay as they are.  Null and empty texts have no spans; repeated rows are treated
    alike; an empty table gives no rows; other columns are not read.

    The texts are read again for the terms' counts and for the spans.  Up to :data:`BROADCAST_PAIRS` revealing pairs
    are broadcast; beyond that the texts with spans, and no others, are shuffled to meet their own pairs.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[row_struct(docs)] * carry)
    pairs = stored(revealing(given, support, share).select(F.xxhash64("entity", "term").alias("pair")), "pii-terms")
    kind = "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + ", clean_text string" * clean + f", row {row_schema(docs)}" * carry
    unknown = F.lit(None).cast("array<long>").alias("own")
    if pairs.count() <= BROADCAST_PAIRS:
        held = spark.sparkContext.broadcast(np.unique(pairs.toArrow()["pair"].to_numpy()))
        return given.select("doc_id", "text", unknown, *["row"] * carry).mapInArrow(_spans(held, clean), kind)
    plain = given.mapInArrow(_those(False), given.schema).select("doc_id", "text", unknown, *["row"] * carry)
    keyed = given.mapInArrow(_those(True), given.schema).withColumn("text_key", F.xxhash64("text"))
    near = keyed.select("text", "text_key").mapInArrow(_near, "text_key long, pair long").distinct()
    own = near.join(pairs.distinct(), "pair").groupBy("text_key").agg(F.collect_set("pair").alias("own"))
    joined = keyed.join(own, "text_key", "left").select("doc_id", "text", "own", *["row"] * carry)
    return plain.union(joined).mapInArrow(_spans(None, clean), kind)


def _those(with_spans: bool):
    """The rows whose texts have base spans, or the others."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(base_spans(t)) == with_spans for t in batch.column(1).to_pylist()], pa.bool_()))

    return run


def _near(batches):
    for batch in batches:
        out = [(k, pair_key(e, t)) for text, k in zip(*[c.to_pylist() for c in batch.columns]) for e, t, _, _ in near_terms(text, base_spans(text))]
        keys = np.array([x[1] for x in out], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(keys, pa.int64())], ["text_key", "pair"])


def cleaned(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans count as the first of them."""
    out, last = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, -b)
    return "".join([*out, text[last:]])


def _spans(held, clean: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        kept_for("pii")
        for batch in (part for b in batches for part in sub_batches(b, 1)):
            texts = batch.column(1).to_pylist()
            own = batch.column(2).to_pylist()
            found = []
            for text, pairs in zip(texts, own):
                spans = base_spans(text)
                known = held.value if held else np.unique(np.array(pairs or [], np.int64))
                if spans and len(known):
                    terms = list(near_terms(text, spans))
                    keys = np.array([pair_key(e, t) for e, t, _, _ in terms], np.uint64).view(np.int64)
                    spans = spans + [("term", a, b) for a, b in sorted({terms[i][2:] for i in np.flatnonzero(find_in(known, keys)[1])})]
                found.append(spans)
            cols = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)]
            if clean:
                cols.append(pa.array([cleaned(t, s) if s else t for t, s in zip(texts, found)], pa.string()))
            names = ["doc_id", "spans", "clean_text"][: len(cols)]
            if batch.num_columns > 3:
                cols, names = [*cols, batch.column(3)], [*names, "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run
