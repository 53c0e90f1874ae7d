"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, fm_index, kneser_ney, langid, neighbours, pieces, pii, simhash, suffix_dedup, token_count


def test_token_counts(docs, empty, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    got = token_count.count_tokens(docs, path).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (by[i]["n_bytes"], by[i]["n_tokens"], by[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), t
    assert token_count.count_tokens(empty, path).collect() == []


def test_piece_codec(docs, empty, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    by = {r["doc_id"]: r for r in pieces.encode_decode(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(by[i]["ids"], "<u4").tolist() == ids and by[i]["n_tokens"] == len(ids)
        assert by[i]["decoded"] == model.decode(ids)
    assert pieces.encode_decode(empty, path).collect() == []


def test_simhash(docs, empty, texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [brute.simhash(t) for _, t in rows]
    want = Counter(zip((d for d, _ in rows), (f"{f:016x}" for f in fps), brute.components(fps, [d for d, _ in rows])))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("crowded", [2, 1024])
def test_simhash_links_of_crowds(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(40):
            x = b
            for k in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(int(np.int64(r["a"]).astype(np.uint64)), int(np.int64(r["b"]).astype(np.uint64))) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    want = brute.components(fps, list(range(len(fps))))
    at = {f: i for i, f in enumerate(fps)}
    edges = spark.createDataFrame([(at[a], at[b]) for a, b in links], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert [root.get(i, i) for i in range(len(fps))] == want


def test_forest_links_by_look_up(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**14, 900, dtype=np.uint64))
    small = simhash.forest_links(fps)
    monkeypatch.setattr(simhash, "CROWDED", 1)
    large = simhash.forest_links(fps)
    assert len(small) == len(large) == len({frozenset(x) for x in large})
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in large)


def test_components_of_a_chain(spark):
    n = 60
    order = np.random.default_rng(1).permutation(n).tolist()
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(1, n)}


def test_language(spark, small, docs, empty):
    d = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(d.where(~langid.held_out(d["doc_id"])).select("doc_id", "text", "lang"))
    rows = langid.identify(d, model).withColumn("held", langid.held_out(F.col("doc_id"))).join(d.select("doc_id", "lang"), "doc_id").where("held").collect()
    for lang in model.langs:  # the accuracy of each language
        own = [r for r in rows if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in own) / len(own) > 0.95
    assert all(langid.crc_mod3(r["doc_id"]) == 1 for r in rows)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i in (0, 1, 2, 20):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "½ ② 7 Ⅷ"), (2, "²³"), (3, "é")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in langid.identify(odd, model).collect()} == {1: True, 2: True, 3: False}
    assert langid.identify(empty, model).collect() == []
    none = langid.train(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("lang is null").count() == 0
    assert langid.accepted(empty, model).collect() == []


def test_language_scores(spark, docs):
    """Every score against a plain model of dictionaries; nothing seen is left out."""
    train = docs.where("doc_id % 2 = 0")
    model = langid.train(train)
    counts = defaultdict(Counter)  # by order and language
    for lang, text in {(r["lang"], r["text"]) for r in train.collect() if r["lang"] and r["text"] is not None}:
        for w in brute.letters(text):
            counts[0, lang][w] += 1
            for n in langid.ORDERS:
                counts[n, lang].update(langid.grams(w, n))
    langs = sorted({x for _, x in counts})
    every = {n: {k for (m, _), c in counts.items() if m == n for k in c} for n in (0, *langid.ORDERS)}
    totals = {n: [sum(counts[n, x].values()) for x in langs] for n in every}
    logs = lambda n, k: np.array([math.log(counts[n, x][k] / max(t, 1) + 0.5 / sum(totals[n])) for x, t in zip(langs, totals[n])])

    def word(w):
        for n, keys in [(0, [w]), *[(n, langid.grams(w, n)) for n in langid.ORDERS]]:
            if known := [logs(n, k) for k in keys if k in every[n]]:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    known, texts = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(docs.where("length(text) < 2500 or text is null"), model).collect():
        found = brute.letters(texts.get(r["doc_id"]))
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = sum(known.setdefault(w, word(w)) if w not in known else known[w] for w in found)
        share = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
        assert r["score"] == pytest.approx(share.max(), rel=1e-3) and share[langs.index(r["lang_pred"])] == pytest.approx(share.max(), rel=1e-3)


@pytest.mark.parametrize("crowded", [1, 3, 16_000])
def test_substring_dedup(docs, shared_ids, empty, crowded):
    for frame in (docs, shared_ids):
        want = brute.removed([(r["doc_id"], r["text"]) for r in frame.collect()])
        got = fm_index.substring_dedup(frame, crowded=crowded).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(want)
        assert all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in got if r["kept_text"] is not None)
    assert fm_index.substring_dedup(empty).collect() == []


@pytest.mark.parametrize("crowded", [1, 3, 16_000])
def test_shared_passages(docs, shared_ids, empty, crowded):
    for frame in (docs, shared_ids):
        got = suffix_dedup.shared_passages(frame, crowded=crowded).collect()
        assert {tuple(r) for r in got} == brute.passages([(r["doc_id"], r["text"]) for r in frame.collect()]) and len(got) == len(set(got))
    assert suffix_dedup.shared_passages(empty).collect() == []


def test_hot_keys_join_whole(spark):
    rows = spark.range(6000).selectExpr("case when id % 3 = 0 then -1 else id % 900 end as k", "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0 or k = -1")
    from graphloom.llm.common import attach

    for how in ("inner", "left"):
        got = attach(rows, side, ["k"], how)
        want = rows.join(side, ["k"], how)
        assert Counter(map(tuple, got.select("k", "id", "n").collect())) == Counter(map(tuple, want.select("k", "id", "n").collect()))


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 4, 30).tolist() for _ in range(20)]
    text = np.array([x for p in parts for x in (0, *p)] + [0])
    index = fm_index.FMIndex(text, 31)
    line = "".join(map(str, text.tolist()))
    for _ in range(200):
        p = rng.integers(1, 4, rng.integers(1, 9)).tolist()
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(p):
            lo, hi = index.extend(np.array([c]), lo, hi)
        s = "".join(map(str, p))
        assert int(hi[0] - lo[0]) == sum(line.startswith(s, i) for i in range(len(line)))


TEXT = "Mail jo.b@x-y.co.uk, a@b.c_x@y.zz or @none; 10.0.0.255 1.2.3.4.5 300.1.1.1; card 4111 1111 1111 1111, 4111-1111-1111-1112; +49 (30) 123-4567 8 +1 2"


def test_personal_data(spark, docs, empty):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "é" * 5 + TEXT), (5, "no data at all")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(d, clean=True, carry=True).collect()}
    for r in d.collect():
        base = [(s["kind"], s["start"], s["end"]) for s in got[r["doc_id"]]["spans"] if s["kind"] != "term"]
        assert base == brute.personal(r["text"])
        assert got[r["doc_id"]]["row"]["text"] == r["text"]
    assert got[5]["clean_text"] == "no data at all" and "@x-y" not in got[1]["clean_text"] and "<email>" in got[1]["clean_text"]
    assert pii.find(docs).count() == docs.count() and pii.find(empty).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_terms_that_reveal(spark, few, monkeypatch):
    if few:
        monkeypatch.setattr(pii, "BROADCAST_PAIRS", 1)
        monkeypatch.setattr(pii, "MAP_BITS", 1 << 15)
        monkeypatch.setattr(pii, "COUNTED_TERMS", 3)
    rows = [(i, f"Report {i} says manager Zephyrine Quillback ask zq@corp.org about topic number {i}") for i in range(5)]
    rows += [(10 + i, f"Report {i} with the word manager about topic and other things {i}") for i in range(20)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), clean=True).collect()}
    for i in range(5):
        assert "Zephyrine" not in got[i]["clean_text"] and "Quillback" not in got[i]["clean_text"] and "manager" in got[i]["clean_text"] and "topic" in got[i]["clean_text"]
    assert all(got[10 + i]["clean_text"] == rows[5 + i][1] for i in range(20))


def _terms(rows, support=pii.SUPPORT, share=pii.SHARE):
    """The ``term`` spans of each row, by counting over all rows."""
    held, pairs, alone, words = [], defaultdict(list), defaultdict(list), Counter()
    for _, text in rows:
        spans = brute.personal(text)
        free = [m.span() for m in pii.WORD.finditer(text or "") if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        near = {(k, (text[a:b].lower() if k in ("email", "ip") else "".join(filter(str.isdigit, text[a:b]))), x, y) for k, a, b in spans for x, y in [w for w in free if w[1] <= a][-pii.NEAR :] + [w for w in free if w[0] >= b][: pii.NEAR] if y - x >= pii.TERM_LETTERS}
        held.append(near)
        for key in {(k, v, text[x:y].lower()) for k, v, x, y in near}:
            pairs[key].append(text)
        for k, a, b in {(k, a, b): 0 for k, a, b in spans}:
            v = text[a:b].lower() if k in ("email", "ip") else "".join(filter(str.isdigit, text[a:b]))
            alone[k, v].append(text)
        words.update({w.lower() for w in pii.WORD.findall(text or "")})
    d = len(rows)
    rows_of = {e: sum(1 for _, t in rows for s in [{(k, t[a:b].lower() if k in ("email", "ip") else "".join(filter(str.isdigit, t[a:b]))) for k, a, b in brute.personal(t)}] if e in s) for e in alone}

    def tells(k, v, term):
        c, ne = pairs[k, v, term], rows_of[k, v]
        return len(set(c)) >= support and ne < d and math.log2(len(c) * d / (ne * words[term])) / math.log2(d / ne) >= share

    return [[("term", a, b) for a, b in sorted({(x, y) for k, v, x, y in near if tells(k, v, t[x:y].lower())})] for (_, t), near in zip(rows, held)]


@pytest.mark.parametrize("support", [1, 2])
def test_term_spans(spark, small, support):
    """Every ``term`` span against plain counting, on real rows; some are there, and rows without personal data stay."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(9000 + i, f"ask Zephyrine Quillback zq@corp.org or zq@corp.org number {i % 3}") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(frame, clean=True, support=support).collect()}
    want = _terms(rows, support)
    assert any(want)
    for (d, text), terms in zip(rows, want):
        assert [tuple(s) for s in got[d]["spans"] if s["kind"] == "term"] == terms, d
        assert got[d]["clean_text"] == text or brute.personal(text)


def test_personal_data_in_long_runs(spark):
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 300_000, "+1(" * 200_000, "a@" * 300_000, " ".join(f"u{i}@x.com word{i}" for i in range(20_000))):
        list(pii.near_terms(text, pii.base_spans(text)))
    assert time.perf_counter() - began < 20
    assert spark.sql("select xxhash64(-5L, 'é x')").first()[0] == int(np.uint64(pii.pair_key(-5, "é x")).astype(np.int64))


def test_decontamination(spark, docs, empty, texts):
    items = [("7", " ".join((texts[11] or "").split()[20:45])), ("10", "one"), ("2", texts[8]), ("3", None), ("4", "!!"), ("5", "a b c d"), ("5", "a b c d"), ("5", "another text under one id"), ("6", "a b c d")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (10, 500_000):
        got = decontaminate.contaminated_spans(docs, bench, most_words=most, clean=True).collect()
        assert len(got) == docs.count()
        for r in got:
            if r["doc_id"] is not None:
                n, hit, names, flags = brute.hits(texts[r["doc_id"]], items)
                assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, names)
                assert [k for k, f in enumerate(flags) if f] == [k for s in r["spans"] for k in range(s["start"], s["end"])]
                assert brute.hits(r["clean_text"], [])[0] == n - hit
    assert decontaminate.contaminated_spans(empty, bench).collect() == []
    assert {r["n_hit"] for r in decontaminate.contaminated_spans(docs, bench.where("false")).collect()} == {0}


def test_kneser_ney(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 700)
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 100)
    train = docs.where(~kneser_ney.held_out(F.col("doc_id")))
    model = kneser_ney.train(train)
    unigrams, bigrams, n_texts = Counter(), Counter(), 0
    tokens = lambda t: [w.lower() if w.isascii() else w.translate(brute.ASCII_LOWER) for w in brute.words(t)] + ["\n"]
    for r in train.collect():
        w = tokens(r["text"])
        n_texts += 1
        unigrams.update(w)
        bigrams.update(zip([None, *w], w))
    n, v = sum(unigrams.values()), len(unigrams)
    assert (model["tokens"], model["words"], model["grams"]) == (n, v, len(bigrams))
    d = kneser_ney.discounts(*[sum(c == k for c in bigrams.values()) for k in (1, 2, 3, 4)])
    before, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (h, w), c in bigrams.items():
        before[w] += 1
        kinds[h][min(c, 3)] += 1
    low_d = kneser_ney.discounts(*[sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    spare = sum(low_d[min(c, 3)] for c in before.values())
    total = Counter(unigrams) | Counter({None: n_texts})

    def p(h, w):
        low = (max(before[w] - low_d[min(before[w], 3)], 0) + spare / (v + 1)) / len(bigrams)
        if not total[h]:
            return low
        c = bigrams[h, w]
        return (c - d[min(c, 3)]) / total[h] * (c > 0) + sum(d[k] * kinds[h][k] for k in (1, 2, 3)) / total[h] * low

    for h in [None, "word", next(iter(unigrams))]:
        if h != "\n":
            assert math.isclose(sum(p(h, w) for w in unigrams) + p(h, "never seen"), 1, rel_tol=1e-9)
    rows = {r["doc_id"]: r for r in kneser_ney.score(docs, model).collect()}
    for r in docs.collect():
        w, got = tokens(r["text"]), rows[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"]) == (len(w), sum(x in unigrams for x in w))
        assert math.isclose(got["score"], sum(math.log10(p(h, x)) for h, x in zip([None, *w], w)), rel_tol=1e-9)
        assert math.isclose(got["base_score"], sum(math.log10((unigrams[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    assert kneser_ney.score(empty, model).collect() == []
    nothing = kneser_ney.train(empty)
    assert {r["score"] for r in kneser_ney.score(docs.limit(2), nothing).collect()} == {0.0}


def test_kneser_ney_tasks_that_run_again(spark, docs, monkeypatch):
    """A task that is lost and runs again hands on the same rows: names, n-grams and places, not only the same sums."""
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 700)
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 100)
    model = kneser_ney.train(docs)
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(3, "text")
    asked = given.mapInArrow(kneser_ney._ask(model), "shard int, chunk string, docs int, base binary, heads binary, keys binary, counts binary, at binary")
    first, again = (sorted(map(tuple, asked.collect()), key=repr) for _ in range(2))
    assert first == again and len({r[1] for r in first}) == 3
    heads = [r[0] for r in first if r[3] is not None]
    assert len(heads) == 3 and 0 <= min(heads) and max(heads) < model["shards"]


def test_counts_of_any_size(tmp_path):
    from graphloom.llm import arrays

    for most in (0, 255, 256, 2**32 - 1, 2**32, 2**40):
        arrays.put_counts(f"file://{tmp_path}/c-{most}", np.array([1, most]))
        assert arrays.mapped_counts(f"file://{tmp_path}/c-{most}").tolist() == [1, most]
    assert len(arrays.mapped_counts(f"file://{tmp_path}/none")) == 0


def _nearest(rows, k=10):
    good = [(i, np.array(x, "f8")) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    for i, x in good:
        if i % 100 == 0:
            near = sorted({(float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in good if j != i and len(y) == len(x)})
            yield i, [(j, s) for s, j in near[:k]]


@pytest.mark.parametrize("crowded", [20, 50_000])
def test_neighbours(spark, crowded, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", crowded)
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1200)]
    same = [1.0] * 8
    rows += [(2000 + i, same) for i in range(60)] + [(3000, None), (3001, [0.0] * 8), (3002, [None] + [1.0] * 7), (3003, [float("nan")] * 8), (3004, []), (3100, [1.0, 2.0]), (None, same), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, probes=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = dict(_nearest(rows))
    assert set(got) <= set(want) and 3100 not in got
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in near}) for i, near in want.items())
    assert hit >= 0.9 * sum(len(n) for n in want.values())
    assert [j for j, _ in got[2000]] == list(range(2001, 2011))
    exact = {i: dict(near) for i, near in _nearest(rows, 10**6)}
    assert all(math.isclose(s, exact[i][j], rel_tol=1e-12, abs_tol=1e-12) for i, near in got.items() for j, s in near)
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_words_split_as_stated():
    assert brute.words("a\x0bb\x1cc\xa0d\re") == [w.decode() for w in "a\x0bb\x1cc\xa0d\re".encode().split()]
    assert zlib.crc32(b"1") % 3 == langid.crc_mod3(1) and hashlib.sha256(b"").hexdigest() == brute.sha("")
