"""The pipeline's rows against its operators' plain versions."""

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from test_operators import _terms
from test_similar import components

import corpus_pipeline
from graphloom.llm import common, pii, queries


def test_pipeline(spark, small):
    import sentencepiece

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "sanitised", "encoded"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    language = common.stored(corpus_pipeline.language(spark, docs, small), "test")
    assert language.columns == columns and language.count() == docs.where("text rlike '[a-zA-Z]'").count()
    rows = sorted(language.collect(), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in rows]
    stay = {d for d, c in zip(ids, components([r["text"] for r in rows], ids)) if d == c}
    left = common.stored(corpus_pipeline.near_duplicates(spark, language, small), "test")
    assert left.columns == columns and sorted(r["doc_id"] for r in left.collect()) == sorted(stay) and len(stay) < len(ids)
    clean = common.stored(corpus_pipeline.decontaminated(spark, left, small), "test")
    assert clean.columns == columns
    cleaned = {r["doc_id"]: r for r in clean.collect()}
    for r in left.collect():
        n, hit, _, _ = brute.hits(r["text"], items)
        assert (r["doc_id"] in cleaned) == (2 * hit <= n)
        if r["doc_id"] in cleaned:
            got = cleaned[r["doc_id"]]
            assert got["n_chars"] == len(got["text"]) and (hit or got["text"] == r["text"])
            assert brute.hits(got["text"], [])[0] == n - hit
    private = common.stored(corpus_pipeline.sanitised(spark, clean, small), "test")
    assert private.columns == columns and private.count() == clean.count()
    order = sorted(cleaned)
    spans = {d: brute.personal(cleaned[d]["text"]) + terms for d, terms in zip(order, _terms([(d, cleaned[d]["text"]) for d in order]))}
    for r in private.collect():
        assert r["text"] == pii.cleaned(cleaned[r["doc_id"]]["text"], spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    begun = set(common.MADE)
    final = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in final} == {d: b"".join(i.to_bytes(4, "little") for i in model.encode(t, add_bos=True, add_eos=True)) for d, t in texts.items()}
    assert len(set(common.MADE) - begun) == 1  # the last stage's rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, docs, shared_ids):
    """Rows with null and repeated ids and texts and clashing columns, with a benchmark table."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(r["doc_id"], r["text"], "xx", r["doc_id"], "r", "t") for r in [*docs.collect(), *shared_ids.collect()]]
    rows += [(None, "ask zq@corp.org or Zephyrine", "xx", None, "a", "b")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, row string, clean_text string")
    frame.write.parquet(f"file://{path}/documents.parquet")
    items = [("7", " ".join(docs.where("doc_id = 11").first()["text"].split()[20:45])), ("8", None), (None, "word")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages_with_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = docs.collect()
    found = corpus_pipeline.language(spark, docs, odd)
    assert found.columns == docs.columns
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r) for r in rows if brute.letters(r["text"]))
    # near copies: a row for each group, and no group without one
    words = [" ".join(brute.words((r["text"] or "").translate(brute.ASCII_LOWER))) for r in rows]
    distinct = list(dict.fromkeys(words))
    group = dict(zip(distinct, components(distinct, list(range(len(distinct))))))
    members = defaultdict(list)
    for r, w in zip(rows, words):
        members[group[w]].append(r)
    left = corpus_pipeline.near_duplicates(spark, docs, odd)
    assert left.columns == docs.columns
    left = left.collect()
    place = [group[" ".join(brute.words((r["text"] or "").translate(brute.ASCII_LOWER)))] for r in left]
    assert sorted(place) == sorted(members)
    for r, g in zip(left, place):
        assert r in members[g] and r["doc_id"] == min((x["doc_id"] for x in members[g] if x["doc_id"] is not None), default=None)
    clean = corpus_pipeline.decontaminated(spark, docs, odd)
    assert clean.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect() if r["item_id"]]
    hits = [brute.hits(r["text"], items) for r in rows]
    assert clean.count() == sum(2 * hit <= n for n, hit, _, _ in hits)
    assert Counter(r for r, (n, hit, _, _) in zip(rows, hits) if not hit) - Counter(clean.collect()) == Counter()
    private = corpus_pipeline.sanitised(spark, docs, odd)
    assert private.columns == docs.columns
    got = private.collect()
    assert len(got) == len(rows) and Counter(r for r in rows if not brute.personal(r["text"])) - Counter(got) == Counter()
    assert not [r for r in got if brute.personal(r["text"])]
    assert corpus_pipeline.encoded(spark, docs, odd).count() == len(rows)


def test_stages_without_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        assert out.collect() == [] and (name == "encoded" or out.columns == docs.columns)


def test_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and set(queries.QUERIES) <= set(e.queries())


def test_contract_columns(spark, small):
    want = {
        "op1": "doc_id n_bytes n_tokens over_limit", "op3": "doc_id fingerprint component_id", "op4": "doc_id held_out lang_pred score", "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op6": "doc_id n_words n_removed kept_sha256", "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op9": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10": "query_id rank vec_id score", "op2": "doc_id start_word end_word first_doc_id",
    }
    for name, f in queries.QUERIES.items():
        assert f(spark, small).columns == want[name.split("_")[0]].split(), name
