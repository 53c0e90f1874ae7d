"""Queries that buckets serve badly get the nearest rows all the same."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import neighbours


def recall(spark, x, asked, k=10):
    """The share of the true nearest that are found, and the least number found for a query."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id").isin(asked), k).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = []
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        true = set(np.argsort(d, kind="stable")[: min(k, len(x) - 1)].tolist())
        hit.append(len(true & set(got.get(i, []))) / len(true))
    return float(np.mean(hit)), min(len(got.get(i, [])) for i in asked)


def test_rows_beside_near_copies(spark):
    rng = np.random.default_rng(2)
    groups = np.repeat(rng.standard_normal((30, 32)), 30, axis=0) + 0.001 * rng.standard_normal((900, 32))
    x = np.concatenate([groups, rng.standard_normal((600, 32))])
    share, least = recall(spark, x, list(range(900, 960)))
    assert share >= 0.9 and least == 10


def test_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1500, 32)), 3 * rng.standard_normal((30, 32))])
    assert recall(spark, x, list(range(1500, 1530))) == (1.0, 10)


def test_few_rows(spark):
    x = np.random.default_rng(4).standard_normal((11, 32))
    assert recall(spark, x, list(range(11))) == (1.0, 10)


def test_recall_on_the_real_table(spark, small):
    """The registered query, with its own settings, against all distances: 0.9 of the true ten at least, and exact scores."""
    from pathlib import Path

    from graphloom.llm import queries

    sf_dir = str(Path(small).parent / "sf0.1")
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    table = [(i, np.array(v, "f8")) for i, v in table if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    got = {}
    for r in queries.op10_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == sorted(ids[ids % 100 == 0].tolist())
    hit = []
    for i in got:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        d[ids == i] = np.inf
        near = ids[np.lexsort((ids, d))[:10]].tolist()
        hit.append(len(set(near) & {v for v, _ in got[i]}) / 10)
        assert all(np.isclose(s, d[ids == v][0], rtol=1e-12) for v, s in got[i])
    assert np.mean(hit) >= 0.9
