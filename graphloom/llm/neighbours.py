"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector's bucket in a table is ``floor((a.x + b) / w)`` for several Gaussian ``a``.  A query
visits its own bucket and perturbed ones in the order of their estimated success (least sum of
squared distances to the walls crossed); the candidates of all tables are ranked by exact distance.
Queries whose k-th candidate is beyond the bucket width, or that have fewer, are asked of all rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TABLES, HASHES, PROBES = 6, 6, 160
#: rows that the bucket width is fitted on, and the width as a multiple of their median distance to the k-th neighbour
FIT_ROWS, WIDTH = 2_000, 1.3
#: share of the median distance within which rows of that sample count as copies of one
COPY = 0.1
#: queries that are compared with a block of rows at once
QUERY_BLOCK = 1024
#: bytes of indexed rows for a shard, and rows of a bucket above which it is dealt over several shards
SHARD_BYTES, BUCKET_ROWS = 32_000_000, 50_000


@dataclass
class Hashing:
    """The hash functions of all tables, for vectors of any length; ``width`` is fitted on a sample."""

    width: float
    tables: int = TABLES
    hashes: int = HASHES
    seed: int = 17

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        """Positions in units of buckets, one column for each hash function."""
        rng = np.random.default_rng([self.seed, table, x.shape[1]])
        return (x @ rng.standard_normal((x.shape[1], self.hashes))) / self.width + rng.random(self.hashes)

    def key(self, buckets: np.ndarray, table: int, dim: int) -> np.ndarray:
        """One signed 64-bit key for each row of bucket numbers (the last axis)."""
        h = np.full(buckets.shape[:-1], np.uint64(table * 1_000_003 + dim), np.uint64)
        for j in range(buckets.shape[-1]):
            h = (h ^ buckets[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def index(self, x: np.ndarray) -> np.ndarray:
        """The key of each row in each table."""
        return np.stack([self.key(np.floor(self.places(x, t)).astype(np.int64), t, x.shape[1]) for t in range(self.tables)], axis=1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The keys that each row visits, ``n`` for each table, in estimated success order."""
        steps = np.array(list(itertools.product((0, -1, 1), repeat=self.hashes)))
        down, up = (steps == -1).astype(float), (steps == 1).astype(float)
        out = []
        for t in range(self.tables):
            place = self.places(x, t)
            inside = place - np.floor(place)
            cost = inside**2 @ down.T + (1 - inside) ** 2 @ up.T
            best = np.argsort(cost, axis=1, kind="stable")[:, :n]
            out.append(self.key(np.floor(place).astype(np.int64)[:, None, :] + steps[best], t, x.shape[1]))
        return np.concatenate(out, axis=1)


def valid(vec) -> F.Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def _fit(rows: DataFrame, k: int) -> float:
    """The bucket width, from at most :data:`FIT_ROWS` rows chosen by a hash of the id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("x").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["x"]), []).append(r["x"])
    if not by_dim:
        return 1.0
    x = np.unique(np.array(max(by_dim.values(), key=len), "f8"), axis=0)
    if len(x) < 2:
        return 1.0
    sq = (x**2).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    # one of each group of near copies, else their distances to each other make buckets too narrow for all other rows
    near, apart = d <= COPY * np.median(d[np.triu_indices(len(x), 1)]), []
    free = np.ones(len(x), bool)
    for i in range(len(x)):
        if free[i]:
            apart.append(i)
            free &= ~near[i]
    if len(apart) > k:
        d = d[np.ix_(apart, apart)]
    at = min(k, len(d) - 1)
    return float(np.median(np.partition(d, at, axis=1)[:, at])) * WIDTH or 1.0


def _matrix(column) -> list[np.ndarray]:
    return [np.frombuffer(b, "<f8") for b in column.to_pylist()]


KIND = "shard int, kind int, key long, id long, keys array<long>, x binary"


def _emit(shards, kind, keys, ids, lists, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(blobs, pa.binary())],
        ["shard", "kind", "key", "id", "keys", "x"],
    )


def _by_length(batch):
    """ids and vectors (a matrix) of a batch, for each length of vectors."""
    by: dict[int, list] = {}
    for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by.setdefault(len(x), []).append((i, x))
    for rows in by.values():
        yield [r[0] for r in rows], np.array([r[1] for r in rows], "f8")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(7)) % np.uint64(shards)


def _ranker(k: int):
    """Over rows sorted by shard, kind, key: the ``k`` best candidates of each query in each shard."""

    def best(shard, ids, x, wanted, blocks):
        """The queries of one shard against its rows, bucket by bucket."""
        found_q, found_v, found_d = [], [], []
        worst = np.full(len(ids), np.inf)
        sq = [float(v @ v) for v in x]
        for key, vec_ids, v in blocks:
            at = wanted.get(key)
            if at is None:
                continue
            at = np.array([i for i in at if len(x[i]) == v.shape[1]])
            if not len(at):
                continue
            for at in np.split(at, range(QUERY_BLOCK, len(at), QUERY_BLOCK)):
                q = np.stack([x[i] for i in at])
                near = np.array([sq[i] for i in at])[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T
                slack = 1e-9 * (1 + np.abs(near))
                if near.shape[1] > k + 1:
                    bound = np.partition(near, k, axis=1)[:, k]
                    worst[at] = np.minimum(worst[at], bound + 1e-9 * (1 + np.abs(bound)))
                a, b = np.nonzero(near <= worst[at][:, None] + slack)
                found_q.append(at[a])
                found_v.append(vec_ids[b])
                found_d.append(np.sqrt(((q[a] - v[b]) ** 2).sum(1)))
        if not found_q:
            return None
        q, v, d = (np.concatenate(f) for f in (found_q, found_v, found_d))
        own = np.array(ids)
        keep = own[q] != v
        q, v, d = q[keep], v[keep], d[keep]
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, d = q[fresh], v[fresh], d[fresh]
        start = np.searchsorted(q, q)
        keep = np.arange(len(q)) - start < k
        return pa.RecordBatch.from_arrays([pa.array(own[q[keep]]), pa.array(v[keep]), pa.array(d[keep])], ["query_id", "vec_id", "score"])

    def run(batches):
        shard, ids, x, wanted, parts = None, [], [], {}, []

        def blocks(batch_parts):
            for key, vec_ids, vecs in batch_parts:
                yield key, np.array(vec_ids), np.stack(vecs)

        held = 0
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            shards, kinds, keys, row_ids = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in cols[:4])
            vectors = _matrix(cols[5])
            lists = None
            for i in range(batch.num_rows):
                if shards[i] != shard:
                    if parts and (out := best(shard, ids, x, wanted, blocks(parts))) is not None:
                        yield out
                    shard, ids, x, wanted, parts, held = int(shards[i]), [], [], {}, [], 0
                if kinds[i] == 0:
                    lists = cols[4].to_pylist() if lists is None else lists
                    for key in lists[i]:
                        wanted.setdefault(key, []).append(len(ids))
                    ids.append(int(row_ids[i]))
                    x.append(vectors[i])
                elif keys[i] in wanted:
                    key = int(keys[i])
                    if not parts or parts[-1][0] != key or len(parts[-1][2][0]) != len(vectors[i]) or len(parts[-1][1]) >= 4096:
                        if held > 100_000:  # hand on what there is, to keep memory bounded
                            if (out := best(shard, ids, x, wanted, blocks(parts))) is not None:
                                yield out
                            parts, held = [], 0
                        parts.append((key, [], []))
                    parts[-1][1].append(int(row_ids[i]))
                    parts[-1][2].append(vectors[i])
                    held += 1
        if parts and (out := best(shard, ids, x, wanted, blocks(parts))) is not None:
            yield out

    return run


def nearest(vectors: DataFrame, queries, k: int = 10, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that ``queries`` (a condition on ``vec_id``) selects.

    ``score`` is the exact Euclidean distance in double precision; ties go to the smaller id; a query
    never finds its own id.  Every row is indexed.  Null vectors, zero ones and those with null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths never
    meet; equal ids count as one per vector; an empty table gives no rows; other columns are not read.

    Of equal vectors only the ``k + 1`` smallest ids can be found, so the rest is left out before
    indexing; buckets above :data:`BUCKET_ROWS` rows are dealt over several shards, which the queries
    visit all.  Pairs are ranked inside the shards; only the best of each query leave them.

    A query that has found fewer than ``k`` rows, or whose ``k``-th is farther than a bucket is wide (probes
    reach such distances badly), is compared with all rows instead, so it gets the nearest there are.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("x")).where("vec_id is not null").where(valid(F.col("x")))
    hashing = Hashing(_fit(rows, k), tables, hashes)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    shards = int(max(32, -(-size["n"] * tables * 8 * (size["d"] or 1) // SHARD_BYTES)))

    same = Window.partitionBy(F.xxhash64("x"), "x").orderBy("vec_id")
    indexed = rows.distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "x")

    def index(batches):
        for batch in batches:
            for ids, x in _by_length(batch):
                keys, blobs = hashing.index(x), [r.tobytes() for r in x]
                for t in range(tables):
                    yield _emit(_shard(keys[:, t].copy(), shards).astype(np.int32), 1, keys[:, t].copy(), ids, [None] * len(ids), blobs)

    def visit(batches):
        for batch in batches:
            for ids, x in _by_length(batch):
                for start in range(0, len(ids), 256):
                    part = x[start : start + 256]
                    for i, keys in enumerate(hashing.probes(part, probes)):
                        at = _shard(keys, shards).astype(np.int64)
                        order = np.argsort(at, kind="stable")
                        cuts = np.flatnonzero(np.diff(at[order])) + 1
                        groups = np.split(order, cuts)
                        yield _emit([int(at[g[0]]) for g in groups], 0, [None] * len(groups), [ids[start + i]] * len(groups), [np.unique(keys[g]).tolist() for g in groups], [part[i].tobytes()] * len(groups))

    index_rows = indexed.mapInArrow(index, KIND)
    asked = rows.where(queries).mapInArrow(visit, KIND)
    crowded = index_rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    crowded = crowded.select("key", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("ways")).persist()
    if not crowded.isEmpty():
        # a crowded bucket's rows go to several shards by id; the queries that visit it ask in each of them
        dealt = F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("ways"))), F.lit(shards)).cast("int")
        index_rows = index_rows.join(crowded, "key", "left").withColumn("shard", F.when(F.col("ways").isNull(), F.col("shard")).otherwise(dealt)).select(*[c.split()[0] for c in KIND.split(", ")])
        one = asked.select("id", "x", "shard", F.explode("keys").alias("key"))
        more = one.join(crowded, "key").select("id", "x", "key", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
        more = more.select("id", "x", "key", F.pmod(F.xxhash64("key", F.col("way").cast("long")), F.lit(shards)).cast("int").alias("shard"))
        more = more.groupBy("shard", "id", "x").agg(F.collect_set("key").alias("keys")).select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), "id", "keys", "x")
        asked = asked.union(more)
    met = index_rows.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "key")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found):
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    pairs = "query_id long, vec_id long, score double"
    found = stored(ranked(met.mapInArrow(_ranker(k), pairs)), "neighbours")
    reach = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"), F.max("score").alias("far"))
    wanted = rows.where(queries).distinct()
    few = F.col("n").isNull() | (F.col("n") < k) | (F.col("far") > hashing.width)
    short = wanted.join(reach, wanted["vec_id"] == reach["query_id"], "left").where(few).select("vec_id", "x")
    short = stored(short, "neighbours-short")
    if short.isEmpty():
        return found

    # these queries go to all shards, over which the rows are dealt by id
    ways = int(max(32, -(-size["n"] * 8 * (size["d"] or 1) // SHARD_BYTES)))

    def plain(kind):
        def run(batches):
            for batch in batches:
                vectors, n = batch.column(1).to_pylist(), batch.num_rows
                sizes = [len(x) for x in vectors]
                keys, lists = (sizes, [None] * n) if kind else ([None] * n, [[d] for d in sizes])
                yield _emit(batch.column(2).to_pylist(), kind, keys, batch.column(0).to_pylist(), lists, [np.array(x, "f8").tobytes() for x in vectors])

        return run

    everyone = indexed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(ways)).cast("int"))
    asking = short.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    met = everyone.mapInArrow(plain(1), KIND).union(asking.mapInArrow(plain(0), KIND)).repartitionById(ways, "shard").sortWithinPartitions("shard", "kind", "key")
    exact = ranked(met.mapInArrow(_ranker(k), pairs))
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").select(*found.columns).unionByName(exact)
