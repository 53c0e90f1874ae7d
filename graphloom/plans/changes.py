"""Registered queries of change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import changes as C
from .algebra import FILES, files
from .star import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("change")
    return e.select((F.col("user_id") % 16).alias("w"), F.col("user_id").alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


_KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'change' END"
_BATCHES = f"""WITH RECURSIVE o AS (SELECT user_id % 16 AS w, user_id AS path, {_KIND} AS kind, ts, event_id AS seq, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT w, path, kind, ts, seq, rn, ts AS first, 0 AS batch FROM o WHERE rn = 1
UNION ALL SELECT o.w, o.path, o.kind, o.ts, o.seq, o.rn, CASE WHEN o.ts - r.ts >= INTERVAL 60 MINUTE OR o.ts - r.first >= INTERVAL 300 MINUTE THEN o.ts ELSE r.first END, r.batch + CASE WHEN o.ts - r.ts >= INTERVAL 60 MINUTE OR o.ts - r.first >= INTERVAL 300 MINUTE THEN 1 ELSE 0 END FROM r JOIN o ON o.w = r.w AND o.rn = r.rn + 1)"""


def _batched(spark, sf_dir):
    return C.batches(_events(spark, sf_dir), ["w"], ["ts", "seq"], quiet=3600, ceiling=18000)


@query("sm2_debounce", _BATCHES + " SELECT w, CAST(batch AS BIGINT) AS batch, count(*) AS events, min(seq) AS first FROM r GROUP BY 1, 2")
def _(spark, sf_dir):
    return _batched(spark, sf_dir).groupBy("w", "batch").agg(F.count("*").alias("events"), F.min("seq").alias("first"))


@query("sm2_last_writes", _BATCHES + " SELECT w, CAST(batch AS BIGINT) AS batch, path, arg_max(kind, (ts, seq)) AS kind FROM r GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return C.last_writes(_batched(spark, sf_dir), ["w"], "path", F.struct("ts", "seq")).select("w", "batch", "path", "kind")


@query("sm3_filter", f"WITH {FILES} SELECT path FROM f WHERE regexp_full_match(path, 'src1[0-9]*/.*') AND NOT regexp_full_match(path, '(.*/)?[^/]*7[.]txt')")
def _(spark, sf_dir):
    return C.in_scope(files(spark, sf_dir), ("/src1*/**",), ("*7.txt",)).select("path")


def _batch(spark, sf_dir):
    """Every seventh known file is written anew, every fifth deleted, every eleventh is new."""
    f = files(spark, sf_dir).withColumnRenamed("doc_id", "seq")
    known = f.where("seq % 11 <> 0").select("path", "hash")
    kind = F.when(F.col("seq") % 5 == 0, "delete").otherwise("update")
    new = F.when(F.col("seq") % 3 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash"))
    events = f.where("seq % 5 = 0 or seq % 7 = 0 or seq % 11 = 0").select("path", kind.alias("type"), new.alias("hash"), "seq")
    return events, known


_CLASSIFIED = f"""WITH {FILES}, e AS (SELECT path, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN hash || '!' ELSE hash END AS hash, hash AS old, doc_id % 11 <> 0 AS known, doc_id % 5 = 0 AS del FROM f WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0),
g AS (SELECT path, old AS hash, row_number() OVER (PARTITION BY old ORDER BY seq) AS k FROM e WHERE del AND known), n AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY seq) AS k FROM e WHERE NOT del AND NOT known),
m AS (SELECT g.path AS from_path, n.path AS path FROM g JOIN n USING (hash, k))
SELECT 'deleted' AS kind, path, NULL AS from_path FROM g WHERE path NOT IN (SELECT from_path FROM m) UNION ALL SELECT 'created', path, NULL FROM n WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT 'changed', path, NULL FROM e WHERE NOT del AND known AND hash <> old UNION ALL SELECT 'moved', path, from_path FROM m"""


@query("sm4_classify", _CLASSIFIED)
def _(spark, sf_dir):
    return C.classify(*_batch(spark, sf_dir)).select("kind", "path", "from_path")


@query("sm5_state", f"WITH {FILES} SELECT path, CASE WHEN doc_id % 3 = 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0) THEN hash || '!' ELSE hash END AS hash FROM f WHERE CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 11 = 0 THEN true ELSE true END")
def _(spark, sf_dir):
    events, known = _batch(spark, sf_dir)
    return C.next_state(known, C.classify(events, known))


@query("sm6_change_log", "SELECT kind, rank, count(*) AS n FROM (SELECT kind, CASE kind WHEN 'created' THEN 0 WHEN 'changed' THEN 1 WHEN 'deleted' THEN 2 ELSE 3 END AS rank FROM (" + _CLASSIFIED + ")) GROUP BY 1, 2")
def _(spark, sf_dir):
    return C.change_log(C.classify(*_batch(spark, sf_dir))).groupBy("kind", "rank").agg(F.count("*").alias("n"))


@query("sm7_initial", f"WITH {FILES} SELECT 'created' AS kind, path, hash FROM f")
def _(spark, sf_dir):
    return C.initial(files(spark, sf_dir)).select("kind", "path", "hash")


@query("sm8_queue", f"WITH e AS (SELECT user_id AS path, ts, event_id, {_KIND} AS kind FROM events), a AS (SELECT path, arg_max(kind, (ts, event_id)) AS last, arg_max(kind, (ts, event_id)) FILTER (kind <> 'change') AS other FROM e GROUP BY 1) SELECT path, CASE WHEN last = 'change' AND other IN ('create', 'rename') THEN other ELSE last END AS kind FROM a")
def _(spark, sf_dir):
    return C.queue(_events(spark, sf_dir), "path", "kind", ["ts", "seq"])


@query("so5_batch_order", f"WITH e AS (SELECT user_id, arg_max({_KIND}, (ts, event_id)) AS kind FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS path, kind FROM e ORDER BY CASE kind WHEN 'rename' THEN 0 WHEN 'delete' THEN 1 WHEN 'change' THEN 2 ELSE 3 END, length(CAST(user_id AS VARCHAR)), 1")
def _(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy(F.col("path").cast("string").alias("path")).agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))
    return C.batch_order(last)
