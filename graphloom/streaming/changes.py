"""Change streams: debounced batches, classification against known state, move pairing, change logs.

The batch forms work on any table of events; the streaming forms use the same rules per micro-batch, with the
known state in a stored table, and a stateful operator for the debounce timer.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.diff import pair_by_content
from ..sources.paths import base_name, matches, parent

# Milliseconds of quiet that end a batch, and its longest duration.
QUIET_MS, CEILING_MS = 100, 500
EVENT = "workspace string, path string, type string, ts timestamp, seq long, hash string"


def batches(events: DataFrame, by: list[str], order: list[str], ts: str = "ts", quiet: float = QUIET_MS / 1000, ceiling: float = CEILING_MS / 1000) -> DataFrame:
    """``events`` with ``batch``: a batch ends ``quiet`` seconds after its last event or ``ceiling`` after its first.

    ``order`` begins with the time; events without one come first, as one moment.  One shuffle; then each workspace's events pass in order
    with nothing kept but where its present batch began.
    """
    columns = events.columns
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62)))
    rows = events.select(*columns, at.alias("batch")).repartition(*by).sortWithinPartitions(*by, *order)
    places = [columns.index(c) for c in by]
    gap, longest = int(quiet * 1e6), int(ceiling * 1e6)

    def run(parts):
        key = begun = last = number = None
        for part in parts:
            t = part.column(len(columns)).to_numpy(zero_copy_only=False)
            keys = list(zip(*[part.column(i).to_pylist() for i in places])) if places else [()] * len(t)
            out = np.empty(len(t), np.int64)
            ends = [*[i for i in range(1, len(t)) if keys[i] != keys[i - 1]], len(t)]
            i = 0
            for end in ends:
                if end == 0:
                    continue
                if keys[i] != key:
                    key, begun, last, number = keys[i], None, None, -1
                pauses = iter([*(i + 1 + np.flatnonzero(np.diff(t[i:end]) >= gap)).tolist(), end])
                pause = next(pauses)
                while i < end:
                    if begun is None or t[i] - last >= gap or t[i] - begun >= longest:
                        begun, number = t[i], number + 1
                    while pause <= i:
                        pause = next(pauses, end)
                    stop = min(pause, i + int(np.searchsorted(t[i:end], begun + longest)))
                    out[i:stop] = number
                    last, i = t[stop - 1], stop
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(out)], [*columns, "batch"])

    return rows.mapInArrow(run, StructType([*events.schema.fields, StructField("batch", LongType())]))


def last_writes(batched: DataFrame, by: list[str], key: str, order: Column) -> DataFrame:
    """The last event of each key in each batch."""
    value = F.struct(*[c for c in batched.columns if c not in (*by, key, "batch")])
    return batched.groupBy(*by, "batch", key).agg(F.max_by(value, order).alias("v")).select(*by, "batch", key, "v.*")


def merged_kind(kinds: Column) -> Column:
    """What a file's events in order come to: a change after a creation stays a creation, renames and deletions override."""
    return F.aggregate(kinds, F.lit(None).cast("string"), lambda was, k: F.when((k == "change") & was.isin("create", "rename"), was).otherwise(k))


def queue(events: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """``key, kind``: each key's events merged in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("kind"))))
    return events.groupBy(key).agg(merged_kind(F.transform(rows, lambda r: r["kind"])).alias("kind"))


def batch_order(changes: DataFrame) -> DataFrame:
    """Renames, deletions, changes, creations; shorter paths first."""
    rank = F.when(F.col("kind") == "rename", 0).when(F.col("kind") == "delete", 1).when(F.col("kind") == "change", 2).otherwise(3)
    return changes.orderBy(rank, F.length("path"), "path")


def in_scope(events: DataFrame, include, exclude) -> DataFrame:
    path = F.col("path")
    return events.where(matches(path, include) & ~matches(path, exclude))


def classify(events: DataFrame, known: DataFrame) -> DataFrame:
    """``kind, path, from_path, hash`` of one batch's last events (``path, type, hash, seq``) against known files (``path, hash``).

    Deletions of unknown paths and unchanged contents are nothing; a deletion and a creation of one content are a move;
    writes are creations or changes by whether the file is known.
    """
    e = events.join(known.select("path", F.col("hash").alias("old")), "path", "left")
    gone = e.where("type = 'delete' and old is not null").select(F.col("old").alias("hash"), "path", "seq")
    new = e.where("type <> 'delete' and old is null").select("hash", "path", "seq")
    moved = pair_by_content(gone, new)
    none = F.lit(None).cast("string")
    deleted = gone.join(moved.select(F.col("from_path").alias("path")), "path", "left_anti").select(F.lit("deleted").alias("kind"), "path", none.alias("from_path"), none.alias("hash"))
    created = new.join(moved.select(F.col("to_path").alias("path")), "path", "left_anti").select(F.lit("created").alias("kind"), "path", none.alias("from_path"), "hash")
    changed = e.where("type <> 'delete' and old is not null and not (old <=> hash)").select(F.lit("changed").alias("kind"), "path", none.alias("from_path"), "hash")
    moves = moved.join(new.select(F.col("path").alias("to_path"), "hash"), "to_path").select(F.lit("moved").alias("kind"), F.col("to_path").alias("path"), "from_path", "hash")
    return created.unionByName(changed).unionByName(deleted).unionByName(moves)


def next_state(known: DataFrame, changes: DataFrame) -> DataFrame:
    """The known files after a batch."""
    gone = changes.where("kind = 'deleted'").select("path").union(changes.where("kind = 'moved'").select("from_path")).union(changes.where("kind <> 'deleted'").select("path"))
    return known.select("path", "hash").join(gone, "path", "left_anti").unionByName(changes.where("kind <> 'deleted'").select("path", "hash"))


def forget_below(known: DataFrame, folder: str) -> DataFrame:
    return known.where(~((F.col("path") == folder) | F.col("path").startswith(folder + "/")))


def change_log(changes: DataFrame) -> DataFrame:
    """``rank, kind, path, from_path``: created, changed, deleted, moved."""
    rank = F.when(F.col("kind") == "created", 0).when(F.col("kind") == "changed", 1).when(F.col("kind") == "deleted", 2).otherwise(3)
    return changes.select(rank.alias("rank"), "kind", "path", "from_path")


def initial(files: DataFrame, skip: bool = False) -> DataFrame:
    """The first batch: every file as created, or nothing."""
    none = F.lit(None).cast("string")
    out = files.select(F.lit("created").alias("kind"), "path", none.alias("from_path"), "hash")
    return out.where("false") if skip else out


# Streams


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON events that are put into a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def _flush(key, rows, state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold each workspace's last event by path; let them go after quiet, or when the ceiling is reached."""
    if state.hasTimedOut:
        first, held = state.get
        state.remove()
        yield _held(key[0], held)
        return
    now = state.getCurrentProcessingTimeMs()
    first, held = state.get if state.exists else (now, "[]")
    parts = [pd.read_json(_text(held), orient="records", dtype=False)] if held != "[]" else []
    new = pd.concat([*parts, *rows]).astype({"path": str})
    new["ts"] = new["ts"].astype(str)
    new = new.sort_values("seq", kind="stable").drop_duplicates("path", keep="last")
    held = new.to_json(orient="records")
    if now - first >= CEILING_MS:
        state.remove()
        yield _held(key[0], held)
    else:
        state.update((first, held))
        state.setTimeoutDuration(max(1, min(QUIET_MS, first + CEILING_MS - now)))


def _text(x: str):
    import io

    return io.StringIO(x)


def _held(workspace: str, held: str) -> pd.DataFrame:
    rows = pd.read_json(_text(held), orient="records", dtype=False)
    return pd.DataFrame({"workspace": workspace, "path": rows["path"].astype(str), "type": rows["type"].astype(str), "hash": rows["hash"].astype(object).where(rows["hash"].notna(), None), "seq": rows["seq"].astype("int64")})


def debounce(stream: DataFrame) -> DataFrame:
    """A stream of each workspace's last events by path, in batches by quiet and ceiling (processing time)."""
    return stream.groupBy("workspace").applyInPandasWithState(_flush, "workspace string, path string, type string, hash string, seq long", "first long, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(stream: DataFrame, state_folder: str, log_folder: str, include=("**/*",), exclude=(), every: str | None = None):
    """Run a stream of events (:data:`EVENT`): classify each micro-batch against the stored state, append the change log,
    then store the next state.  Versions of the state are numbered by batch, so a batch that is run again starts from
    the state before it and writes the same rows."""
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = lambda n: f"{state_folder}/v{n}"
        known = spark.read.schema("path string, hash string").parquet(path(number - 1)) if number else spark.createDataFrame([], "path string, hash string")
        last = in_scope(batch, include, exclude).groupBy("path").agg(F.max_by(F.struct("type", "hash", "seq"), "seq").alias("e")).select("path", "e.*")
        changes = classify(last, known)
        change_log(changes).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log_folder}/batch={number}")
        next_state(known, changes).write.mode("overwrite").parquet(path(number))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{state_folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def entries_of(changes: DataFrame) -> DataFrame:
    """File rows of created and changed paths, as the filesystem writer takes them."""
    return changes.where("kind in ('created', 'changed', 'moved')").select("path", base_name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent"), F.col("hash").alias("content_hash"))


def reconcile_periodically(spark: SparkSession, stored, found, act, heartbeat: float = 60.0, every: float = 300.0, by: str = "hybrid"):
    """A stream that beats each ``heartbeat`` seconds and, if the last run is ``every`` seconds ago or more, hands what differs between the
    stored files and those found (functions that give ``path, hash, modified``) to ``act``.  The first beat runs."""
    from ..operators.diff import reconcile

    done = {"at": None}

    def beat(batch: DataFrame, number: int) -> None:
        now = time.monotonic()
        if done["at"] is None or now - done["at"] >= every:
            act(reconcile(stored(), found(), by))
            done["at"] = now

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(beat).trigger(processingTime=f"{heartbeat} seconds").start()
