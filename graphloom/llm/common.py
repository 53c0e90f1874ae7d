"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MemoTable(dict):
    """A bounded memo of ``compute(key)`` in two generations.

    ``table[key]`` computes on a miss.  :meth:`trim` (called between documents)
    turns a full generation into the old one, so keys in use survive and memory
    stays below two generations.
    """

    def __init__(self, compute: Callable, size: int, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


#: what a worker process keeps from task to task
_KEPT: dict = {}


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept(owner: str, key=None, make: Callable = lambda: None):
    """``make()``, kept in the worker for later tasks of the same operator and key.

    A worker serves many stages; what another operator has kept is let go first, so memory does not add up over stages.
    """
    if _KEPT.get("for") != (owner, key):
        _KEPT.clear()
        give_back()
        _KEPT.update({"for": (owner, key), "value": make()})
    return _KEPT["value"]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators read, under fixed names; null texts become empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def row_struct(docs: DataFrame) -> F.Column:
    """All columns of a row as one struct ``row``, to carry along (whatever their names)."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def row_schema(docs: DataFrame) -> str:
    """The type of :func:`row_struct`, as DDL."""
    return docs.schema.simpleString()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_at: int = 1) -> DataFrame:
    """Apply ``fn`` to parts of the Arrow batches, with a bounded amount of text (column ``text_at``) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text_at):
                yield fn(part)

    return df.mapInArrow(run, schema)


def sub_batches(batch: pa.RecordBatch, text_at: int, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def attach(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """``rows`` joined with ``side`` (stored, one row for each key, with the number ``n`` of its rows), whatever the keys' skew.

    Keys that hold over a 2,000th of all rows (so fewer than 2,000 of them) are broadcast; the rest is joined by shuffle.
    ``how`` is inner or left.
    """
    total, most = side.agg(F.sum(n), F.max(n)).first()
    many = max(1000, (total or 0) // 2000)
    if (most or 0) <= many:
        return rows.join(side, keys, how)
    hot = F.broadcast(side.where(F.col(n) > many))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(n) <= many), keys, how)
    return rest.unionByName(rows.join(hot, keys))


#: folders that this process has made below the shared folder and not removed yet
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is unset (tests on one machine) a local default is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else "file:///tmp/graphloom-checkpoints"
    MADE.append(f"{base.rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders made since there were ``since`` of them (all but ``keep``); what was read from them must have been written."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in MADE[since:]:
        if path not in keep:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    MADE[since:] = [p for p in MADE[since:] if p in keep]
