"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Texts are worked on in blocks of about this many characters, whatever the batch size is.
BLOCK_CHARS = 1 << 20
#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 8 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that spark.checkpoint.dir names, read again; a folder of our own only where none is set (tests).

    The table cuts the lineage and outlives lost executors. It stays until the folder is cleared.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="intelweave-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/intelweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, *size_of: str) -> DataFrame:
    """df, marked for broadcast when rows and the lengths of the columns size_of add up to few bytes."""
    size = F.count(F.lit(1)) * 64
    for c in size_of:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return F.broadcast(df) if df.agg(size.alias("n")).head().n <= BROADCAST_BYTES else df


def blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, each of about chars bytes (one row at least); null texts are empty."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy()
        start, held = 0, 0
        for k, n in enumerate([*size.tolist(), chars + 1]):
            if k > start and held + n > chars or k == len(size):
                if k > start:
                    part = batch.slice(start, k - start)
                    yield part, ["" if t is None else t for t in part.column(place).to_pylist()]
                start, held = k, 0
            held += n


_held: dict = {}
#: Seconds without a task after which a worker lets go of what it holds.
IDLE_S = 2.0
_running, _timer, _lock = 0, None, threading.RLock()


def give_back() -> None:
    """Memory that is free but still held by the allocators of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _began() -> None:
    global _running, _timer
    with _lock:
        _running += 1
        if _timer is not None:
            _timer.cancel()
            _timer = None


def _ended() -> None:
    global _running, _timer
    with _lock:
        _running -= 1
        if not _running:
            _timer = threading.Timer(IDLE_S, _rest)
            _timer.daemon = True
            _timer.start()
    give_back()


def _rest() -> None:
    with _lock:
        if not _running:
            alone(None)
            gc.collect()
            give_back()


def rested(run: Callable) -> Callable:
    """run, a function of an iterator, whose worker process gives free memory back at the end of the task.

    An executor has more workers than cores in time, and they take turns. One that waits holds nothing: what alone keeps
    goes after IDLE_S seconds without a task.
    """

    def task(batches: Iterator) -> Iterator:
        _began()
        try:
            yield from run(batches)
        finally:
            _ended()

    return task


def alone(key, make=None):
    """What make gives, kept for later tasks of this worker process, which keeps one such object at a time.

    Workers outlive tasks and stages: without this each of them would in the end hold every tokeniser. None lets go of
    what is held.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]


#: A key is hot when it holds a thousandth of the rows or more: a table has a thousand of those at most, whatever its size.
HOT_SHARE = 1000
#: So many tasks share the rows of one hot key.
SALTS = 64


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: str, row_bytes: int = 200) -> DataFrame:
    """rows with the columns of facts, which has one row for each key; null keys meet null keys, rows without facts go.

    weight (a column of facts) is the number of rows of a key. Facts of few rows are broadcast. Else both sides are dealt
    out by key, and the rows of hot keys by salt, too (by the column spread of rows): only the list of hot keys, a thousand
    at most, is broadcast. facts must be a written table: it is counted first.
    """
    total = facts.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("rows")).head()
    other = facts.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in facts.columns])
    same = lambda more: [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys] + more
    if total.n * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), same([])).drop(*[f"__{c}" for c in keys])
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total.rows)
    hot = other.filter(is_hot).select(*[f"__{c}" for c in keys], F.lit(True).alias("__hot"))
    salted = rows.join(F.broadcast(hot), same([]), "left").drop(*[f"__{c}" for c in keys])
    salted = salted.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)).drop("__hot")
    copies = other.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, SALTS - 1).otherwise(0).cast("long"))))
    return salted.join(copies, same([F.col("__salt") == F.col("__salt2")])).drop("__salt", "__salt2", *[f"__{c}" for c in keys])
