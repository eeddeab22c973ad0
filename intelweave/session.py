"""A session with the settings this library is written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Adaptive plans, UTC for dates, Arrow for Python stages, state of streams on disk. Sizes of partitions are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "intelweave", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast when its rows, written as text, add up to few bytes; as it is otherwise."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))) + 64)
    return F.broadcast(df) if (df.agg(size.alias("n")).head().n or 0) <= BROADCAST_BYTES else df


def by_key(df: DataFrame) -> DataFrame:
    """df, to be joined with both sides dealt out by key, never broadcast.

    Spark judges a table by its bytes on disk. A table of many like rows is small there and large in the memory of the
    driver, which holds every broadcast side.
    """
    return df.hint("merge")


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Inside, tables dealt out alike are joined where they lie, by keys that hold the column they are dealt out by. Results are the same."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_where_it_lies(df: DataFrame) -> DataFrame:
    """kept, for what is made of tables that are dealt out alike: without a shuffle of them."""
    with co_partitioned(df.sparkSession):
        return kept(df)


def kept(df: DataFrame, parts: int | None = None, by: str = "report_id") -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names, read again; a folder of our own only where none is set.

    For tables that many branches of a plan read: the plan behind them is made once and left behind. With parts, rows are
    dealt out to so many buckets by the column by: joins and sums whose keys hold it need no shuffle between tables of as
    many parts. Deal df out alike first, or each task writes a file for each bucket.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    if parts is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"kept_{uuid.uuid4().hex}"
    with co_partitioned(spark):
        df.write.format("parquet").bucketBy(parts, by).sortBy(by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a path of their own stay
    return out


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder. Without one set, only a local session gets a folder of its own; a cluster must name it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="intelweave-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/intelweave-{uuid.uuid4().hex}"


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
