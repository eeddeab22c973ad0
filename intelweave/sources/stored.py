"""Tables that are changed in place: an upsert or a delete writes anew only the partitions that hold its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")


def write_stored(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """rows as a table in so many partitions by the hash of key. Rows of a null key are left out."""
    known = rows.filter(F.col(key).isNotNull())
    known.select("*", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_stored(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """The rows of a stored table; schema tells its columns where nothing has been written but an empty table."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, bucket int")
    return reader.parquet(path).filter(F.col(key).isNotNull()).drop("bucket")


def _rewrite(spark: SparkSession, path: str, key: str, changes: DataFrame, buckets: int, change) -> None:
    """Partitions that hold keys of changes, as change makes them. A partition that ends empty keeps a row of nulls in place of its rows.

    The new rows are a written table before anything is overwritten, so a job that is lost on the way can run again.
    """
    touched = sorted(r.bucket for r in changes.filter(F.col(key).isNotNull()).select(_bucket(key, buckets)).distinct().collect())  # as many as there are partitions
    if not touched:
        return
    old = spark.read.parquet(path)
    held = old.filter(F.col("bucket").isin(touched) & F.col(key).isNotNull()).drop("bucket")
    now = change(held).select("*", _bucket(key, buckets))
    none = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema], "bucket")
    ready = kept(now.unionByName(none))
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_stored(spark: SparkSession, path: str, new: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Add the rows of new; of rows of one key, old and new, the one last in order stays. buckets is that of write_stored."""

    def change(held: DataFrame) -> DataFrame:
        both = held.unionByName(new.filter(F.col(key).isNotNull()).select(*held.columns))
        rest = [c for c in held.columns if c != key]
        return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*held.columns)

    _rewrite(spark, path, key, new, buckets, change)


def delete_stored(spark: SparkSession, path: str, gone: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Take out the rows whose key is in gone."""
    keys = gone.select(key).filter(F.col(key).isNotNull()).distinct()
    _rewrite(spark, path, key, keys, buckets, lambda held: held.join(keys, key, "left_anti"))
