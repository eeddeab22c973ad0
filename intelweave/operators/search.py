"""Substring search by a trigram index: a search reads the posting lists of its own trigrams, and checks what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Posting lists lie in so many partitions by the hash of their trigram, sorted by it.
LISTS = 256


def _searched(columns: tuple[str, ...]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]


def _trigrams(text: Column) -> Column:
    """Distinct trigrams: the text is taken apart once, as finding its k-th letter takes longer the larger k is."""
    three = lambda w: F.transform(w, lambda c, i: F.concat(c, F.get(w, i + 1), F.get(w, i + 2)))
    letters = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(letters, three))))


def _list(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(LISTS)).cast("int")


def write_trigrams(rows: DataFrame, path: str, id_col: str, columns: tuple[str, ...]) -> None:
    """Posting lists (list, trigram, id): each trigram of the lower-case columns with the rows that hold it. Ids are unique.

    A trigram that is in many rows is spread over several files of its list.
    """
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*[_trigrams(c) for c in _searched(columns)])))).alias("trigram"))
    spread = F.pmod(F.xxhash64("id"), F.lit(8))
    dealt = each.withColumn("list", _list(F.col("trigram"))).repartition("list", spread).sortWithinPartitions("list", "trigram")
    dealt.write.mode("overwrite").partitionBy("list").parquet(path)


def search_trigrams(spark: SparkSession, rows: DataFrame, path: str, text: str, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows that hold text, in any case, in one of the columns; as a scan of them would find.

    Only the lists of text's trigrams are read; rows that hold all of them are read and checked. A text of fewer than three
    characters has no trigram: all rows are looked through.
    """
    text = text.lower()
    hit = F.lit(False)
    for c in _searched(columns):
        hit = hit | F.contains(c, F.lit(text))
    asked = sorted({text[k : k + 3] for k in range(len(text) - 2)})
    if not asked:
        return rows.filter(hit)
    lists = sorted({r[0] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(_list(F.col("t"))).collect()})  # of the text that is asked for
    postings = spark.read.parquet(path).filter(F.col("list").isin(lists) & F.col("trigram").isin(asked))
    all_of_them = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(asked)).select(F.col("id").alias(id_col))
    return rows.join(all_of_them, id_col, "left_semi").filter(hit)
