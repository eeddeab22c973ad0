"""Benchmark decontamination with Spark expressions only.

A window is WINDOW consecutive words of a benchmark item, or all of a shorter item. Any occurrence of a window of n
words in a document covers a whole block of the document cut into blocks of (n + 1) // 2 words. So a document is
cut into such blocks, and only where a block's hash is in the set of all block-long runs of benchmark words are its
word windows formed, one for each place, and joined to the benchmark's by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

WINDOW = 13
#: Block hashes up to this number are held by every task as a set; beyond it they are joined.
SET_SIZE = 100_000
#: Characters that are no part of a word, before letters are lower-cased.
_NO_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Words, lower-cased from A to Z, each followed by one blank."""
    closed = F.concat(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(" "))
    return F.ltrim(F.regexp_replace(closed, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " ", -1), lambda w: w != "")


def _runs(words: Column, n) -> Column:
    """All runs of n consecutive words; none if there are fewer."""
    count = F.size(words) - n + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, n, gram): the windows of each item."""
    words = items.select(F.col(item_col).alias("item"), words_of(normalised(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    words = words.withColumn("n", F.least(F.size("w"), F.lit(window)))
    return words.select("item", "n", F.explode(_runs(F.col("w"), F.col("n"))).alias("gram")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: the id, n_words, spans (array of struct start, length in words: the hit windows), items (ids of the items hit).

    A null text has no words, a null id is a document like any other. Each row gives a row of its own, also where rows
    agree in id and text. Empty tables give no rows, or rows without hits. Other columns aren't read.
    """
    windows = benchmark_windows(items, item_col, item_text_col, window)
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # window at most
    base = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("norm"))
    base = base.withColumns({"n_words": F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))), "key": F.xxhash64("norm"), "row": F.monotonically_increasing_id()})
    hit = F.lit(False)
    joined = []
    for b in sorted({(n + 1) // 2 for n in lengths}):
        grams = windows.filter((F.col("n") + 1).bitwiseAND(-2) == 2 * b).select(F.explode(_runs(F.split("gram", " "), b)).alias("g"))
        hashes = grams.select(F.xxhash64(F.concat("g", F.lit(" "))).alias("h")).distinct()
        cut = F.regexp_extract_all("norm", F.lit(rf"(?:[^ ]++ ){{{b}}}"), F.lit(0))
        if hashes.limit(SET_SIZE + 1).count() <= SET_SIZE:
            held = [r.h for r in hashes.collect()]  # SET_SIZE at most
            hit = hit | _any_in(cut, held)
        else:
            joined.append((cut, hashes))
    if joined:  # the set is too large to hold: the blocks themselves are joined, and ids come back
        found = None
        for cut, hashes in joined:
            of = base.select("__id", "key", F.explode(F.transform(cut, lambda g: F.xxhash64(g))).alias("h")).join(hashes, "h", "left_semi").select("__id", "key")
            found = of if found is None else found.union(of)
        found = found.distinct().withColumn("listed", F.lit(True))
        f = found.withColumnRenamed("__id", "fid").withColumnRenamed("key", "fkey")
        base = base.join(f, F.col("__id").eqNullSafe(F.col("fid")) & (F.col("key") == F.col("fkey")), "left").drop("fid", "fkey")
        hit = hit | F.coalesce("listed", F.lit(False))
    # one row for the document itself, and one for each of its windows where a block was found
    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")
    marked = base.withColumn("w", F.when(hit, words_of(F.col("norm"))))
    places = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram")))
    for n in sorted(lengths):
        places = F.concat(places, F.when(F.col("w").isNotNull(), _places(F.col("w"), n)).otherwise(none))
    each = marked.select("__id", "key", "row", "n_words", F.explode(places).alias("p")).select("__id", "key", "row", "n_words", "p.*")
    side = small(windows.select(F.col("gram").alias("wgram"), F.col("n").alias("wn"), "item"), "wgram")
    met = each.join(side, (F.col("gram") == F.col("wgram")) & (F.col("n") == F.col("wn")), "left").filter((F.col("at") < 0) | F.col("item").isNotNull())
    out = met.groupBy("__id", "key", "row", "n_words").agg(
        F.collect_set(F.when(F.col("at") >= 0, F.struct(F.col("at").alias("start"), F.col("n").alias("length")))).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    return out.select(F.col("__id").alias(id_col), F.col("key").alias("text_key"), "n_words", "spans", "items")


def _any_in(grams: Column, hashes: list[int]) -> Column:
    return F.exists(grams, lambda g: F.xxhash64(g).isin(hashes))


def _places(words: Column, n: int) -> Column:
    return F.transform(_runs(words, n), lambda g, i: F.struct(i.alias("at"), F.lit(n).alias("n"), g.alias("gram")))


def hit_words(spans: Column) -> Column:
    """Places of the words inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: at least one word in share is hit."""
    return found.withColumn("n_hit", F.size(hit_words(F.col("spans"))).cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, all columns kept."""
    bad = judged(find_hits(docs, items, id_col, text_col)).filter("contaminated").select(F.col(id_col).alias("__bad"), F.col("text_key").alias("__bad_key"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")) & (F.xxhash64(normalised(F.col(text_col))) == F.col("__bad_key")), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words, and what stands between two of them, cut out of their texts; a row for a row.

    The rest of a text stays as it is, letter case and punctuation included. All columns are kept. A text without hits, and
    a null one, is as it was; rows that agree in id and text are cut alike; an empty table gives no rows.
    """
    hits = F.array_sort(hit_words(F.col("spans")))
    found = find_hits(docs, items, id_col, text_col).filter(F.size("spans") > 0).select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), hits.alias("__hit")).dropDuplicates(["__id", "__key"])
    both = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(normalised(F.col(text_col))) == F.col("__key")), "left")
    cut = F.regexp_extract_all(F.col(text_col), F.lit(rf"[{_NO_WORD}]*+[^{_NO_WORD}]++|[{_NO_WORD}]++$"), F.lit(0))
    both = both.withColumn("__parts", F.when(F.col("__hit").isNotNull(), cut))  # a column: lambdas would cut again for each hit
    parts = F.col("__parts")
    # runs of kept words between the hits, so that a long text isn't looked through once a word
    edges = F.concat(F.array(F.lit(-1)), F.col("__hit"), F.array(F.size(parts)))
    before = lambda i: F.when((i < F.size("__hit")) & ((i == 0) | (F.get(edges, i) + 1 < F.get(edges, i + 1))), F.regexp_extract(F.get(parts, F.get(edges, i + 1)), rf"^[{_NO_WORD}]*+", 0)).otherwise("")
    kept = lambda i: F.array_join(F.slice(parts, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1), "")
    stays = F.transform(F.sequence(F.lit(0), F.size("__hit")), lambda i: F.concat(kept(i), before(i)))
    return both.withColumn(text_col, F.when(F.col("__hit").isNotNull(), F.array_join(stays, "")).otherwise(F.col(text_col))).select(*docs.columns)
