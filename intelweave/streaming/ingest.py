"""New report files through the pipeline, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.metadata import with_metadata
from ..functions.patterns import Vocabulary
from ..operators.entities import extract_entities
from ..operators.paragraphs import quarantine, segment_paragraphs
from ..sources.files import file_stem, load_json_log, load_text

#: Suffixes of files that hold no text; files of any other suffix, or of none, are read as text.
BINARY = (".pdf", ".zip", ".png", ".jpg", ".gif", ".exe", ".dll")


def report_stream(spark: SparkSession, root: str, glob: str = "*", name: Column | None = None) -> DataFrame:
    """reports with text of the files that arrive below root: JSON in one form, any other suffix as text, binary ones left out.

    name tells a report's name from file_path; without it the file's stem is its name.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = files.filter(~F.concat(F.lit("."), suffix).isin(*BINARY)).withColumn("__text", load_text(F.col("content")))
    text = F.when(suffix == "json", load_json_log(F.col("__text"))).otherwise(F.col("__text"))
    named = files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), text.alias("text"), suffix.alias("file_type"))
    return with_metadata(named.withColumn("raw_name", file_stem(F.col("file_path")) if name is None else name))


def first_reports(reports: DataFrame, within: str | None = None) -> DataFrame:
    """The first row of each report_id, over all batches: the ids seen lie in the stream's state store, not in the output.

    within (such as "30 days") lets the state forget ids that are older than the newest file by more than that.
    """
    if within is None:
        return reports.dropDuplicates(["report_id"])
    return reports.withWatermark("modified", within).dropDuplicatesWithinWatermark(["report_id"])


def ingest_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, vocabulary: Vocabulary | None = None, name: Column | None = None, within: str | None = None) -> StreamingQuery:
    """Process all files that are new since the last call: reports, paragraphs, entities and skipped below out.

    Each report_id is stored once, by the state of first_reports. A batch reads nothing that earlier ones wrote; one that
    is run again overwrites what it wrote before.
    """

    def one(batch: DataFrame, number: int) -> None:
        path = lambda table: f"{out}/{table}/batch={number}"
        batch.write.mode("overwrite").parquet(path("texts"))
        texts = batch.sparkSession.read.schema(batch.schema).parquet(path("texts"))
        good, skipped = quarantine(texts)
        columns = ["report_id", "paragraph_index", "text", "apt_group", "source_vendor", "published_date", "file_path"]
        segment_paragraphs(good).select(*columns).write.mode("overwrite").parquet(path("paragraphs"))
        paragraphs = batch.sparkSession.read.parquet(path("paragraphs"))
        for table, rows in (("entities", extract_entities(paragraphs, vocabulary)), ("skipped", skipped), ("reports", texts.drop("text"))):
            rows.write.mode("overwrite").parquet(path(table))

    stream = first_reports(report_stream(spark, root, name=name), within)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
