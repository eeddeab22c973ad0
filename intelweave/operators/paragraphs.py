"""From report texts to paragraphs and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import strip
from ..functions.text import MIN_PARAGRAPH, segment


def segment_paragraphs(reports: DataFrame, min_length: int = MIN_PARAGRAPH) -> DataFrame:
    """One row per paragraph: all columns of reports with the paragraph as text, numbered from 0 after short ones are gone."""
    rest = [c for c in reports.columns if c != "text"]
    return reports.select(*rest, F.posexplode(segment(F.col("text"), min_length)).alias("paragraph_index", "text"))


def attach_report_columns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """rows with the group, vendor, date and path of their report."""
    cols = [c for c in ("apt_group", "source_vendor", "published_date", "file_path") if c in reports.columns]
    return rows.join(reports.select("report_id", *cols), "report_id")


def document_text(paragraphs: DataFrame, limit: int = 10_000) -> DataFrame:
    """report_id and the first limit characters of its paragraphs, joined by blanks."""
    # paragraphs beyond the limit can't show: what starts after limit characters goes before the collection
    kept = paragraphs.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", F.left("text", F.lit(limit)).alias("text")))).alias("p"))
    return kept.select("report_id", F.left(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit(limit)).alias("text"))


def quarantine(reports: DataFrame, skip_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, skipped): rows with an error, and empty texts unless they are to stay."""
    error = F.col("error") if "error" in reports.columns else F.lit(None).cast("string")
    empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    reason = F.when(error.isNotNull(), error).when(empty & F.lit(skip_empty), "empty_text")
    marked = reports.withColumn("reason", reason)
    path = F.col("file_path") if "file_path" in reports.columns else F.lit(None).cast("string")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("report_id", path.alias("file_path"), "reason")
