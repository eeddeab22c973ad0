"""Files in, tables out. All reading goes through Spark, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import split_tags, with_metadata
from ..operators.dictionary import normalized_terms
from ..schemas import ENTITIES, GROUPS, INDEX_CSV, PARAGRAPHS, RUN_RESULT

TEXT_SUFFIXES = (".txt",)
REPORT_SUFFIXES = (".pdf", ".txt")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = REPORT_SUFFIXES, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content]) of files below root with such a suffix, in any case; no rows if root is missing."""
    cols = ["path", "modificationTime", "length", *(["content"] if content else [])]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = reader.load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kinds = "path string, modificationTime timestamp, length long" + (", content binary" if content else "")
        return spark.createDataFrame([], kinds)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(s))
    return files.filter(wanted).select(*cols)


def file_stem(path: Column) -> Column:
    """Name of the file at the end of a path, without its suffix."""
    return F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def build_report_index(spark: SparkSession, pdf_roots: list[str], text_roots: list[str], only_txt: bool = False, name: Column | None = None) -> DataFrame:
    """reports of all files below the roots: a path counts once. Of two files with one stem the ids agree. Raises if there are none.

    name tells a report's name from file_path; without it the file's stem is its name.
    """
    # a root that is given twice is listed once
    roots = [] if only_txt else [scan_files(spark, r, (".pdf",)) for r in dict.fromkeys(pdf_roots)]
    roots += [scan_files(spark, r, TEXT_SUFFIXES) for r in dict.fromkeys(text_roots)]
    if not roots:
        raise ValueError("no report files")
    files = roots[0]
    for more in roots[1:]:
        files = files.unionByName(more)
    if files.isEmpty():
        raise ValueError("no report files")
    return index_files(files.select(F.col("path").alias("file_path")), name)


def index_files(files: DataFrame, name: Column | None = None) -> DataFrame:
    """reports of files (file_path): a path counts once; everything else is read from the name."""
    files = files.dropDuplicates(["file_path"])
    named = with_metadata(files.withColumn("raw_name", file_stem(F.col("file_path")) if name is None else name).withColumn("file_type", F.lower(F.regexp_extract("file_path", r"\.([^.]*)$", 1))))
    return named.select("report_id", "apt_group", "source_vendor", "published_date", "file_path", "file_type", "raw_name", "extra_tags")


def load_text(content: Column) -> Column:
    """UTF-8 text of bytes, invalid ones left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def load_json_log(text: Column) -> Column:
    """A JSON document as text in one form (keys sorted, no spaces); anything else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def load_reports(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".txt", ".json")) -> DataFrame:
    """reports with text of the text and JSON files below root."""
    files = scan_files(spark, root, suffixes, content=True)
    raw = load_text(F.col("content"))
    named = files.select(F.col("path").alias("file_path"), F.when(F.endswith(F.lower("path"), F.lit(".json")), load_json_log(raw)).otherwise(raw).alias("text"))
    named = named.withColumn("raw_name", file_stem(F.col("file_path"))).withColumn("file_type", F.lower(F.regexp_extract("file_path", r"\.([^.]*)$", 1)))
    return with_metadata(named)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """paragraphs, entities or skipped rows as JSON lines."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.filter("report_id is not null").withColumn("paragraph_index", F.coalesce("paragraph_index", F.lit(0)))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """paragraphs from JSON lines; blank lines are no rows, a missing index is 0."""
    return _numbered(spark.read.schema(PARAGRAPHS).json(path))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.schema(ENTITIES).json(path))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that stands last in order."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """reports from a CSV index; the last row of a report_id wins (rows of one file in their order, files by name)."""
    rows = spark.read.option("header", True).option("multiLine", True).schema(INDEX_CSV).csv(path)
    placed = rows.withColumn("__at", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k")))
    last = last_per_key(placed, "report_id", "__at")
    return last.withColumn("extra_tags", split_tags(F.coalesce("extra_tags", F.lit("")))).withColumn("published_date", F.to_date("published_date"))


def write_index(reports: DataFrame, path: str) -> None:
    reports.withColumn("extra_tags", F.array_join("extra_tags", "|")).write.mode("overwrite").option("header", True).csv(path)


def vocabulary_terms(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(term) of JSON files, each either {key: [...]} or a bare list, without blanks around terms; no rows if path is missing or holds something else."""
    try:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "term string")
    text = F.col("value")
    terms = F.coalesce(F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>"), F.from_json(text, "array<string>"))
    return normalized_terms(files.select(F.explode(terms).alias("term")))


def load_vocabulary(spark: SparkSession, path: str, key: str) -> list[str]:
    """vocabulary_terms as a list for Vocabulary, whose lists are small; extract_entities takes a large one as a DataFrame."""
    return [r.term for r in vocabulary_terms(spark, path, key).collect()]


def collect_run_results(spark: SparkSession, root: str, glob: str = "test_results.json") -> DataFrame:
    """(model_dir, accuracy, f1_weighted, f1_macro) of all test_results.json below root, one a folder; unreadable ones are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return run_results(reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def run_results(files: DataFrame) -> DataFrame:
    """(model_dir, accuracy, f1_weighted, f1_macro) of files (path, value: JSON); the directory names the model."""
    read = files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("model_dir"), F.from_json("value", RUN_RESULT).alias("r"))
    return read.filter("r.accuracy is not null").select("model_dir", "r.accuracy", "r.f1_weighted", "r.f1_macro")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUPS).option("multiLine", True).json(path)


def file_digests(content: Column) -> tuple[Column, Column]:
    """(md5, sha256) of bytes."""
    return F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256")


def sniff_file_type(name: Column, content: Column) -> Column:
    """Kind of a file by its first bytes or its suffix; the first rule that holds."""
    head = lambda h: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(h))
    ends = lambda *s: F.lower(name).rlike("(" + "|".join(x.replace(".", r"\.") for x in s) + ")$")
    return (
        F.when(head("4D5A"), "PE executable (signature)")
        .when(head("7F454C46"), "ELF executable (signature)")
        .when(ends(".doc", ".docm", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"), "Office document (extension)")
        .when(ends(".pdf") | head("25504446"), "PDF (extension/signature)")
        .when(ends(".rtf") | head("7B5C727466"), "RTF (extension/signature)")
        .otherwise("Unknown")
    )
