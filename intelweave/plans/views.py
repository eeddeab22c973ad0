"""The report view over the documents table: a file name and, if wanted, three paragraphs with every kind of entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.metadata import with_metadata
from ..operators.entities import extract_entities
from ..operators.graph import build_nodes, min_entities_filter
from ..operators.paragraphs import segment_paragraphs

_TAIL = r"""concat(text, chr(10), chr(10),
 'Actor used Cobalt Strike from 10.1.', CAST(doc_id % 20 AS <STR>), '.', CAST(doc_id % 7 AS <STR>), ' and c2-', CAST(doc_id % 15 AS <STR>), '.example.net, T10', CAST(50 + doc_id % 10 AS <STR>), ', CVE-2021-', CAST(1000 + doc_id % 30 AS <STR>), ', http://x', CAST(doc_id % 12 AS <STR>), '.example.com/a',
 chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('Operation Night Owl. Campaign Dust-', CAST(doc_id % 5 AS <STR>), '. Targets energy in Moscow, China, Boeing. Seen 10.1.', CAST(doc_id % 20 AS <STR>), '.', CAST(doc_id % 7 AS <STR>), '; again 10.1.', CAST(doc_id % 20 AS <STR>), '.', CAST(doc_id % 7 AS <STR>)) ELSE 'Nothing of note here.' END,
 chr(10), chr(10), 'Dropper ', md5(CAST(doc_id % 40 AS <STR>)), ', ', <SHA>, '. Key HKLM', chr(92), 'Software', chr(92), 'Run; path C:', chr(92), 'Temp', chr(92), 'a', CAST(doc_id % 8 AS <STR>), '.dll; port 8', CAST(100 + doc_id % 50 AS <STR>), '; process evil', CAST(doc_id % 9 AS <STR>), '.exe; service WinSvc', CAST(doc_id % 3 AS <STR>),
 '; host dc', CAST(doc_id % 6 AS <STR>), '.corp; user admin', CAST(doc_id % 4 AS <STR>), '; CWE-', CAST(doc_id % 90 AS <STR>), '; mail a', CAST(doc_id % 11 AS <STR>), '@bad.example.org; SSL serial:aa:bb:cc:dd:ee:ff:00:1', CAST(doc_id % 10 AS <STR>), '; Kaspersky',
 chr(10), 'User-Agent: Bot/', CAST(doc_id % 3 AS <STR>))"""
_NAME = r"""concat(CASE doc_id % 6 WHEN 0 THEN 'APT28' WHEN 1 THEN 'APT29' WHEN 2 THEN '41' WHEN 3 THEN 'Lazarus'
 WHEN 4 THEN 'FIN7' ELSE 'Group' END, '_', <DATE>, '_',
 CASE doc_id % 4 WHEN 0 THEN 'Kaspersky' WHEN 1 THEN 'FireEye' WHEN 2 THEN 'ESET' ELSE 'Misc' END,
 '_T1059_doc', CAST(doc_id AS <STR>))"""
VIEW = f"SELECT doc_id, lang, replace(text, chr(10), concat(chr(10), chr(10))) AS text, {_NAME} AS raw_name FROM (SELECT doc_id, lang, {_TAIL} AS text FROM documents)"
_SPARK = {"<STR>": "STRING", "<SHA>": "sha2(CAST(doc_id % 40 AS STRING), 256)", "<DATE>": "date_format(date_add(DATE'2018-01-01', CAST(doc_id % 2000 AS INT)), 'yyyyMMdd')"}
_DUCKDB = {"<STR>": "VARCHAR", "<SHA>": "sha256(CAST(doc_id % 40 AS VARCHAR))", "<DATE>": "strftime(DATE '2018-01-01' + CAST(doc_id % 2000 AS INTEGER), '%Y%m%d')"}


def view_sql(dialect: str) -> str:
    out = VIEW
    for k, v in (_SPARK if dialect == "spark" else _DUCKDB).items():
        out = out.replace(k, v)
    # a backslash stays as it is in DuckDB's strings; chr(92) writes it in both
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, text, raw_name) of all documents."""
    return spark.sql(view_sql("spark").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reports with text: all columns that the file name gives."""
    return with_metadata(raw_reports(spark, sf_dir))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports are dealt out before anything is done with their texts: a file of few row groups would hold up few tasks."""
    return segment_paragraphs(with_metadata(raw_reports(spark, sf_dir).repartition("raw_name")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(paragraphs(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return min_entities_filter(build_nodes(found if found is not None else entities(spark, sf_dir)))
