"""WARC records from pages, and the derivatives of response records: linked metadata and plain-text conversions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, blocks
from .html_text import lines_of

VERSION = "WARC/1.1"
END = "\r\n\r\n"
_BETWEEN = f"{END}{VERSION}\r\n".encode()
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _urn(*of: Column) -> Column:
    """A record id made from a digest of its parts, so that a rebuilt record keeps its id."""
    h = F.sha2(F.concat_ws("\u0001", *of), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _record(df: DataFrame) -> DataFrame:
    """Adds record: the named fields in one order, an empty line, the block."""
    fields = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for name, c in fields]
    return df.withColumn("record", F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit(END), F.col("block")))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page. A null url has no target; a null html is an empty payload."""
    html, head = F.coalesce(F.col(html_col), F.lit("")), F.concat
    page = pages.select(F.col(id_col).alias("source_id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20]+", "%20").alias("target_uri"), html.alias("payload"))
    http = head(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END), F.col("payload"))
    out = page.withColumns({"block": http, "warc_type": F.lit("response"), "date": F.lit(date), "refers_to": F.lit(None).cast("string"), "content_type": F.lit("application/http; msgtype=response")})
    out = out.withColumns({"payload_digest": _digest(F.col("payload")), "block_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    out = out.withColumn("record_id", _urn(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.col("date"), F.col("source_id").cast("string"), F.col("block_digest")))
    return _record(out.drop("payload"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in blocks(batches, "__payload"):
        plain = ["\n".join(x[0] for x in lines_of(t)) for t in texts]
        kept = [k for k, name in enumerate(rows.schema.names) if name != "__payload"]
        yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), pa.array(plain, pa.string())], [*(rows.schema.names[k] for k in kept), "__plain"])


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record: a metadata and a conversion record that refer to it.

    Input: record_id, target_uri, date, block, block_digest, payload_digest, and source_id if there is one. The
    metadata record (application/warc-fields) keeps the status line, each header of the source response and both
    digests. The conversion record holds all visible text, a line for each block of the page; the payload digest
    is that of the text. Both keep target, date and record_id as WARC-Refers-To. A response without an empty line
    has headers only; a null block gives an empty conversion; repeated records give repeated derivatives with equal
    ids; columns beyond those named aren't read.
    """
    cols = ["record_id", "target_uri", "date", "block_digest", "payload_digest", *(c for c in ("source_id",) if c in records.columns)]
    block = F.coalesce("block", F.lit(""))
    cut = F.instr(block, END)
    head = F.when(cut > 0, F.substring(block, F.lit(1), cut - 1)).otherwise(block)
    payload = F.when(cut > 0, F.substring(block, cut + len(END), F.length(block))).otherwise(F.lit(""))
    source = records.select(*cols, head.alias("__head"), payload.alias("__payload"))
    kept = [f for f in source.schema if f.name != "__payload"]
    done = source.mapInArrow(_texts, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", __plain string")
    lines = F.split("__head", r"\r\n")
    status = F.concat(F.lit("http-status: "), F.regexp_extract("__head", r"^HTTP/\S+ (\d+)", 1))
    headers = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda h: F.concat(F.lit("http-header-"), h))
    facts = F.array_join(F.concat(F.array(status), headers, F.array(F.concat(F.lit("source-block-digest: "), F.col("block_digest")), F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")))), "\r\n")
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(facts, F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__plain").alias("block")),
    )
    out = done.withColumn("d", F.explode(both)).select(*(c for c in cols if c in ("target_uri", "date", "source_id")), F.col("record_id").alias("refers_to"), "d.*")
    out = out.withColumns({"block_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    out = out.withColumns({"payload_digest": F.when(F.col("warc_type") == "conversion", F.col("block_digest")), "record_id": _urn(F.col("warc_type"), F.col("refers_to"), F.col("block_digest"))})
    return _record(out)


def write_warc(records: DataFrame, path: str) -> None:
    """Record after record, each closed by two line ends; a file for each task."""
    records.select("record").write.option("lineSep", END).text(path)


class _Reader:
    """Joins the pieces of a file to records by their declared lengths; holds the pieces of one record."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.length, self.have = -1, 0
        self.done: list[tuple[bytes, bytes, bool]] = []

    def feed(self, *more: bytes) -> None:
        todo = deque(more)
        while todo:
            piece = todo.popleft()
            if not self.pieces and not piece.strip():
                continue
            self.pieces.append(piece)
            if len(self.pieces) == 1:
                head, _, block = piece.partition(END.encode())
                declared = _LENGTH.search(head)
                self.length, self.have = int(declared[1]) if declared else -1, len(block)
            else:
                self.have += len(_BETWEEN) + len(piece)
            if self.have >= self.length:
                todo.extendleft(reversed(self._close()))

    def _close(self) -> list[bytes]:
        """Ends the record at the front; the pieces that turn out not to be part of it."""
        head, _, block = self.pieces[0].partition(END.encode())
        block = _BETWEEN.join([block, *self.pieces[1:]])
        rest = self.pieces[1:]
        self.pieces = []
        over = self.have - self.length
        # the last record of a file keeps the line ends that close it
        if self.length >= 0 and (over == 0 or over == len(END) and block.endswith(END.encode())):
            self.done.append((head, block[: self.length], True))
            return []
        self.done.append((head, block[: len(block) - sum(len(_BETWEEN) + len(p) for p in rest)].removesuffix(END.encode()), False))
        return rest

    def end(self) -> None:
        """The file is over: a record that isn't complete is as it was read, and what follows it is looked at anew."""
        while self.pieces:
            self.feed(*self._close())


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, piece), in order, to (head, block, intact)."""
    reader, file = _Reader(), None

    def flush() -> pa.RecordBatch:
        head, block, intact = zip(*reader.done, strict=True) if reader.done else ((), (), ())
        reader.done = []
        text = lambda values: pa.array([x.decode(errors="replace") for x in values], pa.string())
        return pa.RecordBatch.from_arrays([text(head), text(block), pa.array(intact, pa.bool_())], ["head", "block", "intact"])

    for b in batches:
        for name, piece in zip(b.column(0), b.column(1), strict=True):
            name, piece = name.as_py(), piece.as_py()
            if name != file:
                reader.end()
                file, piece = name, piece.removeprefix(f"{VERSION}\r\n".encode())
            reader.feed(piece)
            if sum(len(x[1]) for x in reader.done) >= BLOCK_CHARS or len(reader.done) >= 512:
                yield flush()
    reader.end()
    yield flush()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: headers (map by lower-case name), block, intact (the length is as declared).

    Spark cuts files at each line end pair before a version line; the pieces of a file then come to one task in order
    and are joined until a block has its Content-Length, so a block may hold that mark itself. A task holds one record.
    A record whose length is missing, wrong or not there in full isn't intact and ends at the next mark; those after it
    are read as if it were right. Bytes that aren't UTF-8 are replaced in block, but count for intact. Of headers
    named twice the last one holds. Empty files give no rows.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    raw = spark.read.option("lineSep", _BETWEEN.decode()).text(path).select(*place, F.col("value").cast("binary").alias("piece"))
    sorted_ = raw.repartition("file").sortWithinPartitions("file", "start", "row")
    parted = sorted_.select("file", "piece").mapInArrow(_records, "head string, block string, intact boolean")
    pairs = F.transform(F.split("head", r"\r\n"), lambda h: F.struct(F.lower(F.substring_index(h, ":", 1)).alias("key"), F.trim(F.regexp_replace(h, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return parted.select(F.map_from_entries(last).alias("headers"), "block", "intact")
