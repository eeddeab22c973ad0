"""Token counts of whole texts by compiled finite-state machines (see transducer.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, blocks, rested, tokenizer_path
from .transducer import transducer


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A null id is kept. Repeated rows give repeated results. Other
    columns are not read, so their names don't matter. An empty table gives an empty table. The work needs no
    shuffle: a text is read as pieces of fixed length whose state maps are composed within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path(tokenizer))
        for rows, texts in blocks(batches, "__text"):
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(machine.count_texts(texts))], ["__id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    counted = plain.mapInArrow(rested(run), f"__id {plain.schema['__id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
