"""The pipeline's stages, one after the other, against brute force on small tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from intelweave.llm import quality  # noqa: E402
from intelweave.llm.common import tokenizer_path  # noqa: E402


def _grams(t, n):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    source = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) between 200 and 3000").orderBy("doc_id").limit(60).collect()]
    flat = [t.replace("\n", " ") for t in source]
    items = [" ".join(t.split(" ")[:40]) for t in flat[8:14]]
    near = [" ".join(w if k % 97 else "changed" for k, w in enumerate(t.split(" "))) for t in flat[:6]]
    texts = [*flat, *near, flat[0], f"{flat[7]} {items[0]}", None, "", "too short"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(5, flat[5], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1) for k in range(len(flat))], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        seen[name], docs = (docs, spark.read.parquet(f"{tmp_path}/{len(seen)}")), spark.read.parquet(f"{tmp_path}/{len(seen)}")
    assert list(stages) == list(seen)
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == seen[name][0].columns
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in quality.verdict(quality.measure(before), bands=quality.fit_bands(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))).filter("kept").collect()}
    assert {i for i, _ in ids(after)} == kept and kept.isdisjoint({len(flat) + 8, len(flat) + 9, len(flat) + 10})
    before, after = seen["line dedup"]
    assert all(r.n_chars == len(r.text or "") for r in after.collect())
    assert {t for _, t in ids(after)} <= {t for _, t in ids(before)} and len({t for _, t in ids(after)}) == len(set(ids(after)))  # rows with one id are one document
    before, after = seen["near copies"]
    sets = {i: _grams(t, 5) for i, t in ids(before)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert {i for i, _ in ids(after)} == {i for i in sets if not any(j < i and alike(sets[i], sets[j]) for j in sets)}
    before, after = seen["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = {tuple(words(t)[i : i + 13]) for t in items for i in range(len(words(t)) - 12)}
    clean = set()
    for i, t in ids(before):
        w = words(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(13)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert {i for i, _ in ids(after)} == clean and len(clean) < len(ids(before))
    lib = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in ids(seen["packing"][0])}
    pieces = defaultdict(list)
    for r in seen["packing"][1].collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in want.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == seen["packing"][1].columns
    assert whole.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == len(want)
