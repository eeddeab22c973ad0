"""Stored tables, search by trigrams, folds and rounds against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from intelweave.operators import catalog as K
from intelweave.operators import features as FE
from intelweave.operators import learn as L
from intelweave.operators import propagate as N
from intelweave.operators import search as SR
from intelweave.sources import stored as ST


def test_stored_table_follows_a_dictionary(spark, tmp_path):
    rng, path, kind = random.Random(2), f"{tmp_path}/t", "k string, name string, added long"
    rows = lambda n, at: [(f"k{rng.randrange(60)}", f"n{at}-{x}", at * 1000 + x) for x in range(n)]
    first = {k: (k, n, a) for k, n, a in rows(40, 0)}
    ST.write_stored(spark.createDataFrame([*first.values(), (None, "lost", 1)], kind), path, "k", 8)
    for at in range(1, 4):
        new = rows(15, at)
        ST.upsert_stored(spark, path, spark.createDataFrame([*new, (None, "lost", 2)], kind), "k", "added", 8)
        for k, n, a in new:
            first[k] = max(first.get(k, (k, n, a)), (k, n, a), key=lambda r: r[2])
        gone = [f"k{rng.randrange(60)}" for _ in range(12)]
        ST.delete_stored(spark, path, spark.createDataFrame([(g,) for g in [*gone, None, "unknown"]], "k string"), "k", 8)
        for g in gone:
            first.pop(g, None)
        assert Counter(map(tuple, ST.read_stored(spark, path, "k").select("k", "name", "added").collect())) == Counter(first.values())


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = tmp_path / "t"
    ST.write_stored(spark.range(200).selectExpr("id AS k", "'a' AS name", "0L AS added"), str(path), "k", 16)
    files = lambda: {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in path.glob("bucket=*")}
    before = files()
    ST.upsert_stored(spark, str(path), spark.createDataFrame([(7, "b", 1)], "k long, name string, added long"), "k", "added", 16)
    assert sum(before[b] != files()[b] for b in before) == 1
    every = [(k,) for k in range(200)]
    ST.delete_stored(spark, str(path), spark.createDataFrame(every, "k long"), "k", 16)
    assert ST.read_stored(spark, str(path), "k").count() == 0
    ST.upsert_stored(spark, str(path), spark.createDataFrame([(7, "c", 2)], "k long, name string, added long"), "k", "added", 16)
    assert [tuple(r) for r in ST.read_stored(spark, str(path), "k").collect()] == [(7, "c", 2)]


def test_search_by_trigrams_equals_a_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abÉ ") for _ in range(rng.randrange(30))), rng.choice([None, "Abba", "ab", ""])) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, name string, kind string")
    SR.write_trigrams(table, f"{tmp_path}/i", "id", ("name", "kind"))
    for text in ("abb", "ABBA", "É a", "ab", "", "aaaa", "zzz", "b a b", "bab%"):
        got = {r.id for r in SR.search_trigrams(spark, table, f"{tmp_path}/i", text, "id", ("name", "kind")).collect()}
        assert got == {k for k, *values in rows if any(text.lower() in (v or "").lower() for v in values)}, text
    plan = SR.search_trigrams(spark, table, f"{tmp_path}/i", "abba", "id", ("name", "kind"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "PushedFilters: [In(trigram" in plan


def test_no_report_is_scored_by_a_model_that_saw_it(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab"[k % 2], [float(k)]) for k in range(40)], "report_id long, apt_group string, readout array<double>")
    seen: list[set] = []
    scored: list[set] = []

    def fit(train):
        seen.append({r.report_id for r in train.collect()})
        return len(seen) - 1

    def predict(model, held):
        scored.append({r.report_id for r in held.collect()})
        return held.select("report_id", F.lit("a").alias("label"), F.lit(1.0).alias("probability"))

    monkeypatch.setattr(L, "predict", predict)
    out = L.fold_predictions(rows, folds=4, fit=fit)
    assert all(not a & b and len(a | b) == 40 for a, b in zip(seen, scored, strict=True)) and set().union(*scored) == set(range(40))
    assert Counter(r.report_id for r in out.collect()) == Counter(range(40)) and [len(s) for s in scored] == [10] * 4


def test_fold_predictions_with_the_classifier(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, "abc"[k % 3], [k % 3 + rng.gauss(0, 0.05), rng.random()]) for k in range(90)], "report_id long, apt_group string, readout array<double>")
    best = L.fold_predictions(rows, folds=3).groupBy("report_id").agg(F.max_by("label", "probability").alias("said")).join(rows, "report_id")
    assert best.filter("said = apt_group").count() > 80


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds(spark, rounds):
    edges = [("r", 0, 1), ("r", 1, 0), ("r", 1, 2), ("r", 2, 1), ("r", 2, 2)]
    x = {0: [1.0, 2.0], 1: [0.5, 0.0], 2: [3.0, 1.0], 3: [4.0, 4.0]}
    e = spark.createDataFrame(edges, "report_id string, src int, dst int")
    f = spark.createDataFrame([("r", k, v) for k, v in x.items()], "report_id string, node_idx int, x array<double>")
    mean, gcn = dict(x), dict(x)
    loops = [(s, d) for _, s, d in edges if s != d] + [(k, k) for k in x]
    degree = Counter(d for _, d in loops)
    for _ in range(rounds):
        near = {k: [mean[s] for _, s, d in edges if d == k] for k in x}
        mean = {k: v + ([sum(c) / len(near[k]) for c in zip(*near[k])] if near[k] else [0.0] * len(v)) for k, v in mean.items()}
        gcn = {k: [sum(gcn[s][i] / (degree[s] * degree[k]) ** 0.5 for s, d in loops if d == k) for i in range(2)] for k in x}
    for got, want in ((N.mean_aggregate(e, f, rounds), mean), (N.gcn_aggregate(e, f, rounds), gcn)):
        rows = {r.node_idx: r.x for r in got.collect()}
        assert rows.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(rows[k], want[k], strict=True))


def test_randomised_svd_is_the_exact_one(spark):
    rng = np.random.default_rng(8)
    spectrum = np.linspace(30, 1, 40)
    a = (np.linalg.qr(rng.normal(size=(300, 40)))[0] * spectrum) @ np.linalg.qr(rng.normal(size=(120, 40)))[0].T + rng.normal(scale=0.05, size=(300, 120))
    a[np.abs(a) < 0.15] = 0
    rows = [(k, f"t{j:03d}", float(a[k, j])) for k in range(300) for j in range(120) if a[k, j]]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(3)
    texts = weights.groupBy("doc_id").agg(F.collect_list(F.struct(F.substring("term", 2, 3).cast("int").alias("at"), "weight")).alias("p")).select(F.col("p.at").alias("at"), F.col("p.weight").alias("weight"))
    basis, sizes = FE.svd_basis(texts, 120, 25)
    exact = np.linalg.svd(a)[1]
    assert np.abs(sizes / exact[:25] - 1).max() < 0.01
    assert np.abs(basis.T @ basis - np.eye(25)).max() < 1e-9
    got = {r.doc_id: r.v for r in FE.truncated_svd(weights, ["doc_id"], 25).collect()}
    v = np.stack([got[k] for k in range(300)])
    assert v.shape == (300, 25) and np.abs(np.linalg.norm(v, axis=0) / exact[:25] - 1).max() < 0.01
    assert np.abs(v.T @ v - np.diag(sizes**2)).max() < 1e-6 * sizes[0] ** 2
    assert FE.truncated_svd(weights.limit(0), ["doc_id"], 5).collect() == []


def test_box_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(9)
    values = {"a": rng.lognormal(size=20_000), "b": rng.integers(0, 5, size=3000).astype(float), "c": np.array([7.0])}
    rows = [(g, float(x), k % 13) for g, xs in values.items() for k, x in enumerate(xs)] + [("d", None, 0)]
    stats = spark.createDataFrame(rows, "apt_group string, num_nodes double, part int")
    parts = [K.box_sketches(stats.filter(F.col("part") % 4 == k)) for k in range(4)]
    got = {r.apt_group: r for r in K.box_stats_of(parts[0].union(parts[1]).union(parts[2]).union(parts[3])).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, xs in values.items():
        assert (got[g].least, got[g].most) == (xs.min(), xs.max())
        for name, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert (xs < got[g][name]).mean() <= rank + 0.01 and (xs <= got[g][name]).mean() >= rank - 0.01
