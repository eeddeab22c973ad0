"""Blocks of the density clusters: how many there are, and that they are compared chunk by chunk."""

import numpy as np

from intelweave.operators import density


def test_a_larger_table_has_larger_blocks_not_more():
    for n in (20_000, 200_000, 600_000):
        assert -(-n // density._held(n, 64)) <= density.SPREAD + 1
    assert density._held(10**9, 64) * 64 * 8 == density.HELD_BYTES and density._held(10**9, 1 << 20) == density.HELD


def test_blocks_of_several_chunks_give_the_same_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(4, 6)).repeat(30, 0) + rng.normal(scale=0.15, size=(120, 6)), rng.normal(size=(40, 6))])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(160), vectors, strict=True)], "report_id long, v array<double>")
    found = []
    for held, chunk in ((1024, 1024), (50, 7)):
        monkeypatch.setattr(density, "HELD", held)
        monkeypatch.setattr(density, "CHUNK", chunk)
        found.append(sorted(tuple(r) for r in density.dbscan(rows, 0.45, 5).select("report_id", "n_near", "core", "cluster").na.fill(-1).collect()))
    assert found[0] == found[1] and len({c for *_, c in found[0]}) > 3
