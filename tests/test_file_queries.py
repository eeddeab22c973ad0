"""Queries that write files and read them again."""

from pathlib import Path

import pytest

from intelweave.plans import queries as Q
from intelweave.sources import files as S


class Stop(Exception):
    pass


def test_s17_files_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.range(1100).selectExpr("id AS doc_id", "'en' AS lang", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stop(spark, root, *rest):
        seen.append(root)
        raise Stop

    monkeypatch.setattr(Q, "ingest_new_files", stop)
    with pytest.raises(Stop):
        Q.QUERIES["s17_ingest_new_files"](spark, str(tmp_path))
    texts = [p.read_text() for p in Path(seen[0]).glob("*.txt")]
    counts = [t.count("Actor used") for t in texts]
    assert sum(counts) == 1100 and max(counts) <= 500


def test_s2_lists_a_root_that_is_given_twice_once(spark, tmp_path, monkeypatch):
    (tmp_path / "APT28_20200101_ESET_x.txt").write_text("x")
    seen, scan = [], S.scan_files
    monkeypatch.setattr(S, "scan_files", lambda spark, root, *rest: seen.append(root) or scan(spark, root, *rest))
    assert S.build_report_index(spark, [], [str(tmp_path)] * 2).count() == 1
    assert seen == [str(tmp_path)]
