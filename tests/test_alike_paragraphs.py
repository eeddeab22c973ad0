"""Entities of paragraphs that are often alike: the rows of extract_entities, each different text looked through once."""

import pytest
from pyspark.sql import functions as F

from intelweave import session
from intelweave.operators import dictionary, entities

TEXTS = [
    "Seen in New York: Cobalt Strike, mimikatz.exe and net; CVE-2021-1234 at 10.1.2.3, 10.1.2.3.", "Nothing of note here.", None, "",
    "server:c2.example.org " + "10.0.0.1 " * 300 + "and Operation Night Owl of Boeing, Sony Pictures, port 80, 端口 81",
]


@pytest.mark.parametrize("broadcast", [8 << 20, -1])
def test_alike_paragraphs_are_looked_through_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    seen, mentions = [], entities._mentions
    monkeypatch.setattr(entities, "_mentions", lambda rows, *more: (seen.append(rows.count()), mentions(rows, *more))[1])
    p = spark.createDataFrame([(f"r{k}", k % 7, TEXTS[k % len(TEXTS)]) for k in range(60)], "report_id string, paragraph_index int, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    by_text = entities.extract_entities_by_text(p)
    assert seen == [4]
    assert rows(by_text) == rows(entities.extract_entities(p))
    assert by_text.count() > 12 * 300


def test_pattern_of_a_text_holds_its_own_terms_only(spark):
    terms = [(0, 0, t) for t in ("Sony", "Sony Pictures", "Boeing", "c++", "--")]
    few = dictionary.term_rows(dictionary.term_index(spark.createDataFrame(terms, "label_rank int, place int, term string")))
    listed = dictionary.numbered_terms(few)
    numbers = dictionary.known_terms(dictionary.known_keys(dictionary.folded(F.col("t")), few), listed)
    got = spark.createDataFrame([("at SONY pictures",), ("",)], "t string").select(dictionary.rank_pattern(numbers, listed, 0).alias("p")).collect()
    assert [r.p for r in got] == [r"(?=s)\bSony|(?=s)\bSony\ Pictures|(?=\-)\b\-\-", r"(?=\-)\b\-\-"]
