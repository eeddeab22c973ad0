"""Entity extraction with few terms and with many: the same mentions; with few, each paragraph by itself."""

import pytest
from pyspark.sql import functions as F

from intelweave.functions.patterns import Vocabulary
from intelweave.operators import dictionary, entities


def _paragraphs(spark):
    texts = [
        "Seen in New York and north  korea: Cobalt Strike, mimikatz.exe and net; CVE-2021-1234 at 10.1.2.3.",
        "Straße nach MOSCOW, İstanbul; ΣΊΣΥΦΟΣ and ſony pictures, Konni. Energy\u0001 \u0002x\u0003 energy",
        "Panda, Deep  Panda. x.net .NET c++ c++y; Operation Night Owl of Boeing",
        "", None, "nothing at all",
    ]
    return spark.createDataFrame([(f"r{k}", k, t) for k, t in enumerate(texts)], "report_id string, paragraph_index int, text string")


WORDS = Vocabulary(malware=["c++", ".net", "σίσυφος", "--", "Deep Panda"], operation=["Night Owl"], industry=["energy", "Boeing"])


@pytest.mark.parametrize("vocabulary", [None, WORDS, Vocabulary([], [], [], [])])
def test_few_terms_like_many(spark, monkeypatch, vocabulary):
    rows = lambda: sorted(map(tuple, entities.extract_entities(_paragraphs(spark), vocabulary).collect()))
    few = rows()
    assert len(few) > 5
    monkeypatch.setattr(dictionary, "INLINE_TERMS", 0)
    assert rows() == few


def test_few_terms_need_no_shuffle_and_no_second_evaluation(spark):
    plan = entities.extract_entities(_paragraphs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "Filter (" not in plan.replace("Filter (isnotnull", "")


def test_folded_all_letters(spark):
    every = "".join(chr(c) for c in range(1, 0xD800))
    each = spark.createDataFrame([(c,) for c in [*every, every]], "c string")
    plain = F.translate(F.lower(F.translate("c", "İ", "i")), "".join(dictionary._TWINS), "".join(dictionary._TWINS.values()))
    assert each.filter(dictionary.folded(F.col("c")) != plain).count() == 0
