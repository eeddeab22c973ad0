"""Steps over texts that deal out sums or texts once, not every trigram, paragraph or n-gram again."""

from pyspark.sql import functions as F

from intelweave.operators import dictionary as DI
from intelweave.operators import entities as D
from intelweave.operators import features as FE
from intelweave.operators import language as LG


def test_language_deals_out_sums_only(spark):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der Hund und die Katze"), (3, "en", None), (4, "de", "und der Hund"), (5, "en", "##")], "report_id long, lang string, text string")
    found = LG.detect_language(docs, LG.fit_language(docs.filter("report_id < 3")))
    assert {r.report_id: r.language for r in found.collect()} == {1: "en", 2: "de", 3: "unknown", 4: "de", 5: "unknown"}
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert dealt and not any("gram" in x for x in dealt)


def test_paragraphs_are_hashed_once(spark):
    nodes = spark.createDataFrame([("r", 0, "REPORT", "r", None, None, None), ("r", 1, "IP", "10.1.2.3", 0, 2, 10), ("r", 2, "CVE", "CVE-1", 0, 11, 16), ("s", 1, "IP", "x", 7, 0, 1)], "report_id string, node_idx int, label string, text string, paragraph_index int, start int, end int")
    paragraphs = spark.createDataFrame([("r", 0, "a 10.1.2.3 CVE-1 b"), ("r", 1, "no node")], "report_id string, paragraph_index int, text string")
    for width in (0, 4):
        rows = lambda x: sorted(x.collect())
        assert rows(FE.features_of_nodes(nodes, paragraphs, width)) == rows(FE.node_features(FE.node_texts(nodes, paragraphs, width)))


def test_many_terms_deal_out_texts_once(spark, monkeypatch):
    monkeypatch.setattr(DI, "INLINE_TERMS", 1)
    paragraphs = spark.createDataFrame([("r", 0, "Redbear and bluefox"), ("r", 1, None), ("s", 0, "bluefox")], "report_id string, paragraph_index int, text string")
    terms = spark.createDataFrame([("MALWARE", "redbear"), ("MALWARE", "bluefox")], "label string, term string")
    found = D.extract_entities(paragraphs, None, terms).filter("label = 'MALWARE'")
    assert sorted((r.report_id, r.text) for r in found.collect()) == [("r", "Redbear"), ("r", "bluefox"), ("s", "bluefox")]
    plan = D.extract_entities(paragraphs, None, terms).select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and not any("paragraph_index" in x and "ENSURE_REQUIREMENTS" in x for x in plan.split("\n"))
