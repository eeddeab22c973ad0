import json

from pyspark.sql import functions as F

from intelweave.functions.patterns import Vocabulary
from intelweave.sources import files as S
from intelweave.streaming.ingest import ingest_new_files


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "APT28_20200102_x.TXT").write_bytes(b"ok \xff text")
    (tmp_path / "APT28_20200102_x.json").write_text('{"b": 1, "a": 2}')
    (tmp_path / "b.json").write_text("not json")
    root = f"file://{tmp_path}"
    assert S.scan_files(spark, root, (".txt",)).count() == 1
    assert S.scan_files(spark, root + "/none").count() == 0
    index = S.build_report_index(spark, [], [root])
    assert index.head().apt_group == "APT28" and index.head().file_type == "txt"
    texts = {r.file_path.rsplit("/", 1)[1]: r.text for r in S.load_reports(spark, root).collect()}
    assert texts == {"APT28_20200102_x.TXT": "ok  text", "APT28_20200102_x.json": '{"a":2,"b":1}', "b.json": "not json"}


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("r", None, "IP", "1.1.1.1", 0, 7, 0, 1)], "report_id string, paragraph_index int, label string, text string, start int, end int, label_rank int, ordinal int")
    S.write_json(rows, f"{tmp_path}/e")
    assert S.read_entities(spark, f"{tmp_path}/e").head().paragraph_index == 0
    (tmp_path / "v.json").write_text(json.dumps({"malware": [" Zeus ", ""]}))
    (tmp_path / "w.json").write_text(json.dumps(["a", "b"]))
    assert S.load_vocabulary(spark, f"{tmp_path}/v.json", "malware") == ["Zeus"]
    assert S.load_vocabulary(spark, f"{tmp_path}/w.json", "malware") == ["a", "b"]
    assert S.load_vocabulary(spark, f"{tmp_path}/none.json", "malware") == []
    (tmp_path / "i.csv").write_text("report_id,apt_group,source_vendor,published_date,file_path,file_type,raw_name,extra_tags\nr,A,,2020-01-02,p,txt,n,x|y\nr,B,,2020-01-03,p,txt,n,\n")
    got = S.read_index(spark, f"{tmp_path}/i.csv").collect()
    assert len(got) == 1 and got[0].apt_group == "B" and got[0].extra_tags == []


def test_run_results(spark, tmp_path):
    for name, text in (("m1", '{"accuracy": 0.5, "f1_weighted": 0.4, "f1_macro": 0.3}'), ("m2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "test_results.json").write_text(text)
    got = S.collect_run_results(spark, str(tmp_path)).collect()
    assert [(r.model_dir, r.accuracy) for r in got] == [("m1", 0.5)]


def test_sniff(spark):
    rows = spark.createDataFrame([("a.bin", bytearray(b"MZ1")), ("a", bytearray(b"\x7fELF")), ("a.DOCX", bytearray(b"x")), ("a", bytearray(b"%PDF-")), ("a.rtf", bytearray()), ("a", bytearray())], "n string, c binary")
    got = [r[0].split(" ")[0] for r in rows.select(S.sniff_file_type(F.col("n"), F.col("c"))).collect()]
    assert got == ["PE", "ELF", "Office", "PDF", "RTF", "Unknown"]


def test_stream_stores_each_report_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "Actor used Cobalt Strike from 10.1.2.3 today.\n\nNothing else to see in here."
    (tmp_path / "in" / "APT28_a.txt").write_text(text)
    run = lambda: ingest_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", Vocabulary(malware=["Cobalt Strike"])).awaitTermination()
    run()
    (tmp_path / "in" / "FIN7_b.txt").write_text("  ")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "APT28_a.txt").write_text(text)
    run()
    assert spark.read.parquet(f"{tmp_path}/out/paragraphs").count() == 2
    assert {r.label for r in spark.read.parquet(f"{tmp_path}/out/entities").collect()} >= {"IP", "MALWARE"}
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/out/skipped").collect()] == ["empty_text"]
