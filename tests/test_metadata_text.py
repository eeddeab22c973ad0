import datetime

from pyspark.sql import functions as F

from intelweave.functions import metadata as M
from intelweave.functions import text as TX


def test_names(spark):
    names = ["28 (03-04-2019) Report", "APT-C-23_x", "未知_a", "X (13-45-2020) 2020-01-02", "A (01-02-99)", "Lazarus CYBERTEAM (T1059.001) final", "", "FIN7_20180104_x"]
    rows = {r.raw_name: r for r in M.with_metadata(spark.createDataFrame([(n,) for n in names], "raw_name string")).collect()}
    assert [rows[n].apt_group for n in names] == ["APT28", "UNKNOWN", "UNKNOWN", "X", "A", "LAZARUS", "UNKNOWN", "FIN7"]
    assert rows[names[0]].published_date == datetime.date(2019, 3, 4)
    assert rows[names[3]].published_date == datetime.date(2020, 1, 2)
    assert rows[names[4]].published_date == datetime.date(1999, 1, 2)
    assert rows[names[7]].published_date == datetime.date(2018, 1, 4)
    assert rows[names[5]].source_vendor == "CYBERTEAM"
    assert rows[names[5]].extra_tags == ["T1059.001"]
    assert rows[""].report_id.startswith("unknown_")


def test_segment(spark):
    t = "\r\nshort\r\n\r\n\r\n\tA paragraph that  is long enough.  \n\nAnother paragraph, also long.\n\nx"
    got = spark.createDataFrame([(t,)], "t string").select(TX.segment(F.col("t"))).head()[0]
    assert got == ["A paragraph that is long enough.", "Another paragraph, also long."]


def test_headers(spark):
    blocks = ["Page 3 of 10 ", "Table  of contents", "3 / 10", "This is a block of real text.", "tiny", "Page 3 of 10 is where it starts"]
    got = spark.createDataFrame([(blocks,)], "b array<string>").select(TX.drop_headers_footers(F.col("b"))).head()[0]
    assert got == ["This is a block of real text.", "Page 3 of 10 is where it starts"]


def test_context(spark):
    got = spark.createDataFrame([("abcdefghij",)], "t string").select(TX.context_window(F.col("t"), F.lit(2), F.lit(4), 3), TX.context_window(F.col("t"), F.lit(2), F.lit(4), 0)).head()
    assert tuple(got) == ("abcdefg", "")
