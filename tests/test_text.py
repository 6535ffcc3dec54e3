import pytest
from pyspark.sql import functions as F

from millwright.functions import text

CLEAN = [
    ("Repl CV001 hyd. pump - 2 way valve leaking!!", "replace hyd pump - two-way valve leaking"),
    ("a/c u/s #3 & als @ cab", "air conditioner unserviceable number <num> and ALS at cabin"),
    ("1570-3week service 2-3/3/10", "<num> - service <num> - <num> / <num> / <num>"),
    ("Won't start, temp sensor (LH) blwn..", "wont start , temperature sensor ( lh ) blown"),
    ("O&K RH 170 GET c/o", "<id> get change out"),
    ("boom cyl L.H.S {leak} at", "boom cylinder left hand side leak at"),
    ("preasure wasn t 1,200.50 kPa", "pressure wasn't <num> , <num> <num> kpa"),
    ("2-WAY 2way auto retard", "two-way two-way auto-retarder"),
    ("H.P hxp pump; ##@@,,", "high pressure high pressure pump number at ,"),
    ("rplcaa eng oil$$$$$", "rplcaa eng oil"),
    ("", ""),
]


def test_clean_documented_examples(spark):
    df = spark.createDataFrame(CLEAN, "raw string, want string")
    for r in df.select("raw", "want", text.clean(F.col("raw")).alias("got")).collect():
        assert r.got == r.want, r.raw


def test_clean_parity_of_empty_text(spark):
    df = spark.createDataFrame([("$$",), (None,)], "raw string")
    assert [r[0] for r in df.select(text.clean(F.col("raw"), parity=True)).collect()] == ["nan", None]


def test_corrections_are_spaced_and_case_sensitive(spark):
    df = spark.createDataFrame([("The wall was craked.",)], "s string")
    assert df.select(text.correct(F.col("s"), {"craked": "cracked"})).first()[0] == "The wall was  cracked ."


def test_corrections_in_groups_equal_those_one_by_one(spark):
    rows = [("repl cyl temp c/o a/c",), ("wind schrod x2 way 2 way",), ("êchan chan chanê",), ("was n't temps cha chan",), ("o/h O&K l.h.s lxhxs",), (None,), ("",)]
    one = F.col("s")
    for wrong, right in text.ordered(text.CORRECTIONS):
        one = F.regexp_replace(one, text.LEFT + wrong + text.RIGHT, f" {right} ")
    got = spark.createDataFrame(rows, "s string").select(text.correct(F.col("s")).alias("a"), one.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert got[2].a == "êchan  change  chanê"


@pytest.mark.parametrize(("raw", "want"), [("$1,200.50", 1200.5), ("-50", 50.0), ("abc", 0.0), (None, None)])
def test_clean_numeric(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(text.clean_numeric(F.col("raw"))).first()[0] == want


def test_clean_numeric_rejects_two_points(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("1.2.3",)], "raw string").select(text.clean_numeric(F.col("raw"))).collect()
