"""Column helpers on tiny literal frames (FIXTURES.md §3)."""

import datetime as dt

from pyspark.sql import functions as F

from casebook.functions.binning import bin_col, collapse_other, decode_col, equal_width_bin, flag
from casebook.functions.compat import ne_null_aware, ratio, round_half_even, round_half_up
from casebook.functions.dates import parse_hhmm_ap, parse_mixed_day_first, parse_month_year, round_hour, season_col
from casebook.functions.strings import alnum_key, first_digits, keyword_hits, split_two, trim_upper


def test_ratio_zero_divisor_is_null(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, 1.5, None]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,)], "x double")
    r = df.select(round_half_up("x", 1).alias("u"), round_half_even("x", 1).alias("e")).collect()
    assert [x.u for x in r] == [0.3, 0.4, 2.5]
    assert [x.e for x in r] == [0.2, 0.4, 2.5]


def test_ne_null_aware_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert df.where(F.col("s") != "a").count() == 1
    assert df.where(ne_null_aware("s", "a")).count() == 2


def test_bins_half_open_and_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 1.0, 5.0, 5.01, 10.0, 20.0, None]], "x double")
    left = [r[0] for r in df.select(bin_col("x", [0, 5, 10], closed="left", open_top=True, invalid="bad")).collect()]
    assert left == ["bad", "[0,5)", "[0,5)", "[5,10)", "[5,10)", ">=10", ">=10", "bad"]
    right = [r[0] for r in df.select(bin_col("x", [0, 5, 10], closed="right")).collect()]
    assert right == [None, None, "(0,5]", "(0,5]", "(5,10]", "(5,10]", None, None]


def test_equal_width_hour_bins(spark):
    df = spark.createDataFrame([(h,) for h in [0, 3, 4, 23, 24, None]], "h int")
    assert [r[0] for r in df.select(equal_width_bin("h", 4, 0, 6)).collect()] == [1, 1, 2, 6, None, None]


def test_decode_collapse_flag(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "k int")
    assert [r[0] for r in df.select(decode_col("k", {1: "Cash", 2: "Card"}, "Invalid entry")).collect()] == \
        ["Cash", "Card", "Invalid entry", "Invalid entry"]
    assert [r[0] for r in df.select(flag(F.col("k") > 1)).collect()] == [0, 1, 1, 0]
    c = spark.createDataFrame([(" India ",), ("india",), ("Select",), (None,), ("Peru",)], "c string")
    up = [r[0] for r in c.select(trim_upper("c")).collect()]
    assert up == ["INDIA", "INDIA", "SELECT", None, "PERU"]
    assert [r[0] for r in c.select(collapse_other(trim_upper("c"), ["INDIA"])).collect()] == \
        ["INDIA", "INDIA", "OTHERS", "OTHERS", "OTHERS"]


def test_hhmm_ampm_strict_and_copy(spark):
    df = spark.createDataFrame([(s,) for s in ["0930A", "1205P", "1200A", "8700P", "1200|", "nan", None]], "t string")
    strict = [None if r[0] is None else (r[0].hour, r[0].minute) for r in df.select(parse_hhmm_ap("t")).collect()]
    assert strict == [(9, 30), (12, 5), (0, 0), None, None, None, None]
    loose = [None if r[0] is None else r[0].hour for r in df.select(parse_hhmm_ap("t", strict=False)).collect()]
    assert loose[3] == 12          # the loose rule maps 87 P to 12


def test_month_year_century_rule(spark):
    df = spark.createDataFrame([(s,) for s in ["Jan-85", "Jan-05", "Dec-68", "Jan-69", "bad"]], "s string")
    years = [None if r[0] is None else r[0].year for r in df.select(parse_month_year("s")).collect()]
    assert years == [1985, 2005, 2068, 1969, None]


def test_round_hour_half_even(spark):
    rows = [(dt.datetime(2024, 1, 1, 16, 30),), (dt.datetime(2024, 1, 1, 17, 30),), (dt.datetime(2024, 1, 1, 23, 55),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    out = [r[0] for r in df.select(round_hour("ts")).collect()]
    assert out == [dt.datetime(2024, 1, 1, 16), dt.datetime(2024, 1, 1, 18), dt.datetime(2024, 1, 2, 0)]


def test_mixed_day_first_formats(spark):
    df = spark.createDataFrame([("11/7/2016 11:51",), ("13-07-2016 08:33:16",), ("",), (None,)], "s string")
    out = [r[0] for r in df.select(parse_mixed_day_first("s")).collect()]
    assert out == [dt.datetime(2016, 7, 11, 11, 51), dt.datetime(2016, 7, 13, 8, 33, 16), None, None]


def test_season_reference_preset(spark):
    df = spark.createDataFrame([(dt.date(2017, m, 1),) for m in (1, 4, 7, 8, 10)], "d date")
    assert [r[0] for r in df.select(season_col("d")).collect()] == ["winter", "spring", "summer", "fall", "fall"]


def test_string_helpers(spark):
    df = spark.createDataFrame([("ENTERPRISE 2.0 inc.", "Term 36 months", "borrowed late late"),
                                (None, "none", None)], "a string, b string, c string")
    r = df.select(alnum_key("a"), first_digits("b"), keyword_hits("c", ["borrowed", "late"]),
                  *split_two("b")).collect()
    assert tuple(r[0]) == ("ENTERPRISE20INC", 36, 3, "Term", "36 months")
    assert tuple(r[1]) == (None, None, 0, "none", None)
