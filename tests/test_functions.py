import datetime as dt
import math

from pyspark.sql import functions as F

from tailrace import functions as fn


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_missing_rules(spark):
    rows = [(1.0,), (None,), (math.nan,), (-2.0,)]
    got = values(
        spark,
        rows,
        "x double",
        fn.nan_to_null(F.col("x")),
        fn.is_missing(F.col("x")),
        fn.pmax(fn.nan_to_null(F.col("x")), 0),
    )
    assert got == [(1.0, False, 1.0), (None, True, None), (None, True, None), (-2.0, False, 0.0)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(fn.sum0(F.col("x")).alias("s")).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_ratio_by_zero_is_null(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)]
    got = values(spark, rows, "a double, b double", fn.ratio(F.col("a"), F.col("b")))
    assert got == [(0.5,), (None,), (None,), (None,)]


def test_area_code(spark):
    rows = [("Vest-Norge (NO5)",), ("NO12 and NO3",), ("Norge",), (None,)]
    assert values(spark, rows, "x string", fn.area_code(F.col("x"))) == [("no5",), ("no12",), (None,), (None,)]


def test_number_is_lenient(spark):
    rows = [("12.5",), ("12,5",), ("x",), ("",), (None,), ("NaN",), ("-3",)]
    got = [v for (v,) in values(spark, rows, "x string", fn.number(F.col("x")))]
    assert got == [12.5, None, None, None, None, None, -3.0]


def test_hours_and_clock_time(spark):
    rows = [("2022-01-01", h) for h in ("00 - 01", "23-24", "07", "x - y", None)] + [(None, "00 - 01")]
    start, end = fn.split_hours(F.col("h"))
    got = values(spark, rows, "d string, h string", start, end, fn.hour_timestamp(F.col("d"), start))
    day = dt.datetime(2022, 1, 1)
    assert got == [
        ("00", "01", day),
        ("23", "24", day.replace(hour=23)),
        ("07", None, day.replace(hour=7)),
        ("x", "y", None),
        (None, None, None),
        ("00", "01", None),
    ]


def test_calendar(spark):
    rows = [(dt.date(2022, 1, 2),), (dt.date(2022, 1, 3),), (dt.date(2021, 12, 31),)]
    d = F.col("d")
    got = values(
        spark, rows, "d date", fn.week_start(d), fn.month_start(d), fn.year_month(d), fn.file_label(d)
    )
    assert got == [
        (dt.date(2021, 12, 27), dt.date(2022, 1, 1), "2022-01", "2022-01-02-000000"),
        (dt.date(2022, 1, 3), dt.date(2022, 1, 1), "2022-01", "2022-01-03-000000"),
        (dt.date(2021, 12, 27), dt.date(2021, 12, 1), "2021-12", "2021-12-31-000000"),
    ]


def test_calendar_at_hour_grain(spark):
    rows = [(dt.datetime(2022, 1, 2, 23),)]
    d = F.col("d")
    got = values(spark, rows, "d timestamp_ntz", fn.week_start(d), fn.month_start(d), fn.file_label(d))
    assert got == [(dt.date(2021, 12, 27), dt.date(2022, 1, 1), "2022-01-02-230000")]


def test_stat_month(spark):
    rows = [("2021M03",), ("2021K1",), (None,)]
    assert values(spark, rows, "x string", fn.stat_month(F.col("x"))) == [
        (dt.date(2021, 3, 1),),
        (None,),
        (None,),
    ]
