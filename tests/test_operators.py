import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.operators import balance, hydro_share, reshape, running, tariffs
from tailrace.operators.scenarios import PUBLISHED_GRID, Scenario, expand_grid, published_grid, variants
from tailrace.sources import Feeds


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


# Balance ------------------------------------------------------------------------------------


def feeds(spark, production, consumption, prices):
    power = "date date, zone string, mwh double"
    price = "date date, name string, display_name string, region string, value double"
    return Feeds(
        spark.createDataFrame(production, power),
        spark.createDataFrame(consumption, power),
        spark.createDataFrame(prices, price),
    )


def test_balance_keeps_keys_of_any_feed(spark):
    d = day("2022-01-01")
    f = feeds(
        spark,
        [(d, "NO1", 2.0), (d, "NO", 9.0), (d, None, 5.0)],
        [(d, "NO2", 3.0)],
        [(d, "oslo", "x", "NO1", 50.0), (d, "mars", None, None, 70.0)],
    )
    long = balance.balance_long(f)
    assert rows(long, "region", "value", "variable") == sorted(
        [("no1", 2000.0, "pro"), ("no2", 3000.0, "cnp"), ("no1", 0.5, "price"), (None, 0.7, "price")], key=str
    )
    wide = balance.balance_wide(long)
    assert rows(wide, "region", "pro", "cnp", "price") == sorted(
        [("no1", 2000.0, None, 0.5), ("no2", None, 3000.0, None), (None, None, None, 0.7)], key=str
    )
    assert balance.complete_rows(wide).count() == 0


def test_repeated_cell_raises_or_averages(spark):
    d = day("2022-01-01")
    f = feeds(spark, [(d, "NO1", 2.0), (d, "NO1", 4.0)], [], [])
    long = balance.balance_long(f)
    with pytest.raises(Exception, match="several values for pro 2022-01-01 no1"):
        balance.balance_wide(long).collect()
    assert rows(balance.balance_wide(long, on_duplicate="mean"), "pro") == [(3000.0,)]
    with pytest.raises(ValueError):
        balance.balance_wide(long, on_duplicate="first")
    copies = feeds(spark, [(d, "NO1", None), (d, "NO1", None)], [], [])
    with pytest.raises(Exception, match="several values"):
        balance.balance_wide(balance.balance_long(copies)).collect()


def test_complete_rows_drop_null_and_nan(spark):
    wide = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (None, 1.0, 1.0), (1.0, math.nan, 1.0), (1.0, 1.0, None)],
        "pro double, cnp double, price double",
    )
    assert balance.complete_rows(wide).count() == 1


def test_date_range_is_inclusive_at_midnight(spark):
    hours = [(dt.datetime(2022, 1, 31, 23),), (dt.datetime(2022, 2, 1, 0),), (dt.datetime(2022, 2, 1, 1),)]
    df = spark.createDataFrame(hours, "date timestamp_ntz")
    kept = balance.in_date_range(df, F.lit("2022-01-31").cast("date"), F.lit("2022-02-01").cast("date"))
    assert [r.date.hour for r in kept.orderBy("date").collect()] == [23, 0]


# Hydropower share ---------------------------------------------------------------------------

MONTHS = [("01", 100, 90), ("02", 100, 80), ("03", 200, 190), ("04", 100, 90), ("05", 100, 95)]


def statistics(spark, months=MONTHS):
    facts = [
        ("Kraft", code, f"2021M{m}", None if v is None else float(v))
        for m, total, hydro in months
        for code, v in (("01", total), ("01.01", hydro))
    ]
    other = [("Olje", "01", "2021M01", 7.0), ("Kraft", "02", "2021M01", 7.0)]
    return spark.createDataFrame(facts + other, schemas.STAT_FACT)


def ratios(spark, months=MONTHS):
    return hydro_share.with_trailing_ratio(hydro_share.monthly_share(statistics(spark, months)))


def shares(spark, dates, dtype="date"):
    wide = spark.createDataFrame([(d, "no1") for d in dates], f"date {dtype}, region string")
    months = hydro_share.share_by_month(wide, ratios(spark))
    got = hydro_share.with_hydro_share(wide, months).collect()
    return {str(r.date): None if r.ssb_prop_vannkraft is None else round(r.ssb_prop_vannkraft, 12) for r in got}


def test_monthly_and_trailing_ratio(spark):
    got = [tuple(r)[-2:] for r in ratios(spark).orderBy("date").collect()]
    assert [(round(a, 12), None if b is None else round(b, 12)) for a, b in got] == [
        (0.9, None), (0.8, None), (0.95, None), (0.9, 0.9), (0.95, 0.91),
    ]


def test_trailing_ratio_needs_all_four(spark):
    months = [("01", 100, 90), ("02", 100, None), ("03", 200, 190), ("04", 100, 90), ("05", 100, 95), ("06", 0, 0)]
    got = {r.date.month: r for r in ratios(spark, months).collect()}
    assert got[4].hydro_ratio_ma4 is None and got[5].hydro_ratio_ma4 is None
    assert got[6].hydro_ratio_month is None and round(got[6].hydro_ratio_ma4, 12) == 375 / 400
    assert got[2].hydro_ratio_month is None


def test_repeated_statistics_raise(spark):
    twice = statistics(spark).union(statistics(spark).limit(1))
    with pytest.raises(Exception, match="several values of 01"):
        hydro_share.monthly_share(twice).collect()


def test_share_as_of(spark):
    dates = ["2021-02-01", "2021-02-02", "2021-04-01", "2021-04-02", "2021-05-01", "2021-05-02", "2021-06-10"]
    assert shares(spark, map(day, dates)) == {
        "2021-02-01": 0.8, "2021-02-02": None, "2021-04-01": 0.9, "2021-04-02": 0.9,
        "2021-05-01": 0.95, "2021-05-02": 0.91, "2021-06-10": 0.91,
    }


def test_share_misses_month_without_first_day(spark):
    dates = ["2021-04-01", "2021-05-02", "2021-06-01"]
    assert shares(spark, map(day, dates)) == {"2021-04-01": 0.9, "2021-05-02": 0.9, "2021-06-01": 0.9}


def test_share_at_hour_grain(spark):
    hours = [dt.datetime(2021, 5, 1, 5), dt.datetime(2021, 5, 2, 0), dt.datetime(2021, 5, 31, 23)]
    got = shares(spark, hours, "timestamp_ntz")
    assert list(got.values()) == [0.95, 0.91, 0.91]


# Tariffs ------------------------------------------------------------------------------------


def test_tariff_boundaries(spark):
    expected = {
        "2020-12-31": (0.0, None),
        "2021-01-01": (0.0, 0.1669),
        "2021-11-30": (0.0, 0.1669),
        "2021-12-01": (0.55, 0.1669),
        "2021-12-31": (0.55, 0.1669),
        "2022-01-01": (0.8, 0.0891),
        "2022-03-31": (0.8, 0.0891),
        "2022-04-01": (0.8, 0.1541),
        "2022-08-31": (0.8, 0.1541),
        "2022-09-01": (0.9, 0.1541),
    }
    df = spark.createDataFrame([(day(d), r) for d in expected for r in ("no4", "no1", None)], "date date, region string")
    got = tariffs.with_tariffs(df).collect()
    for r in got:
        assert (r.param_stromstotte_prop, r.param_elavgift_sats_alminnelig) == expected[str(r.date)]
        assert r.param_mva == (0.0 if r.region == "no4" else 0.25)
    assert [c for c in tariffs.with_tariffs(df).columns if c.startswith("param_")] == schemas.TARIFFS


# Running totals -----------------------------------------------------------------------------


def single_window(df, columns):
    w = W.partitionBy("k").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {
            f"cum__{c}": F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), F.sum(c).over(w))
            for c in columns
        }
    )


def test_running_total_stops_at_null(spark):
    data = [("a", 1, 1.0), ("a", 2, None), ("a", 40, 2.0), ("b", 1, None), ("c", 1, 1.0), ("c", 40, 2.0), ("c", 41, 3.0)]
    df = spark.createDataFrame(data, "k string, d int, x double").withColumn("m", F.expr("d DIV 30"))
    got = running.running_total(df, ["k"], "d", "m", ["x"])
    assert rows(got, "k", "d", "cum__x") == sorted(
        [("a", 1, 1.0), ("a", 2, None), ("a", 40, None), ("b", 1, None), ("c", 1, 1.0), ("c", 40, 3.0), ("c", 41, 6.0)],
        key=str,
    )


@settings(max_examples=8, deadline=None)
@given(
    st.dictionaries(
        st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 90)),
        st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.integers(-9, 9)),
        min_size=1,
        max_size=60,
    )
)
def test_running_total_equals_single_window(spark, data):
    flat = [(k, d, None if x is None else float(x), float(y)) for (k, d), (x, y) in data.items()]
    df = spark.createDataFrame(flat, "k string, d int, x double, y double").withColumn("m", F.expr("d DIV 30"))
    got = running.running_total(df, ["k"], "d", "m", ["x", "y"])
    columns = ["k", "d", "cum__x", "cum__y"]
    assert rows(got, *columns) == rows(single_window(df, ["x", "y"]), *columns)


# Scenarios and reshaping --------------------------------------------------------------------


def test_published_grid():
    grid = published_grid()
    assert [(s.group, s.param_price_baseline, s.param_prop_spot_eksponert) for s in grid] == [
        ("1", 0.25, 0.5), ("2", 0.25, 0.7), ("3", 0.35, 0.5), ("4", 0.35, 0.7), ("5", 0.4, 0.5), ("6", 0.4, 0.7),
    ]
    assert all(s.freq == "hourly" and s.na_rm and s.start_date == "2022-01-01" for s in grid)
    assert len(variants(grid)) == 1 and list(PUBLISHED_GRID)[0] == "freq"
    assert len(variants(expand_grid(na_rm=[True, False], start_date=["2021-01-01", "2022-01-01"]))) == 4
    assert Scenario().param_skatteposisjon_kr == 0.1


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, None, 3.0, None)], "a int, b double, `c.d` double, e string")
    assert reshape.drop_all_null_columns(df).columns == ["a", "c.d", "e"]
    empty = reshape.drop_all_null_columns(df.limit(0))
    assert empty.columns == df.columns and empty.count() == 0


def test_names_and_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Total produksjon av elektrisk kraft", "Vannkraft", "param_a", "ContentsCode.Label"])
    assert reshape.clean_names(df).columns == [
        "total_produksjon_av_elektrisk_kraft", "vannkraft", "param_a", "contents_code_label",
    ]
    assert reshape.clean_names(spark.createDataFrame([(1, 2, 3)], ["Å b", "a-B", "1x"])).columns == ["a_b", "a_b_2", "x1x"]
    assert reshape.starting_with(df, "param_") == ["param_a"]
    assert len(reshape.starting_with(df, "param_", but=True)) == 3
    assert reshape.relocate(["a", "b", "c"], "c", after="a") == ["a", "c", "b"]


def test_last_rows_and_transpose(spark):
    df = spark.createDataFrame([(day("2022-01-01"), 1.5, "a"), (day("2022-01-02"), None, "b")], "date date, x double, `y.z` string")
    assert rows(reshape.at_last_date(df), "`y.z`") == [("b",)]
    assert rows(reshape.transpose_row(reshape.last_row(df))) == [("date", "2022-01-02"), ("x", None), ("y.z", "b")]
    assert rows(reshape.max_date(df)) == [(day("2022-01-02"),)]


def test_unpivot_and_sort(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert rows(reshape.unpivot(df, ["id"])) == [(1, "a", 2.0), (1, "b", None)]
    dates = spark.createDataFrame([(None,), (day("2022-01-02"),), (day("2022-01-01"),)], "date date")
    assert [r.date and r.date.day for r in reshape.sorted_output(dates, "date").collect()] == [1, 2, None]


def test_region_names_match_null_and_repeat(spark):
    df = spark.createDataFrame([("no1", 1), ("no2", 2), (None, 3)], "region string, x int")
    names = spark.createDataFrame([("no1", "A"), ("no1", "B"), (None, "C")], "region string, region_name string")
    assert rows(reshape.with_region_names(df, names), "x", "region_name") == [(1, "A"), (1, "B"), (3, "C")]
