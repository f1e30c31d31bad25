import datetime as dt
import json
from pathlib import Path

import pytest

from tailrace import schemas
from tailrace.plans.tables import Tables
from tailrace.sources import (
    documents,
    label_codes,
    load_feeds,
    metadata_long,
    read_statistics,
    region_dimension,
)
from tailrace.sources.flat import read_flat
from tailrace.sources.regions import distinct_regions, join_regions


def land(folder, name, *docs):
    target = folder / name
    target.mkdir()
    for i, doc in enumerate(docs):
        (target / f"{i}.json").write_text(json.dumps(doc, indent=1))
    return str(target)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_daily_documents(spark, tmp_path):
    prices = {
        "historic": {
            "dates": ["2022-01-01", "2022-01-02"],
            "prices": [
                {"name": "bergen", "displayName": "Vest-Norge (NO5)", "data": [10.5, None]},
                {"name": "all", "displayName": "Norge", "data": [1.0, 2.0]},
            ],
        }
    }
    power = {"items": [{"date": "2022-01-01", "zone": "NO5", "MWh": 7}, {"date": "2022-01-02", "zone": "NO", "MWh": 9.5}]}
    paths = {
        "production": land(tmp_path, "pro", power, power),
        "consumption": land(tmp_path, "cnp", {"items": []}),
        "prices": land(tmp_path, "price", prices),
    }
    feeds = load_feeds(spark, "daily", paths)
    d1, d2 = dt.date(2022, 1, 1), dt.date(2022, 1, 2)
    assert rows(feeds.prices, "date", "name", "region", "value") == [
        (d1, "all", None, 1.0),
        (d1, "bergen", "no5", 10.5),
        (d2, "all", None, 2.0),
        (d2, "bergen", "no5", None),
    ]
    assert rows(feeds.production, "date", "zone", "mwh") == [(d1, "NO5", 7.0)] * 2 + [(d2, "NO", 9.5)] * 2
    assert feeds.consumption.count() == 0


def test_unequal_lists_raise(spark, tmp_path):
    doc = {"historic": {"dates": ["2022-01-01"], "prices": [{"name": "oslo", "displayName": "x", "data": [1, 2]}]}}
    raw = documents.read_documents(spark, land(tmp_path, "p", doc), schemas.DAILY_PRICES_JSON)
    with pytest.raises(Exception, match="differ in length: oslo"):
        documents.daily_prices(raw).collect()


def test_hourly_documents(spark, tmp_path):
    prices = {
        "columns": ["date", "hours", "oslo", "mars"],
        "rows": [
            ["2022-01-01", "00 - 01", "1.5", "2"],
            ["2022-01-01", "01 - 02", "12,5", None],
            ["2022-01-01", "02", "", "x"],
            ["2022-01-01", "03 - 04", 3.25, 7],
            ["2022-01-01", "04 - 05", True, 1e3],
        ],
    }
    power = {"items": [{"date": "2022-01-01", "hours": "05 - 06", "zone": "NO1", "MWh": 3.0}]}
    paths = {
        "production": land(tmp_path, "pro", power),
        "consumption": land(tmp_path, "cnp", power),
        "prices": land(tmp_path, "price", prices),
    }
    feeds = load_feeds(spark, "hourly", paths)
    hour = [dt.datetime(2022, 1, 1, h) for h in range(6)]
    assert rows(feeds.prices, "date", "hour_start", "hour_end", "name", "region", "value") == sorted(
        [
            (hour[0], "00", "01", "oslo", "no1", 1.5),
            (hour[0], "00", "01", "mars", None, 2.0),
            (hour[1], "01", "02", "oslo", "no1", None),
            (hour[1], "01", "02", "mars", None, None),
            (hour[2], "02", None, "oslo", "no1", None),
            (hour[2], "02", None, "mars", None, None),
            (hour[3], "03", "04", "oslo", "no1", 3.25),
            (hour[3], "03", "04", "mars", None, 7.0),
            (hour[4], "04", "05", "oslo", "no1", None),
            (hour[4], "04", "05", "mars", None, 1000.0),
        ],
        key=str,
    )
    assert rows(feeds.production, "date", "hour_start", "hour_end", "zone", "mwh") == [
        (hour[5], "05", "06", "NO1", 3.0)
    ]


def test_flat_files(spark, tmp_path):
    (tmp_path / "power.csv").write_text("date,zone,MWh\n2021-05-01,NO1,1234.5\n2021-05-02,NO,NaN\n2021-05-03,NO2,\n")
    (tmp_path / "prices.csv").write_text(
        "name,displayName,value,date,region\noslo,Sørøst-Norge (NO1),31.75,2019-02-03,no1\n"
    )
    paths = {"production": f"{tmp_path}/power.csv", "consumption": f"{tmp_path}/power.csv", "prices": f"{tmp_path}/prices.csv"}
    feeds = load_feeds(spark, "daily", paths, fmt="csv")
    assert [r.mwh for r in feeds.production.orderBy("date").collect()] == [1234.5, None, None]
    assert rows(feeds.prices, "date", "name", "display_name", "region", "value") == [
        (dt.date(2019, 2, 3), "oslo", "Sørøst-Norge (NO1)", "no1", 31.75)
    ]


def test_broken_documents_stop_the_read(spark, tmp_path):
    good = {"items": [{"date": "2022-01-01", "zone": "NO1", "MWh": 3.0}]}
    path = land(tmp_path, "pro", good, good)
    assert documents.daily_power(documents.read_documents(spark, path, schemas.DAILY_ITEMS_JSON)).count() == 2
    broken = next(Path(path).glob("*.json"))
    broken.write_text(json.dumps(good)[:-12])
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        documents.daily_power(documents.read_documents(spark, path, schemas.DAILY_ITEMS_JSON)).collect()


@pytest.mark.parametrize(
    "parse, schema, doc, name",
    [
        (documents.daily_power, "DAILY_ITEMS_JSON", {"itmes": []}, "items"),
        (documents.hourly_power, "HOURLY_ITEMS_JSON", {"itmes": []}, "items"),
        (documents.daily_prices, "DAILY_PRICES_JSON", {"historic": {"dates": []}}, "historic.prices"),
        (documents.hourly_price_cells, "HOURLY_PRICES_JSON", {"columns": ["date"]}, "rows"),
    ],
)
def test_documents_without_their_array_stop_the_read(spark, tmp_path, parse, schema, doc, name):
    raw = documents.read_documents(spark, land(tmp_path, "x", doc), getattr(schemas, schema))
    with pytest.raises(Exception, match=f"no {name}"):
        parse(raw).collect()


def test_other_header_stops_the_read(spark, tmp_path):
    (tmp_path / "power.csv").write_text("zone,date,MWh\nNO1,2021-05-01,7\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_flat(spark, f"{tmp_path}/power.csv", schemas.POWER_CSV).collect()


def test_landed_statistics(spark, tmp_path):
    (tmp_path / "fact.csv").write_text("ContentsCode,Produk2,Tid,value\nKraft,01,2021M01,5\nKraft,99,2021M01,1\n")
    (tmp_path / "products.csv").write_text("values,valueTexts\n01,Total\n")
    landed = read_statistics(spark, f"{tmp_path}/fact.csv", {"Produk2": f"{tmp_path}/products.csv"}, "csv")
    assert landed.fact.count() == 2
    assert [tuple(r) for r in landed.labelled().collect()] == [("Kraft", "01", "Total", "2021M01", 5.0)]


def test_frequency_is_checked(spark):
    with pytest.raises(ValueError, match="freq = weekly is not supported"):
        load_feeds(spark, "weekly", {})
    with pytest.raises(ValueError, match="daily only"):
        load_feeds(spark, "hourly", {}, fmt="csv")


def test_region_dimension_joins_left(spark):
    prices = spark.createDataFrame([("oslo",), ("mars",)], "name string")
    joined = join_regions(prices, region_dimension(spark))
    assert rows(joined, "name", "region") == [("mars", None), ("oslo", "no1")]
    assert region_dimension(spark).count() == 5
    twice = join_regions(prices.union(prices), region_dimension(spark))
    assert distinct_regions(twice).count() == 2


def test_code_labels(spark):
    fact = spark.createDataFrame(
        [("Kraft", "01", "2021M01", 5.0), ("Kraft", "01.01", "2021M01", 4.0), ("Kraft", "99", "2021M01", 1.0), ("Olje", "01", "2021M01", 9.0)],
        schemas.STAT_FACT,
    )
    metadata = {
        "ContentsCode": spark.createDataFrame([("Kraft", "Power")], schemas.STAT_LABELS),
        "Produk2": spark.createDataFrame([("01", "Total"), ("01.01", "Hydro")], schemas.STAT_LABELS),
        "Region": spark.createDataFrame([("0", "Norge")], schemas.STAT_LABELS),
        "Tid": spark.createDataFrame([("2021M01", "January")], schemas.STAT_LABELS),
    }
    labelled = label_codes(fact, metadata, {"ContentsCode": "Kraft", "Tid": True, "Produk2": ["01", "01.01", "99"]})
    assert labelled.columns == [
        "Variable", "Variable.Label", "Produk2", "Produk2.Label", "Tid", "Tid.Label", "Value",
    ]
    assert sorted(map(tuple, labelled.collect())) == [
        ("Kraft", "Power", "01", "Total", "2021M01", "January", 5.0),
        ("Kraft", "Power", "01.01", "Hydro", "2021M01", "January", 4.0),
    ]
    long = metadata_long(metadata, simplify=True)
    assert long.columns == ["key", "code", "desc"] and long.count() == 5
    assert metadata_long(metadata) is metadata


def test_quarantine_puts_broken_documents_aside(spark, tmp_path):
    good = {"items": [{"date": "2022-01-01", "zone": "NO1", "MWh": 1.5}]}
    texts = [json.dumps(good), "{ items: ", '{"items": [{"MWh": {}}]}', '{"item": []}', json.dumps({"items": None})]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    tables = Tables(spark)
    aside = documents.Quarantine(tables.write, at_most=4)
    raw = aside.read(spark, "production", str(tmp_path), schemas.DAILY_ITEMS_JSON)
    assert rows(documents.daily_power(raw), "zone", "mwh") == [("NO1", 1.5)]
    found = sorted((r.path[-6:], r.reason) for r in aside.broken.collect())
    assert found == [("1.json", "unreadable"), ("2.json", "unreadable"), ("3.json", "no items"), ("4.json", "no items")]
    with pytest.raises(ValueError, match="4 documents of production"):
        documents.Quarantine(tables.write, at_most=3).read(spark, "production", str(tmp_path), schemas.DAILY_ITEMS_JSON)
    # By default they stop the read.
    with pytest.raises(Exception):
        documents.daily_power(documents.read_documents(spark, str(tmp_path), schemas.DAILY_ITEMS_JSON)).collect()


def test_quarantine_of_a_frequency(spark, tmp_path):
    good = {"items": [{"date": "2022-01-01", "zone": "NO1", "MWh": 1.5}]}
    prices = {"historic": {"dates": ["2022-01-01"], "prices": [{"name": "a", "displayName": "A (NO1)", "data": [2.0]}]}}
    for feed, doc in (("production", good), ("consumption", good), ("prices", prices)):
        land(tmp_path, feed, doc, {"historic": {"dates": []}} if feed == "prices" else {"items": None})
    paths = {feed: f"{tmp_path}/{feed}" for feed in ("production", "consumption", "prices")}
    aside = documents.Quarantine(Tables(spark).write, at_most=1)
    feeds = load_feeds(spark, "daily", paths, quarantine=aside)
    assert [f.count() for f in (feeds.production, feeds.consumption, feeds.prices)] == [1, 1, 1]
    assert {(r.feed, r.reason) for r in aside.broken.collect()} == {
        ("production", "no items"), ("consumption", "no items"), ("prices", "no historic.dates")
    }
