"""Runs over a store: every landed file read once, months rewritten when lines reach them, the rest left alone."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import difference
from tailrace.operators.scenarios import Scenario, published_grid
from tailrace.plans import FeedStore, RevenueRun, StoredRun
from tailrace.queries import landing, oracle
from tailrace.queries.catalog import rounded
from tailrace.sources import Feeds
from test_run import AS_OF, DAYS, HOURS, check, fixture, plan

SCENARIOS = [
    Scenario(start_date="2020-12-05", group="a"),
    Scenario(start_date="2022-01-03", na_rm=True, param_price_baseline=0.2, group="b"),
    Scenario(start_date="2021-03-01", end_date="2022-04-09", param_skatteposisjon_kr=0.3, group="c"),
    Scenario(start_date="2021-12-01", end_date="2021-12-20", na_rm=True, group="d"),
]


def between(feeds, first, last):
    inside = (F.coalesce(F.col("date").cast("date"), F.lit(dt.date(1970, 1, 1))) >= F.lit(first)) & (
        F.coalesce(F.col("date").cast("date"), F.lit(dt.date(1970, 1, 1))) < F.lit(last)
    )
    return Feeds(*[rows.where(inside) for rows in (feeds.production, feeds.consumption, feeds.prices)])


def parts(feeds):
    days = [dt.date(1900, 1, 1), dt.date(2021, 8, 20), dt.date(2022, 3, 30), dt.date(2100, 1, 1)]
    return [between(feeds, a, b) for a, b in zip(days, days[1:])]


def held_files(folder, table):
    """The data files of a table by month, with their names, which differ whenever a file is written anew."""
    return {(p.parent.name, p.name) for p in Path(folder).glob(f"{table}/**/*.parquet")}


def test_daily_store_equals_row_by_row_sql(spark, tmp_path):
    """Rows in three batches, a run after each; months of both sides of a border meet."""
    feeds, statistics, con = fixture(spark, DAYS, 1)
    store = FeedStore(spark, str(tmp_path))
    for part in parts(feeds):
        store.append("daily", part)
        StoredRun(store, statistics, SCENARIOS, AS_OF).months.count()
    check(StoredRun(store, statistics, SCENARIOS, AS_OF), con, SCENARIOS)


def test_hourly_store_equals_row_by_row_sql(spark, tmp_path):
    feeds, statistics, con = fixture(spark, HOURS, 3)
    scenarios = published_grid(param_prop_spot_eksponert=[0.5], na_rm=[True, False], end_date=[None, "2022-02-10"])
    store = FeedStore(spark, str(tmp_path))
    for part in parts(feeds):
        store.append("hourly", part)
    check(StoredRun(store, statistics, scenarios, AS_OF), con, scenarios)


def test_new_rows_rewrite_their_months_only(spark, tmp_path):
    feeds, statistics, _ = fixture(spark, DAYS, 2)
    first, second, third = parts(feeds)
    store = FeedStore(spark, str(tmp_path))
    store.append("daily", first)
    store.append("daily", second)
    StoredRun(store, statistics, SCENARIOS, AS_OF).months.count()
    before = {t: held_files(tmp_path, t) for t in ("balance", "calendar", "totals")}
    store.append("daily", third)
    StoredRun(store, statistics, SCENARIOS, AS_OF).months.count()
    for table, files in before.items():
        after = held_files(tmp_path, table)
        gone = {month for month, _ in files - after}
        assert gone and gone <= {"month=2022-03-01", "month=2022-04-01", "month=2022-05-01"}, (table, gone)
    assert store.last_date("daily") == store.balance("daily").agg(F.max("date")).first()[0]
    assert store.last_date("hourly") is None


def test_new_shares_rewrite_totals_from_their_month_on(spark, tmp_path):
    """A later publication of the statistics changes the months that it holds for."""
    feeds, statistics, con = fixture(spark, DAYS, 4)
    store = FeedStore(spark, str(tmp_path))
    store.append("daily", feeds)
    early = statistics.where("Tid < '2022M02'")
    StoredRun(store, early, SCENARIOS, AS_OF).months.count()
    before = held_files(tmp_path, "totals")
    check(StoredRun(store, statistics, SCENARIOS, AS_OF), con, SCENARIOS)
    gone = {month for month, _ in before - held_files(tmp_path, "totals")}
    assert gone and gone <= {"month=2022-02-01", "month=2022-03-01", "month=2022-04-01", "month=2022-05-01"}


def land(feeds, folder, part):
    return landing.land_daily(feeds, str(folder), part)


def test_landed_files_are_read_once(spark, tmp_path):
    feeds, statistics, _ = fixture(spark, DAYS, 6, gaps=0)
    plain = Feeds(
        feeds.production.where("zone is not null"),
        feeds.consumption.where("zone is not null"),
        feeds.prices.where("region is not null").withColumn("name", F.col("region")),
    )
    store = FeedStore(spark, str(tmp_path / "store"))
    landed = tmp_path / "landed"
    first, second, third = parts(plain)
    paths = land(first, landed, "first")
    assert store.ingest("daily", paths, multi_line=False) > 0
    assert store.ingest("daily", paths, multi_line=False) == 0
    land(second, landed, "second")
    land(third, landed, "third")
    assert store.ingest("daily", paths, multi_line=False) > 0
    # Without the landed files the store gives the same as a run over all rows.
    for path in landed.rglob("*"):
        if path.is_file():
            path.unlink()
    run = StoredRun(store, statistics, SCENARIOS, AS_OF, measures=[])
    whole = RevenueRun(spark, {"daily": plain}, statistics, SCENARIOS, AS_OF, measures=[])
    got = rounded(run.minimal(), oracle.MINIMAL, True).toPandas()
    want = rounded(whole.minimal(), oracle.MINIMAL, True).toPandas()
    assert len(got) and difference(got, want) is None, difference(got, want)


def test_changed_file_stops_the_ingest(spark, tmp_path):
    document = {"items": [{"date": "2022-01-01", "zone": "NO1", "MWh": 1.0}]}
    prices = {"historic": {"dates": ["2022-01-01"], "prices": [{"name": "a", "displayName": "A (NO1)", "data": [1.0]}]}}
    paths = {}
    for feed in ("production", "consumption", "prices"):
        (tmp_path / feed).mkdir()
        (tmp_path / feed / "1.json").write_text(json.dumps(prices if feed == "prices" else document))
        paths[feed] = str(tmp_path / feed)
    store = FeedStore(spark, str(tmp_path / "store"))
    assert store.ingest("daily", paths) == 3
    assert [(r.region, r.pro, r.cnp, r.price) for r in store.balance("daily").collect()] == [("no1", 1000.0, 1000.0, 0.01)]
    document["items"][0]["MWh"] = 22.0
    (tmp_path / "production" / "1.json").write_text(json.dumps(document))
    with pytest.raises(ValueError, match="changed since"):
        store.ingest("daily", paths)


def test_failed_ingest_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """Lines of a batch that was not finished are never seen; a balance that was not is caught up."""
    feeds, statistics, con = fixture(spark, DAYS, 5)
    first, second, third = parts(feeds)
    store = FeedStore(spark, str(tmp_path))
    store.append("daily", first)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(FeedStore, "_append", fail)
        store.append("daily", second)
    append = FeedStore._append
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(FeedStore, "_append", lambda s, rows, name, *by: fail() if name == "names" else append(s, rows, name, *by))
        store.append("daily", second)  # its lines are written, but no file is marked as read
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(FeedStore, "_rewrite", fail)
        store.append("daily", second)  # read, but not in the balance
    store.append("daily", third)
    check(StoredRun(store, statistics, SCENARIOS, AS_OF), con, SCENARIOS)


def test_plans_open_the_months_they_need(spark, tmp_path):
    feeds, statistics, _ = fixture(spark, DAYS, 8)
    store = FeedStore(spark, str(tmp_path))
    store.append("daily", feeds)
    run = StoredRun(store, statistics, published_grid(freq=["daily"]), AS_OF, measures=[])
    run.months.count()
    latest = run.national_sums(F.date_sub(run.today, 1))
    text = plan(latest)
    assert "PartitionFilters: [isnotnull(month" in text
    facts = [f for f in run.rows("daily", F.date_sub(run.today, 1)).select(F.input_file_name()).distinct().collect()]
    assert facts and all("month=2022-04-01" in f[0] for f in facts)
    # Months that no variant cuts come from the totals alone.
    pieces = run.pieces("daily", None)._jdf.queryExecution().executedPlan().toString()
    opened = [line for line in pieces.splitlines() if "FileScan" in line and "cnp#" in line]
    assert opened and all("PartitionFilters: [" in line and "PartitionFilters: []" not in line for line in opened)


def test_one_scan_for_each_feed(spark, tmp_path):
    """The first table of a run reads every feed once; all others read that table."""
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    for name in ("production", "consumption", "prices"):
        getattr(feeds, name).write.parquet(f"{tmp_path}/{name}")
    landed = Feeds(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("production", "consumption", "prices")])
    run = RevenueRun(spark, {"daily": landed}, statistics, published_grid(freq=["daily"]), AS_OF, measures=[])
    run.lines("daily")
    for df in (run.wide("daily"), run.region_names, run.months, run.minimal(), run.result()):
        text = plan(df)
        assert not any(f"{tmp_path}/{name}" in text for name in ("production", "consumption", "prices"))


def test_variants_share_one_pass(spark):
    """No plan copies a fact for each variant; 50 choices of rows cost as one does."""
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    texts = []
    for count in (1, 50):
        starts = [(dt.date(2021, 1, 1) + dt.timedelta(days=7 * i)).isoformat() for i in range(count)]
        scenarios = [Scenario(start_date=s, group=s) for s in starts]
        run = RevenueRun(spark, {"daily": feeds}, statistics, scenarios, AS_OF, measures=[], stored=False)
        run._wide["daily"] = run.tables.write(run.wide("daily"), "balance")
        texts.append(plan(run.taken("daily")).splitlines())
    for text in texts:
        generate = next(i for i, line in enumerate(text) if "Generate" in line)
        partial = [i for i, line in enumerate(text) if "Aggregate" in line and "region_key" in line]
        assert generate < min(partial)  # above the sums, not above the facts
        assert sum("FileScan" in line for line in text) == sum("FileScan" in line for line in texts[0])
