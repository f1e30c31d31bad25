"""The whole run against row-by-row SQL on small, gappy data, and its plans."""

import datetime as dt
import inspect
import json
import random
import re
from pathlib import Path
from unittest.mock import Mock

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import difference
from tailrace import schemas
from tailrace.__main__ import main
from tailrace.operators.scenarios import Scenario, expand_grid, published_grid
from tailrace.plans import RevenueRun, sinks
from tailrace.plans.job import run_job
from tailrace.plans.sinks import write_csv, write_json
from tailrace.operators.reshape import drop_all_null_columns, held_counts
from tailrace.plans.tables import CHECKPOINT_DIR, Tables, footers, shared_folder
from tailrace.queries import oracle
from tailrace.queries.catalog import rounded
from tailrace.sources import Feeds

AS_OF = "2022-04-10"
DAYS = [dt.date(2020, 12, 1) + dt.timedelta(days=i) for i in range(520)]
HOURS = [dt.datetime(2021, 12, 28) + dt.timedelta(hours=i) for i in range(0, 24 * 110, 3)]


def fixture(spark, dates, seed, gaps=0.25):
    """Feeds with missing cells, days and first days, prices without region, a region with two
    names (in different periods) and one without prices."""
    rng = random.Random(seed)
    skipped = {d for d in dates if rng.random() < 0.05 or (d.day == 1 and rng.random() < 0.3)}
    production, consumption, prices = [], [], []
    for d in dates:
        if d in skipped:
            continue
        for zone in ("NO1", "NO2", "NO4", "NO", None):
            if rng.random() > gaps:
                production.append((d, zone, float(rng.randint(1, 5000))))
            if rng.random() > gaps:
                mwh = None if rng.random() < 0.05 else float(rng.randint(1, 4000))
                consumption.append((d, zone, mwh))
        for region in ("no1", "no4", None):
            if rng.random() > gaps:
                name = {"no1": "Sør (NO1)", "no4": "Nord (NO4)", None: None}[region]
                if region == "no1" and d.month == 2:
                    name = "Sørøst (NO1)"
                value = None if rng.random() < 0.05 else rng.randint(1, 30000) / 100
                prices.append((d, "x", name, region, value))
    dtype = "timestamp_ntz" if isinstance(dates[0], dt.datetime) else "date"
    power = f"date {dtype}, zone string, mwh double"
    months = pd.period_range(min(dates), max(dates), freq="M")
    statistics = []
    for m in months:
        total = rng.randint(8000, 12000)
        if rng.random() < 0.9:
            statistics.append((m.to_timestamp().date(), float(total), float(rng.randint(6000, total))))
    frames = {
        "production": spark.createDataFrame(production, power),
        "consumption": spark.createDataFrame(consumption, power),
        "prices": spark.createDataFrame(
            prices, f"date {dtype}, name string, display_name string, region string, value double"
        ),
        "statistics": spark.createDataFrame(statistics, "date date, total double, hydro double"),
    }
    coded = frames["statistics"].select(
        F.lit("Kraft").alias("ContentsCode"),
        F.date_format("date", "yyyy'M'MM").alias("Tid"),
        F.inline(F.expr("array(named_struct('p', '01', 'v', total), named_struct('p', '01.01', 'v', hydro))")).alias("Produk2", "value"),
    )
    con = duckdb.connect()
    for name, frame in frames.items():
        arrow = frame.toArrow()
        con.register(f"{name}_arrow", arrow)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    feeds = Feeds(frames["production"], frames["consumption"], frames["prices"])
    return feeds, coded, con


def check(run, con, scenarios):
    ctes = oracle.model(scenarios, AS_OF, feeds="")
    for name, columns, summed in (
        ("regional", oracle.RESULT, False),
        ("national", oracle.RESULT, True),
        ("weekly", oracle.MINIMAL, True),
        ("minimal", oracle.MINIMAL, True),
    ):
        got = rounded(getattr(run, name)(), columns, summed).toPandas()
        want = con.sql(f"{ctes} SELECT {oracle.projection(columns, summed)} FROM {name}").df()
        assert len(got), name
        assert difference(got, want) is None, (name, difference(got, want))


@pytest.mark.parametrize(("seed", "stored"), [(1, True), (2, False)])
def test_daily_run_equals_row_by_row_sql(spark, seed, stored):
    feeds, statistics, con = fixture(spark, DAYS, seed)
    scenarios = [
        Scenario(start_date="2020-12-05", group="a"),
        Scenario(start_date="2022-01-03", na_rm=True, param_price_baseline=0.2, group="b"),
        Scenario(start_date="2022-01-03", na_rm=True, param_prop_hushold=0.5, group="c"),
        Scenario(start_date="2021-03-01", end_date="2022-04-09", param_skatteposisjon_kr=0.3, group="d"),
    ]
    run = RevenueRun(spark, {"daily": feeds}, statistics, scenarios, AS_OF, stored=stored)
    check(run, con, scenarios)


def test_hourly_run_equals_row_by_row_sql(spark):
    feeds, statistics, con = fixture(spark, HOURS, 3)
    scenarios = published_grid(param_prop_spot_eksponert=[0.5], na_rm=[True, False])
    run = RevenueRun(spark, {"hourly": feeds}, statistics, scenarios, AS_OF)
    check(run, con, scenarios)


def test_both_frequencies_in_one_run(spark):
    daily, statistics, _ = fixture(spark, DAYS, 4)
    hourly, _, _ = fixture(spark, HOURS, 4)
    scenarios = expand_grid(freq=["daily", "hourly"], na_rm=[True])
    run = RevenueRun(spark, {"daily": daily, "hourly": hourly}, statistics, scenarios, AS_OF, measures=[])
    both = run.minimal()
    for scenario in scenarios:
        alone = RevenueRun(spark, {"daily": daily, "hourly": hourly}, statistics, [scenario], AS_OF, measures=[])
        got = rounded(both.filter(F.col("group") == scenario.group), oracle.MINIMAL, True).toPandas()
        want = rounded(alone.minimal(), oracle.MINIMAL, True).toPandas()
        assert len(got) and difference(got, want) is None


def test_weekly_sums_and_running_totals_add_up(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 5, gaps=0)
    run = RevenueRun(spark, {"daily": feeds}, statistics, [Scenario(na_rm=True)], AS_OF)
    national, weekly = run.national(), run.weekly()
    total = national.agg(F.sum("en_staten_spot")).first()[0]
    assert weekly.agg(F.sum("en_staten_spot")).first()[0] == pytest.approx(total)
    assert weekly.agg(F.max_by("en_staten_spot_cum", "date")).first()[0] == pytest.approx(total)
    regional = run.regional().groupBy("region").agg(
        F.max_by("en_vkraft_cum", "date").alias("last"), F.sum("en_vkraft").alias("all")
    )
    for r in regional.collect():
        assert r["last"] == pytest.approx(r["all"])


def test_unknown_frequency(spark):
    with pytest.raises(ValueError, match="weekly"):
        RevenueRun(spark, {}, None, [Scenario(freq="weekly")])


def test_grid_in_slices(spark, monkeypatch):
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    scenarios = published_grid(freq=["daily"], na_rm=[True, False])
    whole = RevenueRun(spark, {"daily": feeds}, statistics, scenarios, AS_OF, measures=[]).weekly().toPandas()
    monkeypatch.setattr("tailrace.operators.scenarios.SLICE", 5)
    sliced = RevenueRun(spark, {"daily": feeds}, statistics, scenarios, AS_OF, measures=[]).weekly().toPandas()
    assert difference(rounded_frame(sliced), rounded_frame(whole)) is None


def operators(text):
    """Names of a plan's operators, without what tells one run from another."""
    names = [re.sub(r"\(\d+\)", "", line.strip(" +-:*")).split("[")[0].split(" ")[0] for line in text.splitlines()]
    return [n for n in names if n and n not in ("Relation", "LocalTableScan", "Scan", "Project")]


def test_grid_of_any_length_has_one_plan(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    many = [f"{i / 1000}" for i in range(50_000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        for grid in (
            published_grid(freq=["daily"]),
            published_grid(freq=["daily"], param_price_baseline=list(map(float, many)), param_prop_hushold=[0.1, 0.2, 0.3]),
        ):
            run = RevenueRun(spark, {"daily": feeds}, statistics, grid, AS_OF, measures=[])
            plans.append((operators(plan(run.regional())), operators(plan(run.weekly()))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0] == plans[1]
    assert plans[0][0].count("Window") == 1


def test_groups_are_unique(spark):
    with pytest.raises(ValueError, match="'1'"):
        RevenueRun(spark, {"daily": None}, None, [Scenario(), Scenario(na_rm=True)])


def above(text, marker):
    """Lines of a plan from the first one that has the marker up to the root."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if marker in line)
    depth, found = len(lines[at]), []
    for line in reversed(lines[: at + 1]):
        own = re.search(r"[A-Za-z*(]", line).start() if re.search(r"[A-Za-z*(]", line) else depth
        if own < depth:
            found.append(line)
            depth = own
    return found


def test_facts_never_move_after_the_pivot(spark):
    """The balance is stored by region and month: neither the join with the months of 20 row choices, none of them
    broadcast, nor the window moves it."""
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    starts = [f"2021-{m:02d}-{d:02d}" for m in range(1, 11) for d in (1, 15)]
    run = RevenueRun(spark, {"daily": feeds}, statistics, expand_grid(start_date=starts), AS_OF, measures=[])
    run.months.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = above(plan(run.regional()), "FileScan parquet spark_catalog.default.balance")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    window = next(i for i, line in enumerate(path) if "Window" in line)
    assert any("Join" in line for line in path[:window])
    assert not any("Exchange" in line or "Generate" in line for line in path[:window]), path


def test_one_date_for_a_run(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    zone = spark.conf.get("spark.sql.session.timeZone")
    run = RevenueRun(spark, {"daily": feeds}, statistics, [Scenario(start_date="2021-01-01")])
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
        run.months.count()
        first = run.regional().count(), run.latest().count()
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Pago_Pago")
        assert (run.regional().count(), run.latest().count()) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_close_leaves_nothing(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    with RevenueRun(spark, {"daily": feeds}, statistics, published_grid(freq=["daily"]), AS_OF) as run:
        assert run.minimal().count()
        paths = [Path(p.removeprefix("file:")) for group in run.tables.paths.values() for p in group]
        assert paths and all(p.exists() for p in paths)
    assert not any(p.exists() for p in paths)


def rounded_frame(frame):
    return frame.round(4)


def test_no_rows_keep_the_schema(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 7)
    run = RevenueRun(spark, {"daily": feeds}, statistics, [Scenario(start_date="2030-01-01")], AS_OF)
    assert run.minimal().count() == 0 and run.minimal().columns == oracle.MINIMAL
    assert run.result().columns == oracle.RESULT and run.result().count() == 0


# Plans --------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    feeds, statistics, _ = fixture(spark, DAYS, 8)
    run = RevenueRun(spark, {"daily": feeds}, statistics, published_grid(freq=["daily"]), AS_OF, measures=[])
    weekly, latest, regional = plan(run.weekly()), plan(run.latest()), plan(run.regional())
    for text in (weekly, latest, regional):
        assert "Python" not in text and "ArrowEval" not in text
        assert "SinglePartition" not in text
        assert "NestedLoop" not in text and "Cartesian" not in text
    # Weekly sums move only their partial results; no fact row is shuffled or sorted.
    assert weekly.count("Exchange hashpartitioning") == 2 and weekly.count("Window") == 1
    # The latest slice reads the months it needs.
    assert "2022-04-01" in latest or "trunc" in latest
    # Several row choices share one scan of the balance.
    mixed = RevenueRun(spark, {"daily": feeds}, statistics, expand_grid(na_rm=[True, False], start_date=["2021-01-01", "2022-01-01"]), AS_OF, measures=[])
    assert plan(mixed.weekly()).count("FileScan") == 2
    # Facts do not move for running totals, whatever the number of scenarios.
    assert regional.count("Exchange hashpartitioning") == 0
    assert "Scan ExistingRDD" not in regional


class Session:
    """What shared_folder() asks of a session."""

    _jvm = None

    def __init__(self, folder=None):
        self.sparkContext = self._jsc = self
        self.applicationId = "app-1"
        self.conf = {"spark.sql.warehouse.dir": "hdfs://x/warehouse"}
        if folder:
            self.conf[CHECKPOINT_DIR] = folder

    def getCheckpointDir(self):
        return None

    def hadoopConfiguration(self):
        return None


def test_shared_folder(monkeypatch):
    monkeypatch.setattr("atexit.register", lambda *_: None)
    assert shared_folder(Session("hdfs://x/shared/")) == "hdfs://x/shared/tailrace-app-1"
    assert shared_folder(Session()) == "hdfs://x/warehouse/_intermediate/tailrace-app-1"


def test_footers_answer(spark, tmp_path):
    """Counts and the last date of a stored table need none of its rows; the rules of columns stay."""
    feeds, statistics, _ = fixture(spark, DAYS, 6)
    tables = Tables(spark)
    run = RevenueRun(spark, {"daily": feeds}, statistics, published_grid(freq=["daily"]), AS_OF, measures=[])
    stored = tables.write(run.wide("daily"), "balance")
    path = tables.paths["balance"][0]
    with footers(spark):
        read = spark.read.parquet(path)
        assert "PushedAggregation: [MAX(date)]" in plan(read.agg(F.max("date")))
        counted = plan(read.agg(*held_counts(read.columns)))
        assert "PushedAggregation: [COUNT(*)" in counted and "ReadSchema: struct<count(*)" in counted
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    assert tables.aggregated("balance", F.max("date"))[0] == stored.agg(F.max("date")).first()[0]
    empty = stored.withColumns({"none": F.lit(None).cast("double"), "text": F.lit(None).cast("string")})
    held = tables.write(empty, "more")
    counts = tables.aggregated("more", *held_counts(held.columns))
    assert drop_all_null_columns(held, counts).columns == drop_all_null_columns(held).columns == stored.columns


def test_tables_are_removed(spark):
    with Tables(spark) as tables:
        assert tables.write(spark.range(3), "three").count() == 3
        (path,) = tables.paths["three"]
        assert Path(path.removeprefix("file:")).is_dir()
    assert not Path(path.removeprefix("file:")).exists()


# Files --------------------------------------------------------------------------------------


def test_csv_and_json_files(spark, tmp_path):
    schema = "`group` string, na_rm boolean, date timestamp_ntz, en_staten_spot double, region_name string"
    rows = [("1", True, dt.datetime(2022, 1, 1, 5), 1.123456, None), ("2", False, None, None, "Norge")]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    write_csv(df, f"{tmp_path}/csv")
    write_json(df, f"{tmp_path}/json")
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "group,na.rm,date,en.staten.spot,region.name"
    assert lines[1:] == ["1,TRUE,2022-01-01T05:00:00Z,1.123456,NA", "2,FALSE,NA,NA,Norge"]
    objects = [json.loads(x) for x in next((tmp_path / "json").glob("part-*")).read_text().splitlines()]
    assert objects == [
        {"group": "1", "na.rm": True, "date": "2022-01-01 05:00:00", "en.staten.spot": 1.123456},
        {"group": "2", "na.rm": False, "region.name": "Norge"},
    ]


def test_failed_job_leaves_old_results(spark, tmp_path, monkeypatch):
    def rows(n):
        text = "group string, date timestamp_ntz"
        return spark.createDataFrame([(str(i), dt.datetime(2022, 1, 1)) for i in range(n)], text)

    sinks.write_results(rows(3), rows(2), str(tmp_path), "x-")
    names = {"x-no-2022-01-01-000000.csv", "x-no-latest.csv", "x-minimal-latest.csv", "x-minimal-latest.json"}
    assert {p.name for p in tmp_path.iterdir()} == names

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(sinks, "write_json", fail)
        sinks.write_results(rows(9), rows(9), str(tmp_path), "x-")
    assert {p.name for p in tmp_path.iterdir()} == names
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/{name}").count()
    assert [read("x-no-latest.csv"), read("x-minimal-latest.csv")] == [3, 2]
    sinks.write_results(rows(5), rows(4), str(tmp_path), "x-")
    assert [read("x-no-latest.csv"), read("x-minimal-latest.csv")] == [5, 4]


def test_job_from_documents_to_files(spark, tmp_path):
    rng = random.Random(9)
    dates = [dt.date(2022, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    days = [d.isoformat() for d in dates]

    def land(name, *docs):
        folder = tmp_path / name
        folder.mkdir()
        for i, doc in enumerate(docs):
            (folder / f"{i}.json").write_text(json.dumps(doc))
        return str(folder)

    def items(part):
        return {
            "items": [
                {"date": d, "hours": f"{h:02d} - {h + 1:02d}", "zone": z, "MWh": rng.randint(1, 99)}
                for d in part for h in range(3) for z in ("NO", "NO1", "NO5")
            ]
        }

    rows = [[d, f"{h:02d} - {h + 1:02d}", "10,5" if rng.random() < 0.1 else str(rng.randint(9, 400)), "70", "1"] for d in days for h in range(3)]
    paths = {
        "hourly": {
            "production": land("pro", items(days[:30]), items(days[30:])),
            "consumption": land("cnp", items(days)),
            "prices": land("price", {"columns": ["date", "hours", "oslo", "bergen", "mars"], "rows": rows}),
        }
    }
    months = pd.period_range("2021-09", "2022-03", freq="M")
    facts = [("Kraft", code, f"{m.year}M{m.month:02d}", v) for m in months for code, v in (("01", 100.0), ("01.01", 90.0))]
    spark.createDataFrame(facts, schemas.STAT_FACT).write.parquet(f"{tmp_path}/statistics")
    out = str(tmp_path / "out")
    run_job(spark, paths, f"{tmp_path}/statistics", out, as_of="2022-03-01", prefix="x-")

    minimal = spark.read.option("header", True).csv(f"{out}/x-minimal-latest.csv")
    assert minimal.columns == schemas.MINIMAL
    weeks = minimal.filter("freq = 'weekly'")
    assert weeks.count() == 6 * weeks.select("date").distinct().count()
    assert minimal.filter("freq = 'hourly'").count() == 6 * len(
        {(d, h) for d, h, price, *_ in rows if d >= "2022-02-28"}
    )
    national = spark.read.option("header", True).csv(f"{out}/x-no-latest.csv")
    assert national.columns == schemas.RESULT
    dated = f"{out}/x-no-2022-03-01-020000.csv"
    assert spark.read.option("header", True).csv(dated).count() == national.count()
    assert spark.read.json(f"{out}/x-minimal-latest.json").count() == minimal.count()


def test_command_line_with_flat_files(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    days = [(dt.date(2022, 1, 1) + dt.timedelta(days=i)).isoformat() for i in range(40)]
    power = [f"{d},{z},{rng.randint(1, 99)}" for d in days for z in ("NO", "NO1", "NO2")]
    prices = [f"x,{r.upper()} name,{rng.randint(9, 400)},{d},{r}" for d in days for r in ("no1", "no2")]
    (tmp_path / "power.csv").write_text("\n".join(["date,zone,MWh", *power]))
    (tmp_path / "prices.csv").write_text("\n".join(["name,displayName,value,date,region", *prices]))
    facts = [("Kraft", c, f"2021M{m:02d}", v) for m in range(8, 13) for c, v in (("01", 10.0), ("01.01", 9.0))]
    spark.createDataFrame(facts, schemas.STAT_FACT).write.parquet(f"{tmp_path}/statistics")
    power_path, out = f"{tmp_path}/power.csv", tmp_path / "out"
    options = {
        "production": power_path, "consumption": power_path, "prices": f"{tmp_path}/prices.csv",
        "statistics": f"{tmp_path}/statistics", "out": str(out), "freq": "daily", "format": "csv",
        "as-of": "2022-02-09",
    }
    argv = ["tailrace", *[part for name, value in options.items() for part in (f"--{name}", value)]]
    monkeypatch.setattr("sys.argv", argv)
    main()
    national = spark.read.option("header", True).csv(f"{out}/no-2022-02-09-000000.csv")
    assert national.count() == 6 * len(days)
    # No balance row falls on the first day of a month with statistics, so no share is known.
    assert {r["en.vkraft"] for r in national.select("`en.vkraft`").collect()} == {"0.0"}


def test_command_line_with_both_frequencies(monkeypatch):
    seen = {}
    names = list(inspect.signature(run_job).parameters)
    monkeypatch.setattr("tailrace.__main__.run_job", lambda *args: seen.update(zip(names, args)))
    monkeypatch.setattr("tailrace.__main__.SparkSession", Mock())
    feeds = ["--production", "a", "b", "--consumption", "c", "d", "--prices", "e", "f"]
    argv = ["tailrace", "--freq", "daily", "hourly", *feeds, "--statistics", "s", "--out", "o", "--codes", "Tid=2021M01,2021M02", "Produk2=01"]
    monkeypatch.setattr("sys.argv", argv)
    main()
    assert seen["paths"] == {
        "daily": {"production": "a", "consumption": "c", "prices": "e"},
        "hourly": {"production": "b", "consumption": "d", "prices": "f"},
    }
    assert {s.freq for s in seen["scenarios"]} == {"daily", "hourly"} and len(seen["scenarios"]) == 12
    assert seen["codes"] == {"Tid": ["2021M01", "2021M02"], "Produk2": ["01"]}
    for wrong in (["--freq", "daily"], ["--freq", "daily", "hourly", "--codes", "Tid"]):
        monkeypatch.setattr("sys.argv", ["tailrace", *feeds, "--statistics", "s", "--out", "o", *wrong])
        with pytest.raises(SystemExit):
            main()
