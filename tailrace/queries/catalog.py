"""Named queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.functions import (
    area_code,
    file_label,
    hour_timestamp,
    number,
    split_hours,
    week_start,
    year_month,
)
from tailrace.operators import balance, hydro_share, reshape, running, tariffs
from tailrace.operators.scenarios import Scenario, expand_grid, expand_scenarios, published_grid
from tailrace.plans import FeedStore, RevenueRun, StoredRun, calculate
from tailrace.plans import run as runs
from tailrace.plans.sinks import last_label, write_csv, write_json, write_results
from tailrace.plans.tables import Tables, new_path, written
from tailrace.queries import landing, oracle
from tailrace.schemas import plain
from tailrace.sources import Feeds, documents, flat, load_feeds, metadata_long, read_statistics, regions
from tailrace.sources.warehouse import Warehouse, shifted

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2027-03-01"  # day of the daily runs; fixed, so that results do not move
HOURLY_AS_OF = "2024-01-25"
# The published grid over daily data, one scenario with gaps in the data, and hourly runs.
GRID = published_grid(freq=["daily"])
GAPPED = [Scenario(start_date="2021-01-01")]
HOURLY_GRID = published_grid()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(rows: DataFrame, columns: list[str], summed: bool = False) -> DataFrame:
    """Columns with the rounding of the comparison; adding 0 turns -0 into 0."""

    def item(column: str):
        n = oracle.digits(column, summed)
        if n is None:
            return F.col(column)
        return (F.round(F.col(column) + F.lit(oracle.boundary(n)), n) + F.lit(0.0)).alias(column)

    return rows.select(*map(item, columns))


def daily_run(spark, folder, scenarios=GRID, measures=schemas.RUNNING, **options) -> RevenueRun:
    w = Warehouse(spark, folder)
    return RevenueRun(
        spark, {"daily": w.daily()}, w.statistics(), scenarios, AS_OF, measures=measures, **options
    )


def hourly_run(spark, folder, measures=schemas.RUNNING) -> RevenueRun:
    w = Warehouse(spark, folder)
    return RevenueRun(
        spark, {"hourly": w.hourly()}, w.statistics(), HOURLY_GRID, HOURLY_AS_OF, measures=measures
    )


def daily_wide(spark: SparkSession, folder: str) -> DataFrame:
    return balance.balance_wide(balance.balance_long(Warehouse(spark, folder).daily()))


FEEDS = f"WITH {oracle.FEEDS}"
HOURLY = f"WITH {oracle.HOURLY_FEEDS}"
BALANCE = f"{FEEDS},{oracle.BALANCE}"
HOURLY_BALANCE = f"{HOURLY},{oracle.BALANCE}"
SHARED = f"{BALANCE},{oracle.STATISTICS},{oracle.SHARED}"
RUN = oracle.model(GRID, AS_OF)
GAPPED_RUN = oracle.model(GAPPED, AS_OF)
HOURLY_RUN = oracle.model(HOURLY_GRID, HOURLY_AS_OF, hourly=True)


# Sources ------------------------------------------------------------------------------------


@query(f"{FEEDS} SELECT * FROM prices")
def src_prices_daily(spark, folder):
    docs = landing.daily_price_documents(Warehouse(spark, folder).prices())
    path = landing.landed_documents(docs, "prices-daily")
    return documents.daily_prices(
        documents.read_documents(spark, path, schemas.DAILY_PRICES_JSON, multi_line=False)
    )


HOURLY_PRICE_CELLS = f"""{HOURLY}, areas AS (SELECT DISTINCT day, name FROM hourly),
hours_seen AS (SELECT DISTINCT day, hours, date FROM hourly),
matrix AS (
  SELECT date, day, hours, left(hours, 2) AS hour_start, right(hours, 2) AS hour_end, a.name,
    CASE WHEN CAST(left(hours, 2) AS INTEGER) % 7 = 0 AND a.name = 'oslo' THEN NULL ELSE price END AS value
  FROM hours_seen JOIN areas a USING (day) LEFT JOIN hourly USING (day, hours, date, name))"""


@query(
    f"""{HOURLY_PRICE_CELLS} SELECT date, hour_start, hour_end, name, display_name, region, value
    FROM matrix LEFT JOIN (SELECT name, display_name, region FROM area WHERE region IS NOT NULL) USING (name)"""
)
def src_prices_hourly(spark, folder):
    """Matrices with cells of both types: numbers, and text that is a number or not."""
    docs = landing.with_numbers(landing.hourly_price_documents(Warehouse(spark, folder).hourly_price_items()))
    path = landing.landed_documents(docs, "prices-hourly")
    raw = documents.read_documents(spark, path, schemas.HOURLY_PRICES_JSON, multi_line=False)
    return documents.hourly_prices(raw, regions.region_dimension(spark))


def _daily_power(spark, rows, name):
    path = landing.landed_documents(landing.daily_power_documents(rows), name)
    return documents.daily_power(
        documents.read_documents(spark, path, schemas.DAILY_ITEMS_JSON, multi_line=False)
    )


def _hourly_power(spark, items, name):
    path = landing.landed_documents(landing.hourly_power_documents(items), name)
    return documents.hourly_power(
        documents.read_documents(spark, path, schemas.HOURLY_ITEMS_JSON, multi_line=False)
    )


@query(f"{FEEDS} SELECT * FROM production")
def src_production_daily(spark, folder):
    return _daily_power(spark, Warehouse(spark, folder).production(), "production-daily")


@query(f"{FEEDS} SELECT * FROM consumption")
def src_consumption_daily(spark, folder):
    return _daily_power(spark, Warehouse(spark, folder).consumption(), "consumption-daily")


HOURLY_POWER = """SELECT date, left(hours, 2) AS hour_start, right(hours, 2) AS hour_end, zone,
  {v} AS mwh FROM hourly WHERE {v} IS NOT NULL"""


@query(f"{HOURLY} {HOURLY_POWER.format(v='all_value')}")
def src_production_hourly(spark, folder):
    return _hourly_power(spark, Warehouse(spark, folder).hourly_items("all_value"), "production-hourly")


@query(f"{HOURLY} {HOURLY_POWER.format(v='even_value')}")
def src_consumption_hourly(spark, folder):
    return _hourly_power(spark, Warehouse(spark, folder).hourly_items("even_value"), "consumption-hourly")


@query(f"{FEEDS} SELECT * FROM consumption")
def src_csv_daily(spark, folder):
    rows = Warehouse(spark, folder).consumption().withColumnRenamed("mwh", "MWh")
    return flat.power_rows(
        flat.read_flat(spark, landing.landed_csv(rows, "consumption-csv"), schemas.POWER_CSV)
    )


@query(f"{FEEDS} SELECT * FROM prices")
def src_csv_prices(spark, folder):
    rows = Warehouse(spark, folder).prices().select(
        "name", F.col("display_name").alias("displayName"), "value", "date", "region"
    )
    return flat.price_rows(
        flat.read_flat(spark, landing.landed_csv(rows, "prices-csv"), schemas.PRICES_CSV)
    )


@query(
    f"{FEEDS} SELECT 'cnp' AS feed, zone AS area, count(*) AS n, sum(mwh) AS total FROM consumption GROUP BY zone"
    " UNION ALL SELECT 'pro', zone, count(*), sum(mwh) FROM production GROUP BY zone"
    " UNION ALL SELECT 'price', region, count(*), round(sum(value), 4) FROM prices GROUP BY region"
)
def src_by_frequency(spark, folder):
    """The three daily feeds landed as documents and read back through the frequency switch."""
    w = Warehouse(spark, folder)
    paths = {
        name: landing.landed_documents(make(rows), name)
        for name, make, rows in (
            ("production", landing.daily_power_documents, w.daily().production),
            ("consumption", landing.daily_power_documents, w.daily().consumption),
            ("prices", landing.daily_price_documents, w.daily().prices),
        )
    }
    feeds = load_feeds(spark, "daily", paths, multi_line=False)

    def summary(rows, feed, area, total):
        return rows.groupBy(F.col(area).alias("area")).agg(
            F.lit(feed).alias("feed"), F.count(F.lit(1)).alias("n"), total.alias("total")
        )

    mwh, value = F.sum("mwh"), F.round(F.sum("value"), 4)
    return (
        summary(feeds.consumption, "cnp", "zone", mwh)
        .unionByName(summary(feeds.production, "pro", "zone", mwh))
        .unionByName(summary(feeds.prices, "price", "region", value))
    )


BROKEN = {
    "no json": "{ items: ",
    "another type": '{"items": [{"date": "2022-01-01", "zone": "NO1", "MWh": {}}]}',
    "no array": '{"item": []}',
}


@query(
    f"{FEEDS} SELECT 'rows' AS part, zone, sum(mwh) AS mwh, count(*) AS n FROM production GROUP BY zone"
    " UNION ALL SELECT 'unreadable', NULL, NULL, 2 UNION ALL SELECT 'no items', NULL, NULL, 1"
)
def src_quarantine(spark, folder):
    """Landed production among which three documents are broken: the others' rows, and what was put aside."""
    docs = landing.daily_power_documents(Warehouse(spark, folder).production())
    path = landing.landed_documents(docs, "production-broken")
    spark.createDataFrame([(t,) for t in BROKEN.values()], "value string").write.mode("append").text(path)
    aside = documents.Quarantine(Tables(spark).write, at_most=3)
    raw = aside.read(spark, "production", path, schemas.DAILY_ITEMS_JSON, multi_line=False)
    n = F.count(F.lit(1)).alias("n")
    rows = documents.daily_power(raw).groupBy("zone").agg(F.sum("mwh").alias("mwh"), n)
    broken = aside.broken.groupBy(F.col("reason").alias("part")).agg(n)
    nothing = {"zone": F.lit(None).cast("string"), "mwh": F.lit(None).cast("double")}
    return rows.withColumn("part", F.lit("rows")).unionByName(broken.withColumns(nothing))


@query(
    f"{HOURLY_PRICE_CELLS}, texts AS (SELECT day AS date, hours, name, value FROM matrix)"
    " SELECT date, hours, name, value FROM texts"
)
def unpivot_prices(spark, folder):
    docs = landing.hourly_price_documents(Warehouse(spark, folder).hourly_price_items())
    return documents.hourly_price_cells(docs).withColumn("value", number(F.col("value")))


@query(
    f"{FEEDS}, areas(region) AS (VALUES ('no1'), ('no2'), ('no3'), ('no4'), ('no5')),"
    " dates AS (SELECT DISTINCT date FROM prices)"
    " SELECT date, region AS name, value FROM dates CROSS JOIN areas LEFT JOIN prices USING (date, region)"
)
def unpivot_wide_prices(spark, folder):
    areas = ["no1", "no2", "no3", "no4", "no5"]
    prices = Warehouse(spark, folder).prices()
    cells = [F.max(F.when(F.col("region") == a, F.col("value"))).alias(a) for a in areas]
    return reshape.unpivot(prices.groupBy("date").agg(*cells), ["date"])


def _statistics_metadata(facts: DataFrame) -> dict[str, DataFrame]:
    """Code lists of the coded columns, and one of a variable that the facts lack."""
    label = F.when(F.col("Produk2") == hydro_share.HYDRO, F.lit("Vannkraft")).otherwise(
        F.lit("Total produksjon av elektrisk kraft")
    )
    months = facts.select(F.col("Tid").alias("values")).distinct()
    return {
        "ContentsCode": facts.select(
            F.col("ContentsCode").alias("values"), F.lower("ContentsCode").alias("valueTexts")
        ).distinct(),
        "Produk2": facts.select(F.col("Produk2").alias("values"), label.alias("valueTexts")).distinct(),
        "Tid": months.withColumn("valueTexts", F.concat(F.lit("month "), F.col("values"))),
        "Region": months.withColumn("valueTexts", F.col("values")),
    }


CODED = f"""WITH {oracle.STATISTICS},
coded AS (
  SELECT 'Kraft' AS contents, strftime(date, '%YM%m') AS tid, '01' AS product, total AS value FROM statistics
  UNION ALL SELECT 'Kraft', strftime(date, '%YM%m'), '01.01', hydro FROM statistics),
products AS (SELECT * FROM (VALUES ('01', 'Total produksjon av elektrisk kraft'), ('01.01', 'Vannkraft'))
  t(product, label))"""


@query(
    f"""{CODED} SELECT contents AS variable, 'kraft' AS variable_label, product AS produk2,
    label AS produk2_label, tid, 'month ' || tid AS tid_label, value
    FROM coded JOIN products USING (product) WHERE tid NOT LIKE '%M12'"""
)
def src_stat_table_labelled(spark, folder):
    """Landed facts with landed code lists; the list of months lacks each December."""
    path = landing.landed_csv(Warehouse(spark, folder).statistics(), "statistics")
    lists = _statistics_metadata(read_statistics(spark, path, fmt="csv").fact)
    lists["Tid"] = lists["Tid"].filter(~F.col("values").endswith("M12"))
    paths = {v: landing.landed_csv(lists[v], f"labels-{v}") for v in ("Produk2", "Tid", "ContentsCode")}
    landed = read_statistics(spark, path, paths, "csv")
    wanted = {"ContentsCode": "Kraft", "Tid": True, "Produk2": ["01", "01.01"]}
    return reshape.clean_names(landed.labelled(wanted))


@query(
    f"""{CODED} SELECT DISTINCT 'ContentsCode' AS key, contents AS code, 'kraft' AS "desc" FROM coded
    UNION ALL SELECT DISTINCT 'Produk2', product, label FROM coded JOIN products USING (product)
    UNION ALL SELECT DISTINCT 'Tid', tid, 'month ' || tid FROM coded
    UNION ALL SELECT DISTINCT 'Region', tid, tid FROM coded"""
)
def stat_meta_long(spark, folder):
    return metadata_long(_statistics_metadata(Warehouse(spark, folder).statistics()), simplify=True)


@query(
    f"{FEEDS}, dimension(name, display_name, region) AS (VALUES ('oslo', 'Sørøst-Norge (NO1)', 'no1'),"
    " ('kristiansand', 'Sørvest-Norge (NO2)', 'no2'), ('bergen', 'Vest-Norge (NO5)', 'no5'),"
    " ('trondheim', 'Midt-Norge (NO3)', 'no3'), ('tromso', 'Nord-Norge (NO4)', 'no4'))"
    " SELECT d.name, d.display_name, d.region, count(*) AS days, sum(mwh) AS mwh"
    " FROM production JOIN dimension d ON lower(zone) = region GROUP BY ALL"
)
def dim_regions(spark, folder):
    production = Warehouse(spark, folder).production().withColumn("region", F.lower("zone"))
    return (
        production.join(regions.region_dimension(spark), "region")
        .groupBy("name", "display_name", "region")
        .agg(F.count(F.lit(1)).alias("days"), F.sum("mwh").alias("mwh"))
    )


@query(f"{FEEDS} SELECT DISTINCT region, display_name AS region_name FROM prices")
def distinct_regions(spark, folder):
    return regions.distinct_regions(Warehouse(spark, folder).prices())


@query(f"{HOURLY} SELECT DISTINCT region, display_name AS region_name FROM prices")
def distinct_regions_hourly(spark, folder):
    return regions.distinct_regions(Warehouse(spark, folder).hourly().prices)


@query(f"{HOURLY} SELECT day AS date, hours, name, price AS value, display_name, region FROM hourly")
def join_region_left(spark, folder):
    cells = Warehouse(spark, folder).hourly_price_items()
    return regions.join_regions(cells, regions.region_dimension(spark)).withColumn("value", number(F.col("value")))


@query(
    f"{HOURLY_BALANCE} SELECT wide.*, region_name FROM wide JOIN"
    " (SELECT DISTINCT region, display_name AS region_name FROM prices) n"
    " ON wide.region IS NOT DISTINCT FROM n.region"
)
def join_region_names(spark, folder):
    feeds = Warehouse(spark, folder).hourly()
    wide = balance.balance_wide(balance.balance_long(feeds))
    return reshape.with_region_names(wide, regions.distinct_regions(feeds.prices))


# Filters and projections --------------------------------------------------------------------


@query(f"{FEEDS} SELECT * FROM production WHERE zone <> 'NO'")
def filter_drop_total_zone(spark, folder):
    return balance.drop_total_zone(Warehouse(spark, folder).production())


@query(f"{BALANCE} SELECT * FROM wide WHERE pro IS NOT NULL AND cnp IS NOT NULL AND price IS NOT NULL")
def filter_complete_rows(spark, folder):
    return balance.complete_rows(daily_wide(spark, folder))


@query(f"{HOURLY_BALANCE} SELECT * FROM wide WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def filter_date_range(spark, folder):
    wide = balance.balance_wide(balance.balance_long(Warehouse(spark, folder).hourly()))
    return balance.in_date_range(
        wide, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")
    )


PREFIXED = ["date", "region", *schemas.TARIFFS]


@query(f"{GAPPED_RUN} SELECT {', '.join(PREFIXED)} FROM priced")
def project_by_prefix(spark, folder):
    rows = tariffs.with_tariffs(daily_wide(spark, folder)).filter(F.col("date") <= _day_after(AS_OF))
    kept = rows.select("date", "region", *reshape.starting_with(rows, "param_"))
    order = reshape.relocate(kept.columns, "param_mva", after="region")
    return kept.select(order)


HELD = [c for c in oracle.RESULT if c not in oracle.REGION_ONLY]


@query(f"{RUN} SELECT {oracle.projection(HELD, summed=True)} FROM national")
def drop_all_null_columns(spark, folder):
    tables = Tables(spark)
    national = tables.write(daily_run(spark, folder).national(), "national")
    counts = tables.aggregated("national", *reshape.held_counts(national.columns))
    held = reshape.drop_all_null_columns(national, counts)
    return rounded(held, held.columns, summed=True)


HEADLINE = [plain(c) for c in schemas.HEADLINE]
NATIONAL = ["group", "date", "year_month", "quarter", "region", "region_name"]
NATIONAL_KEY = NATIONAL + ["pro", "cnp", "alt_til_spotpris", *HEADLINE]
NATIONAL_KEY += ["pro_cum", *[f"{c}_cum" for c in HEADLINE]]


@query(
    f"{RUN} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national"
    f" WHERE date >= DATE '{AS_OF}' - 1"
)
def latest_slice(spark, folder):
    since = F.date_sub(F.lit(AS_OF).cast("date"), 1)
    run = daily_run(spark, folder, measures=["pro", "alt_til_spotpris"])
    return rounded(runs.latest_slice(run.national(since), since), NATIONAL_KEY, summed=True)


@query(
    f"{BALANCE} SELECT max(date) AS date, strftime(max(date), '%Y-%m-%d') || '-000000' AS label FROM wide"
)
def max_date(spark, folder):
    last = reshape.max_date(daily_wide(spark, folder))
    return last.withColumn("label", file_label(F.col("date")))


@query(
    f"{BALANCE} SELECT max(date) AS date, count(*) AS n, count(price) AS prices, count(pro) AS pro FROM wide"
)
def max_date_stored(spark, folder):
    """The last date of a stored balance and how much it holds, from the footers of its files."""
    tables = Tables(spark)
    tables.write(daily_wide(spark, folder), "balance")
    counts = [F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.count("pro").alias("pro")]
    row = tables.aggregated("balance", F.max("date").alias("date"), *counts)
    return spark.createDataFrame([row], "date date, n long, prices long, pro long")


LAST = ["group", "date", "region", "quarter", *HEADLINE, *[f"{c}_cum" for c in HEADLINE]]


def _picked(source: str) -> str:
    as_text = ", ".join(
        f"CAST(CAST(round({c}, 0) AS BIGINT) AS VARCHAR) AS {c}"
        if c.startswith("en_")
        else f"CAST({oracle.quoted(c)} AS VARCHAR) AS {oracle.quoted(c)}"
        for c in LAST
    )
    return f"""{RUN}, picked AS (
      SELECT * FROM national WHERE param_price_baseline = 0.4::DOUBLE AND param_prop_spot_eksponert = 0.7::DOUBLE),
    last AS (SELECT {as_text} FROM picked WHERE date = (SELECT max(date) FROM picked))
    {source}"""


@query(_picked(f"UNPIVOT last ON {', '.join(map(oracle.quoted, LAST))} INTO NAME name VALUE value"))
def scenario_last_row(spark, folder):
    national = written(daily_run(spark, folder, measures=[]).national(), "national")
    picked = national.filter(
        (F.col("param_price_baseline") == 0.4) & (F.col("param_prop_spot_eksponert") == 0.7)
    )
    last = reshape.last_row(reshape.at_last_date(picked)).select(LAST)
    whole = {c: F.round(F.col(c), 0).cast("bigint") for c in LAST if c.startswith("en_")}
    return reshape.transpose_row(last.withColumns(whole))


@query(f"{BALANCE} SELECT * FROM wide ORDER BY date NULLS LAST, region NULLS LAST")
def sorted_output(spark, folder):
    return reshape.sorted_output(daily_wide(spark, folder), "date", "region")


# Balance and share --------------------------------------------------------------------------


@query(f"{BALANCE} SELECT * FROM long")
def balance_long(spark, folder):
    return balance.balance_long(Warehouse(spark, folder).daily())


@query(f"{BALANCE} SELECT * FROM wide")
def balance_wide(spark, folder):
    return daily_wide(spark, folder)


@query(f"{HOURLY_BALANCE} SELECT * FROM wide")
def balance_wide_hourly(spark, folder):
    return balance.balance_wide(balance.balance_long(Warehouse(spark, folder).hourly()))


@query(
    f"{BALANCE}, coarse AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, region, variable,"
    " avg(value) AS value FROM long GROUP BY ALL)"
    " SELECT date, region, round(max(value) FILTER (variable = 'pro'), 4) AS pro,"
    " round(max(value) FILTER (variable = 'cnp'), 4) AS cnp,"
    " round(max(value) FILTER (variable = 'price'), 4) AS price FROM coarse GROUP BY date, region"
)
def balance_wide_mean(spark, folder):
    """Many values per cell, averaged: all days of a month under its first day."""
    long = balance.balance_long(Warehouse(spark, folder).daily())
    coarse = long.withColumn("date", F.trunc("date", "month"))
    wide = balance.balance_wide(coarse, on_duplicate="mean")
    return wide.withColumns({c: F.round(c, 4) for c in balance.VARIABLES})


@query(f"WITH {oracle.STATISTICS},{oracle.RATIOS} SELECT date, total, hydro, hydro_ratio_month FROM ratios")
def hydro_share_monthly(spark, folder):
    return hydro_share.monthly_share(Warehouse(spark, folder).statistics()).drop("ContentsCode")


@query(f"WITH {oracle.STATISTICS},{oracle.RATIOS} SELECT date, hydro_ratio_month, hydro_ratio_ma4 FROM ratios")
def hydro_share_ma4(spark, folder):
    monthly = hydro_share.monthly_share(Warehouse(spark, folder).statistics())
    return hydro_share.with_trailing_ratio(monthly).select(
        "date", "hydro_ratio_month", "hydro_ratio_ma4"
    )


@query(f"{SHARED} SELECT date, region, ssb_prop_vannkraft FROM shared")
def hydro_share_asof(spark, folder):
    w = Warehouse(spark, folder)
    wide = balance.balance_wide(balance.balance_long(w.daily()))
    ratios = hydro_share.with_trailing_ratio(hydro_share.monthly_share(w.statistics()))
    months = hydro_share.share_by_month(wide, ratios)
    return hydro_share.with_hydro_share(wide, months).select("date", "region", "ssb_prop_vannkraft")


MONTHLY = ["date", "region", "price", "price_monthly_mean"]


@query(f"{GAPPED_RUN} SELECT {oracle.projection(MONTHLY)} FROM named")
def monthly_price_mean(spark, folder):
    return rounded(daily_run(spark, folder, GAPPED, measures=[]).detail(), MONTHLY)


# Scalar functions ---------------------------------------------------------------------------


@query(
    """SELECT n_name, n_name || ' (NO' || n_regionkey || ')' AS display_name,
    lower(nullif(regexp_extract(CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE
      n_name || ' (NO' || n_regionkey || ')' END, 'NO\\d+'), '')) AS region FROM nation"""
)
def fn_region_from_name(spark, folder):
    nation = Warehouse(spark, folder).table("nation")
    display = F.concat("n_name", F.lit(" (NO"), "n_regionkey", F.lit(")"))
    text = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(display)
    return nation.select("n_name", display.alias("display_name"), area_code(text).alias("region"))


HOUR_SHAPES = ["HH - HH", "HH", "HH--HH;xx", "xx - HH"]


@query(
    """WITH raw AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
      lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h, event_id % 5 AS shape FROM events)
    SELECT event_id, CASE shape WHEN 3 THEN 'xx' WHEN 4 THEN NULL ELSE h END AS hour_start,
      CASE shape WHEN 0 THEN h WHEN 2 THEN h WHEN 3 THEN h END AS hour_end,
      CASE WHEN shape < 3 THEN CAST(day || ' ' || h || ':00:00' AS TIMESTAMP) END AS date
    FROM raw"""
)
def fn_hour_timestamp(spark, folder):
    """Well-formed hours, a missing second part, an extra part, a malformed and a NULL one."""
    events = Warehouse(spark, folder).table("events")
    h = F.lpad(F.hour("ts").cast("string"), 2, "0")
    hours = F.lit(None).cast("string")
    for number_, shape in enumerate(HOUR_SHAPES):
        text = F.replace(F.lit(shape), F.lit("HH"), h)
        hours = F.when(F.col("event_id") % 5 == number_, text).otherwise(hours)
    start, end = split_hours(F.col("hours"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select("event_id", "ts", hours.alias("hours")).select(
        "event_id",
        start.alias("hour_start"),
        end.alias("hour_end"),
        hour_timestamp(day, start).alias("date"),
    )


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9497 AS date,
    strftime(CAST(o_orderdate AS DATE) + 9497, '%Y-%m') AS year_month,
    CAST(quarter(CAST(o_orderdate AS DATE) + 9497) AS INTEGER) AS quarter,
    CAST(date_trunc('week', CAST(o_orderdate AS DATE) + 9497) AS DATE) AS week_start,
    strftime(CAST(o_orderdate AS DATE) + 9497, '%Y-%m-%d-%H%M%S') AS label FROM orders"""
)
def fn_dates(spark, folder):
    orders = Warehouse(spark, folder).table("orders")
    date = F.col("date")
    return orders.select("o_orderkey", shifted(F.col("o_orderdate")).alias("date")).select(
        "o_orderkey",
        "date",
        year_month(date).alias("year_month"),
        F.quarter(date).alias("quarter"),
        week_start(date).alias("week_start"),
        file_label(date).alias("label"),
    )


# Revenue columns of rows --------------------------------------------------------------------

ROW_KEY = ["date", "region"]


@query(f"{GAPPED_RUN} SELECT {', '.join(PREFIXED)} FROM named")
def tariff_params(spark, folder):
    return daily_run(spark, folder, GAPPED, measures=[]).detail().select(PREFIXED)


def _revenue_query(name: str, *prefixes: str) -> None:
    """Row values of the output columns that start with one of the prefixes."""
    columns = [plain(m) for m in schemas.MEASURES if m.startswith(prefixes)]
    wanted = [m for m in schemas.MEASURES if plain(m) in columns]

    def rows(spark, folder):
        run = daily_run(spark, folder, GAPPED, measures=wanted)
        return rounded(run.regional(), ROW_KEY + columns)

    rows.__name__ = name
    query(f"{GAPPED_RUN} SELECT {oracle.projection(ROW_KEY + columns)} FROM regional")(rows)


_revenue_query("support_rate", "stromstotte_per_kwh")
_revenue_query("rev_base", "alt_til_spotpris", "en.vkraft")
_revenue_query("rev_income", "en.inntekt")
_revenue_query("rev_tax", "en.grunnrenteskatt", "en.selskapsskatt", "en.skatt")
_revenue_query("rev_owner_split", "en.resultat_til_eiere")
_revenue_query("rev_household", "en.hushold")
_revenue_query("rev_grid_levy", "en.elavgift")
_revenue_query("rev_state", "en.staten")


# Scenarios and rollups ----------------------------------------------------------------------


GRID_COLUMNS = ["group", *oracle.SCENARIO]


@query(
    f"{RUN}, days AS (SELECT \"group\", count(*) AS n_rows, sum(pro) AS pro FROM named GROUP BY 1)"
    f" SELECT {', '.join('g.' + oracle.quoted(c) for c in GRID_COLUMNS)}, n_rows, pro"
    " FROM grid g JOIN days USING (\"group\")"
)
def scenario_grid(spark, folder):
    """Every combination of the grid, with the balance rows it applies to."""
    run = daily_run(spark, folder, measures=["pro"])
    sums = run.detail().groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("pro").alias("pro")
    )
    return expand_scenarios(sums, spark, GRID, [f"{c} AS {c}" for c in GRID_COLUMNS] + ["n_rows", "pro"])


SWEEP = ["group", *ROW_KEY, "year_month", "quarter", "region_name", *oracle.SCENARIO]
SWEEP += ["pro", "cnp", "price", "ssb_prop_vannkraft", *HEADLINE]


@query(f"{RUN} SELECT {oracle.projection(SWEEP)} FROM regional")
def scenario_sweep(spark, folder):
    return rounded(daily_run(spark, folder, measures=["pro"]).regional(), SWEEP)


MIXED = [
    *published_grid(freq=["daily"], param_price_baseline=[0.25], end_date=["2024-01-20"]),
    Scenario(start_date="2021-06-15", group="3"),
    Scenario(start_date="2023-01-01", end_date="2023-12-31", na_rm=True, group="4"),
]
VARIANT = ["group", *ROW_KEY, "price_monthly_mean", "na_rm", *HEADLINE, *[f"{c}_cum" for c in HEADLINE]]


@query(f"{oracle.model(MIXED, AS_OF)} SELECT {oracle.projection(VARIANT)} FROM regional")
def scenario_sweep_variants(spark, folder):
    """Scenarios that differ in their rows as well."""
    return rounded(daily_run(spark, folder, MIXED, measures=[]).regional(), VARIANT)


STARTS = expand_grid(
    freq=["daily"], start_date=[f"{2021 + i // 6}-{i % 6 * 2 + 1:02d}-{i % 28 + 1:02d}" for i in range(24)], na_rm=[True, False]
)


@query(
    f"{oracle.model(STARTS, AS_OF)} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national"
    f" WHERE date >= DATE '{AS_OF}' - 1"
)
def scenario_sweep_starts(spark, folder):
    """48 choices of rows: the totals of their months are added up from pieces that are computed once."""
    run = daily_run(spark, folder, STARTS, measures=["pro", "alt_til_spotpris"])
    since = F.date_sub(F.lit(AS_OF).cast("date"), 1)
    return rounded(runs.latest_slice(run.national(since), since), NATIONAL_KEY, summed=True)


CUMULATIVE = ["group", *ROW_KEY, *[f"{c}_cum" for c in oracle.RUNNING]]


@query(f"{GAPPED_RUN} SELECT {oracle.projection(CUMULATIVE)} FROM regional")
def regional_cumulative(spark, folder):
    return rounded(daily_run(spark, folder, GAPPED).regional(), CUMULATIVE)


@query(f"{RUN} SELECT {oracle.projection(CUMULATIVE)} FROM regional")
def regional_cumulative_sweep(spark, folder):
    return rounded(daily_run(spark, folder).regional(), CUMULATIVE)


RUNNING_TOTAL = ["date", "region", "pro_cum", "cnp_cum", "price_cum"]


@query(
    f"{BALANCE}, totals AS (SELECT date, region,"
    + ", ".join(
        f" CASE WHEN count({c}) OVER w = count(*) OVER w THEN sum({c}) OVER w END AS {c}_cum"
        for c in balance.VARIABLES
    )
    + " FROM wide WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING"
    f" AND CURRENT ROW)) SELECT {oracle.projection(RUNNING_TOTAL)} FROM totals"
)
def running_total(spark, folder):
    """The running-total operator on its own; it reads its rows twice."""
    wide = written(daily_wide(spark, folder), "balance")
    monthly = wide.withColumn("year_month", year_month(F.col("date")))
    totals = running.running_total(monthly, ["region"], "date", "year_month", balance.VARIABLES)
    named = totals.withColumnsRenamed({f"cum__{c}": f"{c}_cum" for c in balance.VARIABLES})
    return rounded(named, RUNNING_TOTAL)


ALL_NATIONAL = [*NATIONAL, *oracle.SUMMED, *[f"{c}_cum" for c in oracle.RUNNING]]


@query(f"{GAPPED_RUN} SELECT {oracle.projection(ALL_NATIONAL, summed=True)} FROM national")
def national_rollup(spark, folder):
    return rounded(daily_run(spark, folder, GAPPED).national(), ALL_NATIONAL, summed=True)


@query(f"{RUN} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national")
def national_daily(spark, folder):
    run = daily_run(spark, folder, measures=["pro", "alt_til_spotpris"])
    return rounded(run.national().filter(F.col("region") == "no"), NATIONAL_KEY, summed=True)


@query(f"{HOURLY_RUN} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national")
def national_hourly(spark, folder):
    run = hourly_run(spark, folder, measures=["pro", "alt_til_spotpris"])
    return rounded(run.national(), NATIONAL_KEY, summed=True)


@query(
    f"{GAPPED_RUN} SELECT {oracle.projection(oracle.RESULT)} FROM regional UNION ALL"
    f" SELECT {oracle.projection(oracle.RESULT, summed=True)} FROM national"
)
def regional_plus_national(spark, folder):
    run = daily_run(spark, folder, GAPPED)
    return rounded(run.regional(), oracle.RESULT).unionByName(
        rounded(run.national(), oracle.RESULT, summed=True)
    )


ASSUMED = [Scenario(start_date="2021-06-01", na_rm=True, param_prop_hushold=0.3)]
ALONE = [c for c in oracle.RESULT if c not in ("group", *oracle.SCENARIO)]


@query(
    f"{oracle.model(ASSUMED, AS_OF)} SELECT {oracle.projection(ALONE, summed=True)} FROM"
    f" (SELECT {', '.join(ALONE)} FROM regional UNION ALL SELECT {', '.join(ALONE)} FROM national)"
)
def revenue_model(spark, folder):
    """One set of assumptions by keyword."""
    w = Warehouse(spark, folder)
    assumptions = {"start_date": "2021-06-01", "na_rm": True, "param_prop_hushold": 0.3}
    result = calculate(spark, {"daily": w.daily()}, w.statistics(), AS_OF, **assumptions)
    return rounded(result, ALONE, summed=True)


WEEKLY = [c for c in oracle.MINIMAL if not c.endswith("_cum")]


@query(f"{RUN} SELECT {oracle.projection(WEEKLY, summed=True)} FROM weekly")
def weekly_rollup(spark, folder):
    return rounded(daily_run(spark, folder, measures=[]).weekly(), WEEKLY, summed=True)


@query(f"{RUN} SELECT {oracle.projection(oracle.MINIMAL, summed=True)} FROM weekly")
def weekly_cumulative(spark, folder):
    return rounded(daily_run(spark, folder, measures=[]).weekly(), oracle.MINIMAL, summed=True)


MINIMAL_SQL = f"{RUN} SELECT {oracle.projection(oracle.MINIMAL, summed=True)} FROM minimal"


@query(MINIMAL_SQL)
def minimal_output(spark, folder):
    return rounded(daily_run(spark, folder, measures=[]).minimal(), oracle.MINIMAL, summed=True)


@query(f"{HOURLY_RUN} SELECT {oracle.projection(oracle.MINIMAL, summed=True)} FROM minimal")
def minimal_output_hourly(spark, folder):
    return rounded(hourly_run(spark, folder, measures=[]).minimal(), oracle.MINIMAL, summed=True)


# Runs over a store --------------------------------------------------------------------------

LAST_WEEK = "2027-02-23"  # the week before AS_OF lands after the rest


def _between(feeds: Feeds, condition: str) -> Feeds:
    return Feeds(*[rows.where(condition) for rows in (feeds.production, feeds.consumption, feeds.prices)])


def _daily_store(spark, folder) -> FeedStore:
    """A store of all daily documents, in two batches: what landed first, and a week later the rest."""
    landed = new_path(spark, "landed")
    feeds = Warehouse(spark, folder).daily()
    store = FeedStore(spark, new_path(spark, "store"))
    for part, condition in (("first", f"date < '{LAST_WEEK}'"), ("second", f"date >= '{LAST_WEEK}'")):
        paths = landing.land_daily(_between(feeds, condition), landed, part)
        store.ingest("daily", paths, multi_line=False)
        statistics = Warehouse(spark, folder).statistics()
        StoredRun(store, statistics, GRID, AS_OF, measures=[]).months  # the first batch's totals stay
    return store


@query(MINIMAL_SQL)
def incremental_run(spark, folder):
    """A week lands after a run: only its files are read, only its months are written anew."""
    run = StoredRun(_daily_store(spark, folder), Warehouse(spark, folder).statistics(), GRID, AS_OF, measures=[])
    return rounded(run.minimal(), oracle.MINIMAL, summed=True)


@query(
    f"SELECT 'one' AS grid, * FROM ({RUN} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national"
    f" WHERE date >= DATE '{AS_OF}' - 1) UNION ALL SELECT 'two', * FROM"
    f" ({oracle.model(MIXED, AS_OF)} SELECT {oracle.projection(NATIONAL_KEY, summed=True)} FROM national"
    f" WHERE date >= DATE '{AS_OF}' - 1)"
)
def store_two_grids(spark, folder):
    """Two grids over one store; of the facts only the last month and those that a grid cuts are opened."""
    store, statistics = _daily_store(spark, folder), Warehouse(spark, folder).statistics()
    since, parts = F.date_sub(F.lit(AS_OF).cast("date"), 1), []
    for grid, scenarios in (("one", GRID), ("two", MIXED)):
        run = StoredRun(store, statistics, scenarios, AS_OF, measures=["pro", "alt_til_spotpris"])
        rows = runs.latest_slice(run.national(since), since)
        parts.append(rounded(rows, NATIONAL_KEY, summed=True).withColumn("grid", F.lit(grid)))
    return parts[0].unionByName(parts[1])


# Sinks --------------------------------------------------------------------------------------


HOURLY_MINIMAL_SQL = f"{HOURLY_RUN} SELECT {oracle.projection(oracle.MINIMAL, summed=True)} FROM minimal"


@query(HOURLY_MINIMAL_SQL)
def sink_roundtrip_csv(spark, folder):
    """Hourly rows in full precision; rounded after reading."""
    rows = hourly_run(spark, folder, measures=[]).minimal()
    path = new_path(spark, "minimal-csv")
    write_csv(rows, path)
    return rounded(_read_csv(spark, path, rows), oracle.MINIMAL, summed=True)


@query(HOURLY_MINIMAL_SQL)
def sink_roundtrip_json(spark, folder):
    rows = hourly_run(spark, folder, measures=[]).minimal()
    path = new_path(spark, "minimal-json")
    write_json(rows, path)
    back = spark.read.schema(_dotted_schema(rows)).json(path).toDF(*rows.columns)
    return rounded(back, oracle.MINIMAL, summed=True)


DATED = "'no-' || strftime((SELECT max(date) FROM national), '%Y-%m-%d-%H%M%S') || '.csv'"


@query(
    f"{HOURLY_RUN}, files(file) AS (VALUES ('no-latest.csv'), ({DATED}))"
    f" SELECT file, {oracle.projection(NATIONAL_KEY, summed=True)} FROM national, files"
)
def sink_national_csv(spark, folder):
    """The national result under its dated and its latest name."""
    run = hourly_run(spark, folder, measures=["pro", "alt_til_spotpris"])
    national = run.tables.write(run.national(), "national")
    out = new_path(spark, "results")
    write_results(national, run.tables.write(run.minimal(), "minimal"), out)
    names = [f"no-{last_label(national)}.csv", "no-latest.csv"]
    files = [
        _read_csv(spark, f"{out}/{name}", national).withColumn("file", F.lit(name)) for name in names
    ]
    return rounded(files[0].unionByName(files[1]), ["file", *NATIONAL_KEY], summed=True)


@query(
    f"{HOURLY_RUN} SELECT max(date) AS date, strftime(max(date), '%Y-%m-%d-%H%M%S') AS label FROM national"
)
def max_date_hourly(spark, folder):
    last = reshape.max_date(hourly_run(spark, folder, measures=[]).national())
    return last.withColumn("label", file_label(F.col("date")))


def _read_csv(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    reader = spark.read.schema(_dotted_schema(rows)).options(header=True, nullValue="NA")
    return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path).toDF(*rows.columns)


def _dotted_schema(rows: DataFrame):
    renamed = rows.toDF(*[schemas.DOTTED.get(c, c) for c in rows.columns])
    return renamed.schema


def _day_after(day: str):
    return F.date_add(F.lit(day).cast("date"), 1)
