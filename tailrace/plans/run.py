"""The revenue run: feeds, statistics and a scenario grid to regional, national, weekly and
latest results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.functions import month_start, sum0, week_start, year_month
from tailrace.operators import balance, hydro_share, revenue, running, tariffs
from tailrace.operators.scenarios import Scenario, check_groups, expand_scenarios, variants
from tailrace.plans.tables import Tables
from tailrace.sources.feeds import Feeds

# Key and name of national rows, label of weekly rows.
NATION, NATION_NAME = "no", "Norge"
WEEKLY = "weekly"

# A series of facts is a region of a variant; region_key is the frequency and the region with a
# stand-in for NULL, which no lower-case region equals. Plain equality on it lets the join with the months
# and the window over a month share one partitioning.
SERIES = ["variant", "region_key"]
BUCKET = "month"
NO_REGION = "<NULL>"
# Facts meet the months of all variants on their place, and stay there for the window.
PLACE = ["region_key", BUCKET]
# Lines, as stored, that share a file of the balance.
CLUSTER_BYTES = 64 << 20
REGION_ONLY = ["price", "ssb_prop_vannkraft", "price_monthly_mean", "stromstotte_per_kwh"]
REGION_ONLY += schemas.TARIFFS


class RevenueRun:
    """All results of one grid over one set of feeds.

    Results are DataFrames over shared tables (the balance of each frequency, the months), which the
    first result that needs them writes. close(), or leaving the run as a context, deletes the
    tables; results have to be read before.

    feeds       canonical feeds per frequency in use
    statistics  coded production statistics (ContentsCode, Produk2, Tid, value)
    as_of       day of the run; None is the date in UTC when the run is made
    measures    revenue columns wanted, headline columns at least; only their terms are computed
    stored      write the shared tables (lines, balance, months) once, or recompute them per branch
    """

    by_month = False  # whether the balance is in folders by month

    def __init__(
        self,
        spark: SparkSession,
        feeds: Mapping[str, Feeds],
        statistics: DataFrame,
        scenarios: Sequence[Scenario] = (Scenario(),),
        as_of: str | None = None,
        on_duplicate: str = "raise",
        measures: Sequence[str] = schemas.RUNNING,
        stored: bool = True,
    ):
        for scenario in scenarios:
            if scenario.freq not in feeds:
                raise ValueError(f"freq = {scenario.freq} is not supported")
        self.spark = spark
        self.feeds = feeds
        self.statistics = statistics
        self.scenarios = list(scenarios)
        self.used = list(dict.fromkeys(s.freq for s in scenarios))
        check_groups(scenarios)
        now = dt.datetime.now(dt.timezone.utc).date().isoformat()
        self.day = dt.date.fromisoformat(as_of or now)
        self.today = F.lit(self.day)
        self.on_duplicate = on_duplicate
        wanted = [schemas.plain(m) for m in schemas.RUNNING if m in {*measures, *schemas.HEADLINE}]
        self.measures = revenue.measures([*wanted, *[f"{m}_cum" for m in wanted]])
        self.basis = revenue.used_basis(self.measures.values())
        self.guards = revenue.guards(self.basis)
        self.stored = stored
        self.tables = Tables(spark)
        self._lines: dict[str, DataFrame] = {}
        self._wide: dict[str, DataFrame] = {}

    # Scenario-free part ------------------------------------------------------------------

    def lines(self, freq: str) -> DataFrame:
        """The rows of all feeds in one narrow form. Feeds are read for this table only."""
        if freq not in self._lines:
            named = balance.balance_long(self.feeds[freq], names=True)
            self._lines[freq] = self._shared(named, f"lines-{freq}")
        return self._lines[freq]

    def wide(self, freq: str) -> DataFrame:
        """Energy balance of all dates. A region's month is one piece of one file, as large as CLUSTER_BYTES of lines
        make it: lines move once, for the pivot, and the balance never again."""
        if freq not in self._wide:
            lines = self.keyed(freq, self.lines(freq))
            if not self.stored:
                self._wide[freq] = balance.balance_wide(lines, self.on_duplicate, *PLACE)
            else:
                files = 1 + self.tables.size(f"lines-{freq}") // CLUSTER_BYTES
                wide = balance.balance_wide(lines.repartition(files, *PLACE), self.on_duplicate, *PLACE)
                self._wide[freq] = self.tables.write_clustered(wide, "balance", PLACE, files, "date")
        return self._wide[freq]

    def names(self, freq: str) -> DataFrame:
        """(region, region_name) of the prices."""
        prices = self.lines(freq).where(F.col("variable") == balance.PRICE)
        return prices.select("region", "region_name").distinct()

    def months_seen(self, freq: str) -> DataFrame:
        """The months of the balance, and whether they have rows on their first day."""
        return hydro_share.first_days(self.wide(freq))

    def share(self, freq: str) -> DataFrame:
        """Hydropower share that holds in each month of the balance."""
        ratios = hydro_share.with_trailing_ratio(hydro_share.monthly_share(self.statistics))
        return hydro_share.carried_share(self.months_seen(freq), ratios)

    def rows(self, freq: str, since: Column | None = None, only: Column | None = None) -> DataFrame:
        """Balance rows that any variant of a frequency takes, keyed by region and month. The rows of
        one variant are picked where they meet its range, see picked(). A balance in folders by month
        opens the months from since on, or those that `only` holds for."""
        dates = [self._dates(v) for v in variants(self.scenarios) if v[0] == freq]
        first, last = F.lit(min(d[0] for d in dates)), F.lit(max(d[1] for d in dates))
        rows = self.keyed(freq, self.wide(freq))
        if since is not None:
            first = F.greatest(first, F.trunc(since, "month"))
        if self.by_month:
            rows = balance.in_date_range(rows, F.trunc(first, "month"), last, BUCKET)
        if only is not None:
            rows = rows.where(only)
        if self._completeness(freq) == {True}:
            rows = balance.complete_rows(rows)
        return balance.in_date_range(rows, first, last)

    def keyed(self, freq: str, rows: DataFrame) -> DataFrame:
        """Rows with their month and the key of their region."""
        keys = {BUCKET: month_start(F.col("date")), "region_key": _region_key(freq)}
        return rows.withColumns({k: c for k, c in keys.items() if k not in rows.columns})

    def _completeness(self, freq: str) -> set[bool]:
        return {v[3] for v in variants(self.scenarios) if v[0] == freq}

    def _range(self, variant: tuple) -> tuple[Column, Column, bool]:
        first, last = self._dates(variant)
        return F.lit(first), F.lit(last), variant[3]

    def _dates(self, variant: tuple) -> tuple[dt.date, dt.date]:
        _, start, end, _ = variant
        last = self.day + dt.timedelta(days=1) if end is None else dt.date.fromisoformat(end)
        return dt.date.fromisoformat(start), last

    def cuts(self, freq: str) -> dict[dt.date, list[dt.datetime]]:
        """By month, the instants at which the rows of a variant of the frequency begin or have ended."""
        found: dict[dt.date, set] = {}
        for variant in variants(self.scenarios):
            if variant[0] == freq:
                first, last = (dt.datetime.combine(day, dt.time()) for day in self._dates(variant))
                for instant in (first, last + dt.timedelta(microseconds=1)):
                    found.setdefault(instant.date().replace(day=1), set()).add(instant)
        return {month: sorted(instants) for month, instants in found.items()}

    def ranges(self, freq: str) -> Column:
        """variant, first_date, last_date and complete of each variant of a frequency."""
        each = []
        for i, variant in enumerate(variants(self.scenarios)):
            if variant[0] == freq:
                first, last, na_rm = self._range(variant)
                named = {"variant": F.lit(i), "first_date": first, "last_date": last, "complete": F.lit(na_rm)}
                each.append(F.struct(*[c.alias(n) for n, c in named.items()]))
        return F.inline(F.array(*each))

    def picked(self, rows: DataFrame) -> DataFrame:
        """The rows that the variant beside them takes."""
        rows = balance.in_date_range(rows, F.col("first_date"), F.col("last_date"))
        return rows.filter(~F.col("complete") | balance.is_complete())

    def with_basis(self, rows: DataFrame) -> DataFrame:
        """Share of the day, tariffs and basis of rows that carry the shares of their month."""
        shared = rows.withColumn("ssb_prop_vannkraft", hydro_share.day_share())
        return revenue.with_basis(tariffs.with_tariffs(shared), self.basis)

    @cached_property
    def region_names(self) -> DataFrame:
        """Region names seen in the prices, with the number of names of each region."""
        parts = [self.names(f).select(_region_key(f).alias("region_key"), "region_name") for f in self.used]
        names = reduce(DataFrame.unionByName, parts)
        return names.withColumn("names", F.count(F.lit(1)).over(W.partitionBy("region_key")))

    def pieces(self, freq: str, only: Column | None = None) -> DataFrame:
        """Totals per region, piece of a month and completeness, for all variants at once.

        Months are cut where the rows of some variant begin or end (twice a variant, whatever the data), so
        that each piece belongs to a variant as a whole or not at all. A row is read once and counts in one
        piece; what a variant takes is added up from pieces, see months.
        """
        chosen = self._completeness(freq)
        whole = balance.is_complete() if len(chosen) > 1 else F.lit(chosen == {True})
        return self.piece_totals(freq, self.rows(freq, only=only), self.cuts(freq), whole)

    def piece_totals(
        self, freq: str, rows: DataFrame, cuts: Mapping[dt.date, Sequence[dt.datetime]], whole: Column
    ) -> DataFrame:
        calendar = hydro_share.with_cuts(self.share(freq), cuts)
        rows = self.with_basis(hydro_share.with_month_share(rows, calendar))
        instants = [F.col(c) for c in calendar.columns if c.startswith(hydro_share.CUT)]
        start = F.col(BUCKET).cast("timestamp_ntz")
        begins = F.greatest(start, *[F.when(c <= F.col("date"), c) for c in instants]) if instants else start
        keys = ["region_key", BUCKET, begins.alias("begins"), whole.alias("whole")]
        return rows.groupBy(*keys).agg(
            F.max("on_first").alias("on_first"),  # the same in all rows of the group
            F.max("later").alias("later"),
            F.sum("price").alias("price"),
            F.count("price").alias("prices"),
            F.count(F.lit(1)).alias("rows"),
            *running.bucket_totals(self.basis, self.guards),
        )

    def taken(self, freq: str) -> DataFrame:
        """The pieces of each variant of a frequency."""
        pieces = self.pieces(freq).select("*", self.ranges(freq))
        begins = F.col("begins")
        inside = (begins >= F.col("first_date")) & (begins <= F.col("last_date"))
        return pieces.where(inside & (~F.col("complete") | F.col("whole")))

    @cached_property
    def months(self) -> DataFrame:
        """One row per variant, region, month and region name: shares, mean price and the totals
        of earlier months.

        All that a fact row needs from other rows sits in this small table, so facts meet it in
        one join. The shares come from all rows of the balance, the other figures from the rows
        that completeness and date range leave. A region with several names has its facts once
        per name, hence its totals that many times; a region without prices has no name and
        drops out.
        """
        rows = reduce(DataFrame.unionByName, [self.taken(freq) for freq in self.used])
        one_value = ("first_date", "last_date", "complete", "on_first", "later")
        added = [c for c in rows.columns if c.startswith(("total__", "missing__"))]
        totals = rows.groupBy(*SERIES, BUCKET).agg(
            *[F.max(c).alias(c) for c in one_value],  # the same in all rows of the group
            (F.sum("price") / F.nullif(F.sum("prices"), F.lit(0))).alias("price_monthly_mean"),
            F.sum("rows").alias("rows"),
            *[F.sum(c).alias(c) for c in added],
        )
        rate = revenue.support_rate(F.col("price_monthly_mean"), F.lit(tariffs.SUPPORT_FLOOR))
        named = totals.withColumn("rate", rate).join(self.region_names, "region_key")
        scale = {c: F.expr(f"total__{c} * names") for c in self.basis}
        scale |= {
            c: F.expr(f"coalesce(total__{c} * rate, 0D) * names") for c in revenue.rated(self.basis)
        }
        named = named.withColumns({f"total__{c}": value for c, value in scale.items()})
        if "support__vs" in self.basis:  # needs the rate, so without one all rows lack it
            gaps = F.expr("if(rate IS NULL, rows, missing__support__vs)")
            named = named.withColumn("missing__support__vs", gaps)
        named = named.drop("rows", "rate", "names")
        earlier = running.before_bucket(named, [*SERIES, "region_name"], BUCKET)
        return self._shared(earlier, "months")

    def detail(self, since: Column | None = None, clustered: bool = False) -> DataFrame:
        """Basis rows of each variant, joined with their month, which brings the variants; clustered
        gathers a region's month in one partition before that, while rows are narrow and stand for
        all variants. The balance of one frequency is stored that way."""
        rows = reduce(DataFrame.unionByName, [self.rows(freq, since) for freq in self.used])
        if clustered and (self.by_month or not self.stored or len(self.used) > 1):
            rows = rows.repartition(*PLACE)
        joined = self.picked(self.months.join(rows, PLACE))
        joined = self.with_basis(joined.drop("first_date", "last_date", "complete"))
        rate = revenue.support_rate(F.col("price_monthly_mean"), F.col("param_stromstotte_floor"))
        return revenue.rate_support(
            joined.withColumn("support_rate", rate), "support_rate", self.basis
        )

    def cumulated(self, since: Column | None = None) -> DataFrame:
        """Detail rows with running totals per region. With since, only the months from there
        on pass through the window; earlier ones count through their totals.

        A window partition is one region's month: at most its hours, as dates are unique."""
        return running.add_running(
            self.detail(since, clustered=True),
            SERIES,
            BUCKET,
            ["date", "region_name"],
            self.basis,
            self.guards,
        )

    # Scenario part -----------------------------------------------------------------------

    def regional(self) -> DataFrame:
        columns = {c: c for c in ["date", "region", "region_name", "cnp", *REGION_ONLY]}
        columns["stromstotte_per_kwh"] = "support_rate * param_stromstotte_prop"
        return self._result(self.cumulated(), columns)

    def national_sums(self, since: Column | None = None) -> DataFrame:
        """Sums over regions per date. The running totals are sums of regional ones: a region
        without a row at a date is missing from them there."""
        summed = ["cnp", *self.basis, *[f"cum__{c}" for c in self.basis]]
        return self.cumulated(since).groupBy("variant", "date").agg(*_sums(summed))

    def national(self, since: Column | None = None) -> DataFrame:
        """National rows with all result columns, NULL where a sum means nothing."""
        columns = {"date": "date", "cnp": "cnp"}
        columns |= {"region": f"'{NATION}'", "region_name": f"'{NATION_NAME}'"}
        columns |= {c: "CAST(NULL AS DOUBLE)" for c in REGION_ONLY}
        return self._result(self.national_sums(since), columns)

    def result(self) -> DataFrame:
        """Regional and national rows."""
        return self.regional().unionByName(self.national())

    def weekly(self) -> DataFrame:
        """Headline columns per week, and their running totals over the weeks."""
        week = week_start(F.col("date")).alias("date")
        sums = self.detail().groupBy("variant", week).agg(*_sums(self.basis))
        # One row per week: the window is as long as the calendar, not as the data.
        w = W.partitionBy("variant").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        weeks = sums.withColumns({f"cum__{c}": F.sum(c).over(w) for c in self.basis})
        return self._minimal(weeks).withColumn("freq", F.lit(WEEKLY))

    def latest(self) -> DataFrame:
        """National headline columns from the day before the run on."""
        yesterday = F.date_sub(self.today, 1)
        return self._minimal(latest_slice(self.national_sums(yesterday), yesterday))

    def minimal(self) -> DataFrame:
        return self.weekly().unionByName(self.latest())

    def _shared(self, df: DataFrame, name: str) -> DataFrame:
        return self.tables.write(df, name) if self.stored else df

    def close(self) -> None:
        """Delete the shared tables."""
        self.tables.close()

    def __enter__(self) -> RevenueRun:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _result(self, rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """Result columns of every scenario, calendar columns from the date."""
        date = F.col("date")
        dated = rows.withColumns({"year_month": year_month(date), "quarter": F.quarter(date)})
        columns = {**columns, "year_month": "year_month", "quarter": "quarter", **self.measures}
        return self._expand(dated, columns, schemas.RESULT)

    def _minimal(self, rows: DataFrame) -> DataFrame:
        columns = {"date": "date", **self.measures}
        return self._expand(rows, columns, schemas.MINIMAL)

    def _expand(
        self, rows: DataFrame, columns: Mapping[str, str], order: Sequence[str]
    ) -> DataFrame:
        """Every row once per scenario, with the columns of the written order that exist."""
        known = {c: c for c in ["group", *map(schemas.plain, schemas.SCENARIO)]} | dict(columns)
        names = [c for c in map(schemas.plain, order) if c in known]
        project = [f"{known[c]} AS {c}" for c in names]
        return expand_scenarios(rows, self.spark, self.scenarios, project)


def calculate(
    spark: SparkSession,
    feeds: Mapping[str, Feeds],
    statistics: DataFrame,
    as_of: str | None = None,
    **assumptions,
) -> DataFrame:
    """Regional and national rows of one set of assumptions, without scenario columns."""
    run = RevenueRun(spark, feeds, statistics, [Scenario(**assumptions)], as_of)
    return run.result().drop("group", *map(schemas.plain, schemas.SCENARIO))


def _region_key(freq: str) -> Column:
    return F.concat(F.lit(f"{freq}:"), F.coalesce("region", F.lit(NO_REGION)))


def _sums(columns: Sequence[str]) -> list[Column]:
    return [sum0(F.col(c)).alias(c) for c in columns]


def latest_slice(rows: DataFrame, since: Column) -> DataFrame:
    return rows.filter(F.col("date") >= since)
