"""Landed feeds kept as tables between runs: every landed file is read once.

Below one folder, each table partitioned by what later steps choose by:

lines      rows of all feeds, narrow, by frequency, batch and month
names      region names of each batch's prices, by frequency and batch
files      the landed files that have been read, with the batch that read them; written after a batch's lines,
           so lines of a batch that failed are never seen
balance    one row per date and region, by frequency and month
calendar   which months have rows on their first day, and the version of their rows, by frequency and month
totals     totals per region of whole months, by frequency and month
done       batches whose months are in balance and calendar

New files add a batch of lines and rewrite the months they touch, by dynamic partition overwrite; other months stay as
they are. Months are rewritten from all their lines, so a job that failed is simply repeated, and a month's totals are
written anew where its rows or its shares have changed. Running totals need the totals of earlier months only, so
later months shift with them when a run adds them up. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailrace.functions import month_start
from tailrace.operators import balance, hydro_share
from tailrace.plans.run import BUCKET, RevenueRun
from tailrace.plans.tables import aggregated
from tailrace.sources.feeds import Feeds, load_feeds

FEEDS = ("production", "consumption", "prices")
DATES = {"daily": "date", "hourly": "timestamp_ntz"}
# Regions of one month go to so many files of the balance.
SPREAD = 8

FILES = "freq string, batch string, feed string, path string, size long, modified timestamp"
LINES = "region string, value double, variable string, region_name string, batch string, month date"
BALANCE = "region string, pro double, cnp double, price double, month date"
NAMES = "region string, region_name string, batch string"
CALENDAR = "has_first boolean, version string, month date"
DONE = "batch string"


class FeedStore:
    """The tables of one folder; ingest() reads what has landed since the last time."""

    def __init__(self, spark: SparkSession, folder: str, on_duplicate: str = "raise"):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.on_duplicate = on_duplicate

    # Tables ------------------------------------------------------------------------------

    def table(self, name: str, schema: str, freq: str | None = None) -> DataFrame:
        """A table as it is now, of one frequency or all; without files it has no rows."""
        path = f"{self.folder}/{name}" + (f"/freq={freq}" if freq else "")
        if not self._exists(path):
            return self.spark.createDataFrame([], T.StructType.fromDDL(schema))
        return self.spark.read.schema(schema).parquet(path)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _append(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _rewrite(self, rows: DataFrame, name: str, *by: str) -> None:
        """Overwrite the partitions that rows have; others stay."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(f"{self.folder}/{name}")

    def files(self, freq: str) -> DataFrame:
        return self.table("files", FILES).where(F.col("freq") == freq)

    def batches(self, freq: str) -> list[str]:
        """Batches that were read whole; one for each ingest that found new files."""
        return [r[0] for r in self.files(freq).select("batch").distinct().collect()]

    def lines(self, freq: str) -> DataFrame:
        lines = self.table("lines", f"date {DATES[freq]}, {LINES}", freq)
        return lines.where(F.col("batch").isin(self.batches(freq)))

    def names(self, freq: str) -> DataFrame:
        names = self.table("names", NAMES, freq).where(F.col("batch").isin(self.batches(freq)))
        return names.select("region", "region_name").distinct()

    def balance(self, freq: str) -> DataFrame:
        return self.table("balance", f"date {DATES[freq]}, {BALANCE}", freq)

    def calendar(self, freq: str) -> DataFrame:
        return self.table("calendar", CALENDAR, freq)

    def last_date(self, freq: str) -> dt.date | dt.datetime | None:
        """The latest date of the balance: of its last month alone, and of footers where they hold it."""
        month = self.calendar(freq).agg(F.max(BUCKET)).first()[0]
        if month is None:
            return None
        return aggregated(self.spark, f"{self.folder}/balance/freq={freq}/{BUCKET}={month}", F.max("date"))[0]

    # Reading what is new ------------------------------------------------------------------

    def landed(self, paths: Mapping[str, str]) -> DataFrame:
        """feed, path, size and time of the files below each feed's path; contents are not read."""
        found = []
        for feed in FEEDS:
            reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
            columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
            found.append(reader.load(paths[feed]).select(F.lit(feed).alias("feed"), *columns))
        return reduce(DataFrame.unionByName, found)

    def ingest(self, freq: str, paths: Mapping[str, str], fmt: str = "json", multi_line: bool = True) -> int:
        """Read the files that have landed since the last time and bring the balance up to date; returns their
        number. A file that has changed since it was read stops the ingest: start another folder then."""
        known = self.files(freq).select("feed", "path", F.col("size").alias("was"), F.col("modified").alias("then"))
        landed = self.landed(paths).join(known, ["feed", "path"], "left")
        same = (F.col("size") == F.col("was")) & (F.col("modified") == F.col("then"))
        # Names of files pass the driver, as they do whenever Spark reads files.
        new = landed.where(F.col("was").isNull() | ~same).collect()
        changed = [r.path for r in new if r.was is not None]
        if changed:
            raise ValueError(f"{len(changed)} landed files have changed since they were read, as {changed[0]}")
        if new:
            by_feed = {feed: [r.path for r in new if r.feed == feed] for feed in FEEDS}
            self._add(freq, load_feeds(self.spark, freq, by_feed, fmt, multi_line), [tuple(r)[:4] for r in new])
        self._catch_up(freq)
        return len(new)

    def append(self, freq: str, feeds: Feeds) -> None:
        """Add rows that were read by other means, once."""
        self._add(freq, feeds, [(None, None, None, None)])
        self._catch_up(freq)

    def _add(self, freq: str, feeds: Feeds, files: Sequence[tuple]) -> None:
        batch = uuid.uuid4().hex
        keys = {"freq": F.lit(freq), "batch": F.lit(batch), BUCKET: month_start(F.col("date"))}
        lines = balance.balance_long(feeds, names=True).withColumns(keys)
        self._append(lines.select("date", "region", "value", "variable", "region_name", *keys), "lines", *keys)
        own = self.table("lines", f"date {DATES[freq]}, {LINES}", freq).where(F.col("batch") == batch)
        names = own.where(F.col("variable") == balance.PRICE).select("region", "region_name").distinct()
        self._append(names.withColumns({k: keys[k] for k in ("freq", "batch")}), "names", "freq", "batch")
        rows = self.spark.createDataFrame([(freq, batch, *file) for file in files], FILES)
        rows.write.mode("append").parquet(f"{self.folder}/files")

    def _catch_up(self, freq: str) -> None:
        """Rewrite the months of batches that are not in the balance yet."""
        done = self.table("done", f"freq string, {DONE}").where(F.col("freq") == freq).select("batch")
        ahead = [r[0] for r in self.files(freq).select("batch").distinct().join(done, "batch", "left_anti").collect()]
        if not ahead:
            return
        lines = self.lines(freq)
        touched = [r[0] for r in lines.where(F.col("batch").isin(ahead)).select(BUCKET).distinct().collect()]
        dated = [m for m in touched if m is not None]
        mine = F.col(BUCKET).isin(dated) if dated else F.lit(False)
        if len(dated) < len(touched):
            mine = mine | F.col(BUCKET).isNull()
        # A month's rows meet once, for the pivot and for its files; regions spread so that no task has a month.
        spread = F.pmod(F.xxhash64("region"), F.lit(SPREAD)).alias("spread")
        rows = lines.where(mine).select("*", spread).repartition(BUCKET, "spread")
        wide = balance.balance_wide(rows, self.on_duplicate, BUCKET, "spread").drop("spread")
        wide = wide.withColumn("freq", F.lit(freq)).sortWithinPartitions(BUCKET, "date")
        self._rewrite(wide, "balance", "freq", BUCKET)
        version = {"freq": F.lit(freq), "version": F.lit(uuid.uuid4().hex)}
        months = hydro_share.first_days(self.balance(freq).where(mine)).withColumns(version)
        self._rewrite(months.coalesce(1), "calendar", "freq", BUCKET)  # a row a month
        marks = self.spark.createDataFrame([(freq, b) for b in ahead], f"freq string, {DONE}")
        marks.write.mode("append").parquet(f"{self.folder}/done")


class StoredRun(RevenueRun):
    """A run over a store. It reads no landed file; of the facts it reads the months that its results need, and
    the totals of whole months are taken from the store."""

    by_month = True

    def __init__(self, store: FeedStore, statistics: DataFrame, scenarios: Sequence, as_of: str | None = None, **options):
        freqs = dict.fromkeys((s.freq for s in scenarios), None)
        super().__init__(store.spark, freqs, statistics, scenarios, as_of, store.on_duplicate, **options)
        self.store = store

    def wide(self, freq: str) -> DataFrame:
        if freq not in self._wide:
            self._wide[freq] = self.store.balance(freq)
        return self._wide[freq]

    def names(self, freq: str) -> DataFrame:
        return self.store.names(freq)

    def months_seen(self, freq: str) -> DataFrame:
        return self.store.calendar(freq).drop("version")

    def pieces(self, freq: str, only: Column | None = None) -> DataFrame:
        """Whole months from the store; those that a variant cuts are added up from the balance."""
        cut = F.col(BUCKET).isin(list(self.cuts(freq)))
        fresh = super().pieces(freq, cut)
        held = _WholeMonths(self, freq).current().where(~cut)
        chosen = self._completeness(freq)
        if chosen == {True}:
            held = held.where("whole")
        begins = F.col(BUCKET).cast("timestamp_ntz").alias("begins")
        whole = F.col("whole") if len(chosen) > 1 else F.lit(chosen == {True}).alias("whole")
        kept = [c for c in fresh.columns if c not in ("begins", "whole")]
        return fresh.unionByName(held.select(begins, whole, *kept))


class _WholeMonths(RevenueRun):
    """Totals of every month, uncut, for all measures and both kinds of rows, as the store keeps them."""

    def __init__(self, run: StoredRun, freq: str):
        scenarios = [s for s in run.scenarios if s.freq == freq][:1]
        super().__init__(run.spark, {freq: None}, run.statistics, scenarios, run.day.isoformat())
        self.run, self.freq, self.store = run, freq, run.store

    def share(self, freq: str) -> DataFrame:
        return self.run.share(freq)

    @property
    def schema(self) -> str:
        columns = [f"total__{c} double" for c in self.basis]
        columns += [f"missing__{g} long" for g in dict.fromkeys(self.guards[c] for c in self.basis)]
        fixed = "region_key string, whole boolean, on_first double, later double, price double, prices long, rows long"
        return f"{fixed}, version string, {', '.join(columns)}, {BUCKET} date"

    def current(self) -> DataFrame:
        """The totals; months whose rows or shares are not those they were made of are written anew first."""
        shares = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("on_first", "later")]
        made_of = F.md5(F.concat_ws("|", "version", *shares)).alias("made_of")
        wanted = self.store.calendar(self.freq).join(self.share(self.freq), BUCKET).select(BUCKET, made_of)
        held = self.store.table("totals", self.schema, self.freq).groupBy(BUCKET).agg(F.max("version").alias("version"))
        stale = wanted.join(held, BUCKET, "left").where(~F.col("made_of").eqNullSafe(F.col("version"))).drop("version")
        months = {r[0]: r[1] for r in stale.collect()}  # a row a month
        if months:
            version = F.try_element_at(F.create_map(*[F.lit(x) for r in months.items() for x in r]), F.col(BUCKET))
            rows = self.keyed(self.freq, self.store.balance(self.freq)).where(F.col(BUCKET).isin(list(months)))
            found = self.piece_totals(self.freq, rows, {}, balance.is_complete()).drop("begins")
            found = found.withColumns({"version": version, "freq": F.lit(self.freq)})
            self.store._rewrite(found.repartition(BUCKET), "totals", "freq", BUCKET)
        return self.store.table("totals", self.schema, self.freq).drop("version")
