"""Intermediate tables in the folder the cluster shares.

A table that several branches read is written once: lineage ends there, a lost executor costs
no recomputation, and the planner knows the table's size on disk when it picks join strategies.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Row, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_removed_at_exit: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one named by spark.checkpoint.dir; where that is unset,
    below the warehouse, which is shared as well. It is removed when the driver ends."""
    folder = (
        spark.conf.get(CHECKPOINT_DIR, None)
        or spark.sparkContext.getCheckpointDir()
        or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
    )
    own = f"{folder.rstrip('/')}/tailrace-{spark.sparkContext.applicationId}"
    if own not in _removed_at_exit:
        _removed_at_exit.add(own)
        atexit.register(_remove_at_exit, _files(spark), own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet and return the table."""
    return Tables(df.sparkSession).write(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    _delete(*_files(spark), path)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a folder another name, in place of what has that name."""
    jvm, configuration = _files(spark)
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    files = new.getFileSystem(configuration)
    files.delete(new, True)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{path} could not be moved to {target}")


def _files(spark: SparkSession) -> tuple:
    """What it takes to delete files, also when the session has stopped."""
    context = spark.sparkContext
    return context._jvm, context._jsc.hadoopConfiguration()


def _delete(jvm, configuration, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


def _remove_at_exit(files: tuple, path: str) -> None:
    try:
        _delete(*files, path)
    except (Py4JError, OSError):  # the JVM has gone before
        pass


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within, the session has these settings; plan and read inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def footers(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, counts and extremes of parquet tables that are read here are answered from the footers of their
    files, where nothing but partitions is filtered and columns are numbers or dates; plan and read inside."""
    return settings(spark, {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"})


def aggregated(spark: SparkSession, path: str, *columns: Column) -> Row:
    """Aggregates of a parquet table as one row, from footers where they hold them."""
    with footers(spark):
        return spark.read.parquet(path).agg(*columns).first()


class Tables:
    """The intermediate tables of one run, by name; drop() or close() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}
        self.registered: dict[str, str] = {}  # path -> table of the session's catalogue

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_clustered(self, df: DataFrame, name: str, keys: Sequence[str], files: int, *order: str) -> DataFrame:
        """Like write(), with the rows of a key in one of so many files: joins, sums and windows by the keys need
        no exchange of this table. df should be partitioned by the keys in as many parts."""
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        self.registered[path] = table
        writer = df.write.format("parquet").bucketBy(files, *keys).sortBy(*keys, *order)
        writer.option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def aggregated(self, name: str, *columns: Column) -> Row:
        """Aggregates of the table of this name that was written last."""
        return aggregated(self.spark, self.paths[name][-1], *columns)

    def size(self, name: str) -> int:
        """Bytes of a table's files."""
        jvm, configuration = _files(self.spark)
        paths = [jvm.org.apache.hadoop.fs.Path(path) for path in self.paths.get(name, [])]
        return sum(p.getFileSystem(configuration).getContentSummary(p).getLength() for p in paths)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            for path in self.paths.pop(name, []):
                if path in self.registered:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.registered.pop(path)}")
                remove(self.spark, path)

    def close(self) -> None:
        self.drop(*list(self.paths))

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.close()
