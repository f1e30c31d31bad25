"""From raw documents to the plan of a training set's shards, stage by stage.

toxicity          documents that the severity model calls toxic go
jaccard_join      of each group of linked near copies one document stays, that with the smallest doc_id
decontamination   documents that hold a benchmark item go
mixture           documents are taken as often as the mix of sources takes them, or not at all
sharding          every row that is left gets its shard and slot

A stage is a function of (spark, docs, sf_dir); its result is written as parquet and read again as the
docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.llm import decontamination, hilbert, jaccard, mixture, toxicity
from tailrace.plans.tables import Tables

# The severity model and the edit distance have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, by a model of the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in toxicity.ADDED}
    marked = toxicity.score(docs.withColumnsRenamed(own), model)
    kept = marked.where("not toxic").drop(*toxicity.ADDED)
    return kept.withColumnsRenamed({new: old for old, new in own.items()})


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one: the smallest doc_id, a null one last, then the smallest hash of its text."""
    tables = Tables(spark)
    rows = tables.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard.near_copies(rows.select(F.col("__row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row")
    first = rows.select("__row", order.alias("order")).join(found, "__row").groupBy("component_id")
    first = first.agg(F.min("order").alias("order")).select("order.__row")
    return rows.join(first, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    rows = Tables(spark).write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    taken = mixture.mix_rows(rows, "__row").where("taken > 0")
    times = taken.select("__row", F.expr("int(taken div size)").alias("__times"))
    copies = rows.join(times, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times")))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return hilbert.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("mixture", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
