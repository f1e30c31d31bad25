"""One query per operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.llm import (
    chunks,
    decontamination,
    hilbert,
    jaccard,
    merkle,
    metric,
    mixture,
    packing,
    rendering,
    revisits,
    substrings,
    toxicity,
    turns,
)
from tailrace.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_copies(read(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontamination.matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its expected severity."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, read(spark, folder, "labels"))
    return toxicity.score(documents, model).drop("text")


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard_documents(read(spark, folder, "documents"))


def op5_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric.near_duplicates(read(spark, folder, "embeddings"))


def op6_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of every page."""
    return rendering.render_pages(read(spark, folder, "pages")).drop("url")


def op7_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit of a crawl of all pages, with the response it stands for; headers as one text."""
    found = revisits.resolve(revisits.crawl(read(spark, folder, "pages")))
    fields = F.array_sort(F.map_entries("headers"))
    named = F.transform(fields, lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return found.withColumn("headers", F.array_join(named, "; "))


def op8_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines and what of it repeats an earlier chunk of lines."""
    rows = chunks.remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_bytes", F.sha2("text", 256).alias("kept_sha256")
    )


def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_documents(read(spark, folder, "documents"))


def op10_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without strings of 400 bytes that occur twice, and how many words of it lie in
    passages of 50 words that stand in another document too."""
    rows = substrings.cut_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", digest, "n_shared_words")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and root, and the root that its leaf gives after some documents have changed."""
    one_more = {"n_chars": F.col("n_chars") + 1}
    rows = merkle.manifest(read(spark, folder, "documents"), one_more, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    folded = merkle.fold(F.col("found_leaf"), F.col("proof"))
    digests = rows.withColumns({"proof_sha256": merkle.proof_digest(F.col("proof")), "folded_root": folded})
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return digests.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of a document and its place in a sequence."""
    import public_tokenizers

    rows = packing.pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.crc32("ids").alias("ids_crc32")
    return rows.select("doc_id", "start", "length", ids, "doc_tokens", "sequence_id", "offset")


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows, dropped = turns.damaged(read(spark, folder, "conversations"))
    return turns.repaired(rows, dropped)


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_decontamination,
        op3_toxicity,
        op4_hilbert_shards,
        op5_metric_join,
        op6_rendering,
        op7_revisits,
        op8_line_chunks,
        op9_mixture,
        op10_suffix_arrays,
        op11_merkle_manifest,
        op12_packing,
        op13_turn_repair,
    )
}
