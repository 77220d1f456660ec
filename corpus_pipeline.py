"""From raw documents to packed training sequences; every stage reads what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontaminate, jaccard, lines, packing, quality
from tempora.llm.common import fingerprint, read, ready, when_small
from tempora.session import scratch_path, stage

RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _key(doc_id: Column) -> Column:
    """A document's id, with null as a value that joins."""
    return F.coalesce(doc_id, F.lit(-(2**63)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of the trusted ones does not reject, unchanged."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality.classify(docs, labels).filter("keep").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that stand elsewhere before; documents of which nothing is left go."""
    done = lines.dedup_lines(docs)
    done = done.filter((F.col("n_removed") == 0) | (F.trim(F.replace("new_text", F.lit("\n"), F.lit(""))) != ""))
    changed = {"text": F.col("new_text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("new_text")).otherwise(F.col("row.n_chars"))}
    return done.select(*[changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id, then text fingerprint; null ids come last. Rows that
    repeat an id and a text are one, and a text without words is alone.
    """
    linked = jaccard.link_keyed(docs.select("doc_id", "text"))
    linked = stage(linked.select(_key(F.col("doc_id")).alias("_key"), F.col("text_print").alias("_print"), F.col("doc_id").isNull().alias("no_id"), "comp"), "linked")
    each = linked.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("no_id", "_key", "_print")).alias("s"))
    alone = linked.filter("comp is null").select("_key", "_print")
    keys = stage(each.select("s._key", "s._print").union(alone).distinct(), "staying")
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("doc_id")).alias("_key"), fingerprint(F.col("text")).alias("_print"))
    rows = rows.join(when_small(keys, 24), ["_key", "_print"], "left_semi")
    again = linked.join(when_small(keys, 24), ["_key", "_print"], "left_semi")
    if keys.count() < again.count():
        rows = rows.dropDuplicates(["_key", "_print"])
    return rows.select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.hits(docs.select("doc_id", "text"), stage(decontaminate.windows(items), "windows"))
    dirty = found.select(_key(F.col("id")).alias("_key"), F.col("print").alias("_print")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("doc_id")).alias("_key"), fingerprint(F.col("text")).alias("_print"))
    return rows.join(when_small(stage(dirty, "contaminated"), 24), ["_key", "_print"], "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), RANKS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No SQL says what a tokenizer or a language model does; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = scratch_path(spark, name)
        step(ready(spark), docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
