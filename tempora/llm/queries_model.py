"""op9 quality and op10 language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import language, quality
from tempora.llm.common import read


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(language.training_part(docs))
    rows = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.predict(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    scored = quality.classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id", "lang")
    return scored.select("row.doc_id", "row.lang", "perplexity", "worst_perplexity", "keep")


PLANS = {f.__name__: f for f in (op9_quality, op10_language)}
CHECKS: dict[str, str] = {}
