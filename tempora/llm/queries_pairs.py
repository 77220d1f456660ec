"""op4 Jaccard join and op8 vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import jaccard, vectors
from tempora.llm.common import read


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


PLANS = {f.__name__: f for f in (op4_jaccard, op8_vectors)}
CHECKS: dict[str, str] = {}
