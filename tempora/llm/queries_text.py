"""op1 decontaminate, op2 lines, op3 packing, op5 sharding, op6 pages, op7 chat."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import chat, decontaminate, lines, packing, pages, sharding
from tempora.llm.common import read


RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("row.doc_id", "n_chunks", "n_removed", F.col("new_text").alias("text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), RANKS)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pages.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url")
    return done.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: What a user's turn asks of the assistant, as a tool.
REPLY = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}, "additionalProperties": False}


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.link(chat.exchanges(turns), {"reply": REPLY})


PLANS = {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_packing, op5_sharding, op6_pages, op7_chat)}
CHECKS: dict[str, str] = {}
