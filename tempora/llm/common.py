"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import prepare, stage

#: A side is broadcast only when its counted rows times its row width stay below this many bytes.
BROADCAST_BYTES = 16 << 20
ARROW_ROWS = 1000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, since a row may hold a very long text."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fingerprint(text: Column) -> Column:
    """Tells the rows of one id apart when an id is repeated with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def when_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table, marked for broadcast only if its counted size is below BROADCAST_BYTES; else joins shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Every round hooks each root to its smallest neighbouring root and contracts the edges. Each edge loses at least one
    of its roots, so the roots of a component at least halve, whatever its shape. Tables are written after each round;
    hubs are reduced by aggregates with map-side combine and joins that Spark can split.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("comp")), "labels")
    live = edges
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        parents = stage(parents, "parents")
        for _ in range(2):
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parents = parents.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parents = stage(parents, "parents")
        hop = parents.select(F.col("a").alias("comp"), F.col("p").alias("next"))
        labels = stage(labels.join(hop, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
        ends = parents.select(F.col("a").alias("x"), F.col("p").alias("px"))
        live = (
            live.join(ends, F.col("a") == F.col("x"), "left").select(F.coalesce("px", "a").alias("a"), "b")
            .join(ends, F.col("b") == F.col("x"), "left").select("a", F.coalesce("px", "b").alias("b"))
            .filter("a <> b").distinct()
        )
        live = stage(live, "edges")
    return labels
