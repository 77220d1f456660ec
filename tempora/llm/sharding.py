"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. A row sits where its key hashes to, and its arc (the stretch up to
the next point clockwise) belongs to the shard of that point. Loads are bounded by exact quotas, floor(n / shards) or
one more. Rows that a full shard cannot take continue clockwise to the next point of a shard with room. The decision is
made per arc: an arc's rows, in ring order, fill the home shard first and then the shards that follow, so only the rows
of overflowing arcs move. What is gathered for the decision are counts per arc and salt, whose number the parameters
fix; rows never leave the executors. A hot key (one id with a third of all rows) is one ring position, and is spread
over the salts for ranking, so no task ranks all of it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import stage

VNODES = 64
SALTS = 16


def _point(name: str) -> int:
    """A place on the ring, as a signed 64-bit number like xxhash64."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) in ring order; a shard keeps its points whatever the number of shards."""
    return sorted((_point(f"shard-{s}/{v}"), s) for s in range(shards) for v in range(vnodes))


def plan(counts: dict[tuple[int, int], int], points: list[tuple[int, int]], quotas: list[int], salts: int) -> list[tuple]:
    """(arc, salt, lo, hi, shard, slot) pieces: rows lo..hi-1 of that arc and salt go to the shard, from that slot on.

    Pass one gives each arc, in ring order, what its home shard still takes. Pass two walks the rest clockwise.
    """
    room, used, pieces, rest = list(quotas), [0] * len(quotas), [], []

    def take(arc: int, salt: int, lo: int, hi: int, shard: int) -> int:
        n = min(room[shard], hi - lo)
        if n:
            pieces.append((arc, salt, lo, lo + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return lo + n

    for arc, (_, shard) in enumerate(points):
        for salt in range(salts):
            n = counts.get((arc, salt), 0)
            lo = take(arc, salt, 0, n, shard)
            if lo < n:
                rest.append((arc, salt, lo, n))
    for arc, salt, lo, n in rest:
        step = arc
        while lo < n:
            step = (step + 1) % len(points)
            lo = take(arc, salt, lo, n, points[step][1])
    return pieces


def shard(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text plus 1. Null text: no bytes, crc 0. Null id: one ring position of its own.
    Repeated rows are separate rows. Ties on the ring are broken by id, crc and size; rows equal in all of them are
    interchangeable. An empty table gives no rows. Shard sizes differ by one row at most; slots are 0, 1, 2, ...
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("_at"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("_salt"),
    )
    # the number of points before a position names its arc; the points are a bounded array of constants
    marks = F.array(*[F.lit(p) for p, _ in points])
    before = F.size(F.filter(marks, lambda p: p < F.col("_at")))
    keyed = stage(keyed.withColumn("_arc", F.pmod(before, F.lit(len(points)))), "ring_rows")
    counts = {(r["_arc"], r["_salt"]): r["count"] for r in keyed.groupBy("_arc", "_salt").count().collect()}
    n = sum(counts.values())
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    pieces = spark.createDataFrame(
        plan(counts, points, quotas, salts), "_arc int, _salt int, _lo long, _hi long, shard int, _slot long"
    )
    order = Window.partitionBy("_arc", "_salt").orderBy("_at", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    # at most vnodes * shards * (salts + shards) pieces, whatever the rows
    placed = ranked.join(
        F.broadcast(pieces), ["_arc", "_salt"]
    ).filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot")
    )


def home(at: int, points: list[tuple[int, int]]) -> int:
    """The shard that owns a ring position when nothing is full; for tests."""
    return points[bisect_left(points, (at, -1)) % len(points)][1]
