"""Importance resampling towards a target: which documents look as if they came from the target's distribution.

Texts are read as UTF-8 bytes. A table of 256 bytes lower-cases A-Z and blanks every separator, ``bytes.split`` yields the
words, and the crc32 of a run of words is the seed of the crc32 of the run that is one word longer, so no run is ever
joined. Counters reduce the checksums of a batch before they are folded into buckets; Spark adds up the buckets of all
tasks. A bucket's gain is the log of its share in the target over its share in the documents, a document's weight is the
floored mean of its features' gains, and Gumbel noise from the id turns a draw without replacement into a top list.

Only bucket tables come to the driver (``buckets`` rows each, whatever the input), a histogram of scores in steps of
SCORE_STEP (gains are logs of 64-bit counts and the noise has 32 bits, so under 2,000 steps), and one count a range.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import fingerprint, when_small
from tempora.session import stage

BUCKETS = 10_000
LONGEST = 2
#: Bytes of a text that are split at once.
STEP_BYTES = 1 << 20
#: Checksums that a counter holds before it is folded into buckets.
FOLD = 1 << 18
SCORE_STEP = 64

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(raw: bytes, step: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """All words in order, a list for each ``step`` bytes; a word is never cut."""
    left = b""
    for at in range(0, len(raw), step):
        text = left + raw[at : at + step].translate(_WORD_BYTES)
        cut = len(text) if at + step >= len(raw) else text.rfind(b" ") + 1
        left = text[cut:]
        yield text[:cut].split()


def grams(raw: bytes, longest: int = LONGEST, step: int = STEP_BYTES) -> Iterator[list[list[int]]]:
    """For each list of words, the crc32 of all runs of 1, 2, .. ``longest`` words that end in it."""
    before: list[bytes] = []
    for new in words(raw, step):
        run = before + new
        spaced = [b" " + w for w in run]
        sums, found = list(map(crc32, run)), []
        for k in range(1, longest + 1):
            if k > 1:
                sums = list(map(crc32, spaced[k - 1 :], sums))
            found.append(sums[max(0, len(before) - k + 1) :])
        yield found
        before = run[max(0, len(run) - longest + 1) :] if longest > 1 else []


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Per task one row per bucket that it saw."""
    table, counts = np.zeros(buckets, np.int64), Counter()

    def fold() -> None:
        keys = np.fromiter(counts.keys(), np.int64, len(counts))
        np.add.at(table, keys % buckets, np.fromiter(counts.values(), np.int64, len(counts)))
        counts.clear()

    for batch in batches:
        for raw in _bytes(batch.column(0)):
            for sums in grams(raw, longest):
                for level in sums:
                    counts.update(level)
                if len(counts) > FOLD:
                    fold()
    fold()
    seen = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(table[seen], pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; null texts have none."""
    seen = texts.select(text).mapInArrow(lambda b: _count(b, buckets, longest), "bucket int, n long")
    table = np.zeros(buckets, np.int64)
    for r in seen.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        table[r["bucket"]] = r["n"]
    return table


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of every bucket."""
    n, of_source, of_target = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (of_source + n) / ((s + 1) * (of_target + n))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_features, weights = [], [], []
        for raw in _bytes(batch.column(1)):
            n = total = of_words = 0
            for sums in grams(raw, longest):
                of_words += len(sums[0])
                size = sum(map(len, sums))
                at = np.fromiter(chain.from_iterable(sums), np.int64, size)
                total += int(gain[at % len(gain)].sum())
                n += size
            n_words.append(of_words)
            n_features.append(n)
            weights.append(total // n if n else 0)
        numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], *numbers], [batch.schema.names[0], *batch.schema.names[2:], "n_words", "n_features", "weight"]
        )


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id alone; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> DataFrame:
    """Every document as ``row`` (the ``keep`` columns) with n_words, n_features, weight, score and rank.

    Of the N documents with ``min_words`` words or more, floor(percent * N / 100) with the highest scores are drawn and
    ranked 1, 2, 3...; the others' rank is null. Ties go to the smaller id, null ids last, then by text; rows that repeat
    an id and a text are drawn one by one. Null and empty texts have no feature and weight 0. An empty target has
    share 1 / ``buckets`` everywhere. Columns beside ``doc_id`` and ``text`` matter only if kept, whatever their names.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("_text"), F.col(doc_id).alias("_id"), fingerprint(F.col(text)).alias("_print"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"row {kinds['row']}, _id {kinds['_id']}, _print bigint, n_words long, n_features long, weight long"
    weighed = rows.mapInArrow(lambda b: _weigh(b, gain, longest), schema)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).withColumn("_uid", F.monotonically_increasing_id())
    return _ranked(stage(scored, "scored"), percent, min_words).select("row", "n_words", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Only rows from the step of the last drawn score upwards are sorted, by ranges; a rank is a range's offset plus a place in it."""
    step, able = F.floor(F.col("score") / SCORE_STEP), F.col("n_words") >= min_words
    steps = sorted(((r["step"], r["n"]) for r in scored.filter(able).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    sums = np.cumsum([n for _, n in steps], dtype=np.int64)
    wanted = percent * int(sums[-1]) // 100 if steps else 0
    no_rank = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", no_rank)
    last = steps[bisect_left(sums, wanted)][0]
    near = able & (step >= last)
    spark = scored.sparkSession
    keys = [F.desc("score"), F.asc_nulls_last("_id"), F.asc("_print"), F.asc("_uid")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.filter(near).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage(placed.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, before = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + place + 1
    ranked = placed.withColumn("_part", part).join(when_small(offsets, 16), "_part")
    ranked = ranked.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~near).select("*", no_rank))
