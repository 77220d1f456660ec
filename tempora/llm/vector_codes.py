"""Product codes of vectors: integer k-means on every part of a vector, with adaptive distance bounds.

Every row keeps, for each part, its b + 1 closest entries, an upper bound of the distance to the first, an ordered lower
bound for each of the other b, and one outer bound for all entries that are not listed. When entries move, the bounds move
with them; a lower bound at a place is the least of itself and all behind it. A part whose upper bound is below the first of them
keeps its entry unread. Otherwise the upper bound is made exact, and only the entries before the first place whose bound
is above it are compared, in integers, ties to the lower index; where no place is, all entries are. After each round b
shrinks to what nearly all rows of that part needed.

Rows and bounds are written after every round to the shared folder and the round before is dropped. The codebooks
(entries times the vector's length) travel with the tasks; a round returns one sum for each of their numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import when_small
from tempora.session import discard, scratch_path, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integers are held between -LIMIT and LIMIT - 1 (components up to 8,192), so that sums of squares are exact.
LIMIT = 1 << 25
#: Share of the rows whose comparisons b must cover.
COVERED = 0.99


def to_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(LIMIT - 1.0), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))


def usable(vector: Column) -> Column:
    """A vector without null and non-finite components."""
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, number), F.lit(False))


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; they differ by one if the length is no multiple."""
    return [i * length // parts for i in range(parts + 1)]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


@dataclass
class Bounds:
    """Of one part of many rows: entries by closeness, the first one's upper bound, the others' lower bounds, the outer bound."""

    near: np.ndarray
    up: np.ndarray
    low: np.ndarray
    out: np.ndarray

    @staticmethod
    def blank(n: int, b: int) -> Bounds:
        """Nothing is known: every row compares all entries."""
        return Bounds(np.zeros((n, b + 1), np.uint8), np.full(n, np.inf, np.float32), np.full((n, b), -np.inf, np.float32), np.full(n, -np.inf, np.float32))

    def shrunk(self, b: int) -> Bounds:
        """With b lower bounds; the outer bound takes in those that go."""
        out = np.minimum(self.out, self.low[:, b:].min(1)) if self.low.shape[1] > b else self.out
        return Bounds(self.near[:, : b + 1].copy(), self.up, self.low[:, :b].copy(), out)

    def moved(self, move: np.ndarray) -> Bounds:
        low = _down(self.low - move[self.near[:, 1:]].astype(np.float64))
        return Bounds(self.near, _up(self.up + move[self.near[:, 0]].astype(np.float64)), low, _down(self.out - float(move.max(initial=0))))


def squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own list of entries, in integers."""
    return np.square(rows[:, None, :] - entries).sum(2)


def assign(rows: np.ndarray, book: np.ndarray, old: Bounds) -> tuple[Bounds, np.ndarray]:
    """The bounds with every row's nearest entry in front, and how many places each row compared."""
    b = old.low.shape[1]
    new = Bounds(old.near.copy(), old.up.copy(), old.low.copy(), old.out.copy())
    behind = np.minimum.accumulate(np.concatenate([old.low, old.out[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    used = np.zeros(len(rows), np.uint8)
    open_ = np.flatnonzero(~(old.up < behind[:, 0]))
    known = open_[np.isfinite(old.up[open_])]
    new.up[known] = _up(np.sqrt(squares(rows[known], book[old.near[known, :1]])[:, 0]))
    above = new.up[open_, None] < behind[open_]
    used[open_] = np.where(above.any(1), above.argmax(1), b + 1)
    for place in range(1, b + 1):
        at = np.flatnonzero(used == place)
        if len(at):
            listed = old.near[at, : place + 1]
            found = squares(rows[at], book[listed])
            order = np.lexsort((listed, found), axis=-1)
            found = np.sqrt(np.take_along_axis(found, order, 1))
            new.near[at, : place + 1] = np.take_along_axis(listed, order, 1)
            new.up[at], new.low[at, :place] = _up(found[:, 0]), _down(found[:, 1:])
    at = np.flatnonzero(used == b + 1)
    if len(at):
        found = squares(rows[at], book[None])
        order = np.argsort(found, axis=1, kind="stable")
        found = np.sqrt(np.take_along_axis(found, order, 1))
        new.near[at], new.up[at], new.low[at] = order[:, : b + 1], _up(found[:, 0]), _down(found[:, 1 : b + 1])
        new.out[at] = _down(found[:, b + 1]) if b + 1 < len(book) else np.float32(np.inf)
    return new, used


def _pack(bounds: list[Bounds], used: list[np.ndarray]) -> pa.Array:
    """One value of fixed width a row: per part the entries, how many places were compared, and the bounds."""
    columns = []
    for have, places in zip(bounds, used, strict=True):
        numbers = np.concatenate([have.up[:, None], have.low, have.out[:, None]], 1).astype("<f4")
        columns += [have.near, places[:, None], np.ascontiguousarray(numbers).view(np.uint8)]
    table = np.ascontiguousarray(np.concatenate(columns, 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(table.shape[1]), len(table), [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array, sizes: list[int]) -> tuple[list[Bounds], list[np.ndarray]]:
    table = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    bounds, used, at = [], [], 0
    for b in sizes:
        near, places = table[:, at : at + b + 1], table[:, at + b + 1]
        at += b + 2
        numbers = np.ascontiguousarray(table[:, at : at + 4 * (b + 2)]).view("<f4")
        at += 4 * (b + 2)
        bounds.append(Bounds(near, numbers[:, 0], numbers[:, 1:-1], numbers[:, -1]))
        used.append(places)
    return bounds, used


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length).astype(np.int64)


def _bounds(batch: pa.RecordBatch, rows: np.ndarray, books: list[np.ndarray], moves: list[np.ndarray] | None, had: list[int], sizes: list[int]):
    """New bounds and compared places of a batch's rows, part by part."""
    ends = np.cumsum([0, *(book.shape[1] for book in books)])
    old = _unpack(batch.column("state"), had)[0] if moves is not None else None
    done = []
    for p, book in enumerate(books):
        before = old[p].shrunk(sizes[p]).moved(moves[p]) if old else Bounds.blank(len(rows), sizes[p])
        done.append(assign(rows[:, ends[p] : ends[p + 1]], book, before))
    return [x for x, _ in done], [x for _, x in done]


def _round(batches: Iterator[pa.RecordBatch], *with_: object) -> Iterator[pa.RecordBatch]:
    books = with_[0]
    length = sum(book.shape[1] for book in books)
    for batch in batches:
        if batch.num_rows:
            state = _pack(*_bounds(batch, _vectors(batch.column("vec"), length), *with_))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec"), state], ["row", "vec", "state"])


def _last(batches: Iterator[pa.RecordBatch], *with_: object) -> Iterator[pa.RecordBatch]:
    books = with_[0]
    ends = np.cumsum([0, *(book.shape[1] for book in books)])
    for batch in batches:
        if batch.num_rows:
            rows = _vectors(batch.column("vec"), ends[-1])
            bounds, _ = _bounds(batch, rows, *with_)
            codes = np.stack([x.near[:, 0] for x in bounds], 1)
            error = sum(np.square(rows[:, ends[p] : ends[p + 1]] - book[codes[:, p]]).sum(1) for p, book in enumerate(books))
            code = [x.tobytes().hex() for x in codes]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["row", "code", "error"])


def _sums(batches: Iterator[pa.RecordBatch], sizes: list[int], entries: int, length: int) -> Iterator[pa.RecordBatch]:
    """Per task: sums of each entry's parts, their counts, and how often each number of places was compared."""
    ends = cuts(length, len(sizes))
    totals = np.zeros((entries, length), np.int64)
    counts = np.zeros((len(sizes), entries), np.int64)
    places = np.zeros((len(sizes), entries + 1), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _vectors(batch.column("vec"), length)
        bounds, used = _unpack(batch.column("state"), sizes)
        for p, have in enumerate(bounds):
            np.add.at(totals[:, ends[p] : ends[p + 1]], have.near[:, 0], rows[:, ends[p] : ends[p + 1]])
            counts[p] += np.bincount(have.near[:, 0], minlength=entries)
            places[p] += np.bincount(used[p], minlength=entries + 1)
    flat = np.concatenate([totals.ravel(), counts.ravel(), places.ravel()])
    seen = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(flat[seen], pa.int64())], ["slot", "total"])


def _added(state: DataFrame, sizes: list[int], entries: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = state.select("vec", "state").mapInArrow(lambda b: _sums(b, sizes, entries, length), "slot int, total long")
    flat = np.zeros(entries * length + len(sizes) * (2 * entries + 1), np.int64)
    for r in found.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        flat[r["slot"]] = r["total"]
    totals, counts, places = np.split(flat, [entries * length, entries * length + len(sizes) * entries])
    return totals.reshape(entries, length), counts.reshape(len(sizes), entries), places.reshape(len(sizes), entries + 1)


def adapted(sizes: list[int], places: np.ndarray, entries: int) -> list[int]:
    """For each part the fewest bounds, an eighth of the entries at least, that cover nearly all rows' comparisons."""
    least, found = max(1, -(-entries // 8)), []
    for b, seen in zip(sizes, places, strict=True):
        share = np.cumsum(seen[: b + 1]) / max(seen.sum(), 1)
        needed = int((share >= COVERED).argmax()) if (share >= COVERED).any() else b
        found.append(min(b, max(least, needed)))
    return found


@dataclass
class Coded:
    """``rows`` (row, code, error), the final codebooks by part, and b of every part in each round."""

    rows: DataFrame
    books: list[np.ndarray]
    sizes: list[list[int]]

    def digest(self) -> str:
        """sha256 of all entries' integers in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(
    vectors: DataFrame, keep: list[str], vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Coded:
    """Codes of all usable vectors.

    Dropped are vectors that are null, hold null or non-finite components, or have another length than the vector of the
    smallest id (null ids come last, repeated ids by their vectors). The first codebooks are the parts of the ``entries`` smallest ids, fewer if
    there are fewer rows. Repeated rows are coded like any other; equal distances go to the lower index. Components beyond 8,192 count as that.
    Columns that are not kept don't matter; ``row`` holds the kept ones under their own names. An empty table gives no rows and empty codebooks.
    """
    good = vectors.filter(usable(F.col(vector)))
    rows = good.select(F.struct(*keep).alias("row"), F.col(vec_id).alias("_id"), to_integers(F.col(vector)).alias("vec"))
    rows = stage(rows, "vectors")
    order = [F.asc_nulls_last("_id"), F.asc("vec")]
    kind = rows.schema["row"].dataType.simpleString()
    length = next((len(r["vec"]) for r in rows.orderBy(*order).limit(1).collect()), 0)
    same = rows.filter(F.size("vec") == length)
    first = [r["vec"] for r in same.orderBy(*order).limit(entries).collect()]
    seeds = np.array(first, np.int64).reshape(len(first), length)
    ends = cuts(length, parts)
    books = [seeds[:, lo:hi].copy() for lo, hi in zip(ends, ends[1:])]
    known = len(seeds)
    had: list[int] = []
    sizes = [min(known - 1, max(1, known // 4))] * parts if known else [0] * parts
    spark, path, before = rows.sparkSession, None, None
    seen, moves, state = [], None, same.select("row", "vec")
    for _ in range(rounds if known else 0):
        step, schema = (books, moves, had, sizes), f"row {kind}, vec array<int>, state binary"
        before, path = path, scratch_path(spark, "bounds")
        state.mapInArrow(lambda b, w=step: _round(b, *w), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if before:
            discard(spark, before)
        totals, counts, places = _added(state, sizes, known, length)
        moves = []
        for p, book in enumerate(books):
            mean = np.where(counts[p][:, None] > 0, totals[:, ends[p] : ends[p + 1]] // np.maximum(counts[p], 1)[:, None], book)
            moves.append(_up(np.sqrt(np.square(mean - book).sum(1))))
            books = [*books[:p], mean, *books[p + 1 :]]
        seen.append(sizes)
        had, sizes = sizes, adapted(sizes, places, known)
    step = (books, moves, had, sizes)
    done = state.mapInArrow(lambda b: _last(b, *step), f"row {kind}, code string, error long") if known else state.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return Coded(stage(done, "codes"), books, seen)


def with_group_error(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """The error summed over equal values of ``group``, nulls together; a value with most rows is added up where it is read."""
    keyed = rows.withColumn("_none", group.isNull()).withColumn("_group", group)
    sums = stage(keyed.groupBy("_none", "_group").agg(F.sum("error").alias(name)), "group_errors")
    sums = sums.select(F.col("_none").alias("_n"), F.col("_group").alias("_g"), name)
    return keyed.join(when_small(sums, 32), (F.col("_none") == F.col("_n")) & F.col("_group").eqNullSafe(F.col("_g"))).select(*rows.columns, name)
