"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Two sets with Jaccard >= 3/4 differ in at most H = (|r| + |s|) // 7 shingles. The universe is hashed into m segments, m
set by the size band; if more than H segments of one of the two sets are not empty, at least one of those holds the same
subset in both. Each set indexes the subsets of its segments under its own band, and under the lower band when a set of
3/4 its size falls there. A set with too few non-empty segments to promise a match spends more, in order of cost: first
the one-deletion neighbourhoods of its segments (a segment of two or more then covers a distance of one), and if that is
not enough its single shingles. m is the number of segments with the least expected cost.

Equal subsets make candidates, not links. Candidates pass a length bound and a parity bound (a sketch of shingle
parities differs in no more bits than the sets differ in shingles; large sets have a wide one) and are then verified on the words themselves. In a
group that shares a subset not all pairs are listed: sets are first held against the group's smallest member, then
against one that the subset's hash picks, and pairs are listed only between components that are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import ascii_lower, components, fingerprint, when_small
from tempora.session import stage

SHINGLE = 5
#: Longs of the parity sketch.
SKETCH = 16
#: Sets above this size have a wide sketch as well.
WIDE = 1000
#: Shingles per segment, for the largest sets of a band, that the allocation chooses from.
LOADS = (1.6, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8)
STEP_BYTES = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = np.zeros(256, bool)
_BREAKS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finishing steps of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and stop of each word of texts laid end to end; ``ends`` are the texts' ends."""
    low = _LOWER[raw].astype(np.uint64)
    inside = ~_BREAKS[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[:-1][ends[:-1] < len(raw)]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    row = np.searchsorted(ends, start, "right")
    size = np.add.reduceat(inside.astype(np.int64), start)
    owner = np.zeros(len(raw), np.int64)
    owner[start] = start
    at = np.arange(len(raw)) - np.maximum.accumulate(owner)
    value = _mix(low + (at.astype(np.uint64) << np.uint64(8))) * inside
    return _mix(np.add.reduceat(value, start) + size.astype(np.uint64)), row, start, start + size


def shingle_sets(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text its sorted distinct shingle hashes and a digest of its words."""
    hashes, row, start, stop = word_hashes(raw, ends)
    bounds = np.searchsorted(row, np.arange(len(ends) + 1)).tolist()
    windows = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        windows = windows * _STEP + hashes[j : j + len(windows)]
    windows = _mix(windows)
    # the words with one space between them, all texts in a row
    kept = ~_BREAKS[raw]
    low = np.where(kept, _LOWER[raw], 32).astype(np.uint8)
    kept[stop[stop < len(raw)]] = True
    line = memoryview(low[kept].tobytes())
    place = np.cumsum(kept)
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            yield np.zeros(0, np.uint64), b""
            continue
        if b - a < SHINGLE:
            own = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                own = _mix(own + hashes[j])
        else:
            own = np.unique(windows[a : b - SHINGLE + 1])
        yield own, hashlib.blake2b(line[place[start[a]] - 1 : place[stop[b - 1] - 1]], digest_size=16).digest()


def band(n: int) -> int:
    return n.bit_length()


@cache
def segments(b: int) -> int:
    """Number of segments of the band of sizes 2**(b-1) .. 2**b - 1: the one with the fewest expected signatures.

    A set of n shingles fills about k = m (1 - exp(-n/m)) segments, and pays n more when they are too few.
    """
    low, high = 2 ** (b - 1), 2**b - 1
    sizes = np.unique(np.linspace(low, 4 * high / 3, 64).astype(int))

    def cost(m: int) -> float:
        load = sizes / m
        filled = m * -np.expm1(-load)
        spread = np.sqrt(np.maximum(m * np.exp(-load) * (1 - (1 + load) * np.exp(-load)), 0.05))
        need = np.where(sizes <= high, sizes // 3, 2 * sizes // 7)
        short = [0.5 * (1 + erf(z / 2**0.5)) for z in (need + 0.5 - filled) / spread]
        return float(np.mean((filled + short * sizes) / sizes))

    return min((max(1, int(np.ceil(high / x))) for x in LOADS), key=cost)


def signatures(shingles: np.ndarray) -> list[np.ndarray]:
    """Hashes under which a set is indexed; see the module's text."""
    n = len(shingles)
    out = []
    own = band(n)
    for b in range(band(-(-3 * n // 4)), own + 1):
        m = segments(b)
        seed = np.uint64(b) << np.uint64(56)
        place = _mix(shingles ^ seed) % np.uint64(m)
        order = np.argsort(place, kind="stable")
        seg, members = place[order], _mix(shingles[order] + seed)
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums, sizes = np.add.reduceat(members, first), np.diff(np.append(first, n))
        exact = _mix(_mix(sums) + seg[first] + seed)
        out.append(exact)
        # partners are larger by a third at most in the own band, and not larger in a lower one
        need = n // 3 if b == own else 2 * n // 7
        if len(first) <= need:
            which = np.repeat(np.arange(len(first)), sizes)
            pairs = sizes[which] > 1
            out.append(_mix(_mix(sums[which] - members) + seg[first][which] + seed)[pairs])
            if len(first) + (sizes > 1).sum() <= need:
                out.append(_mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in each of 64 * SKETCH buckets, as longs."""
    bits = np.bincount((_mix(shingles + np.uint64(1)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes | None:
    """The same for a set that would fill the small sketch: as many buckets as the next power of two of its size."""
    if len(shingles) <= WIDE:
        return None
    size = 1 << len(shingles).bit_length()
    bits = np.bincount((_mix(shingles + np.uint64(2)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Differing parities of two wide sketches, the longer one folded to the length of the shorter."""
    short, long = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(short ^ folded).sum())


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, limit, x, y) the pairs whose wide sketches, if both have one, stay within the limit."""
    for batch in batches:
        limits, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
        mask = [p is None or q is None or 7 * _apart(p, q) <= limit for limit, p, q in zip(limits, x, y, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = batch.column(1).fill_null("").cast(pa.large_string())
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy()).astype(np.int64)
    lo, base = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
        raw = "".join(texts.slice(lo, hi - lo).to_pylist()).encode()
        yield lo, hi, np.frombuffer(raw, np.uint8), ends[lo:hi] - base
        lo, base = hi, ends[hi - 1]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, cls, check, n, s0..): one row per document; cls and check are halves of the digest, null without words."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, raw, ends in _steps(batch):
            cls, check, sizes, bits, wide = [], [], [], [], []
            for shingles, digest in shingle_sets(raw, ends):
                a, b = _halves(digest) if digest else (None, None)
                cls.append(a)
                check.append(b)
                sizes.append(len(shingles))
                bits.append(sketch(shingles))
                wide.append(wide_sketch(shingles))
            columns = [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(c, pa.int64()) for c in np.array(bits).T]
            columns.append(pa.array(wide, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "cls", "check", "n", *_SKETCH, "wide"])


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, cls) rows; a text that this task has met before is not indexed again."""
    met: set[bytes] = set()
    for batch in batches:
        for _, _, raw, ends in _steps(batch):
            sigs, owners = [], []
            for shingles, digest in shingle_sets(raw, ends):
                if digest and digest not in met:
                    met.add(digest)
                    own = np.concatenate(signatures(shingles))
                    sigs.append(own)
                    owners.append(np.full(len(own), _halves(digest)[0], np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "cls"]
                )


def _word_shingles(text: str) -> set[tuple[str, ...]]:
    words = text.split(" ")
    return {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))}


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b) the pairs whose sets of word shingles reach Jaccard 3/4, by whole numbers."""
    last, mine = None, set()
    for batch in batches:
        keep = []
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, mine = a, _word_shingles(x.as_py())
            other = _word_shingles(y.as_py())
            both = len(mine & other)
            keep.append(100 * both >= 75 * (len(mine) + len(other) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _near(x: str, y: str) -> Column:
    """Length and parity bounds of a pair; both are necessary for a link."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    return (4 * nx >= 3 * ny) & (4 * ny >= 3 * nx) & (7 * apart <= nx + ny)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``, on the words of their texts."""
    left = texts.select(F.col("cls").alias("a"), F.col("words").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("words").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_linked, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """As ``link_keyed``: doc_id, n_shingles, component_id, text_print."""
    return link_keyed(docs).drop("comp")


def link_keyed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, text_print, comp.

    comp is the component's own key, which null and repeated ids do not blur; rows without a set have none.
    Null, empty and blank texts have no set and are alone. Equal sets of words are one class and linked. Null ids are
    linked but never name a component unless all its ids are null. Rows that repeat get equal results. An empty table
    gives no rows. Links have no cap.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    described = slim.select("doc_id", "text", fingerprint(F.col("text")).alias("print"))
    kinds = ", ".join(f"{s} long" for s in _SKETCH)
    described = stage(described.mapInArrow(_describe, f"doc_id long, print long, cls long, check long, n long, {kinds}, wide binary"), "sets")
    agree = F.when(F.min("check") == F.max("check"), F.min("doc_id")).otherwise(
        F.raise_error(F.lit("two texts share half a digest; use wider class ids"))
    )
    classes = described.filter("cls is not null").groupBy("cls").agg(
        agree.alias("first_id"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in _SKETCH], F.max("wide").alias("wide")
    )
    classes = stage(classes, "classes")
    by_sig = Window.partitionBy("sig")
    index = slim.mapInArrow(_index, "sig long, cls long")
    shared = index.select("*", F.min("cls").over(by_sig).alias("low"), F.max("cls").over(by_sig).alias("high"))
    shared = stage(shared.filter("low <> high").select("sig", "cls", "low").distinct(), "shared")
    ids = stage(shared.select("cls").distinct(), "shared_classes")
    found = classes.join(ids, "cls", "left_semi")
    found = stage(found, "candidates")

    info = found.select("cls", "n", *_SKETCH)
    links = None
    labels = found.select(F.col("cls").alias("node"), F.col("cls").alias("comp"))
    for turn in ("smallest", "picked", "all"):
        marked = shared.join(labels, F.col("cls") == F.col("node")).select("sig", "cls", "low", "comp")
        if turn != "smallest":
            spread = marked.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
            marked = stage(marked.join(spread.select("sig"), "sig", "left_semi"), "apart")
            if marked.isEmpty():
                break
        if turn == "smallest":
            pairs = marked.filter("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b"))
        elif turn == "picked":
            pick = marked.groupBy("sig").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("sig", "cls")).alias("p"))
            pairs = marked.join(pick, "sig").filter("comp <> p.comp")
            pairs = pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"))
        else:
            full = stage(marked.join(info, "cls"), "apart_full")
            x, y = full.alias("x"), full.alias("y")
            apart = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & _near("x", "y")
            pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart)
            pairs = pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        pairs = pairs.distinct()
        if turn != "all":
            pairs = pairs.join(info.select(F.col("cls").alias("a"), F.struct("*").alias("x")), "a")
            pairs = pairs.join(info.select(F.col("cls").alias("b"), F.struct("*").alias("y")), "b").filter(_near("x", "y"))
            pairs = pairs.select("a", "b")
        wide = found.select("cls", "n", "wide")
        pairs = pairs.join(wide.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x")), "a")
        pairs = pairs.join(wide.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y")), "b")
        pairs = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("limit"), "x", "y")
        pairs = stage(pairs.mapInArrow(_screen, "a long, b long"), "pairs")
        new = stage(_verify(pairs, _words_of(pairs, found, slim)), "links")
        links = new if links is None else links.union(new)
        grouped = components(links)
        labels = found.select(F.col("cls").alias("node")).join(grouped, "node", "left")
        labels = stage(labels.select("node", F.coalesce("comp", "node").alias("comp")), "comps")
    # a component's name is its smallest document
    named = classes.select("cls", "first_id").join(labels, F.col("cls") == F.col("node"), "left")
    named = named.select("cls", "first_id", F.coalesce("comp", "cls").alias("comp"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = stage(named.join(names, "comp").select("cls", "comp", "component_id"), "names")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = described.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("print").alias("text_print"), "comp")


def _words_of(pairs: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, words) of the classes in ``pairs``, read from one document of each."""
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    owners = found.select("cls", F.col("first_id").alias("id")).join(asked, "cls", "left_semi")
    owners = when_small(stage(owners, "owners"), 32)
    words = F.array_join(F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), ""), " ")
    having = docs.join(owners, F.col("doc_id").eqNullSafe(F.col("id"))).select("cls", "text")
    # ids may repeat with other texts: the digest tells whose words these are
    having = having.mapInArrow(_own_words, "cls long, text string").select("cls", words.alias("words"))
    return stage(having.groupBy("cls").agg(F.min("words").alias("words")), "words")


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the digest of their class."""
    for batch in batches:
        classes = batch.column(0).to_pylist()
        for lo, hi, raw, ends in _steps(batch):
            own = [bool(d) and _halves(d)[0] == c for (_, d), c in zip(shingle_sets(raw, ends), classes[lo:hi], strict=True)]
            part = batch.slice(lo, hi - lo)
            yield part.filter(pa.array(own, pa.bool_()))
