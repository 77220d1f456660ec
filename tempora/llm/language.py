"""Language identification with error-correcting output codes over byte n-grams.

Each language has a codeword. Up to five languages the bits are all ways to part them in two, and beyond that the columns
of a Hadamard matrix, so any two codewords differ in about half of the bits: from four languages on in four bits at
least, which corrects one wrong bit, and in more with more languages. Two or three languages have too few partings for that.
For every bit one binary classifier, a multinomial naive Bayes on hashed byte trigrams inside words, tells languages
whose bit is 1 from those whose bit is 0. All training rows are counted (no sample): Spark sums one vector of feature
counts per language. Decoding adds up the logistic losses of the bits, each weighted by how well its classifier does on
the training rows, and takes the codeword with the least; a small lead over the next one is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features; with the number of languages this bounds every model table.
FEATURES = 1 << 15
#: Languages up to which all partings are bits.
EXHAUSTIVE = 5
#: Bytes of text that one step works on.
STEP_BYTES = 1 << 20
#: A score below this is flagged.
AMBIGUOUS = 0.75
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = True
_INSIDE[128:] = True


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1, any two of them far apart; no two columns part the languages alike."""
    if 2 <= n <= EXHAUSTIVE:
        # every parting once: the first language is always on the side of +1
        sides = np.arange(1, 1 << (n - 1))
        return np.array([np.ones(len(sides), int), *[1 - 2 * (sides >> i & 1) for i in range(n - 1)]])
    size = 2
    while size < n:
        size *= 2
    i, j = np.indices((size, size))
    ones = np.vectorize(lambda x: bin(x).count("1") & 1)(i & j)
    return (1 - 2 * ones)[:n, 1:]


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each byte trigram whose middle is inside a word; everything else counts as a word's edge."""
    low = _LOWER[raw]
    low = np.where(_INSIDE[low], low, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    first, last = starts[:-1][np.diff(starts) > 0], starts[1:][np.diff(starts) > 0] - 1
    before[first], after[last] = 32, 32
    keep = np.flatnonzero(low != 32)
    code = (before[keep] << 16) | (low[keep] << 8) | after[keep]
    code = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % FEATURES
    return code, row[keep]


def _steps(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi-1, their bytes and where each starts; a step has STEP_BYTES or one row."""
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    lengths = pa.compute.binary_length(texts).to_numpy()
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
        raw = "".join(texts.slice(lo, hi - lo).to_pylist()).encode()
        yield lo, hi, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lengths[lo:hi])]).astype(np.int64)
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row per language and feature that it saw."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, hi, raw, starts in _steps(batch, 1):
            code, row = features(raw, starts)
            for lang in set(langs[lo:hi]):
                mine = (langs[lo:hi] == lang)[row]
                have = sums.setdefault(lang, np.zeros(FEATURES, np.int64))
                have += np.bincount(code[mine], minlength=FEATURES)
    for lang, counts in sums.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())],
            ["lang", "feature", "n"],
        )


class Model:
    """Weights of the bits' classifiers, the languages' codewords and the bits' weights in decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray, bit_weights: np.ndarray | None = None):
        self.langs, self.words = langs, codewords(len(langs))
        smooth = counts + 0.5
        logs = []
        for bit in range(self.words.shape[1]):
            one = self.words[:, bit] > 0
            sides = [smooth[side].sum(0) if side.any() else np.ones(FEATURES) for side in (one, ~one)]
            logs.append(np.log(sides[0] / sides[0].sum()) - np.log(sides[1] / sides[1].sum()))
        self.weights = np.array(logs).T.astype(np.float32).copy()
        self.bit_weights = np.ones(self.words.shape[1]) if bit_weights is None else bit_weights

    def margins(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's mean log odds of every bit, and its number of features."""
        code, row = features(raw, starts)
        n = np.bincount(row, minlength=len(starts) - 1)
        sums = [np.bincount(row, self.weights[code, bit], len(n)) for bit in range(self.weights.shape[1])]
        return np.array(sums).T.reshape(len(n), -1) / np.maximum(n, 1)[:, None], n

    def decode(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, and its share among all codewords (0 to 1)."""
        scaled = margins * np.sqrt(np.maximum(n, 1))[:, None]
        loss = np.logaddexp(0, -scaled[:, None, :] * self.words[None]) @ self.bit_weights
        loss -= loss.min(1, keepdims=True)
        share = np.exp(-loss)
        return loss.argmin(1), share.max(1) / share.sum(1)


def _right_bits(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    at = {lang: i for i, lang in enumerate(model.langs)}
    right, total = np.zeros(model.words.shape[1], np.int64), 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, raw, starts in _steps(batch, 1):
            margins, n = model.margins(raw, starts)
            truth = model.words[[at[x] for x in langs[lo:hi]]]
            right += ((margins * truth > 0) & (n > 0)[:, None]).sum(0)
            total += int((n > 0).sum())
    bits = len(right)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(bits), pa.int32()), pa.array(right, pa.int64()), pa.array([total] * bits, pa.int64())],
        ["bit", "n_right", "total"],
    )


def fit(labelled: DataFrame) -> Model:
    """Fit on every row of ``labelled(lang, text)``; rows without text or lang teach nothing.

    What reaches the driver is one row per language and feature, whatever the number of rows.
    """
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(set(got["lang"]))
    table = np.zeros((len(langs), FEATURES))
    if langs:
        table[got["lang"].map({x: i for i, x in enumerate(langs)}), got["feature"]] = got["n"]
    model = Model(langs, table)
    if len(langs) < 2:
        return model
    found = rows.mapInArrow(lambda b: _right_bits(b, model), "bit int, n_right long, total long")
    found = found.groupBy("bit").agg(F.sum("n_right").alias("n_right"), F.sum("total").alias("total"))
    quality = np.zeros(model.words.shape[1])
    for r in found.collect():
        quality[r["bit"]] = max(0.0, 2 * r["n_right"] / max(r["total"], 1) - 1)
    if quality.sum():
        model.bit_weights = quality * len(quality) / quality.sum()
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs: list[str] = []
        scores: list[float] = []
        for lo, hi, raw, starts in _steps(batch, batch.num_columns - 2):
            letters = batch.column(batch.num_columns - 1).slice(lo, hi - lo).to_pylist()
            margins, n = model.margins(raw, starts)
            best, share = model.decode(margins, n) if model.langs else (np.zeros(hi - lo, int), np.zeros(hi - lo))
            for has, i, s in zip(letters, best, share, strict=True):
                known = bool(has) and bool(model.langs)
                langs.append(model.langs[i] if known else UNKNOWN)
                scores.append(float(s) if known else 0.0)
        columns = [batch.column(i) for i in range(batch.num_columns - 2)]
        names = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
        )


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    Null text or a text without letters is ``und`` with score 0; so is every text if the model knows no language.
    Equal shares (a tie) go to the language that sorts first. A text of letters that no feature covers is a tie.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    out = rows.mapInArrow(lambda b: _predict(b, model), f"{schema}, lang_pred string, score double")
    return out.withColumn("ambiguous", (F.col("score") < AMBIGUOUS) | (F.col("lang_pred") == UNKNOWN))


def training_part(docs: DataFrame) -> DataFrame:
    """Rows that may teach: a language is given and crc32 of the id's digits leaves no remainder of 1 by 3."""
    return docs.filter(F.col("lang").isNotNull() & ~held_out())


def held_out():
    """Null ids are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
