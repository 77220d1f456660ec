"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

A text's words are lower-cased, digits become 0, and each word is padded by a space on both sides; the model predicts a
word's characters from up to ORDER - 1 before them. Counts are gathered from every trusted text: n-grams are counted per
task and summed by key, and each order's table is joined by key with its contexts and with the
next lower order. The finished table stays on Spark.

Texts are scored in shards. Each different text is dealt to one of many blocks of about BLOCK bytes; a block lists the
different grams of its texts with all they may back off to, the lists are joined by key with the model, and what is found goes back to
the block, where the same shuffled texts are scored. So no task holds more of the model than its own texts ask for.

A document has two perplexities per character: of the whole text, and of the worst 2 % of its words, where slurs, keys
and markup stand out that a mean hides. Each is held against a quantile of the trusted documents of its language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import when_small
from tempora.session import stage

#: At most 4, so that a gram fits in 64 bits.
ORDER = 4
#: Share of a document's words that count as its worst.
WORST = 0.02
#: Quantiles of trusted documents above which a document is rejected.
MEAN_QUANTILE, WORST_QUANTILE = 0.995, 0.985
#: Bytes of different texts that are scored together, on average.
BLOCK = 16 << 20
#: Texts that a task remembers, and characters looked at once; they bound memory only.
TABLE = 300_000
CHUNK = 1_000_000
#: The language that stands for a missing or untrained one.
POOLED = ""

#: Bits of the number of places for recent grams, 4 MB a language.
SLOTS = 18

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = {ord(c): "0" for c in "123456789"} | {0: "\uffff"}
_LONG = re.compile("[\U00010000-\U0010ffff]")
_SPACE = re.compile(r"\s")
#: A text with one model is known by two hashes with different seeds.
_KEY = ["model", "_a", "_b"]


def normal(text: str) -> str:
    """Lower case, digits as 0; characters beyond 16 bits and NUL become one character of their own."""
    text = text.lower().translate(_DIGITS)
    return text if text.isascii() else _LONG.sub("\uffff", text)


def gram_numbers(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the grams that end in each character of words in normal form and in their closing spaces, and where
    those spaces are. A number holds a gram's characters in 16 bits each, the last one lowest.
    """
    line = np.frombuffer(f" {' '.join(words)} ".encode("utf-16-le"), np.uint16).astype(np.uint64)
    space = line == 32
    numbers, inside = line[1:].copy(), np.ones(len(line) - 1, bool)
    for back in range(1, order):
        # a context ends at the space before the word
        numbers[back - 1 :] |= np.where(inside[back - 1 :], line[: len(line) - back], 0) << np.uint64(16 * back)
        inside[back - 1 :] &= ~space[: len(line) - back]
    return numbers, space[1:]


def sizes(numbers: np.ndarray) -> np.ndarray:
    """Characters of each gram; the empty gram is 0."""
    return sum((numbers >> np.uint64(16 * i) != 0).astype(np.int64) for i in range(4))


def shorter(numbers: np.ndarray) -> np.ndarray:
    """The grams without their first characters."""
    keep = np.uint64(16) * np.maximum(sizes(numbers) - 1, 0).astype(np.uint64)
    return numbers & ((np.uint64(1) << keep) - np.uint64(1))


def needed(numbers: np.ndarray) -> np.ndarray:
    """The grams, their contexts, and what both may back off to."""
    found, now = [np.zeros(1, np.uint64)], np.unique(numbers)
    while len(now) and now[-1]:
        found += [now, now >> np.uint64(16)]
        now = np.unique(shorter(now))
    return np.unique(np.concatenate(found))


class Recent:
    """A value for each gram met lately: a fixed number of places, found by a hash, the last of those that share one stays."""

    def __init__(self):
        self.numbers, self.values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers * _SPREAD) >> np.uint64(64 - SLOTS)

    def unmet(self, numbers: np.ndarray) -> np.ndarray:
        """Different grams that are not in their places, which they take; only the last of a place can be met again."""
        new = np.unique(numbers[self.numbers[self.places(numbers)] != numbers])
        self.numbers[self.places(new)] = new
        return new

    def get(self, numbers: np.ndarray, work_out) -> np.ndarray:
        place = self.places(numbers)
        out = self.values[place]
        other = np.flatnonzero(self.numbers[place] != numbers)
        if len(other):
            new, where = np.unique(numbers[other], return_inverse=True)
            values = work_out(new)
            out[other] = values[where]
            place, last = np.unique(self.places(new)[::-1], return_index=True)
            self.numbers[place], self.values[place] = new[::-1][last], values[::-1][last]
        return out


def pieces(texts: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words in normal form and each one's text, about CHUNK characters at a time; a word is never cut."""
    words: list[str] = []
    owner: list[tuple[int, int]] = []
    size = 0

    def full() -> tuple[list[str], np.ndarray]:
        return words, np.repeat([i for i, _ in owner], [n for _, n in owner])

    for i, text in enumerate(texts):
        line, at = normal(text), 0
        while at < len(line):
            end = at + CHUNK
            if end < len(line):
                space = _SPACE.search(line, end)
                end = space.start() if space else len(line)
            own = line[at:end].split()
            size += min(end, len(line)) - at
            at = end
            if own:
                words += own
                owner.append((i, len(own)))
            if size > CHUNK and words:
                yield full()
                words, owner, size = [], [], 0
    if words:
        yield full()


def _count_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for words, _ in pieces(x.as_py() for x in texts):
                numbers, counts = np.unique(gram_numbers(words, order)[0], return_counts=True)
                columns = [pa.array([lang] * len(numbers), pa.string()), pa.array(numbers.view(np.int64)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def gram_counts(trusted: DataFrame, order: int) -> DataFrame:
    """Counts of each language, and those of all text together as the pooled model's."""
    rows = trusted.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text").filter("text is not null")
    grams = rows.mapInArrow(lambda b: _count_grams(b, order), "lang string, gram long, n long")
    own = stage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "own_grams")
    pooled = own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "gram", "n")
    return own.filter(F.col("lang") != POOLED).union(pooled)


def _cut_first(gram: Column, size: int) -> Column:
    """A gram of ``size`` characters without its first one."""
    return gram.bitwiseAND(F.lit((1 << 16 * (size - 1)) - 1))


def probabilities(raw: DataFrame, order: int) -> DataFrame:
    """(lang, gram, p, back): interpolated probability of the last character; back is the weight that the gram, as a
    context, gives to the next lower order. Grams from a word's start have plain counts, others count what precedes them.
    """
    size = sum(F.when(F.shiftrightunsigned("gram", 16 * i) != 0, 1).otherwise(0) for i in range(4))
    raw = raw.withColumn("size", size)
    tables = {order: raw.filter(F.col("size") == order).select("lang", "gram", "n")}
    for k in range(order - 1, 0, -1):
        before = tables[k + 1].select("lang", _cut_first(F.col("gram"), k + 1).alias("gram"))
        continued = before.groupBy("lang", "gram").agg(F.count("*").alias("n"))
        tables[k] = stage(continued.union(raw.filter(F.col("size") == k).select("lang", "gram", "n")), "grams")
    lower, every, backs = None, None, None
    for k in range(1, order + 1):
        table = tables[k]
        few = table.groupBy("lang").agg(
            F.count("*").alias("kinds"), *[F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        )
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cuts = [F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.01)).alias(f"d{i}") for i in (1, 2, 3)]
        few = when_small(stage(few.select("lang", "kinds", *cuts), "discounts"), 64)
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = F.least(cut, F.col("n") * 0.99)
        rows = table.join(few, "lang").select("lang", "gram", "n", cut.alias("cut"), F.shiftrightunsigned("gram", 16).alias("context"))
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        sums = stage(sums.select("lang", "context", "total", (F.col("freed") / F.col("total")).alias("back")), "contexts")
        rows = rows.join(when_small(sums, 48), ["lang", "context"])
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            kinds = few.select("lang", "kinds")
            made = rows.join(kinds, "lang").withColumn("p", own + F.col("back") / (F.col("kinds") + 1))
            made = made.select("lang", "gram", "p")
            unknown = sums.join(kinds, "lang").select("lang", F.lit(0).cast("long").alias("gram"), (1 / (F.col("kinds") + 1)).alias("p"))
            made = made.union(unknown)
        else:
            short = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("below"))
            rows = rows.withColumn("short", _cut_first(F.col("gram"), k))
            made = rows.join(when_small(short, 48), ["lang", "short"]).select("lang", "gram", (own + F.col("back") * F.col("below")).alias("p"))
        lower = stage(made, "probabilities")
        every = lower if every is None else every.union(lower)
        contexts = sums.select("lang", F.col("context").alias("gram"), "back")
        backs = contexts if backs is None else backs.union(contexts)
    none = F.lit(None).cast("double")
    both = every.withColumn("back", none).union(backs.select("lang", "gram", none.alias("p"), "back"))
    return both.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("back").alias("back"))


class Classifier:
    """``table(lang, gram, p, back)`` stays on Spark; the languages and their limits are few."""

    def __init__(self, table: DataFrame, order: int):
        self.table, self.order, self.limits = table, order, {}
        self.languages = sorted(r["lang"] for r in table.select("lang").distinct().collect())

    def limit(self, lang: str) -> tuple[float, float]:
        """A language without trusted documents of its own takes the most lenient limits."""
        if lang in self.limits:
            return self.limits[lang]
        return tuple(max(x) for x in zip(*self.limits.values(), strict=True)) if self.limits else (math.inf, math.inf)

    def used(self) -> Column:
        """The model of a row's ``lang``."""
        return F.when(F.col("lang").isin(self.languages), F.col("lang")).otherwise(F.lit(POOLED)) if self.languages else F.lit(POOLED)

    def key(self) -> list[Column]:
        """What a text's scores are known by."""
        return [self.used().alias("model"), F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the texts (model, _a, _b, text) that this task has met lately: a text that is copied without end does not swamp its block."""
    met: set[tuple] = set()
    for batch in batches:
        new = []
        for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            new.append(key not in met)
            met.add(key)
        if len(met) > TABLE:
            met.clear()
        yield batch.filter(pa.array(new, pa.bool_()))


def _by_model(texts: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """Each model's different texts, in a fixed order."""
    texts = texts.sort_by([(k, "ascending") for k in _KEY])
    model, a, b = (np.array(texts.column(k).to_pylist(), dtype=object) for k in _KEY)
    first = np.ones(len(a), bool)
    first[1:] = (model[1:] != model[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    for name in sorted(set(model)):
        yield name, texts.filter(pa.array(first & (model == name)))


def _list(texts: pa.Table, order: int) -> pa.Table:
    """(block, model, gram) of every different gram that a block's texts may ask for."""
    blocks, models, grams = [], [], []
    for name, own in _by_model(texts):
        recent, found = Recent(), []
        for words, _ in pieces(x.as_py() for x in own.column("text")):
            found.append(recent.unmet(gram_numbers(words, order)[0]))
        every = needed(np.concatenate([*found, np.zeros(0, np.uint64)]))
        blocks.append(np.full(len(every), texts.column("block")[0].as_py(), np.int64))
        models += [name] * len(every)
        grams.append(every.view(np.int64))
    return pa.table({"block": np.concatenate(blocks), "model": pa.array(models, pa.string()), "gram": np.concatenate(grams)})


class Costs:
    """Surprisal in nats of a gram's last character after the others, from the model's rows that a block has asked for."""

    def __init__(self, grams: np.ndarray, p: np.ndarray, back: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.p, self.back, self.recent = grams[order], p[order], back[order], Recent()

    def find(self, column: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Values of the grams, NaN where there is none."""
        if not len(self.grams):
            return np.full(len(numbers), np.nan)
        at = np.minimum(np.searchsorted(self.grams, numbers), len(self.grams) - 1)
        return np.where(self.grams[at] == numbers, column[at], np.nan)

    def work_out(self, numbers: np.ndarray) -> np.ndarray:
        cost, weight, open_ = np.zeros(len(numbers)), np.ones(len(numbers)), np.arange(len(numbers))
        while len(open_):
            p = self.find(self.p, numbers)
            done = ~np.isnan(p) | (numbers == 0)
            cost[open_[done]] = -np.log(np.maximum(weight[done] * np.where(np.isnan(p[done]), 1e-6, p[done]), 1e-12))
            back = self.find(self.back, numbers[~done] >> np.uint64(16))
            weight = weight[~done] * np.where(back > 0, back, 1.0)
            open_, numbers = open_[~done], shorter(numbers[~done])
        return cost

    def texts(self, texts: Iterable[str], n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean surprisal per character of each text, closing spaces included, and that of its worst words; NaN without words."""
        total, size, rates, owners = np.zeros(n), np.zeros(n), [np.zeros(0)], [np.zeros(0, np.int64)]
        for words, owner in pieces(texts):
            numbers, space = gram_numbers(words, order)
            cost = self.recent.get(numbers, self.work_out)
            ends = np.flatnonzero(space)
            starts = np.concatenate([[0], ends[:-1] + 1])
            long, spent = ends + 1 - starts, np.add.reduceat(cost, starts)
            total += np.bincount(owner, spent, n)
            size += np.bincount(owner, long, n)
            rates.append(spent / long)
            owners.append(owner)
        rate, owner = np.concatenate(rates), np.concatenate(owners)
        count = np.bincount(owner, minlength=n)
        worst = np.maximum(1, np.rint(WORST * count)).astype(np.int64)
        order_ = np.lexsort((-rate, owner))
        place = np.arange(len(rate)) - np.repeat(np.cumsum(count) - count, count)
        top = place < worst[owner[order_]]
        with np.errstate(invalid="ignore"):
            return total / size, np.where(count > 0, np.bincount(owner[order_][top], rate[order_][top], n) / worst, np.nan)


def _score(texts: pa.Table, found: pa.Table, order: int) -> pa.Table:
    out = []
    names = np.array(found.column("model").to_pylist(), dtype=object)
    for name, own in _by_model(texts):
        mine = found.filter(pa.array(names == name)) if len(names) else found
        column = lambda k: mine.column(k).to_numpy().astype(np.float64)  # noqa: B023, E731
        costs = Costs(mine.column("gram").to_numpy().astype(np.int64).view(np.uint64), column("p"), column("back"))
        mean, worst = costs.texts((x.as_py() for x in own.column("text")), len(own), order)
        has = ~np.isnan(mean)
        scores = own.select(_KEY).append_column("perplexity", pa.array(np.exp(mean))).append_column("worst_perplexity", pa.array(np.exp(worst)))
        out.append(scores.filter(pa.array(has)))
    return pa.concat_tables(out)


def perplexities(docs: DataFrame, model: Classifier) -> DataFrame:
    """(model, _a, _b, perplexity, worst_perplexity) of every different text with words of ``docs(lang, text)``."""
    order = model.order
    texts = docs.filter("text is not null").select(*model.key(), "text")
    schema = "model string, _a long, _b long, perplexity double, worst_perplexity double"
    if not model.languages:
        return docs.sparkSession.createDataFrame([], schema)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    once = texts.mapInArrow(_once, "model string, _a long, _b long, text string")
    once = once.withColumn("block", F.pmod(F.xxhash64(*_KEY), F.lit(max(1, -(-size // BLOCK)))))
    asked = once.groupBy("block").applyInArrow(lambda t: _list(t, order), "block long, model string, gram long")
    table = when_small(model.table.select(F.col("lang").alias("model"), "gram", "p", "back"), 48)
    found = asked.join(table, ["model", "gram"])
    scored = once.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda t, f: _score(t, f, order), schema)
    return stage(scored, "scores")


def _kept(docs: DataFrame, model: Classifier, scores: DataFrame, *keep: str) -> DataFrame:
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), *model.key())
    tops = [(x, *map(float, model.limit(x))) for x in model.languages]
    tops = docs.sparkSession.createDataFrame(tops, "model string, top_mean double, top_worst double")
    rows = rows.join(when_small(scores, 48), _KEY, "left").join(when_small(tops, 48), "model", "left")
    fits = (F.col("perplexity") <= F.col("top_mean")) & (F.col("worst_perplexity") <= F.col("top_worst"))
    return rows.select("row", "model", "perplexity", "worst_perplexity", F.coalesce(fits, F.lit(True)).alias("keep"))


def score(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """Struct ``row`` of the named columns (default: all) with model, perplexity, worst_perplexity and keep.

    Equal texts under one model are scored once. Documents without words (null, empty, blank) have null perplexities and are kept; so have and are
    all under a model that was trained on nothing. Repeated rows stay; columns beside lang and text matter only if kept, whatever their names.
    """
    return _kept(docs, model, perplexities(docs, model), *keep)


def train(trusted: DataFrame, order: int = ORDER) -> Classifier:
    """The model of all of ``trusted(lang, text)``, without limits. A missing language counts for the pooled model, which all trusted text trains."""
    raw = stage(gram_counts(trusted, order), "grams")
    return Classifier(stage(probabilities(raw, order), "model"), order)


def set_limits(model: Classifier, trusted: DataFrame, scores: DataFrame) -> None:
    """Quantiles of the trusted documents' perplexities by model; ties with a limit are kept."""
    seen = trusted.filter("text is not null").select(*model.key()).join(when_small(scores, 48), _KEY).groupBy("model")
    limits = seen.agg(
        F.percentile_approx("perplexity", MEAN_QUANTILE, 10_000).alias("mean"),
        F.percentile_approx("worst_perplexity", WORST_QUANTILE, 10_000).alias("worst"),
    )
    model.limits = {r["model"]: (r["mean"], r["worst"]) for r in limits.collect()}


def fit(trusted: DataFrame, order: int = ORDER) -> Classifier:
    """Model and limits from all of ``trusted(lang, text)``. Without trusted text every document is kept."""
    model = train(trusted, order)
    set_limits(model, trusted, perplexities(trusted, model))
    return model


def classify(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """``score`` of all documents by the model and limits of the trusted ones among them, every text scored once."""
    trusted = trusted_documents(docs, labels)
    model = train(trusted)
    scores = perplexities(docs, model)
    set_limits(model, trusted, scores)
    return _kept(docs, model, scores, *keep)


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that every label of theirs calls good and not toxic; null labels vouch for nothing."""
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    good = good.filter("q = 1 and t = 0 and doc_id is not null").select("doc_id")
    return docs.select("doc_id", "lang", "text").join(when_small(stage(good, "trusted"), 16), "doc_id", "left_semi")
