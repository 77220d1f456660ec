"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ten words (a shorter item is one window). A window is a set of word shingles, and a
document contains it only if it contains every one of them; so it is enough to look a window up by one shingle, the
necessary prefix, and the rarest one gives the fewest candidates. One pass over the texts finds where any benchmark
shingle stands; those places give the corpus frequencies that order the shingles. Candidates must fit by position (the
window starts at or after word 0 and ends by the last word); each document then meets the list of its candidates once
and compares them word by word, so no text travels with a shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import BROADCAST_BYTES, ascii_lower, fingerprint, when_small
from tempora.session import stage

WINDOW = 10
SHINGLE = 5
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and anything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(class, win, k): distinct windows of each distinct item text; k is the shingle length that fits."""
    texts = items.select(F.array_join(words(F.col("text")), " ").alias("class")).filter("class <> ''").distinct()
    split = texts.withColumn("_w", F.split("class", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    cut = split.select("class", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("win"))
    return cut.distinct().withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))


def _shingle_hashes(hashes: str, k: int) -> Column:
    """Hash of the k words from each place on."""
    n = F.greatest(F.size(hashes) - k + 1, F.lit(0))
    return F.transform(
        F.slice(hashes, 1, n), lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(hashes, i + j) for j in range(1, k)])
    )


def _window_shingles(wins: DataFrame, lengths: list[int]) -> DataFrame:
    """(win, off, key) of all shingles of each window."""
    hashed = wins.select("win", "k").distinct().withColumn("_h", F.transform("win", lambda w: F.xxhash64(w)))
    parts = [hashed.filter(F.col("k") == k).select("win", F.posexplode_outer(_shingle_hashes("_h", k)).alias("off", "key")) for k in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _when_light(listed: DataFrame) -> DataFrame:
    """Lists of candidates, marked for broadcast only if their counted bytes are below BROADCAST_BYTES."""
    one = F.transform("fits", lambda c: F.octet_length(F.array_join(c["win"], " ")) + 16 * (F.size(c["win"]) + 2))
    total = listed.agg(F.sum(F.aggregate(one, F.lit(32).cast("long"), lambda a, b: a + b))).first()[0] or 0
    return F.broadcast(listed) if total <= BROADCAST_BYTES else listed


def hits(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, print, start, win): verified occurrences of windows in ``docs(doc_id, text)``."""
    lengths = sorted(r["k"] for r in wins.select("k").distinct().collect())  # SHINGLE values at most
    if not lengths:
        return wins.select(
            F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("print"), F.lit(0).alias("start"), "win"
        )
    shingles = stage(_window_shingles(wins, lengths), "shingles")
    keys = when_small(stage(shingles.select("key").distinct(), "shingle_keys"), 16)
    texts = docs.select(F.col("doc_id").alias("id"), fingerprint(F.col("text")).alias("print"), words(F.col("text")).alias("_w"))
    texts = texts.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # the outer form: the plain one infers a filter on the array, which would repeat the hashing inside each lambda
    places = None
    for k in lengths:
        one = texts.select("id", "print", F.size("_w").alias("n"), F.posexplode_outer(_shingle_hashes("_h", k)).alias("pos", "key"))
        places = one if places is None else places.union(one)
    found = stage(places.join(keys, "key").select("id", "print", "key", "pos", "n"), "places")
    often = found.groupBy("key").agg(F.count("*").alias("df"))
    ranked = shingles.join(often, "key", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "off")).alias("rarest")
    )
    # a window with a shingle that stands nowhere in the corpus is nowhere
    prefix = ranked.filter("rarest.df > 0").select("win", "rarest.key", "rarest.off", F.size("win").alias("len"))
    prefix = when_small(stage(prefix, "prefixes"), 256)
    start = F.col("pos") - F.col("off")
    fits = found.join(prefix, "key").filter((start >= 0) & (start + F.col("len") <= F.col("n")))
    listed = fits.groupBy("id", "print").agg(F.collect_set(F.struct(start.alias("start"), "win")).alias("fits"))
    listed = stage(listed.withColumnsRenamed({"id": "_id", "print": "_print"}), "candidates")
    there = F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    # only texts with candidates go to the lists, once a document
    asked = docs.select(F.col("doc_id").alias("id"), fingerprint(F.col("text")).alias("print"), "text")
    asked = asked.join(when_small(listed.select("_id", "_print"), 16), there, "left_semi")
    read = asked.join(_when_light(listed), there)
    # the outer array holds a text's words for all of its comparisons
    same = F.transform(
        F.array(words(F.col("text"))), lambda w: F.filter("fits", lambda c: F.slice(w, c["start"] + 1, F.size(c["win"])) == c["win"])
    )
    return read.select("id", "print", F.explode(F.flatten(same)).alias("hit")).select("id", "print", "hit.*").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words give no window; items without an id hit words
    but are not named; items with equal words are one class and are all named. Rows that repeat an id and text get equal
    results. An empty table of documents gives no rows, an empty benchmark gives no hits.
    """
    wins = stage(windows(items, size), "windows")
    found = stage(hits(docs, wins), "hits")
    by_doc = ["id", "print"]
    spans = found.select(*by_doc, "start", (F.col("start") + F.size("win")).alias("end")).distinct()
    before = Window.partitionBy(*by_doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.coalesce(F.max("end").over(before), F.lit(0)), "start"), F.lit(0))
    covered = spans.withColumn("fresh", fresh).groupBy(*by_doc).agg(F.sum("fresh").alias("n_hit"))
    names = items.select(F.array_join(words(F.col("text")), " ").alias("class"), F.col("item_id").cast("string").alias("item"))
    names = names.filter("class <> '' and item is not null").distinct()
    classes = found.select(*by_doc, "win").join(wins.select("win", "class"), "win").select(*by_doc, "class").distinct()
    named = classes.join(names, "class").groupBy(*by_doc).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = covered.join(named.withColumnsRenamed({"id": "id2", "print": "print2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("print") == F.col("print2")), "left")
    marks = marks.select("id", "print", "n_hit", "items")
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("_print"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_print") == F.col("print")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
