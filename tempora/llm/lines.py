"""Line dedup on content-defined chunks of lines and on runs of line pairs, in DataFrame functions only.

A text's lines are hashed, and a rolling hash over the last two line hashes sets chunk ends, one in two on average: an
end depends on the lines beside it alone, so inserted or lost lines shift nothing further on. A long line (50 words or
more) is always a chunk of its own, so a repeated paragraph is found whatever stands around it. Chunks of two or more
lines, and long lines, that occur more than once in the corpus keep their first occurrence (smallest id, then text
fingerprint, then position) and lose the others, after their bytes were compared.

What stands around a short passage sets where its chunks end, so passages are also found by their pairs of neighbouring
lines, each of which has a first place in the same order. A run of later pairs with 50 words or more goes, but for the
lines of pairs that have their first place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import fingerprint, when_small
from tempora.session import stage

LONG_LINE_WORDS = 50
MEAN_LINES = 2


def chunked(docs: DataFrame, long_words: int = LONG_LINE_WORDS, mean_lines: int = MEAN_LINES) -> DataFrame:
    """``docs(text)`` with ``_lines``: array of (line, hash, words, long), and ``_starts``: the numbers of the lines that
    start a chunk; the lines joined by line feeds are the input.
    """
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    marked = F.transform(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1),
        lambda x: F.struct(
            x.alias("line"), F.xxhash64(x).alias("hash"), F.when(F.trim(x) == "", 0).otherwise(words(x)).alias("words"), (words(x) >= long_words).alias("long")
        ),
    )
    cut = docs.withColumn("_lines", marked)

    def opens(i):
        """Whether line i starts a chunk: the rolling hash of the two lines before it says so, or a long line is near."""
        line = lambda k: F.get("_lines", k)
        rolling = F.pmod(F.xxhash64(line(i - 2)["hash"], line(i - 1)["hash"]), F.lit(mean_lines)) == 0
        return (i == 0) | line(i)["long"] | line(i - 1)["long"] | rolling

    return cut.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), opens))


def _end(i):
    """The line after the last one of chunk i."""
    return F.coalesce(F.get("_starts", i + 1), F.size("_lines"))


def _units(cut: DataFrame) -> DataFrame:
    """(id, print, pair, at, hash, body, words, next_words) of every chunk that counts and every pair of lines."""

    def chunk(start, i):
        end = _end(i)
        part = F.slice("_lines", start + 1, end - start)
        body = F.array_join(F.transform(part, lambda x: x["line"]), "\n")
        fit = ((end - start >= 2) | F.element_at(part, 1)["long"]) & (F.trim(F.replace(body, F.lit("\n"), F.lit(""))) != "")
        none = F.lit(0)
        return F.struct(
            F.lit(False).alias("pair"), i.alias("at"), F.xxhash64(body).alias("hash"), F.when(fit, body).alias("body"), none.alias("words"), none.alias("next_words")
        )

    def pair(x, i):
        after = F.get("_lines", i + 1)
        return F.struct(
            F.lit(True).alias("pair"), i.alias("at"), F.xxhash64(x["hash"], after["hash"]).alias("hash"),
            F.concat(x["line"], F.lit("\n"), after["line"]).alias("body"),
            x["words"].alias("words"), after["words"].alias("next_words"),
        )

    both = F.concat(F.transform("_starts", chunk), F.transform("_lines", pair))
    # the outer form: the plain one infers a filter on the array, which would repeat the chunking inside each lambda
    return cut.select("id", "print", F.inline_outer(both)).filter("body is not null")


def repeats(docs: DataFrame, long_words: int, mean_lines: int) -> DataFrame:
    """(id, print, drop, runs, firsts): for each document the numbers of its chunks that occurred before, (first, last)
    line of its runs of pairs that did, and its pairs that are the first of several.
    """
    rows = docs.select(F.col("doc_id").alias("id"), fingerprint(F.col("text")).alias("print"), "text")
    rows = _units(chunked(rows, long_words, mean_lines))
    often = rows.groupBy("pair", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("pair", "hash")
    often = when_small(stage(often, "repeated_hashes"), 17)
    again = stage(rows.join(often, ["pair", "hash"], "left_semi"), "repeated_chunks")
    # grouping by the body compares bytes; a hash that two bodies share makes two groups
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "at")
    first = again.groupBy("pair", "hash", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that a chunk with very many copies meets it in a join that Spark can split
    first = stage(first.select("pair", "hash", F.col("body").alias("same"), "first"), "first_chunks")
    joined = again.join(first, ["pair", "hash"]).filter("body = same")
    met = joined.select("id", "print", "pair", "at", "words", "next_words", (~place.eqNullSafe(F.col("first"))).alias("later"))
    met = stage(met.distinct(), "places")
    by_doc = Window.partitionBy("id", "print").orderBy("at")
    runs = met.filter("pair and later").withColumn("run", F.col("at") - F.row_number().over(by_doc)).groupBy("id", "print", "run")
    runs = runs.agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"), (F.sum("words") + F.max_by("next_words", "at")).alias("words"))
    runs = runs.filter(F.col("words") >= long_words)
    kinds = {
        "drop": met.filter("not pair and later").select("id", "print", "at"),
        "runs": runs.select("id", "print", F.struct("lo", "hi").alias("at")),
        "firsts": met.filter("pair and not later").select("id", "print", "at"),
    }
    parts = None
    for kind, part in kinds.items():
        made = part.select("id", "print", *[(F.col("at") if k == kind else F.lit(None).cast(kinds[k].schema["at"].dataType)).alias(k) for k in kinds])
        parts = made if parts is None else parts.union(made)
    found = parts.groupBy("id", "print").agg(*[F.array_sort(F.collect_set(k)).alias(k) for k in kinds])
    return found.filter("size(drop) > 0 or size(runs) > 0")


def dedup_lines(docs: DataFrame, long_words: int = LONG_LINE_WORDS, mean_lines: int = MEAN_LINES) -> DataFrame:
    """All columns of ``docs`` as ``row``, with new_text, n_chunks, n_removed (chunks that lost lines).

    Rows that repeat with the same id and text are one occurrence: they lose the same lines. Null and empty texts have no
    chunk that counts and stay as they are. Blank chunks and single short lines are never removed by themselves. An empty
    table gives no rows.
    """
    drops = repeats(docs, long_words, mean_lines)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), fingerprint(F.col("text")).alias("_print"))
    met = rows.join(
        drops, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_print") == F.col("print")), "left"
    ).select("row", "drop", "runs", "firsts", F.col("row.text").alias("text"))
    met = chunked(met, long_words, mean_lines)
    whole = F.transform("drop", lambda c: F.sequence(F.get("_starts", c), _end(c) - 1))
    first = F.flatten(F.transform("firsts", lambda i: F.array(i, i + 1)))
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))
    gone = F.array_union(F.flatten(whole), F.array_except(covered, first))
    met = met.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    joined = F.array_join(F.transform(left, lambda i: F.get("_lines", i)["line"]), "\n")
    owner = F.flatten(F.transform("_starts", lambda s, i: F.array_repeat(i, _end(i) - s)))
    met = met.withColumn("_owner", F.when(F.size("_gone") > 0, owner))
    hit = F.array_distinct(F.transform("_gone", lambda i: F.get("_owner", i)))
    # a generated row: a filter on these columns is not pushed into the chunking, where it would be worked out per line
    made = F.struct(
        F.when(F.size("_gone") > 0, joined).otherwise(F.col("text")).alias("new_text"),
        F.size("_starts").alias("n_chunks"),
        F.size(hit).alias("n_removed"),
    )
    return met.select("row", F.inline_outer(F.array(made)))
