"""Binary event scores: confusion, rates, exact AUC and average precision, threshold sweep and choice.

All of it runs on score groups (key, score, rows, positives), so the cost after the first aggregate depends on the
number of distinct scores and not on the number of scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.values import alert, ratio, ratio_or_zero, verdict
from tempora.operators.ordered import running_sums
from tempora.session import stage

POOLED = "ALL"

# Frozen decision threshold, weight of recall, cap of the alert rate, near band.
THRESHOLD = 0.065
BETA = 2.0
ALERT_RATE_CAP = 0.20
NEAR_BAND = 0.02

# Left-closed probability bins.
BIN_EDGES = (0.0, 0.025, 0.05, 0.065, 0.10, 0.20, 0.50)
BIN_LABELS = (
    "[0.000, 0.025)",
    "[0.025, 0.050)",
    "[0.050, 0.065)",
    "[0.065, 0.100)",
    "[0.100, 0.200)",
    "[0.200, 0.500)",
    "[0.500, 1.000]",
)


def long_scores(predictions: DataFrame, leads: Sequence[int] = (1, 2, 3), threshold: float = THRESHOLD) -> DataFrame:
    """One row per station, hour and lead: probability, alert, target and verdict."""
    blocks = []
    for k in leads:
        p, y = F.col(f"p_{k}h"), F.col(f"target_{k}h").cast("int")
        blocks.append(F.struct(F.lit(f"{k}h").alias("lead"), p.alias("p"), alert(p, threshold).alias("alert"), y.alias("y")))
    rows = predictions.select("station_id", "timestamp_utc", F.explode(F.array(*blocks)).alias("b"))
    flat = rows.select("b.lead", "station_id", "timestamp_utc", "b.p", "b.alert", "b.y")
    return flat.withColumn("verdict", verdict(F.col("alert"), F.col("y")))


def labelled(scores: DataFrame) -> DataFrame:
    """Rows with a probability and a known target; unknown targets are never counted as 0."""
    return scores.filter(F.col("verdict").isNotNull())


def score_groups(scores: DataFrame, keys: Sequence[str], scope: str | None = None) -> DataFrame:
    """Rows and positives per key and distinct score; with ``scope`` also pooled over that column."""
    by = [*keys, scope] if scope else list(keys)
    groups = scores.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    if scope is None:
        return groups
    both = groups.withColumn(scope, F.explode(F.array(F.lit(POOLED), F.col(scope))))
    return both.groupBy(*by, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def confusion(groups: DataFrame, keys: Sequence[str], threshold: Column | float = THRESHOLD) -> DataFrame:
    fired = F.col("p") >= (threshold if isinstance(threshold, Column) else F.lit(threshold))
    neg = F.col("n") - F.col("pos")

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(name)

    return groups.groupBy(*keys).agg(
        total(F.when(fired, F.col("pos")), "TP"),
        total(F.when(fired, neg), "FP"),
        total(F.when(~fired, F.col("pos")), "FN"),
        total(F.when(~fired, neg), "TN"),
    )


def rates(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Skill figures from TP, FP, FN, TN; 0 where a denominator of precision, recall or F is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    n = tp + fp + fn + tn
    square = beta * beta
    base = counts.withColumns(
        {
            "n": n,
            "positives": tp + fn,
            "negatives": fp + tn,
            "precision": ratio_or_zero(tp, tp + fp),
            "recall": ratio_or_zero(tp, tp + fn),
            "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
            "fbeta": ratio_or_zero((1 + square) * tp, (1 + square) * tp + square * fn + fp),
        }
    )
    return base.withColumns(
        {
            "accuracy": ratio(tp + tn, F.col("n")),
            "alert_rate": ratio(tp + fp, F.col("n")),
            "positive_rate": ratio(tp + fn, F.col("n")),
            "false_alarms_per_hit": ratio(fp, tp),
        }
    )


def ranking(groups: DataFrame, keys: Sequence[str], staged: bool = False) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision; NULL when only one class is present."""
    cum = running_sums(groups, keys, "p", ["n", "pos"], staged)
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    all_pos, all_neg = F.col("pos_all"), F.col("n_all") - F.col("pos_all")
    neg_below = F.col("n_upto") - F.col("pos_upto") - neg
    tp = all_pos - F.col("pos_upto") + pos
    taken = F.col("n_all") - F.col("n_upto") + F.col("n")
    sums = cum.groupBy(*keys).agg(
        F.sum(pos * (neg_below + neg / 2)).alias("_won"),
        F.sum(pos * (tp / taken)).alias("_area"),
        F.max(all_pos).alias("_p"),
        F.max(all_neg).alias("_n"),
    )
    two = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *keys,
        F.when(two, F.col("_won") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(two, F.col("_area") / F.col("_p")).alias("pr_auc"),
    )


def metrics(scores: DataFrame, keys: Sequence[str], scope: str | None = "station_id", threshold: Column | float = THRESHOLD) -> DataFrame:
    """Confusion, rates and ranking skill, pooled and per scope value in one table.

    The score groups are read by several aggregates, so they are staged once.
    """
    by = [*keys, scope] if scope else list(keys)
    groups = score_groups(scores, keys, scope).select(*by, "p", "n", "pos")
    groups = stage(groups, "score_groups")
    return rates(confusion(groups, by, threshold)).join(ranking(groups, by, staged=True), by)


def sweep(groups: DataFrame, keys: Sequence[str], beta: float = BETA) -> DataFrame:
    """Every distinct score as a threshold: hits, false alarms and rates when it and all above are alerts."""
    cum = running_sums(groups, keys, "p", ["n", "pos"])
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    taken = F.col("n_all") - F.col("n_upto") + F.col("n")
    square = beta * beta
    return cum.select(
        *keys,
        F.col("p").alias("threshold"),
        tp.alias("tp"),
        (taken - tp).alias("fp"),
        ratio_or_zero(tp, taken).alias("precision"),
        ratio_or_zero(tp, F.col("pos_all")).alias("recall"),
        (taken / F.col("n_all")).alias("alert_rate"),
        ratio_or_zero(2 * tp, taken + F.col("pos_all")).alias("f1"),
        ratio_or_zero((1 + square) * tp, taken + square * F.col("pos_all")).alias("fbeta"),
    )


def choose_threshold(table: DataFrame, keys: Sequence[str], cap: float = ALERT_RATE_CAP) -> DataFrame:
    """Largest F-beta within the alert-rate cap, the lowest threshold among near ties.

    A key without any threshold inside the cap keeps its row with an unknown threshold.
    """
    inside = F.col("alert_rate") <= cap
    table = stage(table, "sweep")
    best = table.groupBy(*keys).agg(
        F.max(F.when(inside, F.col("fbeta"))).alias("best"),
        F.count("*").alias("candidates"),
        F.count_if(inside).alias("candidates_inside"),
        F.max_by("alert_rate", F.struct("fbeta", "threshold")).alias("_free_rate"),
    )
    near = F.abs(F.col("fbeta") - F.col("best")) <= 1e-8 + 1e-5 * F.abs(F.col("best"))
    tied = table.join(best.select(*keys, "best"), list(keys)).filter(inside & near)
    chosen = tied.groupBy(*keys).agg(
        F.min("threshold").alias("threshold"),
        F.min_by("fbeta", "threshold").alias("fbeta"),
        F.min_by("alert_rate", "threshold").alias("alert_rate"),
    )
    return (
        best.join(chosen, list(keys), "left")
        .withColumn("guardrail_binding", F.col("_free_rate") > cap)
        .drop("best", "_free_rate")
    )


def bin_index(p: Column) -> Column:
    """Number of the bin, 1 to 7, that holds a probability."""
    out = F.lit(1)
    for edge in BIN_EDGES[1:]:
        out = out + (p >= edge).cast("int")
    return out


def bin_table(scores: DataFrame, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Reliability by probability bin; empty bins keep a row."""
    spark = scores.sparkSession
    bins = ", ".join(f"({i + 1}, '{label}')" for i, label in enumerate(BIN_LABELS))
    dim = spark.sql(f"SELECT * FROM VALUES {bins} AS t(bin_no, bin)")
    dim = dim.withColumn("lead", F.explode(F.array(*[F.lit(f"{k}h") for k in leads])))
    facts = scores.groupBy("lead", bin_index(F.col("p")).alias("bin_no")).agg(
        F.count("*").alias("n"), F.sum("y").alias("positive_count"), F.sum("alert").alias("alert_count")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "positive_count", "alert_count")}
    return (
        dim.join(facts, ["lead", "bin_no"], "left")
        .withColumns(zero)
        .withColumn("positive_rate", ratio(F.col("positive_count"), F.col("n")))
    )


def verdict_counts() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in ("TP", "FP", "FN", "TN")]


def alert_patterns(alerts: DataFrame) -> DataFrame:
    """Counts of the eight alert patterns over three leads, alert frequencies and changes between leads."""
    spark = alerts.sparkSession
    flags = [F.col(f"alert_{k}h") for k in (1, 2, 3)]
    ready = alerts.filter(flags[0].isNotNull() & flags[1].isNotNull() & flags[2].isNotNull())
    counted = ready.groupBy(*[f"alert_{k}h" for k in (1, 2, 3)]).agg(F.count("*").alias("n"))
    a, b, c = flags
    rules = [(F.concat(*[f.cast("string") for f in flags]), F.lit(True)), (F.lit("N_comparable"), F.lit(True))]
    rules += [(F.lit(f"alert_freq_{k}h"), F.col(f"alert_{k}h") == 1) for k in (1, 2, 3)]
    rules += [(F.lit("transition_1h_ne_2h"), a != b), (F.lit("transition_2h_ne_3h"), b != c)]
    named = F.array(*[F.struct(name.alias("pattern"), F.when(cond, F.col("n")).otherwise(0).alias("k")) for name, cond in rules])
    sums = counted.select(F.explode(named).alias("r")).groupBy("r.pattern").agg(F.sum("r.k").alias("count"))
    names = [f"{i:03b}" for i in range(8)] + ["N_comparable"] + [f"alert_freq_{k}h" for k in (1, 2, 3)]
    names += ["transition_1h_ne_2h", "transition_2h_ne_3h"]
    dim = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}')" for n in names) + " AS t(pattern)")
    out = dim.join(sums, "pattern", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = counted.agg(F.sum("n")).scalar()
    return out.withColumn("percentage", ratio(F.col("count") * 100.0, total))


def compare_metrics(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Differences right minus left of two metric tables on the same keys."""
    joined = left.alias("l").join(right.alias("r"), list(keys))
    deltas = [(F.col(f"r.{m}") - F.col(f"l.{m}")).alias(f"delta_{m}") for m in names]
    return joined.select(*keys, *deltas)


def errors_by_month(scored: DataFrame) -> DataFrame:
    """False alarms and misses per lead, year and month; no month is named beforehand."""
    errors = scored.filter(F.col("verdict").isin("FP", "FN"))
    by = [F.year("timestamp_utc").alias("year"), F.month("timestamp_utc").alias("month")]
    return errors.groupBy("lead", "verdict", *by).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("prob_mean"))
