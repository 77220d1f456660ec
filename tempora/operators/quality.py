"""Data-quality checks. Each gives rows (check, passed, detail); detail is the number of violations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.clock import expected_hours
from tempora.functions.values import changed_parts, close, fingerprint
from tempora.operators.profile import step_report

KEY = ["station_id", "timestamp_utc"]


def check_rows(one_row: DataFrame, violations: dict[str, str]) -> DataFrame:
    """Turn named violation counts of a one-row table into check rows."""
    items = F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).cast("bigint").alias("detail")) for n, c in violations.items()])
    rows = one_row.select(F.explode(items).alias("r")).select("r.*")
    return rows.select("check", (F.coalesce("detail", F.lit(0)) == 0).alias("passed"), F.coalesce("detail", F.lit(0)).alias("detail"))


def rule_check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows of a table that break each rule; an unknown outcome breaks nothing."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return check_rows(counts, {n: f"c{i}" for i, n in enumerate(rules)})


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def grid_check(df: DataFrame, keys: Sequence[str] = ("station_id",), ts: str = "timestamp_utc") -> DataFrame:
    """Hourly, gap-free and on the hour. Times off the hour are extra and make up for no lost hour."""
    report = step_report(df, keys, ts)
    due = F.floor(F.unix_seconds("last") / 3600) - F.ceil(F.unix_seconds("first") / 3600) + 1
    lost = due - (F.col("unique_times") - F.col("off_grid"))
    totals = report.agg(F.sum("gaps").alias("gaps"), F.sum("short_steps").alias("short"), F.sum("off_grid").alias("off"), F.sum(lost).alias("lost"))
    return check_rows(totals, {"no_gaps": "gaps", "no_short_steps": "short", "on_the_hour": "off", "no_missing_hours": "lost"})


def unique_key(df: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return check_rows(repeated, {"unique_key": "repeated"})


def calendar_check(df: DataFrame, key: str = "station_id", ts: str = "timestamp_utc") -> DataFrame:
    """Rows per key and year beside the hours of that year, and days per month beside the days present."""
    counts = df.groupBy(key, F.year(ts).alias("year")).agg(F.count("*").alias("n_rows"), F.countDistinct(ts).alias("n_hours"))
    return counts.withColumn("expected_hours", expected_hours(F.col("year"))).withColumn(
        "complete_year", F.col("n_hours") == F.col("expected_hours")
    )


def binary(column: str) -> Column:
    """Violated when a known value is neither 0 nor 1."""
    return ~F.col(column).isin(0.0, 1.0)


def same_values(left: DataFrame, right: DataFrame, columns: Sequence[str], tolerance: float, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Compare two tables on their common keys, one row per column: rows compared, mismatches, largest difference."""
    joined = left.alias("l").join(right.alias("r"), list(keys))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"l.{c}").cast("double").alias("a"), F.col(f"r.{c}").cast("double").alias("b")) for c in columns]
    )
    flat = joined.select(F.explode(pairs).alias("p")).select("p.*")
    return flat.groupBy("column").agg(
        F.count("*").alias("compared"),
        F.count_if(~close(F.col("a"), F.col("b"), tolerance)).alias("mismatches"),
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_abs_difference"),
    )


def replay_windows(hours: DataFrame, times: DataFrame, back: int, ahead: int) -> DataFrame:
    """The rows of T-back..T+ahead for each (station_id, timestamp_utc) of ``times``, as a series of its own.

    ``probe_time`` is T and ``offset`` the hours after it. Rows find the times by station and hour, an equi-join.
    """
    asked = times.select("station_id", F.col("timestamp_utc").alias("probe_time")).distinct()
    asked = asked.select("*", F.explode(F.sequence(F.lit(-back), F.lit(ahead))).alias("offset"))
    asked = asked.withColumn("timestamp_utc", F.timestamp_add("hour", F.col("offset"), F.col("probe_time")))
    return hours.join(asked, KEY)


def probe(
    hours: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    change: Callable[[DataFrame], DataFrame],
    times: DataFrame,
    back: int,
    ahead: int = 6,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Rebuild features at every (station, T) of ``times`` from a changed history and compare them with the shipped ones.

    All probes are one plan: each T is a series of its own rows, whose station is named after it, and ``change`` sees
    how far a row lies from its T in ``offset``.
    """
    name = F.concat_ws(" ", "station_id", F.unix_seconds("probe_time"))
    replayed = replay_windows(hours, times, back, ahead).withColumns({"probe_station": F.col("station_id"), "station_id": name})
    rebuilt = build(change(replayed)).filter(F.col("timestamp_utc") == F.col("probe_time"))
    rebuilt = rebuilt.select(F.col("probe_station").alias("station_id"), "timestamp_utc", *columns)
    shipped = build(hours).join(times.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, *columns)
    return same_values(shipped, rebuilt, columns, tolerance)


def truncated() -> Callable[[DataFrame], DataFrame]:
    """Keep only rows up to T."""
    return lambda df: df.filter(F.col("offset") <= 0)


def perturbed(columns: Sequence[str], shift: float = 1234.5) -> Callable[[DataFrame], DataFrame]:
    """Shift every value in the hours after T."""
    return lambda df: df.withColumns({c: F.when(F.col("offset") > 0, F.col(c) + shift).otherwise(F.col(c)) for c in columns})


def recent_only(hours: int) -> Callable[[DataFrame], DataFrame]:
    """Keep only the last hours that the features may look at, and nothing after T."""
    return lambda df: df.filter(F.col("offset").between(-hours, 0))


def label_rules(labels: DataFrame) -> DataFrame:
    """Variants of an hourly label: binary, ordered, unknown without reports, and a flag that agrees with the counts."""
    label, strict, recovered = F.col("label"), F.col("label_strict"), F.col("label_recovered")
    return rule_check(
        labels,
        {
            "label_is_binary": binary("label") | binary("label_strict") | binary("label_recovered"),
            "strict_not_above_label": strict > label,
            "label_not_above_recovered": label > recovered,
            "unknown_stays_unknown": (F.col("n_reports") == 0) & label.isNotNull(),
            "flag_matches_label": (F.col("wx_field_observed") == 1) & (F.col("n_reports_with_wx") == 0),
        },
    )


def target_rules(targets: DataFrame, leads: Sequence[int]) -> DataFrame:
    """Targets of all leads: binary, never 0 for unknown, and a flag that says whether the value is known."""
    wrong, zero, flag = F.lit(False), F.lit(False), F.lit(False)
    for k in leads:
        value, seen = F.col(f"target_{k}h"), F.col(f"target_{k}h_observed")
        wrong = wrong | F.coalesce(binary(f"target_{k}h"), F.lit(False))
        zero = zero | F.coalesce((seen == 0) & (value == 0), F.lit(False))
        flag = flag | ((seen == 1) != value.isNotNull())
    return rule_check(targets, {"targets_binary": wrong, "unknown_not_zero": zero, "flag_matches_value": flag})


def score_rules(scored: DataFrame, threshold: float) -> DataFrame:
    """Scored rows: a probability, the alert that the threshold gives, and a known target."""
    p = F.col("p")
    return rule_check(
        scored,
        {
            "probability_in_unit_interval": ~p.between(0, 1),
            "alert_follows_threshold": F.col("alert") != (p >= threshold).cast("int"),
            "unknown_target_not_scored": F.col("y").isNull(),
        },
    )


def alignment_rules(aligned: DataFrame, inventory: DataFrame) -> DataFrame:
    """Hours beside their scan: age and order, nothing without a match, one row an hour, only listed scans."""
    matched = F.col("sat_available") == 1
    rules = rule_check(
        aligned,
        {
            "age_within_limit": matched & ~F.col("age_minutes").between(0, 90),
            "end_not_after_hour": matched & (F.col("acq_end") > F.col("timestamp_utc")),
            "unmatched_is_empty": ~matched & (F.col("gid").isNotNull() | F.col("cloudy").isNotNull() | F.col("age_minutes").isNotNull()),
        },
    )
    foreign = aligned.filter(matched).join(inventory, "gid", "left_anti").agg(F.count("*").alias("n"))
    return union([rules, unique_key(aligned), check_rows(foreign, {"source_in_inventory": "n"})])


def extraction_rules(rows: DataFrame, fill: int) -> DataFrame:
    """Pixel features: shares in 0..1, no class for the fill value, nothing where no pixel is valid."""
    return rule_check(
        rows,
        {
            "fractions_in_unit_interval": ~F.col("cloudy_fraction").between(0, 1) | ~F.col("clear_fraction").between(0, 1),
            "fill_is_no_class": F.col("cloud_mask") == fill,
            "unavailable_is_empty": (F.col("available") == 0) & F.col("cloud_mask").isNotNull(),
        },
    )


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that a step lost or added, repeats counted; each side is read once."""
    sides = before.withColumn("_side", F.lit(1)).unionAll(after.withColumn("_side", F.lit(-1)))
    net = sides.groupBy(*before.columns).agg(F.sum("_side").alias("n"))
    total = net.agg(F.sum(F.greatest("n", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("added"))
    return check_rows(total, {"scores_lost": "lost", "scores_added": "added"})


def split_order(bounds: DataFrame) -> DataFrame:
    """Every split ends before the next begins."""
    times = {s: F.max(F.when(F.col("split") == s, F.struct("first", "last"))) for s in ("train", "validation", "test")}
    row = bounds.agg(*[c.alias(s) for s, c in times.items()])
    late = row.select(
        (F.col("train.last") >= F.col("validation.first")).cast("int").alias("a"), (F.col("validation.last") >= F.col("test.first")).cast("int").alias("b")
    )
    return check_rows(late, {"train_before_validation": "a", "validation_before_test": "b"})


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Keys missing on either side and keys in common."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    parts = [("missing_right", a.subtract(b)), ("missing_left", b.subtract(a)), ("common", a.intersect(b))]
    return union([df.agg(F.lit(name).alias("set"), F.count("*").alias("n")) for name, df in parts])


def unchanged(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many parts two builds of a table have, and how many of them differ in content, whatever the order of their rows."""
    columns = before.columns
    a, b = fingerprint(before, by, columns), fingerprint(after, by, columns)
    parts = a.select(*by).union(b.select(*by)).distinct().withColumn("_changed", F.lit(0))
    counted = parts.union(changed_parts(a, b, by).withColumn("_changed", F.lit(1)))
    return counted.agg(F.count_if(F.col("_changed") == 0).alias("n_parts"), F.count_if(F.col("_changed") == 1).alias("n_changed"))
