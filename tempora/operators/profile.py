"""Column profiles, coverage and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.values import percent
from tempora.operators.series import with_previous


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form: ``variable`` and ``value``."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "variable", "value"
    )


def per_column(df: DataFrame, by: Sequence[str], figures: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per group and variable from ``{variable: {figure: aggregate}}``.

    All figures are aggregated side by side, so a task sends one row per group, not one per row and column; only the
    result is unrolled. A table without rows gives no figures.
    """
    # a figure's place in the list names its columns, so variables may have any name
    wide = df.groupBy(*by).agg(
        F.count("*").alias("_rows"), *[value.alias(f"_{i}_{name}") for i, each in enumerate(figures.values()) for name, value in each.items()]
    )
    items = [
        F.struct(F.lit(variable).alias("variable"), *[F.col(f"_{i}_{name}").alias(name) for name in each])
        for i, (variable, each) in enumerate(figures.items())
    ]
    return wide.filter(F.col("_rows") > 0).select(*by, F.inline(F.array(*items)))


def column_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing values, share, smallest, largest and mean of each column, from one pass."""

    def figures(name: str) -> dict[str, Column]:
        value = F.col(name).cast("double")
        missing = F.count_if(value.isNull())
        return {
            "n": F.count("*"),
            "n_missing": missing,
            "missing_pct": F.round(missing * F.lit(100.0) / F.count("*"), 4),
            "min": F.min(value),
            "max": F.max(value),
            "mean": F.avg(value),
        }

    return per_column(df, by, {c: figures(c) for c in columns})


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both sides are known, from their merged moments; NULL when a side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.when(spread != 0, F.covar_pop(a, b) / spread)


def rate_by(df: DataFrame, keys: Sequence[Column | str], digits: int = 3) -> DataFrame:
    """Observed and positive hours and their share per group, among observed hours."""
    observed = df.filter(F.col("label").isNotNull())
    counts = observed.groupBy(*keys).agg(
        F.count("*").alias("observed_hours"), F.count_if(F.col("label") == 1).alias("positive_hours")
    )
    return counts.withColumn("positive_pct", percent(F.col("positive_hours"), F.col("observed_hours"), digits))


def coverage(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Grid hours, missing hours and coverage per group; the input is on a full calendar."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("grid_hours"), F.count("label").alias("observed_hours"))
    return counts.withColumns(
        {
            "missing_hours": F.col("grid_hours") - F.col("observed_hours"),
            "coverage_pct": percent(F.col("observed_hours"), F.col("grid_hours"), 2),
        }
    )


def right_closed_bin(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the bin (edge, next edge] that holds the value; NULL outside."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((value > low) & (value <= high), name).otherwise(out)
    return out


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, 0 when a side does not vary; columns never known with it are left out."""
    goal = F.col(target).cast("double")
    figures = {}
    for name in columns:
        value = F.col(name).cast("double")
        figures[name] = {"n": F.count_if(value.isNotNull() & goal.isNotNull()), "r": F.coalesce(correlation(value, goal), F.lit(0.0))}
    return per_column(df, [], figures).filter(F.col("n") > 0)


def step_report(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Continuity of each series: first, last, gaps, largest step, short steps, times off the grid."""
    unique = df.select(*keys, ts).distinct()
    stepped = with_previous(unique, keys, ts, "_previous")
    step = F.unix_seconds(ts) - F.unix_seconds("_previous")
    return stepped.groupBy(*keys).agg(
        F.count("*").alias("unique_times"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.count_if(step > step_seconds).alias("gaps"),
        F.max(step).alias("largest_step_s"),
        F.count_if(step < step_seconds).alias("short_steps"),
        F.count_if(F.unix_seconds(ts) % step_seconds != 0).alias("off_grid"),
        (F.floor((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / step_seconds) + 1 - F.count("*")).alias("missing_steps"),
    )
