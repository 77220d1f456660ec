"""Exact running sums, ranks and percentiles in value order, without one big ordered window.

Equal values are collapsed first. The number line is cut into leaves of 1e-5 relative width, at every magnitude, and the leaves into slots,
by a fixed rule that depends on the value alone, so every run and every retry cuts alike. A running sum is then the
sum inside the leaf plus the totals of the earlier leaves of its slot plus the totals of the earlier slots: three
windows, none of which sees more than one leaf, the leaves of one slot, or the slots of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import stage

LEAVES_PER_OCTAVE = 1 << 16
#: Above the exponents of all finite doubles, so that every size counts from zero upwards.
OCTAVES = 1100
LEAVES_PER_SLOT = 8192


def value_groups(df: DataFrame, keys: Sequence[str], x: str, **sums) -> DataFrame:
    """One row per key and distinct value with ``n`` rows and the named sums; unknown values are left out."""
    extra = [F.sum(c).alias(name) for name, c in sums.items()]
    return df.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, x).agg(F.count("*").alias("n"), *extra)


def _leaf(x: Column) -> Column:
    """Leaf number: rises with x, evenly in the logarithm of its size, so tiny values spread like large ones; zero is a leaf."""
    size = F.least(F.log2(F.abs(x)), F.lit(float(OCTAVES))) + OCTAVES
    place = F.floor(size * LEAVES_PER_OCTAVE) + 1
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, place).otherwise(-place)


def running_sums(groups: DataFrame, keys: Sequence[str], x: str, names: Sequence[str], staged: bool = False) -> DataFrame:
    """Add ``<name>_upto`` (ascending in x, own row included) and ``<name>_all`` to rows that are unique per key and x.

    The groups are read three times below, so they are staged once instead of being computed again from their source;
    ``staged`` tells that they already are.
    """
    keys = list(keys)
    groups = groups if staged else stage(groups, "value_groups")
    rows = groups.withColumn("_leaf", _leaf(F.col(x).cast("double")))
    leaves = (
        rows.groupBy(*keys, "_leaf")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("_slot", F.floor(F.col("_leaf") / LEAVES_PER_SLOT))
    )
    slots = leaves.groupBy(*keys, "_slot").agg(*[F.sum(n).alias(n) for n in names])
    key_wide = Window.partitionBy(*keys)
    before = key_wide.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *keys,
        "_slot",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_slot_{n}") for n in names],
        *[F.sum(n).over(key_wide).alias(f"{n}_all") for n in names],
    )
    before = Window.partitionBy(*keys, "_slot").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    starts = leaves.select(
        *keys, "_slot", "_leaf", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_leaf_{n}") for n in names]
    ).join(slots, [*keys, "_slot"])
    inside = Window.partitionBy(*keys, "_leaf").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in names]).join(starts, [*keys, "_leaf"])
    upto = [(F.col(f"_in_{n}") + F.col(f"_leaf_{n}") + F.col(f"_slot_{n}")).alias(f"{n}_upto") for n in names]
    return out.select(*groups.columns, *[f"{n}_all" for n in names], *upto)


def percentiles(df: DataFrame, keys: Sequence[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per wanted name."""
    ranked = running_sums(value_groups(df, keys, x), keys, x, ["n"])
    picks = []
    for name, q in wanted.items():
        position = (F.col("n_all") - 1) * F.lit(q)
        below, above = F.floor(position), F.ceil(position)
        picks += [
            F.min(F.when(F.col("n_upto") > below, F.col(x))).alias(f"_a_{name}"),
            F.min(F.when(F.col("n_upto") > above, F.col(x))).alias(f"_b_{name}"),
            F.max(position - below).alias(f"_t_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(*picks)
    mixed = [
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_t_{n}")).alias(n) for n in wanted
    ]
    return found.select(*keys, *mixed)


def pooled_percentiles(df: DataFrame, x: str, wanted: dict[str, float]) -> DataFrame:
    """The same over the whole table: one row."""
    return percentiles(df.select(F.lit(1).alias("_all"), x), ["_all"], x, wanted).drop("_all")


def positions(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """1-based position of each distinct value among the distinct values of its key, and their number."""
    groups = df.select(*keys, x).distinct().withColumn("n", F.lit(1))
    return running_sums(groups, keys, x, ["n"]).select(
        *keys, x, F.col("n_upto").alias("position"), F.col("n_all").alias("n_values")
    )
