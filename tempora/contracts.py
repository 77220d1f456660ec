"""Column contracts, checked on ``df.schema`` alone: no job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name parts that must never appear in a model vector.
FORBIDDEN_MARKERS = ("target", "label", "weather_code", "sat_", "radar", "lightning", "thunderstorm")


class ContractError(ValueError):
    """A table does not have the columns it promises."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def require_exact(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if list(df.columns) != list(names):
        raise ContractError(f"expected columns {list(names)}, found {df.columns}")
    return df


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Names, order and types must match; nullability is free."""
    want = [(f.name, f.dataType) for f in schema]
    have = [(f.name, f.dataType) for f in df.schema]
    if want != have:
        raise ContractError(f"expected schema {want}, found {have}")
    return df


def forbid_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    present = [n for n in names if n in df.columns]
    if present:
        raise ContractError(f"refused columns: {present}")
    return df


def leaked_names(names: Iterable[str]) -> list[str]:
    return [n for n in names if any(m in n.lower() for m in FORBIDDEN_MARKERS)]


def guard_features(df: DataFrame, features: Sequence[str], expected: int | None = None) -> DataFrame:
    """Refuse a feature list that names a target, an observation of the event, or has a wrong size."""
    leaked = leaked_names(features)
    if leaked:
        raise ContractError(f"leaking feature names: {leaked}")
    if len(set(features)) != len(features):
        raise ContractError("repeated feature names")
    if expected is not None and len(features) != expected:
        raise ContractError(f"expected {expected} features, found {len(features)}")
    return require_columns(df, features)
