"""Registry of the queries: a Spark plan and, where SQL can say the same, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.catalog.oracle_views import with_views
from tempora.session import prepare

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    """Timestamps leave without a zone, as the tables store them."""
    zoned = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(zoned) if zoned else df


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            return edge(plan(prepare(spark), path))

        run.__name__ = name
        run.__doc__ = plan.__doc__
        PLANS[name] = run
        if sql is not None:
            CHECKS[name] = with_views(sql.strip())
        return plan

    return register
