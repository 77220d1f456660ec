"""Structured Streaming forms of the hourly tables; the batch functions are reused wherever state allows it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.clock import shift_hours
from tempora.functions.values import all_known
from tempora.operators.labels import keep_first
from tempora.operators.status import freshness
from tempora.session import scratch_path

KEY = ["station_id", "timestamp_utc"]


#: Files that one micro-batch takes at most; a backlog is worked off in batches of bounded size.
MAX_FILES = 1000


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files: int = MAX_FILES) -> DataFrame:
    """New parquet files of a folder as a stream, at most ``files`` per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)


Each = Callable[[DataFrame, int], DataFrame]


def _drain(stream: DataFrame, root: str, mode: str, each: Each | None) -> None:
    def save(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch, batch_id) if each else batch
        rows.write.mode("overwrite").parquet(f"{root}/data/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Each | None = None) -> DataFrame:
    """Process what is available and return what was written.

    Every micro-batch writes its own folder and a repeated batch overwrites it, so the result is exactly once.
    """
    root = scratch_path(stream.sparkSession, name)
    _drain(stream, root, mode, each)
    return stream.sparkSession.read.option("basePath", f"{root}/data").parquet(f"{root}/data")


def latest_per_key(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result of an update-mode query: for every key the row of its last batch."""
    rest = [c for c in written.columns if c not in (*keys, "batch_id")]
    best = F.max_by(F.struct(*rest), "batch_id").alias("_b")
    return written.groupBy(*keys).agg(best).select(*keys, "_b.*")


def first_seen(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Repeated keys are dropped while their time is within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_counts(flagged: DataFrame, ts: str, delay: str) -> DataFrame:
    """The hourly report counts as a tumbling window."""
    event = F.col("ts_station") | F.col("ts_vicinity")
    hour = F.window(ts, "1 hour")
    return (
        flagged.withWatermark(ts, delay)
        .groupBy("station_id", hour.alias("w"))
        .agg(F.count("*").alias("n_reports"), F.count_if("decodable").alias("n_reports_with_wx"), F.count_if(event).alias("n_ts_reports"))
        .select("station_id", F.col("w.start").alias("timestamp_utc"), "n_reports", "n_reports_with_wx", "n_ts_reports")
    )


def trailing_totals(hours: DataFrame, value: str, k: int, delay: str) -> DataFrame:
    """Sum and mean over the last k hours, T included, unknown unless all k hours have a value."""
    span = F.window("timestamp_utc", f"{k} hours", "1 hour")
    full = F.count(value) == k
    return (
        hours.withWatermark("timestamp_utc", delay)
        .groupBy("station_id", span.alias("w"))
        .agg(F.when(full, F.sum(value)).alias("total"), F.when(full, F.avg(value)).alias("mean"))
        .select("station_id", (F.col("w.end") - F.make_interval(hours=F.lit(1))).alias("timestamp_utc"), "total", "mean")
    )


def episode_sessions(positive: DataFrame, gap_hours: int, delay: str) -> DataFrame:
    """Event episodes as sessions; an episode comes out when the watermark has passed its gap."""
    session = F.session_window("timestamp_utc", f"{gap_hours} hours")
    return (
        positive.withWatermark("timestamp_utc", delay)
        .groupBy("station_id", session.alias("w"))
        .agg(F.count("*").alias("n_hours"))
        .select("station_id", F.col("w.start").alias("event_start"), shift_hours(F.col("w.end"), -gap_hours).alias("event_end"), "n_hours")
    )


class HourStore:
    """Hours seen so far, one folder per micro-batch and day, so that each batch looks back over the same window and reads its days alone."""

    def __init__(self, spark: SparkSession, schema: T.StructType, name: str):
        self.spark, self.schema = spark, schema
        self.path = scratch_path(spark, name)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        first = keep_first(batch, KEY, [c for c in batch.columns if c not in KEY])
        rows = first.select(*self.schema.names).withColumn("day", F.to_date("timestamp_utc"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch_id={batch_id}")

    def recent(self, batch_id: int, since: DataFrame) -> DataFrame:
        """Rows of this and earlier batches from a start time on, a repeated hour taken from its earliest batch."""
        known = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("day", T.DateType())])
        rows = self.spark.read.schema(known).option("basePath", self.path).parquet(self.path)
        # the day is a folder, so older ones are not read
        rows = rows.filter((F.col("batch_id") <= batch_id) & (F.col("day") >= F.to_date(since.scalar())) & (F.col("timestamp_utc") >= since.scalar()))
        return keep_first(rows, KEY, ["batch_id"]).drop("batch_id", "day")


class LatestStore:
    """The newest time of every key after each micro-batch; a batch reads one row a key of the batch before it."""

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.path, self.key = spark, scratch_path(spark, name), key

    def add(self, found: DataFrame, batch_id: int) -> DataFrame:
        """Newest times of ``found(key, observed)`` and of all before; a null time is a key that was seen without one."""
        if batch_id:
            found = found.unionByName(self.spark.read.parquet(f"{self.path}/{batch_id - 1}"))
        newest = found.groupBy(self.key).agg(F.max("observed").alias("observed"))
        newest.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        return self.spark.read.parquet(f"{self.path}/{batch_id}")


def hourly_backfill(build: Callable[[DataFrame], DataFrame], archive: str, table: str, metrics: str, delay: str) -> Each:
    """Keep an hourly table right under late rows by rewriting the (station, day) parts that a micro-batch touches.

    Each batch of reports is added to the ``archive`` by station and day; the parts it touches are read back, built anew by
    ``build`` and overwritten in ``table``, no other part. Counts of rows and of those later than ``delay`` behind the newest
    time of earlier batches are observed while the batch is written and kept in ``metrics``. A repeated batch overwrites its own rows.
    """

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        newest = None
        if batch_id:
            newest = spark.read.parquet(f"{metrics}/{batch_id - 1}").agg(F.max("newest")).first()[0]
        late = F.col("valid_ts") < F.lit(newest) - F.expr(f"INTERVAL {delay}") if newest else F.lit(False)
        seen = Observation(f"batch-{batch_id}")
        rows = batch.withColumn("station", F.col("station_id")).withColumn("day", F.to_date("valid_ts"))
        counted = rows.observe(seen, F.count("*").alias("n_rows"), F.count_if(late).alias("n_late"), F.max("valid_ts").cast("string").alias("newest"))
        counted.write.mode("overwrite").partitionBy("station", "day").parquet(f"{archive}/batch_id={batch_id}")
        found = seen.get
        known = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
        all_rows = spark.read.schema(known).option("basePath", archive).parquet(archive).filter(F.col("batch_id") <= batch_id)
        parts = spark.read.schema(known).option("basePath", archive).parquet(f"{archive}/batch_id={batch_id}").select("station", "day").distinct()
        touched = build(all_rows.join(parts, ["station", "day"], "left_semi").select(*batch.columns))
        touched = touched.withColumn("station", F.col("station_id")).withColumn("day", F.to_date("timestamp_utc"))
        touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station", "day").parquet(table)
        row = [(batch_id, found["n_rows"], found["n_late"], max(filter(None, (found["newest"], newest)), default=None), parts.count())]
        done = spark.createDataFrame(row, "batch_no long, n_rows long, n_late long, newest string, n_parts long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{metrics}/{batch_id}")
        return done

    return each


def feature_step(store: HourStore, build: Callable[[DataFrame], DataFrame], history_hours: int) -> Each:
    """Features of a micro-batch from its rows and the hours before them, built by the batch function itself."""

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        store.add(batch, batch_id)
        since = batch.agg(shift_hours(F.min("timestamp_utc"), -history_hours))
        fresh = batch.select(*KEY).distinct()
        return build(store.recent(batch_id, since)).join(fresh, KEY, "left_semi")

    return each


def newest_complete(hours: DataFrame, columns: Sequence[str], now) -> DataFrame:
    """Every station with its newest complete hour up to now, null where there is none; future hours are not used."""
    usable = (F.col("timestamp_utc") <= now) & all_known([F.col(c) for c in columns])
    return hours.groupBy("station_id").agg(F.max(F.when(usable, F.col("timestamp_utc"))).alias("observed"))


def score_ready(hours: DataFrame, model_hours: DataFrame, columns: Sequence[str], now, limit_minutes: int = 180, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Live status per station: newest complete hour up to now, its age, and forecast cover of T+1 to T+3.

    Incomplete newest hours are stepped over; a stale or uncovered station is UNAVAILABLE.
    """
    return judge_newest(newest_complete(hours, columns, now), model_hours, now, limit_minutes, leads)


def judge_newest(newest: DataFrame, model_hours: DataFrame, now, limit_minutes: int = 180, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Status of ``newest(station_id, observed)``."""
    latest = newest.filter("observed is not null")
    wanted = latest.withColumn("timestamp_utc", F.explode(F.array(*[shift_hours(F.col("observed"), k) for k in leads])))
    covered = wanted.join(model_hours.select(*KEY).distinct(), KEY).groupBy("station_id").agg(F.count("*").alias("covered"))
    judged = freshness(latest, now, limit_minutes, "observed").join(covered, "station_id", "left")
    reason = F.coalesce(
        F.when(F.col("status") != "LIVE", "stale_observation"),
        F.when(F.coalesce("covered", F.lit(0)) < len(leads), "forecast_horizon_unavailable"),
    )
    stations = newest.select("station_id").join(judged, "station_id", "left")
    reason = F.coalesce(F.when(F.col("observed").isNull(), "no_complete_hour"), reason)
    return stations.select(
        "station_id", "observed", "data_age_minutes", reason.alias("reason"), F.when(reason.isNull(), "LIVE").otherwise("UNAVAILABLE").alias("status")
    )

