"""Reads and writes: typed or all-text CSV, nested JSON catalogues, hourly payloads, partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.contracts import ContractError, require_exact, require_schema


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a fixed schema; only the named columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_text_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Every cell as text, exactly as written: an empty cell stays an empty string."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .csv(path)
    )
    return df.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


def write_text_csv(df: DataFrame, path: str) -> None:
    """Write text cells so that ``read_text_csv`` gives the same cells back."""
    (
        df.select(*[F.col(c).cast("string") for c in df.columns])
        .write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, one directory per partition value; rebalancing joins small pieces and splits a hot value over many writers."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_parts(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Chunk files as one table; all have the same schema."""
    return require_schema(spark.read.schema(schema).parquet(*paths), schema)


STATION_RECORD = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("iem_name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation_m", T.DoubleType()),
    ]
)


def station_catalog(documents: DataFrame, column: str, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Stations from a JSON text ``{"stations": {id: record}}``; request points may be overridden."""
    schema = T.StructType([T.StructField("stations", T.MapType(T.StringType(), STATION_RECORD))])
    rows = documents.select(F.explode(F.from_json(F.col(column), schema)["stations"]).alias("station_id", "rec"))
    latitude, longitude = F.col("rec.latitude"), F.col("rec.longitude")
    request_latitude, request_longitude = latitude, longitude
    for station, (lat, lon) in (overrides or {}).items():
        request_latitude = F.when(F.col("station_id") == station, F.lit(lat)).otherwise(request_latitude)
        request_longitude = F.when(F.col("station_id") == station, F.lit(lon)).otherwise(request_longitude)
    return rows.select(
        "station_id",
        F.col("rec.iem_name").alias("name"),
        latitude.alias("latitude"),
        longitude.alias("longitude"),
        F.col("rec.elevation_m").alias("elevation_m"),
        request_latitude.alias("request_latitude"),
        request_longitude.alias("request_longitude"),
    )


def payload_schema(variables: Sequence[str]) -> T.StructType:
    hourly = [T.StructField("time", T.ArrayType(T.StringType()))]
    hourly += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    return T.StructType(
        [
            T.StructField("utc_offset_seconds", T.IntegerType()),
            T.StructField("hourly_units", T.MapType(T.StringType(), T.StringType())),
            T.StructField("hourly", T.StructType(hourly)),
        ]
    )


def payload_fault(payload: Column, variables: Sequence[str]) -> Column:
    """First fault of a payload, NULL when it is sound."""
    hourly = payload["hourly"]
    size = F.size(hourly["time"])
    rules = [F.when(hourly.isNull() | hourly["time"].isNull(), "malformed_hourly_block"), F.when(size == 0, "empty_hourly_times")]
    rules += [F.when(hourly[v].isNull(), f"missing_variable:{v}") for v in variables]
    rules += [F.when(F.size(hourly[v]) != size, f"length_mismatch:{v}") for v in variables]
    return F.coalesce(*rules)


def unit_fault(units: Column, expected: dict[str, str]) -> Column:
    """First unit that differs from the expected one, NULL when all agree."""
    rules = [F.when(units.isNull(), "missing_units")]
    for variable, unit in expected.items():
        found = F.trim(F.element_at(units, variable))
        rules.append(F.when(~found.eqNullSafe(F.lit(unit)), f"unexpected_units:{variable}"))
    return F.coalesce(*rules)


def payload_rows(df: DataFrame, keys: Sequence[str], payload: str, variables: Sequence[str]) -> DataFrame:
    """Parallel arrays to rows; payloads with a fault give no rows."""
    p = F.col(payload)
    zipped = F.arrays_zip(p["hourly"]["time"], *[p["hourly"][v] for v in variables])
    names = ["time", *variables]
    sound = df.filter(payload_fault(p, variables).isNull())
    flat = sound.select(*keys, F.explode(zipped).alias("_row"))
    fields = [F.col("_row").getField(n) for n in names]
    time = F.try_to_timestamp(fields[0], F.lit("yyyy-MM-dd'T'HH:mm"))
    values = [F.when(~F.isnan(c), c).alias(v) for c, v in zip(fields[1:], variables)]
    return flat.select(*keys, time.alias("timestamp_utc"), *values)


def axis_rows(df: DataFrame, keys: Sequence[str], start: str, interval_seconds: str, variables: Sequence[str]) -> DataFrame:
    """Values without a time array: the axis follows from start and interval."""
    zipped = F.arrays_zip(*[F.col(v) for v in variables])
    flat = df.select(*keys, start, interval_seconds, F.posexplode(zipped).alias("_pos", "_row"))
    time = F.timestamp_seconds(F.unix_seconds(F.col(start)) + F.col("_pos") * F.col(interval_seconds))
    return flat.select(*keys, time.alias("timestamp_utc"), *[F.col("_row").getField(v).alias(v) for v in variables])


def split_batch(df: DataFrame, keys: Sequence[str], text: str, expected: str, schema: T.StructType) -> DataFrame:
    """A JSON array of payloads, one per request position; a wrong count is flagged, not guessed."""
    items = F.from_json(F.col(text), T.ArrayType(schema))
    parsed = df.select(*keys, expected, items.alias("_items"))
    counted = parsed.withColumn("count_ok", F.coalesce(F.size("_items") == F.col(expected), F.lit(False)))
    return counted.select(*keys, "count_ok", F.posexplode("_items").alias("position", "payload"))


def read_manifest(df: DataFrame, status: str, markers: Sequence[str], file: str, gid: str) -> DataFrame:
    """Manifest rows with the given status and all name markers, one per file: the smallest id."""
    keep = F.col("status") == status
    for marker in markers:
        keep = keep & F.col(file).contains(marker)
    return df.filter(keep).groupBy(file).agg(F.min(gid).alias(gid))


def manifest_lookup(wanted: DataFrame, manifest: DataFrame, gid: str) -> DataFrame:
    """Wanted ids with their file, or flagged as missing."""
    found = manifest.withColumn("_hit", F.lit(True))
    return wanted.join(found, gid, "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


CATALOG_ENTRY = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("updated", T.StringType()),
    ]
)


def day_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """A folder of daily JSON catalogues to one row per entry, with the day taken from the file."""
    schema = T.StructType(
        [T.StructField("day", T.StringType()), T.StructField("entries", T.ArrayType(CATALOG_ENTRY))]
    )
    days = spark.read.schema(schema).json(path)
    return days.select("day", F.inline("entries"))


def verbatim_equal(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells compared as text after a round trip: one row with the number of differing cells."""
    require_exact(left.select(key, *columns), [key, *columns])
    if set(left.columns) != set(right.columns):
        raise ContractError("the two tables have different columns")
    pairs = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    differs = [(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).cast("int") for c in [key, *columns]]
    total = differs[0]
    for d in differs[1:]:
        total = total + d
    return pairs.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(total), F.lit(0)).alias("differing_cells"))
