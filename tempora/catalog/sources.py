"""Queries on readers and writers; the files are written from the given tables to the shared scratch folder first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.catalog.registry import query
from tempora.functions import clock
from tempora.operators.quality import check_rows
from tempora.session import scratch_path
from tempora.sources import readers as R
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("report_id", T.LongType()),
        T.StructField("valid", T.StringType()),
        T.StructField("wxcodes", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# The unit that each variable must come in.
UNITS = {"temperature_2m": "°C", "precipitation": "mm", "cloud_cover": "%"}
CARRIED = ["temperature_2m", "precipitation", "cloud_cover"]


@query("csv_scan", "SELECT count(*) AS n, round(sum(round(value * 100)) / 100, 2) AS total FROM events")
def csv_scan(spark, path):
    """Typed CSV of which one column is read."""
    where = scratch_path(spark, "csv")
    rows = V.events(spark, path).select(
        F.col("event_id").alias("report_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("valid"), V.wx_text(F.col("k")).alias("wxcodes"), "value"
    )
    rows.write.option("header", True).csv(where)
    read = R.read_csv(spark, where, REPORT_SCHEMA, ["value"])
    return read.agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100)) / 100, 2).alias("total"))


def text_rows(spark, path):
    rows = V.reports(spark, path)
    return rows.select(
        F.col("report_id").cast("string").alias("report_id"), F.date_format("valid_ts", "yyyy-MM-dd HH:mm").alias("valid"), "wxcodes"
    )


@query("text_csv_codes", "SELECT wxcodes, count(*) AS n FROM reports GROUP BY ALL")
def text_csv_codes(spark, path):
    """All-text scan: an empty cell stays an empty text."""
    where = scratch_path(spark, "text")
    R.write_text_csv(text_rows(spark, path), where)
    return R.read_text_csv(spark, where, ["report_id", "valid", "wxcodes"]).groupBy("wxcodes").agg(F.count("*").alias("n"))


@query("verbatim_round_trip", "SELECT count(*) AS n_rows, 0::BIGINT AS differing_cells FROM events")
def verbatim_round_trip(spark, path):
    where = scratch_path(spark, "verbatim")
    rows = text_rows(spark, path)
    R.write_text_csv(rows, where)
    return R.verbatim_equal(rows, R.read_text_csv(spark, where, rows.columns), "report_id", ["valid", "wxcodes"])


@query(
    "station_catalogue",
    """SELECT s_name AS station_id, n_name AS name, s_suppkey * 37 % 90 + 0.5::DOUBLE AS latitude, s_suppkey * 53 % 180 + 0.25::DOUBLE AS longitude, s_acctbal AS elevation_m,
      CASE WHEN s_name = 'Supplier#000000003' THEN 8.482::DOUBLE ELSE s_suppkey * 37 % 90 + 0.5::DOUBLE END AS request_latitude,
      CASE WHEN s_name = 'Supplier#000000003' THEN 76.92::DOUBLE ELSE s_suppkey * 53 % 180 + 0.25::DOUBLE END AS request_longitude FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def station_catalogue(spark, path):
    """Nested JSON keyed by station id, with a request point that differs from the station."""
    key = F.col("s_suppkey")
    record = F.struct(
        F.col("s_name").alias("station_id"),
        F.col("n_name").alias("iem_name"),
        (key * 37 % 90 + 0.5).alias("latitude"),
        (key * 53 % 180 + 0.25).alias("longitude"),
        F.col("s_acctbal").alias("elevation_m"),
    )
    joined = V.table(spark, path, "supplier").join(V.table(spark, path, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.to_json(F.struct(F.create_map(F.col("s_name"), record).alias("stations")))
    return R.station_catalog(joined.select(text.alias("doc")), "doc", {"Supplier#000000003": (8.482, 76.92)})


def field(name):
    return lambda item: item[name]


def payloads_of(spark, path):
    """One JSON payload per station and day: parallel arrays of at most 24 hours.

    Every fifth day one array is short, every seventh day a unit is wrong.
    """
    day = F.to_date("timestamp_utc").alias("day")
    hour = F.struct("timestamp_utc", *CARRIED)
    packed = V.atmos(spark, path).groupBy("station_id", day).agg(F.array_sort(F.collect_list(hour)).alias("h"))
    number = F.dayofmonth("day")
    series = {c: F.transform("h", field(c)) for c in CARRIED}
    series["precipitation"] = F.when(number % 5 == 0, F.slice(series["precipitation"], 1, 20)).otherwise(series["precipitation"])
    times = F.transform("h", lambda x: F.date_format(x["timestamp_utc"], "yyyy-MM-dd'T'HH:mm"))
    units = F.create_map(*[F.lit(x) for item in UNITS.items() for x in item])
    wrong = F.create_map(*[F.lit(x) for item in {**UNITS, "precipitation": "inch"}.items() for x in item])
    payload = F.struct(
        F.lit(0).alias("utc_offset_seconds"),
        F.when(number % 7 == 0, wrong).otherwise(units).alias("hourly_units"),
        F.struct(times.alias("time"), *[series[c].alias(c) for c in CARRIED]).alias("hourly"),
    )
    return packed.select("station_id", "day", F.to_json(payload).alias("text"))


def parsed_of(spark, path):
    return payloads_of(spark, path).withColumn("payload", F.from_json("text", R.payload_schema(CARRIED)))


@query(
    "payload_rows",
    "SELECT station_id, timestamp_utc, round(temperature_2m, 6) AS temperature_2m, precipitation, cloud_cover FROM atmos WHERE day(timestamp_utc) % 5 <> 0",
)
def payload_rows(spark, path):
    """Parallel arrays to hourly rows; payloads with a length mismatch give none."""
    rows = R.payload_rows(parsed_of(spark, path), ["station_id"], "payload", CARRIED)
    return rows.withColumn("temperature_2m", F.round("temperature_2m", 6))


@query(
    "payload_faults",
    """SELECT fault, unit_fault, count(*) AS n FROM (SELECT DISTINCT station_id, CASE WHEN day(timestamp_utc) % 5 = 0 THEN 'length_mismatch:precipitation' END AS fault,
      CASE WHEN day(timestamp_utc) % 7 = 0 THEN 'unexpected_units:precipitation' END AS unit_fault, day(timestamp_utc) AS d FROM spine) GROUP BY ALL""",
)
def payload_faults(spark, path):
    payload = F.col("payload")
    fault, unit = R.payload_fault(payload, CARRIED), R.unit_fault(payload["hourly_units"], UNITS)
    return parsed_of(spark, path).groupBy(fault.alias("fault"), unit.alias("unit_fault")).agg(F.count("*").alias("n"))


@query(
    "batch_payloads",
    """SELECT s.station_id, d.day, true AS count_ok, 24::BIGINT AS n_hours FROM stations s CROSS JOIN (SELECT DISTINCT strftime(timestamp_utc, '%Y-%m-%d') AS day FROM spine) d""",
)
def batch_payloads(spark, path):
    """One response per day with a payload for every requested station, matched by position."""
    stations = V.stations(spark).select("station_id", "ord")
    placed = payloads_of(spark, path).join(stations, "station_id")
    responses = placed.groupBy("day").agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"), F.count("*").cast("int").alias("requested")
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["text"]), ","), F.lit("]"))
    split = R.split_batch(responses.select("day", "requested", text.alias("text")), ["day"], "text", "requested", R.payload_schema(CARRIED))
    matched = split.join(stations, split["position"] + 1 == stations["ord"])
    return matched.select("station_id", F.col("day").cast("string").alias("day"), "count_ok", F.size(F.col("payload.hourly.time")).cast("bigint").alias("n_hours"))


@query("axis_from_interval", "SELECT station_id, timestamp_utc, precipitation FROM atmos")
def axis_from_interval(spark, path):
    """Values without times: the axis follows from the start and the interval."""
    day = F.to_date("timestamp_utc").alias("day")
    packed = V.atmos(spark, path).groupBy("station_id", day).agg(F.array_sort(F.collect_list(F.struct("timestamp_utc", "precipitation"))).alias("h"))
    arrays = packed.select(
        "station_id",
        F.col("h")[0]["timestamp_utc"].alias("start"),
        F.lit(3600).alias("interval"),
        F.transform("h", lambda x: x["precipitation"]).alias("precipitation"),
    )
    return R.axis_rows(arrays, ["station_id"], "start", "interval", ["precipitation"])


@query(
    "yearly_chunks",
    "SELECT station_id, count(*) AS n, min(timestamp_utc) AS first, max(timestamp_utc) AS last, sum(cents)::BIGINT AS cents FROM series_day WHERE year(timestamp_utc) BETWEEN 1996 AND 1998 GROUP BY station_id",
)
def yearly_chunks(spark, path):
    """Year folders read together as one series; other years are never opened."""
    where = scratch_path(spark, "chunks")
    daily = V.series_day(spark, path)
    R.write_table(daily.withColumn("year", F.year("timestamp_utc")), where, ["year"])
    parts = [f"{where}/year={y}" for y in (1996, 1997, 1998)]
    series = R.read_parts(spark, parts, daily.schema)
    return series.groupBy("station_id").agg(
        F.count("*").alias("n"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.sum("cents").alias("cents")
    )


def manifest_of(spark, path):
    name = F.concat(F.lit("SCAN_"), F.upper(F.date_format("acq_end", "ddMMMyyyy_HHmm")), F.when(F.col("gid") % 2 == 0, "_L2B_CMK.h5").otherwise("_L1C_IMG.h5"))
    return V.scans(spark, path).select("gid", name.alias("filename"), F.when(F.col("gid") % 3 == 0, "FAILED").otherwise("OK").alias("status"))


_MANIFEST = """SELECT gid, 'SCAN_' || upper(strftime(acq_end, '%d%b%Y_%H%M')) || CASE WHEN gid % 2 = 0 THEN '_L2B_CMK.h5' ELSE '_L1C_IMG.h5' END AS filename,
  CASE WHEN gid % 3 = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM scans"""


@query("manifest_files", f"SELECT filename, min(gid) AS gid FROM ({_MANIFEST}) WHERE status = 'OK' AND contains(filename, 'L2B') AND contains(filename, 'CMK') GROUP BY filename")
def manifest_files(spark, path):
    return R.read_manifest(manifest_of(spark, path), "OK", ["L2B", "CMK"], "filename", "gid")


@query(
    "manifest_lookup",
    f"""SELECT w.gid, m.filename, m.gid IS NOT NULL AS found FROM (SELECT gid FROM scans) w LEFT JOIN (SELECT filename, min(gid) AS gid FROM ({_MANIFEST})
      WHERE status = 'OK' AND contains(filename, 'L2B') AND contains(filename, 'CMK') GROUP BY filename) m USING (gid)""",
)
def manifest_lookup(spark, path):
    known = R.read_manifest(manifest_of(spark, path), "OK", ["L2B", "CMK"], "filename", "gid")
    return R.manifest_lookup(V.scans(spark, path).select("gid"), known, "gid")


@query("day_catalogues", "SELECT strftime(acq_end, '%Y-%m-%d') AS day, count(*) AS n_entries, count(DISTINCT gid) AS n_ids, count(*) AS n_stamped FROM scans GROUP BY ALL")
def day_catalogues(spark, path):
    """Daily JSON catalogues in pages of one hour and a hundred ids, back to one row per entry."""
    where = scratch_path(spark, "catalogue")
    named = manifest_of(spark, path).join(V.scans(spark, path).select("gid", "acq_end"), "gid")
    entry = F.struct(F.col("filename").alias("identifier"), F.col("gid").alias("id"), clock.iso_z(F.col("acq_end")).alias("updated"))
    page = F.floor(F.col("gid") / 100)
    pages = named.groupBy(F.date_format("acq_end", "yyyy-MM-dd").alias("day"), F.hour("acq_end").alias("h"), page.alias("page"))
    pages.agg(F.collect_list(entry).alias("entries")).select("day", "entries").write.json(where)
    entries = R.day_catalogues(spark, where)
    return entries.groupBy("day").agg(
        F.count("*").alias("n_entries"),
        F.countDistinct("id").alias("n_ids"),
        F.count(clock.file_stamp(F.col("identifier"))).alias("n_stamped"),
    )


@query("partitioned_table", "SELECT station_id, timestamp_utc, round(temperature_2m, 6) AS temperature_2m FROM atmos WHERE station_id = 'signup'")
def partitioned_table(spark, path):
    """A table partitioned by station, of which one station is read."""
    where = scratch_path(spark, "stations")
    R.write_table(V.atmos(spark, path), where, ["station_id"])
    one = spark.read.parquet(where).filter(F.col("station_id") == "signup")
    return one.select(*KEY, F.round("temperature_2m", 6).alias("temperature_2m"))


@query("pooled_table", "SELECT station_id, count(*) AS n FROM atmos GROUP BY station_id")
def pooled_table(spark, path):
    where = scratch_path(spark, "pooled")
    R.write_table(V.atmos(spark, path), where)
    return spark.read.parquet(where).groupBy("station_id").agg(F.count("*").alias("n"))


@query("pixel_rows", "SELECT scan_id, count(*) AS n, count(*) FILTER (cls = 9) AS filled, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM pixels GROUP BY scan_id")
def pixel_rows(spark, path):
    return (
        V.pixels(spark, path)
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("cls") == 9).alias("filled"),
            F.round(F.min("lat"), 6).alias("south"),
            F.round(F.max("lat"), 6).alias("north"),
        )
    )


@query("ordered_keys", "SELECT station_id, timestamp_utc, row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS place FROM series_day")
def ordered_keys(spark, path):
    """Place of each row in station and time order, without ordering a station in one task."""
    from tempora.operators.ordered import positions

    daily = V.series_day(spark, path).select(*KEY, F.unix_seconds("timestamp_utc").alias("_s"))
    placed = positions(daily, ["station_id"], "_s")
    return placed.select("station_id", F.timestamp_seconds("_s").alias("timestamp_utc"), F.col("position").alias("place"))


@query("sorted_write", "SELECT 'sorted_within_files' AS \"check\", true AS passed, 0::BIGINT AS detail")
def sorted_write(spark, path):
    """A table written in station and time order: every file is sorted inside."""
    from pyspark.sql import Window

    where = scratch_path(spark, "sorted")
    rows = V.series_day(spark, path).select(*KEY)
    rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(where)
    read = spark.read.parquet(where).select(
        *KEY, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_no")
    )
    order = Window.partitionBy("file").orderBy("row_no")
    behind = F.struct(*KEY) < F.lag(F.struct(*KEY)).over(order)
    return check_rows(read.select(behind.alias("b")).agg(F.count_if("b").alias("n")), {"sorted_within_files": "n"})
