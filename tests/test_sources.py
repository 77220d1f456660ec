import json

from conftest import rows
from pyspark.sql import functions as F

from tempora.operators import status as U
from tempora.sources import readers as R


def payload(times, temperature, units=None):
    return json.dumps({"hourly_units": units or {"t": "°C"}, "hourly": {"time": times, "t": temperature}})


TIMES = ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"]


def parsed(spark, text):
    df = spark.createDataFrame([("a", text)], "station_id string, text string")
    return df.withColumn("payload", F.from_json("text", R.payload_schema(["t"])))


def fault(spark, text):
    return parsed(spark, text).select(R.payload_fault(F.col("payload"), ["t"])).first()[0]


def test_payload_faults(spark):
    assert fault(spark, payload(TIMES, [1.0, None, 3.0])) is None
    assert fault(spark, payload(TIMES, [1.0, 2.0])) == "length_mismatch:t"
    assert fault(spark, payload([], [])) == "empty_hourly_times"
    assert fault(spark, json.dumps({"hourly": {"time": TIMES}})) == "missing_variable:t"
    assert fault(spark, "{}") == "malformed_hourly_block"


def test_payload_rows(spark):
    out = rows(R.payload_rows(parsed(spark, payload(TIMES, [1.0, None, 3.0])), ["station_id"], "payload", ["t"]).select("t"))
    assert out == [(1.0,), (None,), (3.0,)]
    assert R.payload_rows(parsed(spark, payload(TIMES, [1.0])), ["station_id"], "payload", ["t"]).count() == 0


def test_units(spark):
    df = parsed(spark, payload(TIMES, [1.0, 2.0, 3.0], {"t": "K"}))
    assert df.select(R.unit_fault(F.col("payload.hourly_units"), {"t": "°C"})).first()[0] == "unexpected_units:t"


def test_text_csv_keeps_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([("1", ""), ("2", " x "), ("3", "M"), ("4", "a,\"b\"")], "k string, v string")
    where = str(tmp_path / "t")
    R.write_text_csv(df, where)
    assert rows(R.read_text_csv(spark, where, ["k", "v"]), "k") == rows(df, "k")


def test_batch_count_is_checked(spark):
    text = f"[{payload(TIMES, [1.0, 2.0, 3.0])}]"
    df = spark.createDataFrame([(1, text, 1), (2, text, 2)], "k int, text string, n int")
    out = rows(R.split_batch(df, ["k"], "text", "n", R.payload_schema(["t"])).select("k", "count_ok", "position"), "k")
    assert out == [(1, True, 0), (2, False, 0)]


def test_freshness_limit_is_inclusive(spark, hour):
    df = spark.createDataFrame([("a", hour(0)), ("b", hour(1))], "station_id string, observed timestamp")
    out = rows(U.freshness(df, F.lit(hour(4)), 180, "observed").select("station_id", "status"), "station_id")
    assert out == [("a", "UNAVAILABLE"), ("b", "LIVE")]


def test_batch_status(spark):
    def status(*values):
        return U.batch_status(spark.createDataFrame([(v,) for v in values], "status string")).first()["batch_status"]

    assert status("LIVE", "LIVE") == "LIVE"
    assert status("LIVE", "UNAVAILABLE") == "LIVE_PARTIAL"
    assert status("UNAVAILABLE") == "UNAVAILABLE"


def test_fail_closed_cascade(spark, hour):
    names = ["station_id", "timestamp_utc", "t", "nwp", "history_rows", "history_ok"]
    hours = spark.createDataFrame(
        [("a", hour(0), 1.0, 1.0, 25, True), ("a", hour(1), None, 1.0, 24, False), ("a", hour(2), 1.0, 1.0, 24, False), ("a", hour(3), 1.0, float("nan"), 25, True)],
        "station_id string, timestamp_utc timestamp, t double, nwp double, history_rows long, history_ok boolean",
    )
    assert hours.columns == names
    stations = spark.createDataFrame([("a",)], "station_id string")
    asked = [(" A ", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 02:00:00"), ("a", "2024-01-01 03:00:00"), ("", "2024-01-01 00:00:00"), ("zz", "2024-01-01 00:00:00"), ("a", "soon"), ("a", "2024-01-02 00:00:00")]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request_id int, station_text string, time_text string")
    out = rows(U.judge_requests(requests, stations, hours, ["t"], ["nwp"]).select("request_id", "reason", "data_status"), "request_id")
    assert [r[1] for r in out] == [
        None,
        "missing_or_nonfinite_atmospheric:t",
        "insufficient_history",
        "missing_required_nwp:nwp",
        "INVALID_STATION",
        "INVALID_STATION",
        "INVALID_TIMESTAMP",
        "timestamp_not_in_history",
    ]
    assert out[0][2] == "COMPLETE" and out[3][2] == "UNAVAILABLE"
