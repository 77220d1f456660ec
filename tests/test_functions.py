from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempora import contracts
from tempora.functions import clock, codes, geo, values, wind


def test_code_families(spark):
    texts = ["-TSRA BR", "VCTS/HZ", "HZ", "M", "", None, "+TS", "RETS"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    out = rows(df.select("i", codes.station_event(t), codes.vicinity_event(t), codes.has_code(t)), "i")
    assert [r[1] for r in out] == [True, False, False, False, False, False, True, False]
    assert [r[2] for r in out] == [False, True, False, False, False, False, False, False]
    assert [r[3] for r in out] == [True, True, True, False, False, False, True, True]


def test_body_recovery(spark):
    bodies = ["24005KT 5000TS FEW025 TEMPO 3000", "6000 TEMPO TSRA", "9999 RETS", "9999 VCTS", "9999 +TSRA NOSIG", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "i int, t string")
    assert [r[1] for r in rows(df.select("i", codes.body_event(F.col("t"))), "i")] == [True, False, False, True, True, False]


def test_wind(spark):
    df = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,)], "d double")
    u, v = wind.uv(F.lit(10.0), F.col("d"))
    out = rows(df.select("d", F.round(u, 6), F.round(v, 6)), "d")
    assert [(r[1] + 0.0, r[2] + 0.0) for r in out] == [(0, -10), (-10, 0), (0, 10), (10, 0)]


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(111.1949, abs=1e-4)


def test_alert_edge_and_unknown(spark):
    df = spark.createDataFrame([(0.065, 1), (0.0649, 0), (None, 1), (float("nan"), 1)], "p double, y int")
    out = rows(df.select(values.alert(F.col("p"), 0.065)))
    assert [r[0] for r in out] == [1, 0, None, None]


def test_one_decimal_is_rounded_on_the_exact_value(spark):
    numbers = [974.05, 0.25, 0.35, 2.5, 1010.5, 0.05, -0.25, 12.0, 99.95, 6.45, 1e-9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r[1] for r in rows(df.select("i", values.one_decimal(F.col("x"))), "i")]
    assert got == [f"{x:.1f}" if f"{x:.1f}" != "-0.0" else "0.0" for x in numbers] or got == [f"{x:.1f}" for x in numbers]


def test_display_value_above_thousand(spark):
    numbers = [1010.5, 1011.5, 999.99, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r[1] for r in rows(df.select("i", values.display_value(F.col("x"))), "i")]
    assert got == ["1010", "1012", "1000.0", "N/A"]


def test_coercion_and_tolerance(spark):
    df = spark.createDataFrame([("1.5",), ("M",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(values.to_number(F.col("t"))))] == [1.5, None, None, None]
    pairs = spark.createDataFrame([(1.0, 1.0 + 1e-12), (None, None), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows(pairs.select(values.close(F.col("a"), F.col("b"), 1e-9)))] == [True, True, False, False]


def test_clocks(spark):
    df = spark.range(1)
    row = df.select(
        clock.tai93_to_utc(F.lit(35.0)),
        clock.file_stamp(F.lit("SCAN_31DEC2025_2345_L2B.h5")),
        clock.acquisition_stamp(F.lit("14-JUN-2025T14:15:19")),
        clock.file_stamp(F.lit("nothing here")),
        clock.normal_stamp(F.lit("2023-06-15T12:00")),
        clock.expected_hours(F.lit(2024)),
        clock.expected_hours(F.lit(2023)),
    ).first()
    assert row[0] == datetime(1993, 1, 1)
    assert row[1] == datetime(2025, 12, 31, 23, 45)
    assert row[3] is None
    assert row[4] == "2023-06-15T12:00:00Z"
    assert (row[5], row[6]) == (8784, 8760)


def test_reason_texts(spark):
    reasons = ["insufficient_history", "missing_required_nwp:nwp_cape", "invalid_timestamp", "x_outside_y", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "i int, r string")
    out = rows(df.select("i", values.reason_group(F.col("r")), values.reason_message(F.col("r"))), "i")
    assert [r[1] for r in out] == ["missing_history", "missing_nwp", "invalid_input", "invalid_input", "other"]
    assert out[2][2] == "Invalid timestamp" and out[4][2] == values.OTHER_REASON


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    b = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b")], "x int, y string")
    c = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert rows(values.fingerprint(a)) == rows(values.fingerprint(b)) != rows(values.fingerprint(c))


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0)], "station_id int, target_1h double")
    with pytest.raises(contracts.ContractError):
        contracts.guard_features(df, ["target_1h"])
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["missing"])
    with pytest.raises(contracts.ContractError):
        contracts.require_exact(df, ["target_1h", "station_id"])
    assert contracts.require_schema(df, df.schema) is df


def test_changed_parts_are_named(spark):
    data = [(d, i, None if i % 3 == 0 else f"v{i}") for d in "abcd" for i in range(20)]
    table = lambda data: values.fingerprint(spark.createDataFrame(data, "day string, n int, v string"), ["day"], ["n", "v"])
    swapped = [("a", i, v) if d == "a" else (d, i, v) for d, i, v in reversed(data)]
    changed = [*[x for x in data if x[0] != "d"], ("b", 3, "null"), ("c", 1, "v1"), ("e", 1, "x")]
    name = lambda other: sorted(r[0] for r in rows(values.changed_parts(table(data), table(other), ["day"])))
    assert name(swapped) == [] and name(changed) == ["b", "c", "d", "e"]
    assert name([(d, i, "null" if v is None and (d, i) == ("a", 0) else v) for d, i, v in data]) == ["a"]
    whole = values.fingerprint(spark.createDataFrame(data, "day string, n int, v string"), columns=["n", "v"]).first()
    parts = rows(table(data))
    assert int(whole["hash_low"]) == sum(int(r[3]) for r in parts) % 2**64 and whole["n_rows"] == 80
    assert rows(values.fingerprint(spark.createDataFrame([], "n int"))) == [(0, "0", "0")]
