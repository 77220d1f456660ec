"""The views of ``tempora.sources.views`` in plain SQL, for checking results with another engine."""

from __future__ import annotations

import re

from tempora.sources import views as V

_STATIONS = ", ".join(
    f"('{i}', {lat}::DOUBLE, {lon}::DOUBLE, {elev}::DOUBLE, {rank}, '{name}')" for i, lat, lon, elev, rank, name in V.STATIONS
)
_BODIES = ", ".join(f"'{b}'" for b in V.BODIES)


def _weather(prefix: str = "") -> str:
    return f"""s / n / 100.0::DOUBLE AS {prefix}temperature_2m, sk / n AS {prefix}relative_humidity_2m,
      (hi + 90000)::DOUBLE AS {prefix}surface_pressure, lo / 100.0::DOUBLE AS {prefix}wind_speed_10m,
      (su * 7 % 360)::DOUBLE AS {prefix}wind_direction_10m, s / 100.0::DOUBLE AS {prefix}precipitation,
      CASE WHEN n IS NOT NULL THEN least(100, n * 20) END::DOUBLE AS {prefix}cloud_cover"""


def _sums(where: str) -> str:
    return f"""SELECT event_type AS station_id, date_trunc('hour', ts) AS timestamp_utc, count(*) AS n,
      sum(round(value * 100)::BIGINT)::BIGINT AS s, min(round(value * 100)::BIGINT) AS lo, max(round(value * 100)::BIGINT) AS hi,
      sum(k)::BIGINT AS sk, sum(user_id)::BIGINT AS su FROM ev WHERE {where} GROUP BY ALL"""


VIEWS: dict[str, str] = {
    "stations": f"SELECT * FROM (VALUES {_STATIONS}) t({V.STATION_COLUMNS})",
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "spine": """SELECT station_id, unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM ev), (SELECT date_trunc('hour', max(ts)) FROM ev),
      INTERVAL 1 HOUR)) AS timestamp_utc FROM stations""",
    "reports": """SELECT event_id AS report_id, event_type AS station_id, ts AS valid_ts, date_trunc('minute', ts) AS valid_minute,
      CASE WHEN k < 8 THEN '-TSRA BR' WHEN k < 12 THEN 'VCTS/HZ' WHEN k < 30 THEN 'M' WHEN k < 34 THEN '' ELSE 'HZ' END AS wxcodes
      FROM ev""",
    "bodies": f"""SELECT *, upper(station_id) || ' ' || strftime(valid_ts, '%d%H%M') || 'Z ' || ([{_BODIES}])[report_id % 8 + 1] AS metar
      FROM reports""",
    "atmos_sums": _sums("true"),
    "nwp_sums": _sums("true"),
    "atmos": f"SELECT station_id, timestamp_utc, {_weather()} FROM spine LEFT JOIN atmos_sums USING (station_id, timestamp_utc)",
    "nwp": f"""SELECT station_id, timestamp_utc, CASE WHEN s % 11 <> 0 THEN s / 10.0::DOUBLE END AS nwp_cape,
      CASE WHEN s % 13 <> 0 THEN lo / -100.0::DOUBLE END AS nwp_convective_inhibition,
      (5000 - s / n) / 1000.0::DOUBLE AS nwp_lifted_index, {_weather('nwp_')} FROM nwp_sums""",
    "scans": """SELECT event_type AS station_id, event_id AS gid, ts AS acq_end,
      least(round(value * 100), 60000.0::DOUBLE) / 60000.0::DOUBLE AS cloudy, k % 4 AS cmk FROM ev""",
    "pixels": """SELECT c_mktsegment AS scan_id, c_custkey AS row, c_custkey % 100 AS col, 5 + (c_custkey * 37 % 2600) / 100.0::DOUBLE AS lat,
      70 + (c_custkey * 53 % 2000) / 100.0::DOUBLE AS lon, CASE WHEN c_custkey % 5 = 4 THEN 9 ELSE c_custkey % 5 END AS cls FROM customer""",
    "strikes": """SELECT p_partkey AS point_id, (['event', 'group', 'flash'])[p_size % 3 + 1] AS lightning_type,
      (p_partkey * 3600)::DOUBLE AS tai93, CASE WHEN p_partkey % 97 = 0 THEN 0.0::DOUBLE ELSE 5 + (p_partkey * 41 % 2600) / 100.0::DOUBLE END AS lat,
      CASE WHEN p_partkey % 97 = 0 THEN 0.0::DOUBLE ELSE 70 + (p_partkey * 59 % 2000) / 100.0::DOUBLE END AS lon, p_brand AS granule FROM part""",
    "climate_grid": """SELECT s_suppkey AS cell_id, 5 + (s_suppkey * 37 % 104) / 4.0::DOUBLE AS grid_lat,
      70 + (s_suppkey * 53 % 80) / 4.0::DOUBLE AS grid_lon, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS annual_hours FROM supplier""",
    "series_day": """SELECT o_orderpriority AS station_id, o_orderdate AS timestamp_utc, count(*) AS n,
      sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL""",
    # labels
    "tokens": r"""SELECT *, CASE WHEN upper(trim(wxcodes)) = 'M' THEN [] ELSE
      list_filter(regexp_split_to_array(trim(wxcodes), '[/\s]+'), lambda t: t <> '') END AS toks FROM reports""",
    "flags": r"""SELECT *, len(toks) > 0 AS decodable,
      len(list_filter(toks, lambda t: regexp_matches(upper(t), '^[+-]*TS'))) > 0 AS ts_station,
      len(list_filter(toks, lambda t: regexp_matches(upper(t), '^[+-]*VC[+-]*TS'))) > 0 AS ts_vicinity FROM tokens""",
    "kept": """SELECT * FROM flags QUALIFY row_number() OVER (PARTITION BY station_id, valid_minute ORDER BY valid_ts, report_id) = 1""",
    "hour_counts": """SELECT station_id, date_trunc('hour', valid_ts) AS timestamp_utc, count(*) AS n_reports,
      count(*) FILTER (decodable) AS n_reports_with_wx, count(*) FILTER (ts_station OR ts_vicinity) AS n_ts_reports,
      count(*) FILTER (ts_station) AS n_station_reports FROM kept GROUP BY ALL""",
    "labels": """SELECT station_id, timestamp_utc, coalesce(n_reports, 0) AS n_reports, coalesce(n_reports_with_wx, 0) AS n_reports_with_wx,
      coalesce(n_ts_reports, 0) AS n_ts_reports,
      CASE WHEN n_reports_with_wx > 0 THEN (CASE WHEN n_ts_reports > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS target,
      CASE WHEN n_reports_with_wx > 0 THEN 1 ELSE 0 END AS target_observed,
      CASE WHEN coalesce(n_reports_with_wx, 0) = 0 THEN 'unavailable' WHEN n_ts_reports > 0 THEN 'observed_thunderstorm'
        ELSE 'observed_non_thunderstorm' END AS label_status
      FROM spine LEFT JOIN hour_counts USING (station_id, timestamp_utc)""",
    "targets": """SELECT l.*, l1.target AS target_1h, l2.target AS target_2h, l3.target AS target_3h FROM labels l
      LEFT JOIN labels l1 ON l1.station_id = l.station_id AND l1.timestamp_utc = l.timestamp_utc + INTERVAL 1 HOUR
      LEFT JOIN labels l2 ON l2.station_id = l.station_id AND l2.timestamp_utc = l.timestamp_utc + INTERVAL 2 HOUR
      LEFT JOIN labels l3 ON l3.station_id = l.station_id AND l3.timestamp_utc = l.timestamp_utc + INTERVAL 3 HOUR""",
    # scored table: probabilities follow from whole-number sums, so both engines agree exactly
    "predictions": """SELECT t.station_id, t.timestamp_utc,
      CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS data_status,
      CASE WHEN a.n IS NULL THEN 'insufficient_history' WHEN b.n IS NULL THEN 'missing_required_nwp' END AS unavailable_reason,
      CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN (a.s * 13 + b.s * 7) % 400 / 1000.0::DOUBLE END AS p_1h,
      CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN (a.s * 17 + b.sk * 3) % 500 / 1000.0::DOUBLE END AS p_2h,
      CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN (a.sk * 29 + b.s * 5) % 1000 / 1000.0::DOUBLE END AS p_3h,
      t.target_1h, t.target_2h, t.target_3h
      FROM targets t LEFT JOIN atmos_sums a ON a.station_id = t.station_id AND a.timestamp_utc = t.timestamp_utc
      LEFT JOIN nwp_sums b ON b.station_id = t.station_id AND b.timestamp_utc = t.timestamp_utc""",
    "alerts": """SELECT *, CASE WHEN p_1h IS NOT NULL THEN (p_1h >= 0.065::DOUBLE)::INT END AS alert_1h,
      CASE WHEN p_2h IS NOT NULL THEN (p_2h >= 0.065::DOUBLE)::INT END AS alert_2h,
      CASE WHEN p_3h IS NOT NULL THEN (p_3h >= 0.065::DOUBLE)::INT END AS alert_3h FROM predictions""",
    "long_scores": " UNION ALL ".join(
        f"""SELECT '{k}h' AS lead, station_id, timestamp_utc, p_{k}h AS p, alert_{k}h AS alert, target_{k}h::INT AS y,
      CASE WHEN alert_{k}h = 1 AND target_{k}h = 1 THEN 'TP' WHEN alert_{k}h = 1 AND target_{k}h = 0 THEN 'FP'
        WHEN alert_{k}h = 0 AND target_{k}h = 1 THEN 'FN' WHEN alert_{k}h = 0 AND target_{k}h = 0 THEN 'TN' END AS verdict FROM alerts"""
        for k in V.LEADS
    ),
    "scored": "SELECT * FROM long_scores WHERE verdict IS NOT NULL",
    # episodes
    "positives": """SELECT station_id, timestamp_utc, CASE WHEN timestamp_utc - lag(timestamp_utc) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
      FROM labels WHERE target = 1 WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc)""",
    "episodes": """SELECT station_id, min(timestamp_utc) AS event_start, max(timestamp_utc) AS event_end, count(*) AS n_hours,
      (date_diff('hour', min(timestamp_utc), max(timestamp_utc)) + 1)::DOUBLE AS duration_h FROM
      (SELECT *, sum(fresh) OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS island FROM positives) GROUP BY station_id, island""",
    # scan alignment
    "scan_times": "SELECT station_id, acq_end, min(gid) AS gid FROM scans GROUP BY ALL",
    "aligned": """SELECT h.station_id, h.timestamp_utc, s.acq_end, s.gid, s.cloudy, s.cmk,
      CASE WHEN s.gid IS NOT NULL THEN 1 ELSE 0 END AS sat_available,
      CASE WHEN s.gid IS NOT NULL THEN date_diff('microsecond', s.acq_end, h.timestamp_utc) / 60000000.0::DOUBLE END AS age_minutes
      FROM spine h LEFT JOIN (SELECT * FROM (SELECT h.station_id, h.timestamp_utc, c.acq_end, c.gid, c.cloudy, c.cmk,
          row_number() OVER (PARTITION BY h.station_id, h.timestamp_utc ORDER BY c.acq_end DESC, c.gid) AS rn
        FROM spine h JOIN scans c ON c.station_id = h.station_id AND c.acq_end <= h.timestamp_utc
          AND c.acq_end >= h.timestamp_utc - INTERVAL 90 MINUTE) WHERE rn = 1) s USING (station_id, timestamp_utc)""",
}


def with_views(body: str) -> str:
    """The query with every view it needs, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    inner = f"SELECT * FROM ({body})" if body.upper().startswith("WITH") else body
    return f"WITH {ctes}\n{inner}" if ctes else body
