"""The sample views as SQL common table expressions, in the dialect of the checking engine."""

SENSORS = """sensors AS (
  SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS object_id,
         CAST(floor(floor(epoch(ts)) / 900) * 900 AS BIGINT) AS ts_measurement,
         20.0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS t_supply,
         0.6 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS t_return,
         value / 10.0 AS p_supply, value / 20.0 AS p_return,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts_recorded
  FROM events)"""

# readings as they are stored: implausible channels are missing
STORED = f"""{SENSORS}, clean AS (SELECT record_id, object_id, ts_measurement,
    CASE WHEN t_supply BETWEEN 0 AND 150 THEN t_supply END AS t_supply,
    CASE WHEN t_return BETWEEN 0 AND 150 THEN t_return END AS t_return,
    CASE WHEN p_supply BETWEEN 0 AND 25 THEN p_supply END AS p_supply,
    CASE WHEN p_return BETWEEN 0 AND 25 THEN p_return END AS p_return, ts_recorded FROM sensors)"""

INCIDENTS = """incidents AS (
  SELECT CAST(event_id AS VARCHAR) AS incident_id, CAST(user_id AS VARCHAR) AS object_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS incident_ts,
         CASE WHEN event_id % 3 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 3600 END AS close_ts,
         event_type AS source
  FROM events WHERE event_type = 'error')"""

# what the models learn from
SEVERE_INCIDENTS = INCIDENTS.replace("event_type = 'error')", "event_type = 'error' AND value > 150)")

WEATHER = """weather AS (
  SELECT CAST(ts AS DATE) AS date, avg(value) - 60.0 AS t_out_mean, min(value) - 60.0 AS t_out_min,
         max(value) - 60.0 AS t_out_max
  FROM events GROUP BY CAST(ts AS DATE))"""

META = """meta AS (
  SELECT CAST(c_custkey AS VARCHAR) AS object_id, CASE WHEN c_custkey % 4 <> 0 THEN r_name END AS object_type,
         c_mktsegment AS facility_type, c_name AS facility_name, n_name AS municipality, r_name AS rso
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CATALOG = """catalog AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS object_id, 'ЦТП-' || CAST(s_suppkey AS VARCHAR) AS facility_name,
         n_name AS municipality
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CLAIMS = """claims AS (
  SELECT o_orderkey AS id_cds_claim, n_name || ' г.о.' AS name_mr,
         'утечка на ЦТП № ' || CAST(o_custkey % 120 AS VARCHAR) AS text_message, o_orderdate AS d_create,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS d_close, o_orderstatus = 'F' AS obj_koteln,
         o_orderstatus <> 'P' AS obj_ctp, o_orderstatus = 'P' AS obj_ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

PANEL = """panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS object_id, CAST(l_shipdate AS DATE) AS date,
         avg(l_quantity) AS p_supply_mean, avg(l_discount) AS dp_mean, avg(l_tax) AS dt_mean,
         avg(l_extendedprice) / 1000.0 AS t_supply_mean, count(*) AS n_samples,
         CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS ord
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""

SCORES = """scores AS (
  SELECT CAST(user_id AS VARCHAR) AS object_id, CAST(ts AS DATE) AS date, max(value) / 500.0 AS score
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

# the next incident at or after the start of the day, hours counted from the end of the day
SCORED = f"""{SCORES}, {SEVERE_INCIDENTS}, scored AS (
  SELECT s.object_id, s.date, s.score,
         CASE WHEN n.nxt IS NULL THEN NULL
              WHEN (n.nxt - epoch(CAST(s.date AS TIMESTAMP)) - 86400) / 3600.0 > 0
              THEN (n.nxt - epoch(CAST(s.date AS TIMESTAMP)) - 86400) / 3600.0 ELSE CAST(0.01 AS DOUBLE)
         END AS t_to_failure
  FROM scores s LEFT JOIN (
    SELECT s2.object_id, s2.date, min(i.incident_ts) AS nxt
    FROM scores s2 JOIN incidents i ON i.object_id = s2.object_id
     AND i.incident_ts >= epoch(CAST(s2.date AS TIMESTAMP))
    GROUP BY s2.object_id, s2.date) n ON n.object_id = s.object_id AND n.date = s.date)"""

DAY = "(DATE '1970-01-01' + CAST(floor(ts_recorded / 86400) AS INTEGER))"
HOUR = "((ts_recorded % 86400) // 3600)"

CLEANED = f"""{SENSORS}, cleaned AS (
  SELECT object_id, ts_measurement, ts_recorded,
         CASE WHEN t_supply BETWEEN 1 AND 150 THEN t_supply END AS t_supply,
         CASE WHEN t_return BETWEEN 1 AND 150 THEN t_return END AS t_return,
         CASE WHEN p_supply BETWEEN 0.1 AND 40 THEN p_supply END AS p_supply,
         CASE WHEN p_return BETWEEN 0.1 AND 40 THEN p_return END AS p_return
  FROM sensors WHERE ts_recorded >= epoch(TIMESTAMP '2024-01-01'))"""

DEDUPED = f"""{CLEANED}, deduped AS (
  SELECT object_id, ts_measurement, avg(t_supply) AS t_supply, avg(t_return) AS t_return,
         avg(p_supply) AS p_supply, avg(p_return) AS p_return, min(ts_recorded) AS ts_recorded
  FROM cleaned GROUP BY object_id, ts_measurement)"""

SIGNALS = ["t_supply", "t_return", "p_supply", "p_return", "dp", "dt"]


def _skew(c: str) -> str:
    return f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE skewness({c}) END"


_MOMENTS = ",\n         ".join(f"avg({s}) AS {s}_mean, stddev_samp({s}) AS {s}_std, min({s}) AS {s}_min, max({s}) AS {s}_max"
                             for s in SIGNALS)

INTRADAY = f"""{DEDUPED}, readings AS (
  SELECT object_id, {DAY} AS date, {HOUR} AS h, t_supply, t_return, p_supply, p_return,
         p_supply - p_return AS dp, t_supply - t_return AS dt FROM deduped), rolled AS (
  SELECT object_id, date, {_MOMENTS},
         quantile_cont(p_supply, 0.5) AS p_supply_median, {_skew("p_supply")} AS p_supply_skew,
         {_skew("dp")} AS dp_skew,
         avg(CASE WHEN h >= 0 AND h < 6 THEN dp END) AS dp_night, avg(CASE WHEN h >= 10 AND h < 20 THEN dp END) AS dp_day,
         avg(CASE WHEN h >= 0 AND h < 6 THEN dt END) AS dt_night, avg(CASE WHEN h >= 10 AND h < 20 THEN dt END) AS dt_day,
         avg(CASE WHEN h >= 0 AND h < 6 THEN p_supply END) AS ps_night,
         avg(CASE WHEN h >= 10 AND h < 20 THEN p_supply END) AS ps_day, count(*) AS n_samples
  FROM readings GROUP BY object_id, date), intraday AS (
  SELECT *, dp_night / nullif(dp_day, 0) AS dp_night_ratio, dt_night / nullif(dt_day, 0) AS dt_night_ratio,
         ps_day - ps_night AS p_drop_night, p_supply_max - p_supply_min AS p_supply_range,
         p_supply_min / nullif(p_supply_mean, 0) AS p_supply_min_to_mean,
         p_supply_median - p_supply_min AS p_supply_drop_depth_intraday, dp_max - dp_min AS dp_range
  FROM rolled)"""

DAILY = f"""{WEATHER}, {INTRADAY}, daily AS (
  SELECT d.*, w.t_out_mean, sin(2 * pi() * month(d.date) / 12) AS sin_month,
         cos(2 * pi() * month(d.date) / 12) AS cos_month,
         sin(2 * pi() * (isodow(d.date) - 1) / 7) AS sin_weekday,
         cos(2 * pi() * (isodow(d.date) - 1) / 7) AS cos_weekday,
         CAST(n_samples < 6 AS INTEGER) AS low_coverage, d.date - DATE '1970-01-01' AS ord
  FROM intraday d LEFT JOIN weather w ON d.date = w.date)"""
