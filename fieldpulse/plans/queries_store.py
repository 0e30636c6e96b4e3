"""Calendar, coverage, catalogue and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions.values import json_rows
from fieldpulse.operators import store as S
from fieldpulse.operators import weather as W
from fieldpulse.operators.merge import missing_days
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.schemas import OBJECTS, SENSORS

META = {c: "VARCHAR" for c in OBJECTS.names}
SENSOR = {f.name: {"string": "VARCHAR", "bigint": "BIGINT", "double": "d"}[f.dataType.simpleString()]
          for f in SENSORS.fields}
INCIDENT = {"incident_id": "VARCHAR", "object_id": "VARCHAR", "incident_ts": "BIGINT", "close_ts": "BIGINT",
            "source": "VARCHAR"}
FROM, TO = 1704672000, 1705276800  # 2024-01-08 and 2024-01-15, midnight


@query("coverage_summary", f"""WITH {V.SENSORS} SELECT_FINAL {V.DAY} AS date, count(DISTINCT object_id) AS objects_count
       FROM sensors GROUP BY 1""", date="DATE", objects_count="BIGINT")
def coverage(v):
    return S.coverage_summary(v.sensors())


@query("coverage_period", f"""WITH {V.SENSORS} SELECT_FINAL {V.DAY} AS date, count(DISTINCT object_id) AS objects_count
       FROM sensors WHERE {V.DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""",
       date="DATE", objects_count="BIGINT")
def coverage_period(v):
    return S.coverage_summary(v.sensors(), "2024-01-05", "2024-01-20")


@query("object_calendar", f"WITH {V.SENSORS} SELECT_FINAL DISTINCT object_id, {V.DAY} AS date FROM sensors",
       object_id="VARCHAR", date="DATE")
def calendar(v):
    return S.object_calendar(v.sensors())


@query("prev_next_day", f"""WITH {V.SENSORS}, days AS (SELECT DISTINCT object_id, {V.DAY} AS date FROM sensors)
       SELECT_FINAL object_id, date, lag(date) OVER (PARTITION BY object_id ORDER BY date) AS prev_day,
       lead(date) OVER (PARTITION BY object_id ORDER BY date) AS next_day FROM days""",
       object_id="VARCHAR", date="DATE", prev_day="DATE", next_day="DATE")
def neighbours(v):
    return S.neighbour_days(v.sensors())


@query("store_health", f"""WITH {V.SENSORS} SELECT_FINAL count(*) AS sensors_count, min({V.DAY}) AS period_from,
       max({V.DAY}) AS period_to FROM sensors""", sensors_count="BIGINT", period_from="DATE", period_to="DATE")
def health(v):
    return S.store_health(v.sensors())


@query("incident_health", f"""WITH {V.INCIDENTS} SELECT_FINAL count(*) AS incidents_count,
       count(DISTINCT object_id) AS incidents_objects FROM incidents""",
       incidents_count="BIGINT", incidents_objects="BIGINT")
def incident_health(v):
    return S.incident_health(v.incidents())


@query("table_health", f"""WITH {V.SCORES} SELECT_FINAL count(*) AS rows, count(DISTINCT object_id) AS objects,
       min(date) AS date_from, max(date) AS date_to FROM scores""",
       rows="BIGINT", objects="BIGINT", date_from="DATE", date_to="DATE")
def table_health(v):
    return S.table_health(v.scores())


@query("weather_health", f"""WITH {V.WEATHER} SELECT_FINAL count(*) AS rows, CAST(NULL AS BIGINT) AS objects,
       min(date) AS date_from, max(date) AS date_to FROM weather""",
       rows="BIGINT", objects="BIGINT", date_from="DATE", date_to="DATE")
def weather_health(v):
    return S.table_health(v.weather())


@query("incident_objects", f"WITH {V.INCIDENTS} SELECT_FINAL DISTINCT object_id FROM incidents", object_id="VARCHAR")
def incident_objects(v):
    return S.incident_objects(v.incidents())


@query("incidents_between", f"""WITH {V.INCIDENTS} SELECT_FINAL * FROM incidents
       WHERE incident_ts >= {FROM} AND incident_ts <= {TO}""", **INCIDENT)
def incidents_between(v):
    return S.incidents_between(v.incidents(), from_ts=FROM, to_ts=TO)


@query("sensors_between", f"""WITH {V.SENSORS} SELECT_FINAL * FROM sensors
       WHERE ts_recorded >= {FROM} AND ts_recorded <= {TO}""", **SENSOR)
def sensors_between(v):
    return S.sensors_between(v.sensors(), from_ts=FROM, to_ts=TO)


@query("object_sensors", f"""WITH {V.SENSORS} SELECT_FINAL * FROM sensors WHERE object_id = '7'
       AND ts_recorded >= {FROM} AND ts_recorded <= {TO}""", **SENSOR)
def object_sensors(v):
    return S.sensors_between(v.sensors(), "7", FROM, TO)


@query("page_sensors", f"""WITH {V.SENSORS} SELECT_FINAL *, (SELECT count(*) FROM sensors) AS total FROM sensors
       ORDER BY ts_recorded, record_id LIMIT 500 OFFSET 1500""", **SENSOR, total="BIGINT")
def page_sensors(v):
    rows, total = S.page(v.sensors(), ["ts_recorded", "record_id"], 1500, 500)
    return rows.withColumn("total", total.scalar())


@query("page_after", f"""WITH {V.SENSORS}, seen AS (SELECT ts_recorded AS t, record_id AS r FROM sensors
       ORDER BY 1, 2 LIMIT 1 OFFSET 1499) SELECT_FINAL sensors.* FROM sensors, seen
       WHERE ts_recorded > t OR (ts_recorded = t AND record_id > r) ORDER BY ts_recorded, record_id LIMIT 500""", **SENSOR)
def page_after(v):
    """The fourth page of 500, reached from the last row of the third."""
    keys, last = ["ts_recorded", "record_id"], None
    for _ in range(3):
        rows = S.page_after(v.sensors(), keys, last, 500) if last else S.page(v.sensors(), keys, 0, 500)[0]
        end = rows.agg(F.max(F.struct(*keys)).alias("m")).first()["m"]
        last = (end["ts_recorded"], end["record_id"]) if end else last
    return S.page_after(v.sensors(), keys, last, 500) if last else v.sensors().limit(0)


@query("objects_on_day", f"""WITH {V.SENSORS}, {V.META} SELECT_FINAL a.object_id, m.* EXCLUDE (object_id)
       FROM (SELECT DISTINCT object_id FROM sensors WHERE {V.DAY} = DATE '2024-01-15') a
       LEFT JOIN meta m ON a.object_id = m.object_id""", **META)
def objects_on_day(v):
    return S.objects_on_day(v.sensors(), v.objects_meta(), "2024-01-15")


@query("search_objects", f"""WITH {V.META} SELECT_FINAL * FROM meta WHERE municipality = 'NATION_3'
       AND facility_type = 'BUILDING' AND facility_name ILIKE '%CUSTOMER#%'""", **META)
def search(v):
    return S.search_objects(v.objects_meta(), "NATION_3", "BUILDING", "CUSTOMER#")


@query("object_by_id", f"WITH {V.META} SELECT_FINAL * FROM meta WHERE object_id = '42'", **META)
def object_by_id(v):
    return S.object_by_id(v.objects_meta(), "42")


WEATHER = {"date": "DATE", "t_out_mean": "d", "t_out_min": "d", "t_out_max": "d"}


@query("weather_between", f"""WITH {V.WEATHER} SELECT_FINAL * FROM weather
       WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""", **WEATHER)
def weather_between(v):
    return S.weather_between(v.weather(), "2024-01-03", "2024-01-25")


@query("heating_degree", f"""WITH {V.WEATHER} SELECT_FINAL *, greatest(0, 18 - t_out_mean) AS heating_degree
       FROM weather""", **WEATHER, heating_degree="d")
def heating(v):
    return v.weather().withColumn("heating_degree", W.heating_degree())


@query("missing_days", f"""WITH {V.WEATHER}, span AS (
       SELECT CAST(unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS date)
       SELECT_FINAL date FROM span WHERE date NOT IN (SELECT date FROM weather)""", date="DATE")
def missing(v):
    return missing_days(v.weather(), "2023-12-20", "2024-02-10")


# every scored day's raw readings; midnight readings would show on two days
@query("day_profiles", f"""WITH {V.SENSORS}, pairs AS (
         SELECT s.*, {V.DAY} AS date FROM sensors s UNION ALL
         SELECT s.*, {V.DAY} - 1 AS date FROM sensors s WHERE ts_recorded % 86400 = 0),
       wanted AS (SELECT CAST(user_id AS VARCHAR) AS object_id, CAST(ts AS DATE) AS date FROM events
                  GROUP BY 1, 2 HAVING max(value) > 100)
       SELECT_FINAL p.* FROM pairs p JOIN wanted w ON p.object_id = w.object_id AND p.date = w.date""",
       object_id="VARCHAR", date="DATE", ts_recorded="BIGINT", t_supply="d", t_return="d", p_supply="d", p_return="d")
def day_profiles(v):
    wanted = v.scores().where(F.col("score") > 100 / 500.0).select("object_id", "date")
    return S.day_profiles(v.sensors(), wanted)


@query("json_safe", f"""WITH {V.META} SELECT_FINAL count(*) AS rows,
       sum(CASE WHEN object_type IS NULL THEN 1 ELSE 0 END) AS nulls FROM meta""", rows="BIGINT", nulls="BIGINT")
def json_safe(v):
    """Rows written as JSON; a missing value and an infinite one both read back as null."""
    shown = v.objects_meta().withColumn("x", F.when(F.col("object_type").isNull(), float("nan")).otherwise(float("inf")))
    back = F.from_json("json", "object_id string, object_type string, x double")
    rows = json_rows(shown).select(back.alias("r"))
    return rows.agg(F.count_if(F.col("r.x").isNull()).alias("rows"), F.count_if(F.col("r.object_type").isNull()).alias("nulls"))
