"""Landed layouts, arrival cleaning and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.text import norm_number
from fieldpulse.functions.values import first_number, to_epoch
from fieldpulse.operators import cleaning as C
from fieldpulse.operators import merge as M
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.plans.jobs import Store, ingest_staged
from fieldpulse.plans.queries_store import META, SENSOR, WEATHER
from fieldpulse.schemas import SENSORS
from fieldpulse.session import scratch
from fieldpulse.sources import landing as L
from fieldpulse.sources.star_views import StarViews

STATS = {"inserted": "BIGINT", "skipped_duplicates": "BIGINT"}
SPLIT_OLD, SPLIT_NEW = 1705708800, 1704844800  # the store ends on 2024-01-20, the upload starts on 2024-01-10


def layout_a(v: StarViews) -> DataFrame:
    """Events as an upload in layout A: text columns, two date spellings, bad numbers, shifted rows."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    stamp = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss")
    serial = (F.col("epoch") / 86400.0 + 25569).cast("string")
    shifted = F.col("event_type") == "view"
    kind = F.col("event_type")
    return v.events().select(
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")).alias("ID"),
        F.when(kind == "signup", F.lit("n/a")).otherwise(stamp).alias("Дата и время показателей"),
        F.when(kind == "error", F.lit("-")).otherwise(k).alias("T пр"), F.lit("").alias("T обр"),
        (F.col("value") / 10).cast("string").alias("P пр"), F.lit("nan").alias("P обр"),
        F.when(kind == "click", serial).otherwise(stamp).alias("Дата и время записи"),
        F.col("user_id").cast("string").alias("ID объекта"),
        F.when(shifted, F.concat(F.lit("D"), (F.col("user_id") % 7).cast("string"), F.lit(" г.о."))).otherwise(kind).alias("Тип объекта"),
        F.when(shifted, F.lit(" МКД ")).otherwise(F.lit("ЦТП")).alias("Котельная/ЦТП"),
        F.concat(F.lit("ЦТП-"), F.col("user_id").cast("string")).alias("Наименование объекта"),
        F.lit(None).cast("string").alias("Муниципалитет"), F.col("event_id").cast("string").alias("#"))


def layout_b(v: StarViews) -> DataFrame:
    """Events as an upload in layout B; the ids overlap with layout A."""
    e = v.events()
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss").alias("data"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("t_forward"), F.lit("300").alias("t_revers"),
        (F.col("value") / 10).cast("string").alias("p_forward"), F.lit(None).cast("string").alias("p_revers"),
        F.col("user_id").cast("string").alias("object_id"), F.lit("котельная").alias("name_koteln"),
        F.concat(F.lit("D"), (F.col("user_id") % 7).cast("string")).alias("name_mr"))


_A = """a AS (SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS object_id,
    CASE WHEN event_type <> 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS ts_measurement,
    CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS t_supply,
    CAST(NULL AS DOUBLE) AS t_return, value / 10 AS p_supply, CAST(NULL AS DOUBLE) AS p_return,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts_recorded FROM events)"""
_A_META = """am AS (SELECT CAST(user_id AS VARCHAR) AS object_id,
    CASE WHEN event_type = 'view' THEN 'МКД' ELSE event_type END AS object_type,
    CASE WHEN event_type <> 'view' THEN 'ЦТП' END AS facility_type, 'ЦТП-' || CAST(user_id AS VARCHAR) AS facility_name,
    CASE WHEN event_type = 'view' THEN 'D' || CAST(user_id % 7 AS VARCHAR) || ' г.о.' END AS municipality,
    CAST(NULL AS VARCHAR) AS rso FROM events)"""
_B = """b AS (SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS object_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts_measurement, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS t_supply,
    CAST(300 AS DOUBLE) AS t_return, value / 10 AS p_supply, CAST(NULL AS DOUBLE) AS p_return,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts_recorded FROM events)"""
_CLEAN = """clean AS (SELECT record_id, object_id, coalesce(ts_measurement, ts_recorded) AS ts_measurement,
    CASE WHEN t_supply BETWEEN 0 AND 150 THEN t_supply END AS t_supply,
    CASE WHEN t_return BETWEEN 0 AND 150 THEN t_return END AS t_return,
    CASE WHEN p_supply BETWEEN 0 AND 25 THEN p_supply END AS p_supply,
    CASE WHEN p_return BETWEEN 0 AND 25 THEN p_return END AS p_return, ts_recorded FROM landed),
    kept AS (SELECT * FROM clean WHERE coalesce(t_supply, t_return, p_supply, p_return) IS NOT NULL)"""


@query("normalize_layout_a", f"WITH {_A} SELECT_FINAL * FROM a", **SENSOR)
def normalize_a(v):
    return L.normalize_a(layout_a(v))[0]


@query("repair_shifted", f"WITH {_A_META} SELECT_FINAL * FROM am", **META)
def shifted(v):
    return L.normalize_a(layout_a(v))[1]


@query("normalize_layout_b", f"WITH {_B} SELECT_FINAL * FROM b", **SENSOR)
def normalize_b(v):
    return L.normalize_b(layout_b(v))[0]


@query("layout_b_objects", """SELECT CAST(user_id AS VARCHAR) AS object_id, NULL AS object_type, NULL AS facility_type,
       'котельная' AS facility_name, 'D' || CAST(user_id % 7 AS VARCHAR) AS municipality, NULL AS rso FROM events""",
       **META)
def layout_b_objects(v):
    return L.normalize_b(layout_b(v))[1]


@query("mixed_dates", f"WITH {_A} SELECT_FINAL record_id, ts_measurement, ts_recorded FROM a",
       record_id="VARCHAR", ts_measurement="BIGINT", ts_recorded="BIGINT")
def mixed_dates(v):
    return L.normalize(layout_a(v))[0].select("record_id", "ts_measurement", "ts_recorded")


@query("clean_ingest", f"WITH {_A}, landed AS (SELECT * FROM a), {_CLEAN} SELECT_FINAL * FROM kept", **SENSOR)
def clean_ingest(v):
    return C.clean_ingest(L.normalize_a(layout_a(v))[0])


@query("union_sources", f"""WITH {_A}, {_B}, landed AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_CLEAN}
       SELECT_FINAL record_id, object_id, ts_measurement, ts_recorded, t_supply, t_return, p_supply, p_return FROM (
       SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts_recorded, object_id, ts_measurement,
         t_supply NULLS FIRST, t_return NULLS FIRST, p_supply NULLS FIRST, p_return NULLS FIRST) AS n FROM kept)
       WHERE n = 1""", **SENSOR)
def union_sources(v):
    return L.union_sources([layout_a(v), layout_b(v)])[0]


@query("dedup_records", f"""WITH {V.SENSORS}, twice AS (SELECT * FROM sensors UNION ALL
       SELECT record_id, object_id, ts_measurement, t_supply, t_return, p_supply, p_return, ts_recorded + 60 FROM sensors)
       SELECT_FINAL * FROM twice QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ts_recorded) = 1""", **SENSOR)
def dedup_records(v):
    s = v.sensors()
    return C.dedup_records(s.unionByName(s.withColumn("ts_recorded", F.col("ts_recorded") + 60)))


@query("meta_dedup", f"""WITH {_A_META} SELECT_FINAL * FROM am QUALIFY row_number() OVER (PARTITION BY object_id
       ORDER BY object_type NULLS LAST, facility_type NULLS FIRST, facility_name, municipality NULLS FIRST) = 1""", **META)
def meta_dedup(v):
    return C.dedup_objects(L.normalize_a(layout_a(v))[1])


def _upload(v: StarViews) -> tuple[DataFrame, DataFrame]:
    """(store, upload): the store ends on the 20th, the upload starts on the 10th."""
    s = v.sensors()
    return s.where(F.col("ts_recorded") < SPLIT_OLD), s.where(F.col("ts_recorded") >= SPLIT_NEW)


_UPLOAD = f"""{V.SENSORS}, store AS (SELECT * FROM sensors WHERE ts_recorded < {SPLIT_OLD}),
    upload AS (SELECT * FROM sensors WHERE ts_recorded >= {SPLIT_NEW}),
    fresh AS (SELECT * FROM upload WHERE record_id NOT IN (SELECT record_id FROM store))"""


@query("insert_new", f"WITH {_UPLOAD} SELECT_FINAL * FROM fresh", **SENSOR)
def insert_new(v):
    store, upload = _upload(v)
    return M.insert_new(store, C.dedup_records(upload), "record_id")


@query("insert_indexed", f"WITH {V.STORED} SELECT_FINAL * FROM clean", **SENSOR)
def insert_indexed(v):
    """Two staged uploads through the index of ids; the store they leave behind."""
    store = Store(v.spark, scratch(v.spark, "indexed"))
    for name, part in zip(("first", "second"), _upload(v)):
        part.write.parquet(f"{store.root}/staged/{name}")
        ingest_staged(store, [f"{store.root}/staged/{name}"])
    return store.sensors().select(*SENSORS.names)


@query("insert_stats", f"""WITH {_UPLOAD} SELECT_FINAL (SELECT count(*) FROM fresh) AS inserted,
       (SELECT count(*) FROM upload) - (SELECT count(*) FROM fresh) AS skipped_duplicates""", **STATS)
def insert_stats(v):
    store, upload = _upload(v)
    batch = C.dedup_records(upload)
    return M.merge_stats(batch, M.insert_new(store, batch, "record_id"))


@query("ingest_stats", f"""WITH {_UPLOAD}, {V.META}, old AS (SELECT DISTINCT object_id FROM store)
       SELECT_FINAL (SELECT count(*) FROM fresh) AS sensors_inserted,
       (SELECT count(*) FROM upload) - (SELECT count(*) FROM fresh) AS sensors_duplicates,
       (SELECT count(*) FROM meta WHERE object_id NOT IN (SELECT object_id FROM old)) AS objects_upserted,
       (SELECT min(ts_recorded) FROM upload) AS period_from, (SELECT max(ts_recorded) FROM upload) AS period_to,
       (SELECT count(DISTINCT object_id) FROM upload) AS objects_count""",
       sensors_inserted="BIGINT", sensors_duplicates="BIGINT", objects_upserted="BIGINT", period_from="BIGINT",
       period_to="BIGINT", objects_count="BIGINT")
def ingest_stats(v):
    store, upload = _upload(v)
    batch = C.dedup_records(upload)
    objects = M.insert_new(store.select("object_id"), C.dedup_objects(v.objects_meta()), "object_id")
    return M.ingest_stats(batch, M.insert_new(store, batch, "record_id"), objects)


@query("meta_upsert", f"""WITH {V.META}, {_A_META}, firsts AS (SELECT * FROM am QUALIFY row_number() OVER (
         PARTITION BY object_id ORDER BY object_type NULLS LAST, facility_type NULLS FIRST, facility_name,
         municipality NULLS FIRST) = 1)
       SELECT_FINAL * FROM (SELECT * FROM meta UNION ALL
         SELECT * FROM firsts WHERE object_id NOT IN (SELECT object_id FROM meta))""", **META)
def meta_upsert(v):
    """Stored objects win; an upload only adds unknown ones."""
    store = v.objects_meta()
    batch = C.dedup_objects(L.normalize_a(layout_a(v))[1])
    return M.merged(store, M.insert_new(store, batch, "object_id"))


@query("incident_insert", f"""WITH {V.INCIDENTS} SELECT_FINAL * FROM incidents
       WHERE incident_id NOT IN (SELECT incident_id FROM incidents WHERE incident_ts < {SPLIT_OLD})""",
       incident_id="VARCHAR", object_id="VARCHAR", incident_ts="BIGINT", close_ts="BIGINT", source="VARCHAR")
def incident_insert(v):
    i = v.incidents()
    batch = C.pick_row(i, ["incident_id"], ["incident_ts"])
    return M.insert_new(i.where(F.col("incident_ts") < SPLIT_OLD), batch, "incident_id")


@query("partial_update", f"""WITH {V.META} SELECT_FINAL m.object_id, coalesce(c.t, m.object_type) AS object_type,
       m.facility_type, coalesce('renamed ' || CAST(c.s_suppkey AS VARCHAR), m.facility_name) AS facility_name,
       m.municipality, m.rso FROM meta m LEFT JOIN (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'rich' END AS t
       FROM supplier) c ON m.object_id = CAST(c.s_suppkey AS VARCHAR)""", **META)
def partial_update(v):
    updates = v.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("object_id"),
        F.when(F.col("s_acctbal") > 5000, F.lit("rich")).alias("object_type"),
        F.concat(F.lit("renamed "), F.col("s_suppkey").cast("string")).alias("facility_name"))
    return M.apply_updates(v.objects_meta(), updates)


# the archive is corrected afterwards: each event is a newer report of its day
@query("weather_upsert", f"""WITH {V.WEATHER}, old AS (SELECT * FROM weather WHERE date < DATE '2024-01-20'),
       batch AS (SELECT CAST(ts AS DATE) AS date, value - 60.0 AS t_out_mean, value - 61.0 AS t_out_min,
                 value - 59.0 AS t_out_max, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
       latest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY date ORDER BY event_id DESC) = 1)
       SELECT_FINAL * FROM (SELECT date, t_out_mean, t_out_min, t_out_max FROM latest UNION ALL
       SELECT * FROM old WHERE date NOT IN (SELECT date FROM latest))""", **WEATHER)
def weather_upsert(v):
    return M.upsert_latest(*_weather(v), "date", "event_id")


def _weather(v: StarViews) -> tuple[DataFrame, DataFrame]:
    day = F.col("ts").cast("date")
    batch = v.table("events").where(day >= F.lit("2024-01-10").cast("date")).select(
        day.alias("date"), (F.col("value") - 60.0).alias("t_out_mean"), (F.col("value") - 61.0).alias("t_out_min"),
        (F.col("value") - 59.0).alias("t_out_max"), "event_id")
    return v.weather().where(F.col("date") < F.lit("2024-01-20").cast("date")), batch


@query("weather_upsert_stats", f"""WITH {V.WEATHER}, old AS (SELECT * FROM weather WHERE date < DATE '2024-01-20'),
       batch AS (SELECT DISTINCT date FROM weather WHERE date >= DATE '2024-01-10')
       SELECT_FINAL count(*) FILTER (date NOT IN (SELECT date FROM old)) AS added,
       count(*) FILTER (date IN (SELECT date FROM old)) AS updated FROM batch""", added="BIGINT", updated="BIGINT")
def weather_upsert_stats(v):
    return M.upsert_stats(*_weather(v), "date")


@query("mixed_dates_all", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
       event_id="BIGINT", seconds="BIGINT")
def mixed_dates_all(v):
    """Every event's moment in one of seven spellings, read back."""
    e = v.events().withColumn("at", F.timestamp_seconds("epoch"))
    spelled = [F.date_format("at", p) for p in (
        "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "d.M.yyyy H:mm:ss", "M/d/yyyy H:mm:ss", "yyyy/M/d H:mm:ss")]
    spelled += [(F.col("epoch") / 86400.0 + 25569).cast("string"),
                F.concat(F.lit(" \t"), F.date_format("at", "d.M.yyyy H:mm:ss"), F.lit("\u00a0"))]
    text = F.element_at(F.array(*spelled), (F.col("event_id") % len(spelled) + 1).cast("int"))
    return e.select("event_id", to_epoch(text).alias("seconds"))


@query("first_number_numeric", """SELECT event_id, value / 100000.0 * 100000.0 AS small, value * 1000000.0 AS large,
       value AS written FROM events""", event_id="BIGINT", small="d", large="d", written="d")
def first_number_numeric(v):
    """Numbers that text spells with an exponent, and numbers inside a text."""
    written = F.concat(F.lit("about "), F.col("value").cast("string"), F.lit(" h"))
    return v.events().select(
        "event_id", (first_number(F.col("value") / 100000.0) * 100000.0).alias("small"),
        first_number(F.col("value") * 1000000.0).alias("large"), first_number(written).alias("written"))


@query("norm_number_spaces", "SELECT o_orderkey, CAST(o_custkey % 120 AS VARCHAR) AS number FROM orders",
       o_orderkey="BIGINT", number="VARCHAR")
def norm_number_spaces(v):
    """Plant names with white space of several kinds around the number."""
    gap = F.element_at(F.array(*[F.lit(x) for x in (" ", "\t", "\u00a0", "\u2003", "")]),
                       (F.col("o_orderkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("ЦТП"), gap, F.lit("№"), gap, (F.col("o_custkey") % 120).cast("string"), gap)
    return v.table("orders").select("o_orderkey", norm_number(name).alias("number"))
