"""Streaming counterparts run over the whole event table, compared on the tables they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.operators import coverage as G
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.plans.queries_store import SENSOR
from fieldpulse.schemas import SENSORS
from fieldpulse.session import cut_lineage, scratch
from fieldpulse.sources.star_views import StarViews
from fieldpulse.streaming import ingest as S
from fieldpulse.streaming import stateful as R


class _StreamViews(StarViews):
    """The same views over a stream of the event files."""

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _streamed(v: StarViews) -> DataFrame:
    return _StreamViews(v.spark, v.folder).sensors()


def _halves(v: StarViews, rows: DataFrame, order: str, name: str, run) -> str:
    """Land the later half of the rows and run, then land the earlier half, all of it late, and run again; the folder."""
    path = scratch(v.spark, name)
    middle = rows.agg(F.percentile_approx(order, 0.5)).first()[0]
    for half in (F.col(order) > F.lit(middle), F.col(order) <= F.lit(middle)):
        rows.where(half).write.mode("append").parquet(f"{path}/landing")
        stream = v.spark.readStream.schema(rows.schema).parquet(f"{path}/landing")
        run(stream, path).awaitTermination()
    return path


def _revisions(v: StarViews, rows: DataFrame, order: str, name: str, revise) -> DataFrame:
    path = _halves(v, rows, order, name, lambda s, p: S.write_table(revise(s), f"{p}/rows", f"{p}/state"))
    return v.spark.read.parquet(f"{path}/rows")


@query("stream_dedup", f"WITH {V.STORED} SELECT_FINAL * FROM clean", **SENSOR)
def stream_dedup(v):
    """Two runs over the same upload leave every record once."""
    path = scratch(v.spark, "stream-dedup")
    for run in ("first", "second"):
        S.stream_ingest(_streamed(v), f"{path}/store", f"{path}/{run}").awaitTermination()
    return v.spark.read.parquet(f"{path}/store").select(*SENSORS.names)


@query("stream_late", f"WITH {V.STORED} SELECT_FINAL * FROM clean", **SENSOR)
def stream_late(v):
    """The later half of the readings arrives first, the earlier half second; nothing is lost or doubled."""
    path = scratch(v.spark, "stream-late")
    middle = v.sensors().agg(F.percentile_approx("ts_recorded", 0.5)).first()[0] or 0
    for run, half in (("late", F.col("ts_recorded") > middle), ("early", F.col("ts_recorded") <= middle)):
        S.stream_ingest(_streamed(v).where(half), f"{path}/store", f"{path}/{run}").awaitTermination()
    return v.spark.read.parquet(f"{path}/store").select(*SENSORS.names)


@query("stream_daily", f"""WITH {V.SENSORS}, d AS (SELECT *, {V.DAY} AS date FROM sensors)
       SELECT_FINAL object_id, date, avg(t_supply) AS t_supply_mean, avg(t_return) AS t_return_mean,
         avg(p_supply) AS p_supply_mean, avg(p_return) AS p_return_mean, min(p_supply) AS p_supply_min,
         max(p_supply) AS p_supply_max, count(*) AS n_samples FROM d GROUP BY 1, 2""",
       object_id="VARCHAR", date="DATE", t_supply_mean="d", t_return_mean="d", p_supply_mean="d", p_return_mean="d",
       p_supply_min="d", p_supply_max="d", n_samples="BIGINT")
def stream_daily(v):
    """From the stream's revisions alone; the half that arrives second is later than the watermark."""
    return R.merged_days(_revisions(v, v.sensors(), "ts_recorded", "stream-daily", R.day_revisions))


def _alerts(v: StarViews) -> DataFrame:
    return v.events().where("value > 100").select(
        F.col("user_id").cast("string").alias("object_id"),
        F.timestamp_seconds(F.floor(F.col("epoch") / 86400) * 86400).alias("event_time"),
        (F.col("value") / 500.0).alias("score"))


@query("stream_orders", f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS object_id, CAST(ts AS DATE) AS date,
         count(*) AS n, max(value) / 500.0 AS score FROM events WHERE value > 100 GROUP BY 1, 2), g AS (
         SELECT *, CASE WHEN date - lag(date) OVER w > 3 OR lag(date) OVER w IS NULL THEN 1 ELSE 0 END AS opens
         FROM a WINDOW w AS (PARTITION BY object_id ORDER BY date)), e AS (
         SELECT *, sum(opens) OVER (PARTITION BY object_id ORDER BY date) AS ep FROM g)
       SELECT_FINAL object_id, min(date) AS opened_at, max(date) AS last_alert_at, sum(n) AS alerts, max(score) AS peak_score,
         (SELECT max(date) FROM a) - max(date) < 5 AS open
         FROM e GROUP BY object_id, ep""",
       object_id="VARCHAR", opened_at="DATE", last_alert_at="DATE", alerts="BIGINT", peak_score="d", open="BOOLEAN")
def stream_orders(v):
    """Orders of three days' cooldown from the stream's revisions alone; open are those whose cooldown the watermark, a day
    behind the last alert, has not passed."""
    found = _revisions(v, _alerts(v), "event_time", "stream-orders", lambda s: R.order_revisions(s, 3))
    return R.merged_orders(found)


@query("stream_coverage", f"""WITH {V.SENSORS} SELECT_FINAL {V.DAY} AS date, count(DISTINCT object_id) AS objects_count
       FROM sensors GROUP BY 1""", date="DATE", objects_count="BIGINT")
def stream_coverage(v):
    """Exact objects per day from the bitmaps that the stream leaves."""
    path = _halves(v, v.sensors(), "ts_recorded", "stream-coverage", lambda s, p: S.stream_bitmaps(s, p, f"{p}/state"))
    return G.count_objects(S.stored_bitmaps(v.spark, path))


@query("coverage_weeks", f"""WITH {V.SENSORS} SELECT_FINAL CAST(date_trunc('week', {V.DAY}) AS DATE) AS week,
       count(DISTINCT object_id) AS objects_count FROM sensors GROUP BY 1""", week="DATE", objects_count="BIGINT")
def coverage_weeks(v):
    """Exact objects per week out of daily bitmaps, in a second table of numbers."""
    numbers = G.number_objects(v.sensors(), scratch(v.spark, "object-numbers"))
    return G.count_objects(cut_lineage(G.day_bitmaps(v.sensors(), numbers)), F.trunc("date", "week").alias("week"))
