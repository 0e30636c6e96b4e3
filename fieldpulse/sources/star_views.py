"""The star-schema sample tables seen as this library's tables.

Each view is plain projection and filtering over whole Parquet tables, so every query on it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.operators.target import add_target

SEVERE = 150.0


class StarViews:
    """Views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        # calendar days of the sample are UTC days
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.table("events").withColumn("epoch", F.unix_seconds(F.col("ts").cast("timestamp")))

    def sensors(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
        return self.events().select(
            F.col("event_id").cast("string").alias("record_id"), F.col("user_id").cast("string").alias("object_id"),
            (F.floor(F.col("epoch") / 900) * 900).alias("ts_measurement"),
            (20.0 + k).alias("t_supply"), (0.6 * k).alias("t_return"),
            (F.col("value") / 10.0).alias("p_supply"), (F.col("value") / 20.0).alias("p_return"),
            F.col("epoch").alias("ts_recorded"))

    def incidents(self, least: float | None = None) -> DataFrame:
        """Errors, all of them or those of a value above ``least``."""
        e = self.events().where(F.col("event_type") == "error")
        if least is not None:
            e = e.where(F.col("value") > least)
        return e.select(
            F.col("event_id").cast("string").alias("incident_id"), F.col("user_id").cast("string").alias("object_id"),
            F.col("epoch").alias("incident_ts"),
            F.when(F.col("event_id") % 3 != 0, F.col("epoch") + 3600).alias("close_ts"),
            F.col("event_type").alias("source"))

    def severe_incidents(self) -> DataFrame:
        """The incidents that the models learn from: with all errors no object-day would be healthy."""
        return self.incidents(SEVERE)

    def weather(self) -> DataFrame:
        return self.table("events").groupBy(F.col("ts").cast("date").alias("date")).agg(
            (F.avg("value") - 60.0).alias("t_out_mean"), (F.min("value") - 60.0).alias("t_out_min"),
            (F.max("value") - 60.0).alias("t_out_max"))

    def objects_meta(self) -> DataFrame:
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        c = c.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return c.select(
            F.col("c_custkey").cast("string").alias("object_id"),
            F.when(F.col("c_custkey") % 4 != 0, F.col("r_name")).alias("object_type"),
            F.col("c_mktsegment").alias("facility_type"), F.col("c_name").alias("facility_name"),
            F.col("n_name").alias("municipality"), F.col("r_name").alias("rso"))

    def catalog(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").cast("string").alias("object_id"),
                        F.concat(F.lit("ЦТП-"), F.col("s_suppkey").cast("string")).alias("facility_name"),
                        F.col("n_name").alias("municipality"))

    def claims(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        o = o.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        status = F.col("o_orderstatus")
        opened = F.col("o_orderdate").cast("timestamp")
        return o.select(
            F.col("o_orderkey").alias("id_cds_claim"), F.concat("n_name", F.lit(" г.о.")).alias("name_mr"),
            F.concat(F.lit("утечка на ЦТП № "), (F.col("o_custkey") % 120).cast("string")).alias("text_message"),
            opened.alias("d_create"), F.when(status == "F", opened).alias("d_close"),
            (status == "F").alias("obj_koteln"), (status != "P").alias("obj_ctp"), (status == "P").alias("obj_ts"))

    def panel(self) -> DataFrame:
        """Object-day panel: supplier by ship date."""
        return self.table("lineitem").groupBy(
            F.col("l_suppkey").cast("string").alias("object_id"), F.col("l_shipdate").cast("date").alias("date")).agg(
            F.avg("l_quantity").alias("p_supply_mean"), F.avg("l_discount").alias("dp_mean"),
            F.avg("l_tax").alias("dt_mean"), (F.avg("l_extendedprice") / 1000.0).alias("t_supply_mean"),
            F.count(F.lit(1)).alias("n_samples"))

    def scores(self) -> DataFrame:
        return self.table("events").groupBy(
            F.col("user_id").cast("string").alias("object_id"), F.col("ts").cast("date").alias("date")).agg(
            (F.max("value") / 500.0).alias("score"))

    def labelled_scores(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id").select(
            "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))

    def scored_panel(self) -> DataFrame:
        """Scored object-days with the hours to the next incident."""
        return add_target(self.scores(), self.severe_incidents())
