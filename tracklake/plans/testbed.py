"""The driver's ``events`` table as pings; the same arithmetic stands in SQL in ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_of


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("sec", epoch_of("ts"))
    far = F.when(F.col("value") >= 120.0, (F.col("event_id") % 100) * 0.01).otherwise(F.lit(0.0))
    draught = F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(F.lit(5.0) + (F.col("event_id") % 7) * 0.1)
    return e.select(
        (F.lit(200_000_000) + F.col("user_id")).cast("long").alias("mmsi"),
        (F.col("sec") - F.pmod("sec", F.lit(600))).cast("long").alias("ts"),
        (F.lit(54.0) + (F.col("user_id") % 500) * 0.002 + far).alias("lat"),
        (F.lit(12.0) + (F.col("event_id") % 5) * 0.0001).alias("lon"),
        (F.col("value") / 50.0).alias("sog"),
        draught.alias("draught"),
        F.col("event_id").alias("seq"),
    )


def land_cells(spark: SparkSession) -> DataFrame:
    """A made-up coast: every third cell of a strip."""
    return spark.range(0, 30, 3).select((F.lit(540) + F.col("id")).alias("cell_lat"), F.lit(120).cast("long").alias("cell_lon"))
