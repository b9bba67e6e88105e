"""What detectors share: consecutive pairs, runs, and winners of a rounded fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geo
from ..functions.scalars import hours, rounded


def track() -> WindowSpec:
    """A vessel's pings in order of time, ties by ``seq``."""
    return Window.partitionBy("mmsi").orderBy("ts", "seq")


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pairs(pings: DataFrame) -> DataFrame:
    """Each ping with the one before it in its track: ts0, lat0, lon0, sog0, draught0, dt_h, dist_nm."""
    w = track()
    x = pings.select("mmsi", "ts", "seq", "lat", "lon", "sog", "draught", *[F.lag(c).over(w).alias(f"{c}0") for c in ("ts", "lat", "lon", "sog", "draught")])
    x = x.where(F.col("ts0").isNotNull())
    x = x.withColumn("dt_h", hours(F.col("ts") - F.col("ts0")))
    return x.withColumn("dist_nm", geo.haversine_nm(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))


def run_id(breaks: Column, w: WindowSpec) -> Column:
    """Number of rows so far at which ``breaks`` holds: constant along a run of rows where it doesn't."""
    return F.sum(F.when(breaks, 1).otherwise(0)).over(so_far(w))


def fold_winners(df: DataFrame, keys: list[str], order: list[str], raw: str, digits: int, largest: bool, cfg: Config = DEFAULT) -> DataFrame:
    """Per key the row that wins a fold comparing each raw value with the best so far, rounded.

    The best so far is always the running extreme of rounded values, as a raw value beyond a
    rounded one rounds to it or beyond; so the winner is the last row whose raw value lies beyond
    that extreme of the rows before.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    value = rounded(F.col(raw), digits, cfg.rounding)
    best = (F.max(value) if largest else F.min(value)).over(before)
    x = df.withColumn("__best", best)
    x = x.where(F.col("__best").isNull() | ((F.col(raw) > F.col("__best")) if largest else (F.col(raw) < F.col("__best"))))
    last = F.lead(F.lit(1)).over(w).isNull()
    return x.withColumn("__last", last).where("__last").drop("__best", "__last")
