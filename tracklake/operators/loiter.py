"""B, loitering pairs: slow runs of one vessel, then runs of two vessels close in space and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Config
from ..functions import geo
from ..functions import scalars as S
from . import tracks


def slow_runs(pings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per run of slow pings: how many, first and last time, mean position, the time of the
    fast ping that ends it, first and last known draught."""
    w = tracks.track()
    slow = F.col("sog") < cfg.loiter_kn
    x = pings.select("mmsi", "ts", "seq", "lat", "lon", "sog", "draught", F.lead("ts").over(w).alias("next_ts"))
    x = x.withColumn("run", tracks.run_id(~slow, w)).where(slow)
    at = F.struct("ts", "seq")
    known = F.when((F.col("draught") >= cfg.draught_min_m) & ~F.isnan("draught"), at)
    return x.groupBy("mmsi", "run").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("lat").alias("avg_lat"), F.avg("lon").alias("avg_lon"),
        F.max_by("next_ts", at).alias("fast_ts"), F.min_by("draught", known).alias("draught_start"), F.max_by("draught", known).alias("draught_end"),
    )


def candidates(pings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Runs of two pings or more that last ``loiter_hours``; a shorter one lasts up to its fast ping."""
    x = slow_runs(pings, cfg).where("n >= 2")
    long = lambda end: S.hours(F.col(end) - F.col("first_ts")) >= cfg.loiter_hours
    x = x.withColumn("ts_end", F.when(long("last_ts"), F.col("last_ts")).when(long("fast_ts"), F.col("fast_ts"))).where("ts_end IS NOT NULL")
    lasted = S.rounded(S.hours(F.col("ts_end") - F.col("first_ts")), 2, cfg.rounding)
    return x.select("mmsi", F.col("first_ts").alias("ts_start"), "ts_end", "avg_lat", "avg_lon", lasted.alias("duration_h"), "draught_start", "draught_end")


def encounters(cands: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every overlap of two vessels' candidates within ``loiter_dist_m`` for ``loiter_hours``.

    Joined by key, not by inequality: one side stands in the band of latitude, and the cell of that
    band by longitude, that it is in, the other also in their neighbours, and both in every time
    bucket they reach into; a pair counts in the bucket where its overlap starts.
    """
    band = geo.metres_to_latitude(cfg.loiter_dist_m)
    width = cfg.pair_bucket_hours * 3600
    x = cands.select(*schema.CANDIDATE, F.floor(F.col("avg_lat") / band).alias("band"))
    x = x.withColumn("place", F.struct("ts_start", F.pmod("mmsi", F.lit(cfg.shards)).alias("shard"), "mmsi"))
    bucket = F.explode(F.sequence(F.floor(F.col("ts_start") / width), F.floor(F.col("ts_end") / width))).alias("bucket")
    # cells of a band, wherever in it or its neighbours the two are
    cells = geo.longitude_cells(F.col("band") * band, cfg.loiter_dist_m, 2 * band)
    cell = F.floor((F.col("lon") + 180.0) / 360.0 * F.col("cells")).cast("long")
    one = x.select(F.struct(*x.columns).alias("a"), "band", F.col("avg_lon").alias("lon"), cells.alias("cells"), bucket).select("a", "band", "bucket", F.pmod(cell, "cells").alias("cell"))
    two = x.select(F.struct(*x.columns).alias("b"), F.col("avg_lon").alias("lon"), bucket, "band").select("b", "lon", "bucket", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    near = F.array_distinct(F.array(*[F.pmod(cell + k, "cells") for k in (-1, 0, 1)]))
    two = two.select("b", "lon", "bucket", "band", cells.alias("cells")).select("b", "bucket", "band", F.explode(near).alias("cell"))
    start, end = F.greatest("a.ts_start", "b.ts_start"), F.least("a.ts_end", "b.ts_end")
    pair = one.join(two, ["band", "cell", "bucket"]).where("a.place < b.place AND a.mmsi <> b.mmsi AND b.ts_start <= a.ts_end")
    pair = pair.withColumn("ts_start", start).withColumn("ts_end", end).where("ts_start < ts_end")
    pair = pair.where((S.hours(F.col("ts_end") - F.col("ts_start")) >= cfg.loiter_hours) & (F.floor(F.col("ts_start") / width) == F.col("bucket")))
    pair = pair.withColumn("raw_m", geo.haversine_m(F.col("a.avg_lat"), F.col("a.avg_lon"), F.col("b.avg_lat"), F.col("b.avg_lon")))
    return pair.where(F.col("raw_m") <= cfg.loiter_dist_m).select("a", "b", "ts_start", "ts_end", "raw_m")


def loitering_pairs(cands: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """B: per pair of vessels its closest encounter, with the evidence of their draughts."""
    r = lambda c, n: S.rounded(c, n, cfg.rounding)
    x = encounters(cands, cfg).withColumn("k1", F.least("a.mmsi", "b.mmsi")).withColumn("k2", F.greatest("a.mmsi", "b.mmsi"))
    x = x.withColumn("place_a", F.col("a.place")).withColumn("place_b", F.col("b.place"))
    x = tracks.fold_winners(x, ["k1", "k2"], ["place_a", "place_b"], "raw_m", 1, False, cfg)
    turn = lambda v: S.draught_direction(F.col(f"{v}.draught_start"), F.col(f"{v}.draught_end"), cfg.draught_step_m)
    delta = lambda v: r(F.col(f"{v}.draught_end") - F.col(f"{v}.draught_start"), 2)
    return x.select(
        F.col("a.mmsi").alias("mmsi_1"), F.col("b.mmsi").alias("mmsi_2"), r(F.col("raw_m"), 1).alias("dist_m"), r(S.hours(F.col("ts_end") - F.col("ts_start")), 2).alias("overlap_h"),
        r((F.col("a.avg_lat") + F.col("b.avg_lat")) / 2.0, 6).alias("lat"), r((F.col("a.avg_lon") + F.col("b.avg_lon")) / 2.0, 6).alias("lon"), "ts_start", "ts_end",
        S.draught_confidence(turn("a"), turn("b")).alias("confidence"), delta("a").alias("draught_delta_1"), delta("b").alias("draught_delta_2"),
    )
