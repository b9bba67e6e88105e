"""Risk of a vessel: what the detectors found of it, in one score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Config
from ..functions.scalars import rounded
from . import detect, tracks


def vessel_stats(a: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """Per vessel with an event: longest gap, impossible miles without position errors, draught changes."""
    gap = a.select("mmsi", F.col("gap_hours").alias("gap"), F.lit(0.0).alias("nm"), F.lit(0).alias("c"))
    nm = d.select("mmsi", F.lit(0.0).alias("gap"), F.when(F.col("gps_error"), F.lit(0.0)).otherwise(F.col("dist_nm")).alias("nm"), F.lit(0).alias("c"))
    change = c.select("mmsi", F.lit(0.0).alias("gap"), F.lit(0.0).alias("nm"), F.lit(1).alias("c"))
    x = gap.unionByName(nm).unionByName(change).groupBy("mmsi")
    return x.agg(F.max("gap").alias("max_gap_hours"), F.sum("nm").alias("total_impossible_nm"), F.sum("c").cast("long").alias("count_C"))


def track_stats(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``vessel_stats`` in one pass over consecutive pairs, where no position errors are known.

    A run's event has the run's greatest rounded distance, so the runs needn't be folded.  Dealt by
    vessel, everything here runs after one shuffle and one sort.
    """
    r = lambda c: rounded(F.col(c), 2, cfg.rounding)
    x = pairs.withColumn("jump", detect.is_jump(cfg))
    x = x.withColumn("run", tracks.run_id(F.coalesce(~F.col("jump"), F.lit(False)), tracks.track()))
    runs = x.groupBy("mmsi", "run").agg(
        F.max(F.when(detect.is_dark(cfg), r("dt_h"))).alias("gap"),
        F.sum(F.when(detect.is_draught_change(cfg), 1)).alias("c"),
        F.sum(F.when(detect.is_simultaneous(cfg), r("dist_nm"))).alias("both"),
        F.max(F.when(F.col("jump"), r("dist_nm"))).alias("jump"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = runs.where("gap IS NOT NULL OR c IS NOT NULL OR both IS NOT NULL OR jump IS NOT NULL").groupBy("mmsi")
    return out.agg(
        F.max(zero("gap")).alias("max_gap_hours"), F.sum(zero("both") + zero("jump")).alias("total_impossible_nm"), F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("count_C")
    )


def with_pairs(stats: DataFrame, b: DataFrame) -> DataFrame:
    """``stats`` with the vessels of loitering pairs, at zero where they have no other event."""
    member = b.select(F.explode(F.array("mmsi_1", "mmsi_2")).alias("mmsi")).distinct()
    zero = member.select("mmsi", F.lit(0.0).alias("max_gap_hours"), F.lit(0.0).alias("total_impossible_nm"), F.lit(0).cast("long").alias("count_C"))
    x = stats.unionByName(zero).groupBy("mmsi")
    return x.agg(F.max("max_gap_hours").alias("max_gap_hours"), F.sum("total_impossible_nm").alias("total_impossible_nm"), F.sum("count_C").alias("count_C"))


def scored(stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    score = F.col("max_gap_hours") / cfg.gap_divisor + F.col("total_impossible_nm") / cfg.distance_divisor + F.col("count_C") * cfg.draught_weight
    return stats.withColumn("dfsi", rounded(score, 3, cfg.rounding)).select(*schema.RISK)


def ranked(scores: DataFrame) -> DataFrame:
    """Highest first, ties by vessel."""
    return scores.orderBy(F.desc("dfsi"), "mmsi")


def top(scores: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return ranked(scores).limit(cfg.top)


def event_totals(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, cands: DataFrame) -> DataFrame:
    """(kind, n) for the five kinds of rows."""
    kinds = (("A", a), ("B", b), ("C", c), ("D", d), ("candidates", cands))
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
