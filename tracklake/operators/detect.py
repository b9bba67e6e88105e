"""Detectors over consecutive pings: A going dark, C draught change, D identity cloning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Config
from ..functions.scalars import rounded
from . import land, tracks


def is_dark(cfg: Config) -> Column:
    moved = (F.col("dist_nm") >= cfg.gap_dist_nm) | (_knots() >= cfg.moving_kn)
    return (F.col("dt_h") >= cfg.gap_hours) & moved


def is_draught_change(cfg: Config) -> Column:
    return F.coalesce((F.col("dt_h") >= cfg.draught_hours) & (_draught_share(cfg) >= cfg.draught_change), F.lit(False))


def is_simultaneous(cfg: Config) -> Column:
    moved = (F.col("lat0") != F.col("lat")) | (F.col("lon0") != F.col("lon"))
    return (F.col("ts") == F.col("ts0")) & moved & (F.col("dist_nm") >= cfg.simultaneous_nm)


def is_jump(cfg: Config) -> Column:
    """Whether no vessel is that fast; null for pairs within one second."""
    return F.when(F.col("ts") > F.col("ts0"), _knots() >= cfg.clone_kn)


def _knots() -> Column:
    return F.when(F.col("dt_h") > 0, F.try_divide("dist_nm", "dt_h")).otherwise(F.lit(0.0))


def _draught_share(cfg: Config) -> Column:
    """The change of draught as a share; null unless both draughts are known."""
    known = (F.col("draught0") >= cfg.draught_min_m) & (F.col("draught") >= cfg.draught_min_m)
    return F.abs(F.col("draught") - F.col("draught0")) / F.when(known, F.col("draught0"))


def going_dark(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A: silence of ``gap_hours`` or more across which the vessel moved."""
    r = lambda c, n: rounded(c, n, cfg.rounding)
    return pairs.where(is_dark(cfg)).select(
        "mmsi", r(F.col("dt_h"), 2).alias("gap_hours"), r(F.col("dist_nm"), 2).alias("dist_nm"), r(_knots(), 2).alias("implied_kn"),
        F.col("lat0").alias("lat_before"), F.col("lon0").alias("lon_before"), F.col("ts0").alias("ts_before"),
        F.col("lat").alias("lat_after"), F.col("lon").alias("lon_after"), F.col("ts").alias("ts_after"),
    )


def draught_change(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """C: another draught after a gap of ``draught_hours`` or more; both draughts must be known."""
    r = lambda c, n: rounded(c, n, cfg.rounding)
    return pairs.where(is_draught_change(cfg)).select(
        "mmsi", r(F.col("dt_h"), 2).alias("gap_hours"), F.col("draught0").alias("draught_before"), F.col("draught").alias("draught_after"),
        r(_draught_share(cfg) * 100.0, 2).alias("change_pct"), F.col("ts0").alias("ts_before"), F.col("ts").alias("ts_after"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"),
    )


def _clone_rows(x: DataFrame, kind: str, speed, error, cfg: Config) -> DataFrame:
    r = lambda c, n: rounded(c, n, cfg.rounding)
    return x.select(
        "mmsi", F.lit(kind).alias("event_type"), speed.cast("double").alias("speed_kn"), r(F.col("dist_nm"), 2).alias("dist_nm"), (F.col("ts") - F.col("ts0")).alias("dt_seconds"),
        r((F.col("sog0") + F.col("sog")) / 2.0, 2).alias("reported_sog"),
        F.col("lat0").alias("lat1"), F.col("lon0").alias("lon1"), F.col("ts0").alias("ts1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("ts").alias("ts2"),
        error.alias("gps_error"),
    )


def simultaneous(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """D, first kind: one identity at two places at the same second."""
    return _clone_rows(pairs.where(is_simultaneous(cfg)), "simultaneous_transmission", F.lit(float("inf")), F.lit(False), cfg)


def speed_rows(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pairs in time whose implied speed no vessel reaches, with ``run``, their unbroken run.

    Pairs within one second neither belong to a run nor break it.
    """
    x = with_runs(pairs, cfg) if "run" not in pairs.columns else pairs
    return x.where("jump").drop("jump").withColumn("kn", F.col("dist_nm") / F.col("dt_h"))


def with_runs(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``pairs`` with ``jump`` and, for pairs in time, ``run``; over all pairs of a vessel."""
    x = pairs.withColumn("jump", F.coalesce(is_jump(cfg), F.lit(False)))
    return x.withColumn("run", tracks.run_id((F.col("ts") > F.col("ts0")) & ~F.col("jump"), tracks.track()))


def with_event(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The pairs that any detector reports, or may, with ``run`` and ``jump``: all that the detectors need."""
    return with_runs(pairs, cfg).where(F.col("jump") | is_dark(cfg) | is_draught_change(cfg) | is_simultaneous(cfg))


def speed_violations(pairs: DataFrame, cfg: Config = DEFAULT, land_cells: DataFrame | None = None) -> DataFrame:
    """D, second kind: of each run of impossible jumps the widest, by a fold on rounded distance."""
    x = tracks.fold_winners(speed_rows(pairs, cfg), ["mmsi", "run"], ["ts", "seq"], "dist_nm", 2, True, cfg)
    x = land.flagged(x, land_cells, [("lat0", "lon0"), ("lat", "lon")], "error")
    return _clone_rows(x, "speed_violation", rounded(F.col("kn"), 1, cfg.rounding), F.col("error"), cfg)


def identity_cloning(pairs: DataFrame, cfg: Config = DEFAULT, land_cells: DataFrame | None = None) -> DataFrame:
    """D: both kinds."""
    return simultaneous(pairs, cfg).unionByName(speed_violations(pairs, cfg, land_cells)).select(*schema.D)
