"""From raw reports to pings: validation, parsing, quantising, dedup, sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalars as S

PING = ["mmsi", "ts", "lat", "lon", "sog", "draught", "ship_type", "name", "dest"]


def mobile_type_valid(x: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce(S.strip(x).isin(*cfg.mobile_types), F.lit(False))


def mmsi_valid(mmsi: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce(mmsi.between(cfg.mmsi_min, cfg.mmsi_max) & ~mmsi.isin(*cfg.mmsi_invalid), F.lit(False))


def coord_valid(lat: Column, lon: Column) -> Column:
    """On the globe and not the null island; tested before quantising."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0))
    return F.coalesce(ok, F.lit(False))


def clean(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Valid pings of raw reports, with ``seq`` kept where there is one.

    The cheap test of the mobile type comes first.  A row goes if its mobile type, MMSI, time or
    position isn't valid; a missing speed or draught is 0.  Columns are stripped once and parsed
    once, then tested on what was parsed.
    """
    c = cfg.columns
    col = lambda name: F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")
    seq = ["seq"] if "seq" in raw.columns else []
    names = ("mmsi", "timestamp", "lat", "lon", "sog", "draught", "ship_type", "name", "dest")
    rows = raw.where(mobile_type_valid(col(c.mobile_type), cfg)).select(*[col(getattr(c, n)).alias(n) for n in names], *seq)
    text = S.once(S.once(rows, {n: F.col(n) for n in names}, *seq), {n: S.strip(F.col(n)) for n in names}, *seq)
    t = {n: F.col(n) for n in names}
    parsed = S.once(
        text,
        {
            "mmsi": S.stripped_int(t["mmsi"]), "ts": S.stripped_ts(t["timestamp"]), "lat": S.stripped_float(t["lat"]), "lon": S.stripped_float(t["lon"]),
            "sog": F.coalesce(S.stripped_float(t["sog"]), F.lit(0.0)), "draught": F.coalesce(S.stripped_float(t["draught"]), F.lit(0.0)),
            **{n: S.clean_stripped(t[n]) for n in ("ship_type", "name", "dest")},
        },
        *seq,
    )
    good = parsed.where(mmsi_valid(F.col("mmsi"), cfg) & F.col("ts").isNotNull() & coord_valid(F.col("lat"), F.col("lon")))
    return quantise(good.select(*PING, *seq))


def quantise(pings: DataFrame) -> DataFrame:
    """Positions to six decimals, speed and draught to three; NaN and infinity stay."""
    fixed = lambda c, n: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.col(c)).otherwise(F.round(c, n)).alias(c)
    made = {"lat": fixed("lat", 6), "lon": fixed("lon", 6), "sog": fixed("sog", 3), "draught": fixed("draught", 3)}
    return pings.select(*[made.get(c, F.col(c)) for c in pings.columns])


def by_vessel(pings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Dealt by vessel once; dedup, tracks and detectors then need no further shuffle."""
    return pings.repartition(partitions, "mmsi") if partitions else pings.repartition("mmsi")


def dedup(pings: DataFrame) -> DataFrame:
    """Of rows equal in vessel, time and position the first by ``seq``."""
    w = Window.partitionBy("mmsi", "ts", "lat", "lon").orderBy("seq")
    return pings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_shard(pings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return pings.withColumn("shard", F.pmod("mmsi", F.lit(cfg.shards)).cast("int"))


def shard_counts(pings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return with_shard(pings, cfg).groupBy("shard").agg(F.count("*").alias("n"))


def ingested(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Raw reports with ``seq`` to deduplicated pings with a shard, in one shuffle."""
    return with_shard(dedup(by_vessel(clean(raw, cfg))), cfg)
