"""Registered queries of the track operators over the driver's tables, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import geo
from .functions import scalars as S
from .operators import clean, detect, land, loiter, risk, tracks
from .plans import bench, flows, testbed

CFG = DEFAULT
Query = Callable[[SparkSession, str], DataFrame]


def _pings(spark: SparkSession, d: str) -> DataFrame:
    return clean.by_vessel(testbed.pings(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return tracks.pairs(_pings(spark, d))


def _fl(x, n: int):
    return S.rounded(x, n)


def parse_ts(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 13 == 0, "31/02/2024 00:00:00").when(F.col("event_id") % 17 == 0, "not a time").otherwise(F.date_format("ts", " d/M/yyyy H:m:s "))
    return e.select("event_id", text.alias("t")).select("event_id", S.parse_ts(F.col("t")).alias("ts"))


def clean_filters(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    c = CFG.columns
    raw = e.select(
        k.alias("seq"),
        F.when(k % 19 == 0, "Class B").when(k % 23 == 0, " Class A ").otherwise("Class A").alias(c.mobile_type),
        F.when(k % 29 == 0, "123456789").when(k % 31 == 0, "219000001.0").when(k % 37 == 0, "12").otherwise((F.lit(200000000) + F.col("user_id")).cast("string")).alias(c.mmsi),
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias(c.timestamp),
        F.when(k % 41 == 0, "90.0001").when(k % 43 == 0, "nan").when(k % 47 == 0, "").otherwise(F.format_string("%d.%d", k % 90, k % 7)).alias(c.lat),
        F.when(k % 53 == 0, "1.5d").otherwise(F.format_string("%d.25", k % 180)).alias(c.lon),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "abc").otherwise(F.format_string("%d.5", k % 20)).alias(c.sog),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.format_string("%d.5", k % 9)).alias(c.draught),
        F.lit(" Cargo\tship ").alias(c.ship_type), F.concat(F.lit("v"), F.col("user_id")).alias(c.name),
    )
    return clean.clean(raw, CFG)


def dedup_pings(spark: SparkSession, d: str) -> DataFrame:
    p = testbed.pings(spark, d)
    again = p.withColumn("seq", F.col("seq") + 100_000_000).withColumn("sog", F.col("sog") + 1.0)
    return clean.dedup(clean.by_vessel(p.unionByName(again))).select("mmsi", "ts", "lat", "lon", "sog", "seq")


def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean.shard_counts(testbed.pings(spark, d), CFG)


def shard_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The order of a shard's rows, as each row's place in it."""
    from pyspark.sql import Window

    p = clean.with_shard(_pings(spark, d), CFG)
    w = Window.partitionBy("mmsi").orderBy("ts", "seq")
    return p.select("shard", "mmsi", "ts", "seq", F.row_number().over(w).cast("long").alias("place"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("mmsi", "seq", "ts0", "ts", "lat0", "lon0", "lat", "lon", _fl(F.col("dt_h"), 4).alias("dt_h"), _fl(F.col("dist_nm"), 3).alias("dist_nm"))


def geo_scalars(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(c) for c in ("lat0", "lon0", "lat", "lon")]
    t = [a[0], a[1], F.col("ts0"), a[2], a[3], F.col("ts")]
    knots, ms = geo.implied_speed_kn(*t), geo.implied_speed_ms(*t)
    finite = lambda x, n: F.when(F.abs(x) < float("inf"), _fl(x, n))
    return _pairs(spark, d).where("lat <> lat0").select(
        "seq", _fl(geo.haversine_nm(*a), 3).alias("nm"), _fl(geo.haversine_m(*a), 1).alias("m"), _fl(geo.haversine_km(*a), 3).alias("km"),
        finite(knots, 3).alias("kn"), finite(ms, 3).alias("ms"), _fl(geo.bearing_deg(*a), 4).alias("bearing"),
    )


def anomaly_a(spark: SparkSession, d: str) -> DataFrame:
    return detect.going_dark(_pairs(spark, d), CFG)


def anomaly_c(spark: SparkSession, d: str) -> DataFrame:
    return detect.draught_change(_pairs(spark, d), CFG)


def _finite(x: DataFrame) -> DataFrame:
    return x.withColumn("speed_kn", F.when(F.col("speed_kn") < float("inf"), F.col("speed_kn")))


def anomaly_d_simultaneous(spark: SparkSession, d: str) -> DataFrame:
    return _finite(detect.simultaneous(_pairs(spark, d), CFG))


def anomaly_d_speed_rows(spark: SparkSession, d: str) -> DataFrame:
    return detect.speed_rows(_pairs(spark, d), CFG).select("mmsi", "seq", F.col("run").cast("long").alias("run"), _fl(F.col("kn"), 2).alias("kn"), _fl(F.col("dist_nm"), 2).alias("dist_nm"))


def anomaly_d(spark: SparkSession, d: str) -> DataFrame:
    return _finite(detect.identity_cloning(_pairs(spark, d), CFG))


def loiter_runs(spark: SparkSession, d: str) -> DataFrame:
    x = loiter.slow_runs(_pings(spark, d), CFG)
    return x.select("mmsi", F.col("run").cast("long").alias("run"), "n", "first_ts", "last_ts", "fast_ts", _fl(F.col("avg_lat"), 6).alias("avg_lat"), _fl(F.col("avg_lon"), 6).alias("avg_lon"), "draught_start", "draught_end")


def loiter_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = loiter.candidates(_pings(spark, d), CFG)
    return x.withColumn("avg_lat", _fl(F.col("avg_lat"), 6)).withColumn("avg_lon", _fl(F.col("avg_lon"), 6))


def loiter_pairs_raw(spark: SparkSession, d: str) -> DataFrame:
    x = loiter.encounters(loiter.candidates(_pings(spark, d), CFG), CFG)
    return x.select(F.col("a.mmsi").alias("mmsi_1"), F.col("b.mmsi").alias("mmsi_2"), "ts_start", "ts_end", _fl(F.col("raw_m"), 1).alias("dist_m"))


def anomaly_b(spark: SparkSession, d: str) -> DataFrame:
    return loiter.loitering_pairs(loiter.candidates(_pings(spark, d), CFG), CFG)


def land_flag(spark: SparkSession, d: str) -> DataFrame:
    return land.flagged(testbed.pings(spark, d).select("seq", "lat", "lon"), testbed.land_cells(spark), [("lat", "lon")], "on_land").select("seq", "on_land")


def _found(spark: SparkSession, d: str) -> flows.Findings:
    return flows.find(testbed.pings(spark, d), CFG)


def vessel_stats(spark: SparkSession, d: str) -> DataFrame:
    f = _found(spark, d)
    return risk.with_pairs(risk.vessel_stats(f.a, f.c, f.d), f.b).withColumn("total_impossible_nm", _fl(F.col("total_impossible_nm"), 2))


def dfsi(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).risk.withColumn("total_impossible_nm", _fl(F.col("total_impossible_nm"), 2))


def dfsi_top5(spark: SparkSession, d: str) -> DataFrame:
    return risk.top(_found(spark, d).risk, CFG).withColumn("total_impossible_nm", _fl(F.col("total_impossible_nm"), 2))


def event_totals(spark: SparkSession, d: str) -> DataFrame:
    f = _found(spark, d)
    return risk.event_totals(f.a, f.b, f.c, f.d, f.candidates)


def amdahl(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 80.0), (2, 44.0), (4, 26.0), (8, 17.5)], "workers int, time_s double")
    x = bench.with_fit(rows)
    return x.select("workers", _fl(F.col("speedup"), 4).alias("speedup"), _fl(F.col("p"), 6).alias("p"), _fl(F.col("law"), 4).alias("law"))


def confidence_table(spark: SparkSession, d: str) -> DataFrame:
    """All sixteen cells of the draught evidence."""
    ways = spark.createDataFrame([("none", None, None), ("stable", 5.0, 5.04), ("loss", 6.0, 5.0), ("gain", 5.0, 6.0)], "way string, s double, e double")
    a, b = ways.alias("a"), ways.alias("b")
    turn = lambda v: S.draught_direction(F.col(f"{v}.s"), F.col(f"{v}.e"), CFG.draught_step_m)
    x = a.crossJoin(F.broadcast(b))  # four rows by four
    return x.select(F.col("a.way").alias("way_1"), F.col("b.way").alias("way_2"), S.draught_confidence(turn("a"), turn("b")).alias("confidence"))


def queries() -> dict[str, Query]:
    ops = (
        parse_ts, clean_filters, dedup_pings, shard_counts, shard_sorted, pairs, geo_scalars, anomaly_a, anomaly_c, anomaly_d_simultaneous, anomaly_d_speed_rows, anomaly_d,
        loiter_runs, loiter_candidates, loiter_pairs_raw, anomaly_b, land_flag, vessel_stats, dfsi, dfsi_top5, event_totals, amdahl, confidence_table,
    )
    return {f.__name__: f for f in ops}


# --- the same in SQL ----------------------------------------------------------------------------


def _r(x: str, n: int) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN printf('%.{n}f', ({x})::double)::double + 0.0::double END)"


def _nm(a: str, b: str, c: str, e: str) -> str:
    return (
        f"(6880.13::double * asin(sqrt(least(1.0::double, pow(sin(radians({c} - {a}) / 2.0::double), 2.0::double) + cos(radians({a})) * cos(radians({c})) * "
        f"pow(sin(radians({e} - {b}) / 2.0::double), 2.0::double)))))"
    )


_PINGS = """
pings AS (SELECT 200000000 + user_id AS mmsi, (epoch_us(ts) // 1000000) - ((epoch_us(ts) // 1000000) % 600) AS ts,
    54.0::double + (user_id % 500) * 0.002::double + CASE WHEN value >= 120.0::double THEN (event_id % 100) * 0.01::double ELSE 0.0::double END AS lat,
    12.0::double + (event_id % 5) * 0.0001::double AS lon, value / 50.0::double AS sog,
    CASE WHEN event_id % 11 = 0 THEN 0.0::double ELSE 5.0::double + (event_id % 7) * 0.1::double END AS draught, event_id AS seq FROM events)"""
_PAIRS = f"""{_PINGS},
lagged AS (SELECT *, lag(ts) OVER w AS ts0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(sog) OVER w AS sog0, lag(draught) OVER w AS draught0
    FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY ts, seq)),
pairs AS (SELECT *, (ts - ts0) / 3600.0::double AS dt_h, {_nm('lat0', 'lon0', 'lat', 'lon')} AS dist_nm FROM lagged WHERE ts0 IS NOT NULL)"""
_KN = "(CASE WHEN dt_h > 0 THEN dist_nm / dt_h ELSE 0.0::double END)"
_A = f"""SELECT mmsi, {_r('dt_h', 2)} AS gap_hours, {_r('dist_nm', 2)} AS dist_nm, {_r(_KN, 2)} AS implied_kn, lat0 AS lat_before, lon0 AS lon_before, ts0 AS ts_before,
    lat AS lat_after, lon AS lon_after, ts AS ts_after FROM pairs WHERE dt_h >= 4.0::double AND (dist_nm >= 1.0::double OR {_KN} >= 0.1::double)"""
_SHARE = "(abs(draught - draught0) / draught0)"
_C = f"""SELECT mmsi, {_r('dt_h', 2)} AS gap_hours, draught0 AS draught_before, draught AS draught_after, {_r(_SHARE + ' * 100.0::double', 2)} AS change_pct,
    ts0 AS ts_before, ts AS ts_after, lat0 AS lat, lon0 AS lon FROM pairs
    WHERE draught0 >= 0.5::double AND draught >= 0.5::double AND dt_h >= 2.0::double AND {_SHARE} >= 0.05::double"""
_DCOLS = f"""{_r('dist_nm', 2)} AS dist_nm, ts - ts0 AS dt_seconds, {_r('(sog0 + sog) / 2.0::double', 2)} AS reported_sog, lat0 AS lat1, lon0 AS lon1, ts0 AS ts1,
    lat AS lat2, lon AS lon2, ts AS ts2, false AS gps_error"""
_SIM = f"""SELECT mmsi, 'simultaneous_transmission' AS event_type, NULL::double AS speed_kn, {_DCOLS} FROM pairs
    WHERE ts = ts0 AND (lat <> lat0 OR lon <> lon0) AND dist_nm >= 0.5::double"""
_SPEED = f"""{_PAIRS},
jumps AS (SELECT *, dist_nm / dt_h AS kn FROM pairs WHERE ts > ts0),
runs AS (SELECT *, sum(CASE WHEN kn >= 60.0::double THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM jumps),
fast AS (SELECT * FROM runs WHERE kn >= 60.0::double)"""
_DSPEED = f"""{_SPEED},
best AS (SELECT *, max({_r('dist_nm', 2)}) OVER (PARTITION BY mmsi, run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fast),
won AS (SELECT *, row_number() OVER (PARTITION BY mmsi, run ORDER BY ts DESC, seq DESC) AS k FROM best WHERE pm IS NULL OR dist_nm > pm)"""
_D = f"""{_SIM} UNION ALL SELECT mmsi, 'speed_violation' AS event_type, {_r('kn', 1)} AS speed_kn, {_DCOLS} FROM won WHERE k = 1"""
_RUNS = """
led AS (SELECT *, lead(ts) OVER w AS next_ts, sum(CASE WHEN sog < 1.0::double THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run
    FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY ts, seq)),
slow AS (SELECT *, row_number() OVER (PARTITION BY mmsi, run ORDER BY ts, seq) AS up, row_number() OVER (PARTITION BY mmsi, run ORDER BY ts DESC, seq DESC) AS down FROM led WHERE sog < 1.0::double),
known AS (SELECT *, row_number() OVER (PARTITION BY mmsi, run ORDER BY ts, seq) AS up2, row_number() OVER (PARTITION BY mmsi, run ORDER BY ts DESC, seq DESC) AS down2 FROM slow WHERE draught >= 0.5::double),
drafts AS (SELECT mmsi, run, max(CASE WHEN up2 = 1 THEN draught END) AS draught_start, max(CASE WHEN down2 = 1 THEN draught END) AS draught_end FROM known GROUP BY ALL),
grouped AS (SELECT mmsi, run, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(CASE WHEN down = 1 THEN next_ts END) AS fast_ts, list_reduce(list(lat ORDER BY ts, seq), lambda a, b: a + b) / count(*) AS avg_lat, list_reduce(list(lon ORDER BY ts, seq), lambda a, b: a + b) / count(*) AS avg_lon FROM slow GROUP BY ALL),
loiters AS (SELECT g.*, draught_start, draught_end FROM grouped g LEFT JOIN drafts d ON g.mmsi = d.mmsi AND g.run = d.run),
ended AS (SELECT *, CASE WHEN (last_ts - first_ts) / 3600.0::double >= 2.0::double THEN last_ts WHEN (fast_ts - first_ts) / 3600.0::double >= 2.0::double THEN fast_ts END AS ts_end FROM loiters WHERE n >= 2),
cands AS (SELECT mmsi, first_ts AS ts_start, ts_end, avg_lat, avg_lon, (ts_end - first_ts) / 3600.0::double AS lasted, draught_start, draught_end FROM ended WHERE ts_end IS NOT NULL)"""
_TURN = lambda v: (
    f"(CASE WHEN {v}.draught_start IS NULL OR {v}.draught_end IS NULL THEN NULL WHEN abs({v}.draught_end - {v}.draught_start) < 0.05::double THEN 'stable' "
    f"WHEN {v}.draught_end < {v}.draught_start THEN 'loss' ELSE 'gain' END)"
)
_ENC = f"""{_PINGS},{_RUNS},
met AS (SELECT a.mmsi AS mmsi_1, b.mmsi AS mmsi_2, a.ts_start AS sa, b.ts_start AS sb, greatest(a.ts_start, b.ts_start) AS ts_start, least(a.ts_end, b.ts_end) AS ts_end,
    {_nm('a.avg_lat', 'a.avg_lon', 'b.avg_lat', 'b.avg_lon')} * 1852.0::double AS raw_m, a.avg_lat AS lat_a, a.avg_lon AS lon_a, b.avg_lat AS lat_b, b.avg_lon AS lon_b,
    {_TURN('a')} AS t1, {_TURN('b')} AS t2, a.draught_end - a.draught_start AS d1, b.draught_end - b.draught_start AS d2
    FROM cands a JOIN cands b ON a.mmsi <> b.mmsi AND (a.ts_start, a.mmsi % 64, a.mmsi) < (b.ts_start, b.mmsi % 64, b.mmsi) AND b.ts_start <= a.ts_end
    AND (least(a.ts_end, b.ts_end) - greatest(a.ts_start, b.ts_start)) / 3600.0::double >= 2.0::double),
near AS (SELECT * FROM met WHERE raw_m <= 500.0::double)"""
_CONF = """CASE WHEN t1 IS NULL AND t2 IS NULL THEN 'proximity_only' WHEN t1 IN ('loss', 'gain') AND t2 IN ('loss', 'gain') AND t1 <> t2 THEN 'draught_transfer'
    WHEN (t1 IN ('loss', 'gain') AND t2 IS NULL) OR (t2 IN ('loss', 'gain') AND t1 IS NULL) THEN 'draught_partial' ELSE 'draught_unchanged' END"""
_NEAREST = f"""{_ENC},
ordered AS (SELECT *, least(mmsi_1, mmsi_2) AS k1, greatest(mmsi_1, mmsi_2) AS k2 FROM near),
mins AS (SELECT *, min({_r('raw_m', 1)}) OVER (PARTITION BY k1, k2 ORDER BY sa, mmsi_1 % 64, mmsi_1, sb, mmsi_2 % 64, mmsi_2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ordered),
nearest AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY sa DESC, mmsi_1 % 64 DESC, mmsi_1 DESC, sb DESC, mmsi_2 % 64 DESC, mmsi_2 DESC) AS k FROM mins WHERE pm IS NULL OR raw_m < pm)"""
_B = f"""SELECT mmsi_1, mmsi_2, {_r('raw_m', 1)} AS dist_m, {_r('(ts_end - ts_start) / 3600.0::double', 2)} AS overlap_h, {_r('(lat_a + lat_b) / 2.0::double', 6)} AS lat,
    {_r('(lon_a + lon_b) / 2.0::double', 6)} AS lon, ts_start, ts_end, {_CONF} AS confidence, {_r('d1', 2)} AS draught_delta_1, {_r('d2', 2)} AS draught_delta_2 FROM nearest WHERE k = 1"""


def _stats() -> str:
    """Common table expressions up to ``stats``."""
    rest = _NEAREST.removeprefix(f"{_PINGS},{_RUNS},")
    return f"""{_DSPEED},{_RUNS},{rest},
a AS ({_A}), c AS ({_C}), d AS ({_D}), b AS ({_B}),
parts AS (SELECT mmsi, gap_hours AS gap, 0.0::double AS nm, 0 AS c FROM a UNION ALL SELECT mmsi, 0.0::double, CASE WHEN gps_error THEN 0.0::double ELSE dist_nm END, 0 FROM d
    UNION ALL SELECT mmsi, 0.0::double, 0.0::double, 1 FROM c UNION ALL SELECT mmsi_1, 0.0::double, 0.0::double, 0 FROM b UNION ALL SELECT mmsi_2, 0.0::double, 0.0::double, 0 FROM b),
stats AS (SELECT mmsi, max(gap) AS max_gap_hours, sum(nm) AS nm, sum(c)::bigint AS count_C FROM parts GROUP BY mmsi),
scores AS (SELECT mmsi, {_r('max_gap_hours / 2.0::double + nm / 10.0::double + count_C * 15.0::double', 3)} AS dfsi, max_gap_hours, {_r('nm', 2)} AS total_impossible_nm, count_C FROM stats)"""


def oracle_sql() -> dict[str, str]:
    kn, ms = "(dist_nm / ((ts - ts0) / 3600.0::double))", "(dist_nm * 1852.0::double / (ts - ts0))"
    y = "(sin(radians(lon - lon0)) * cos(radians(lat)))"
    x = "(cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))"
    turned = f"(degrees(atan2({y}, {x})) + 360.0::double)"
    return {
        "parse_ts": "SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS ts FROM events",
        "clean_filters": """SELECT 200000000 + user_id AS mmsi, epoch_us(ts) // 1000000 AS ts, (event_id % 90) + (event_id % 7) / 10.0::double AS lat, (event_id % 180) + 0.25::double AS lon,
            CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0.0::double ELSE (event_id % 20) + 0.5::double END AS sog, CASE WHEN event_id % 3 = 0 THEN 0.0::double ELSE (event_id % 9) + 0.5::double END AS draught,
            'Cargo ship' AS ship_type, 'v' || user_id AS name, '' AS dest, event_id AS seq FROM events
            WHERE event_id % 19 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 AND event_id % 53 <> 0""",
        "dedup_pings": f"""WITH {_PINGS}, twice AS (SELECT mmsi, ts, lat, lon, sog, seq FROM pings UNION ALL SELECT mmsi, ts, lat, lon, sog + 1.0::double, seq + 100000000 FROM pings),
            n AS (SELECT *, row_number() OVER (PARTITION BY mmsi, ts, lat, lon ORDER BY seq) AS k FROM twice) SELECT mmsi, ts, lat, lon, sog, seq FROM n WHERE k = 1""",
        "shard_counts": f"WITH {_PINGS} SELECT (mmsi % 64)::int AS shard, count(*) AS n FROM pings GROUP BY 1",
        "shard_sorted": f"WITH {_PINGS} SELECT (mmsi % 64)::int AS shard, mmsi, ts, seq, row_number() OVER (PARTITION BY mmsi ORDER BY ts, seq) AS place FROM pings",
        "pairs": f"WITH {_PAIRS} SELECT mmsi, seq, ts0, ts, lat0, lon0, lat, lon, {_r('dt_h', 4)} AS dt_h, {_r('dist_nm', 3)} AS dist_nm FROM pairs",
        "geo_scalars": f"""WITH {_PAIRS} SELECT seq, {_r('dist_nm', 3)} AS nm, {_r('dist_nm * 1852.0::double', 1)} AS m, {_r('dist_nm * 1.852::double', 3)} AS km,
            CASE WHEN ts > ts0 THEN {_r(kn, 3)} END AS kn, CASE WHEN ts > ts0 THEN {_r(ms, 3)} END AS ms,
            {_r(f"(CASE WHEN {turned} >= 360.0::double THEN {turned} - 360.0::double ELSE {turned} END)", 4)} AS bearing FROM pairs WHERE lat <> lat0""",
        "anomaly_a": f"WITH {_PAIRS} {_A}",
        "anomaly_c": f"WITH {_PAIRS} {_C}",
        "anomaly_d_simultaneous": f"WITH {_PAIRS} {_SIM}",
        "anomaly_d_speed_rows": f"WITH {_SPEED} SELECT mmsi, seq, run::bigint AS run, {_r('kn', 2)} AS kn, {_r('dist_nm', 2)} AS dist_nm FROM fast",
        "anomaly_d": f"WITH {_DSPEED} {_D}",
        "loiter_runs": f"WITH {_PINGS},{_RUNS} SELECT mmsi, run::bigint AS run, n, first_ts, last_ts, fast_ts, {_r('avg_lat', 6)} AS avg_lat, {_r('avg_lon', 6)} AS avg_lon, draught_start, draught_end FROM loiters",
        "loiter_candidates": f"""WITH {_PINGS},{_RUNS} SELECT mmsi, ts_start, ts_end, {_r('avg_lat', 6)} AS avg_lat, {_r('avg_lon', 6)} AS avg_lon, {_r('lasted', 2)} AS duration_h, draught_start, draught_end FROM cands""",
        "loiter_pairs_raw": f"WITH {_ENC} SELECT mmsi_1, mmsi_2, ts_start, ts_end, {_r('raw_m', 1)} AS dist_m FROM near",
        "anomaly_b": f"WITH {_NEAREST} {_B}",
        "land_flag": f"WITH {_PINGS} SELECT seq, floor(lat / 0.1::double)::bigint BETWEEN 540 AND 569 AND (floor(lat / 0.1::double)::bigint - 540) % 3 = 0 AND floor(lon / 0.1::double)::bigint = 120 AS on_land FROM pings",
        "vessel_stats": f"WITH {_stats()} SELECT mmsi, max_gap_hours, {_r('nm', 2)} AS total_impossible_nm, count_C FROM stats",
        "dfsi": f"WITH {_stats()} SELECT * FROM scores",
        "dfsi_top5": f"WITH {_stats()} SELECT * FROM scores ORDER BY dfsi DESC, mmsi LIMIT 5",
        "event_totals": f"""WITH {_stats()} SELECT 'A' AS kind, count(*) AS n FROM a UNION ALL SELECT 'B', count(*) FROM b UNION ALL SELECT 'C', count(*) FROM c UNION ALL SELECT 'D', count(*) FROM d
            UNION ALL SELECT 'candidates', count(*) FROM cands""",
        "amdahl": f"""WITH t(workers, time_s) AS (VALUES (1, 80.0::double), (2, 44.0::double), (4, 26.0::double), (8, 17.5::double)),
            s AS (SELECT *, 80.0::double / time_s AS speedup FROM t), f AS (SELECT (1.0::double / speedup - 1.0::double) / (1.0::double / workers - 1.0::double) AS p FROM s WHERE workers = 8)
            SELECT workers, {_r('speedup', 4)} AS speedup, {_r('p', 6)} AS p, {_r('1.0::double / ((1.0::double - p) + p / workers)', 4)} AS law FROM s, f""",
        "confidence_table": f"""WITH w(way, turn) AS (VALUES ('none', NULL), ('stable', 'stable'), ('loss', 'loss'), ('gain', 'gain')),
            p AS (SELECT a.way AS way_1, b.way AS way_2, a.turn AS t1, b.turn AS t2 FROM w a, w b) SELECT way_1, way_2, {_CONF} AS confidence FROM p""",
    }
