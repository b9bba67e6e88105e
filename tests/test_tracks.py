"""Detectors against hand-made tracks and against a sequential model."""

import random

import model
import pytest
from pyspark.sql import functions as F

from tracklake.config import DEFAULT
from tracklake.functions import geo
from tracklake.operators import detect, loiter, risk, tracks
from tracklake.plans import flows

CFG = DEFAULT
T0 = 1769212800
SCHEMA = "mmsi long, ts long, lat double, lon double, sog double, draught double, seq long"
# vessel: (seconds, lat, lon, sog, draught)
HAND = {
    219000001: [(0, 55.0, 12.0), (14400, 55.0, 12.1)],
    219000002: [(0, 55.0, 12.0), (14400, 55.0, 12.009)],
    219000003: [(0, 55.0, 12.0), (43200, 55.0167, 12.0)],
    219000004: [(0, 55.0, 12.0), (14399, 55.0, 12.1)],
    219000005: [(0, 55.0, 12.0), (600, 56.0, 12.0), (1200, 55.0, 12.0), (1800, 55.0001, 12.0)],
    219000006: [(0, 55.0, 12.0), (0, 55.02, 12.0), (60, 55.02, 12.0)],
    219000007: [(0, 55.0, 12.0), (0, 55.003, 12.0)],
    219000008: [(0, 55.0, 12.0, 5.0, 10.0), (7200, 55.0, 12.0, 5.0, 10.5)],
    219000009: [(0, 55.0, 12.0, 5.0, 6.0), (7200, 55.0, 12.0, 5.0, 5.7)],
    219000010: [(0, 57.0, 11.0, 0.5, 8.0), (3600, 57.0, 11.0, 0.5, 8.0), (9000, 57.0, 11.0, 0.5, 7.0)],
    219000011: [(600, 57.003, 11.0, 0.4, 5.0), (9600, 57.003, 11.0, 0.4, 6.0)],
    219000012: [(0, 58.0, 11.0, 0.5), (3300, 58.0, 11.0, 0.5), (14400, 58.1, 11.0, 10.0)],
    219000013: [(0, 58.001, 11.0, 0.5), (7200, 58.001, 11.0, 0.5)],
}


def hand(spark):
    rows = [(m, T0 + p[0], p[1], p[2], *(p[3:4] or (5.0,)), *(p[4:5] or (0.0,)), k) for m, ps in HAND.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hand_made_tracks(spark):
    f = flows.find(hand(spark), CFG)
    a = {r.mmsi: r for r in f.a.collect()}
    assert set(a) == {219000001, 219000003}
    assert (a[219000001].gap_hours, a[219000001].dist_nm, a[219000001].implied_kn) == (4.0, 3.44, 0.86)
    assert (a[219000003].gap_hours, a[219000003].dist_nm, a[219000003].implied_kn) == (12.0, 1.0, 0.08)
    assert {(r.mmsi, r.change_pct) for r in f.c.collect()} == {(219000008, 5.0), (219000011, 20.0)}
    d = {r.mmsi: r for r in f.d.collect()}
    assert set(d) == {219000005, 219000006}
    assert (d[219000005].ts1 - T0, d[219000005].ts2 - T0, d[219000005].dist_nm, d[219000005].speed_kn) == (600, 1200, 60.04, 360.2)
    assert (d[219000006].event_type, d[219000006].dist_nm, d[219000006].speed_kn, d[219000006].dt_seconds) == ("simultaneous_transmission", 1.2, float("inf"), 0)
    assert {(r.mmsi, r.ts_start - T0, r.ts_end - T0, r.draught_start, r.draught_end) for r in f.candidates.collect()} == {
        (219000010, 0, 9000, 8.0, 7.0), (219000011, 600, 9600, 5.0, 6.0), (219000012, 0, 14400, None, None), (219000013, 0, 7200, None, None),
    }
    b = {r.mmsi_1: r for r in f.b.collect()}
    assert set(b) == {219000010, 219000012}
    x = b[219000010]
    assert (x.mmsi_2, x.dist_m, x.overlap_h, x.lat, x.confidence, x.draught_delta_1, x.draught_delta_2) == (219000011, 333.6, 2.33, 57.0015, "draught_transfer", -1.0, 1.0)
    x = b[219000012]
    assert (x.mmsi_2, x.dist_m, x.overlap_h, x.confidence, x.draught_delta_1) == (219000013, 111.2, 2.0, "proximity_only", None)
    scores = [(r.mmsi, r.dfsi) for r in f.risk.collect()]
    assert scores == [
        (219000008, 15.0), (219000011, 15.0), (219000005, 6.004), (219000003, 6.0), (219000001, 2.0), (219000006, 0.12), (219000010, 0.0), (219000012, 0.0), (219000013, 0.0),
    ]
    assert [r.mmsi for r in risk.top(f.risk).collect()] == [m for m, _ in scores[:5]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", [1, 7])
def test_random_tracks_equal_the_model(spark, seed, partitions):
    r = random.Random(seed)
    rows, seq = [], 0
    for m in range(12):
        ts, lat, lon = T0, 55.0 + 0.001 * r.randint(0, 3), 12.0
        for _ in range(120):
            ts += r.choice([0, 60, 600, 3600, 7200, 18000])
            if r.random() < 0.3:
                lat, lon = r.choice([(55.0, 12.0), (56.0, 12.0), (55.001, 12.001), (55.5, 12.2)])
            seq += 1
            rows.append((219000000 + m, ts, lat, lon, r.choice([0.0, 0.5, 0.999, 1.0, 8.0]), r.choice([0.0, 5.0, 5.2, 5.3, 6.0]), seq))
    df = spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA).repartition(partitions)
    pings = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], x)) for x in rows]
    pairs = tracks.pairs(df)
    ts = model.tracks(pings)
    got = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    want = lambda f: sorted(x for t in ts.values() for x in f(t))
    assert got(detect.going_dark(pairs, CFG), "mmsi", "gap_hours", "dist_nm", "ts_before", "ts_after") == want(model.going_dark)
    assert got(detect.draught_change(pairs, CFG), "mmsi", "gap_hours", "draught_before", "draught_after", "ts_before", "ts_after") == want(model.draught_change)
    assert got(detect.identity_cloning(pairs, CFG), "event_type", "mmsi", "dist_nm", "ts1", "ts2") == want(model.cloning)
    events = detect.going_dark(pairs, CFG), detect.draught_change(pairs, CFG), detect.identity_cloning(pairs, CFG)
    stats = lambda x: sorted((r.mmsi, r.max_gap_hours, round(r.total_impossible_nm, 6), r.count_C) for r in x.collect())
    assert stats(risk.track_stats(pairs, CFG)) == stats(risk.vessel_stats(*events))
    cands = [c for t in ts.values() for c in model.candidates(t)]
    found = loiter.candidates(df, CFG)
    key = lambda x: [-1 if v is None else v for v in x]
    assert sorted(map(tuple, found.select("mmsi", "ts_start", "ts_end", "draught_start", "draught_end").collect()), key=key) == sorted(((c["mmsi"], c["ts_start"], c["ts_end"], c["first"], c["last"]) for c in cands), key=key)
    assert got(loiter.loitering_pairs(found, CFG), "mmsi_1", "mmsi_2", "dist_m", "ts_start", "ts_end") == model.loitering(cands)


def test_distance_boundaries(spark):
    rows = [(55.0, 12.0, 55.0045, 12.0), (55.0, 12.0, 55.00449, 12.0), (0.0, 179.9999, 0.0, -179.9999)]
    x = spark.createDataFrame(rows, "a double, b double, c double, d double").select(F.round(geo.haversine_m(*map(F.col, "abcd")), 3).alias("m"), F.round(geo.bearing_deg(*map(F.col, "abcd")), 1).alias("t"))
    assert [(r.m, r.t) for r in x.collect()] == [(500.377, 0.0), (499.265, 0.0), (22.239, 90.0)]


def test_encounters_over_all_longitudes(spark):
    """Neighbouring cells, the antimeridian and the poles: the join by cells finds what the exact distance says."""
    r, cands = random.Random(4), []
    places = [(0.0, 179.9995), (0.0, -179.9995), (60.0, -179.999), (60.0, 179.999), (89.999, 10.0), (89.999, -170.0), (-89.9995, 0.0), (0.0, 180.0)]
    for _ in range(150):
        lat, lon = r.choice([0.0, 37.0, 71.3, 88.9]), r.choice([-180.0, -0.001, 12.0, 103.8, 179.999])
        places.append((lat + r.uniform(-0.004, 0.004), max(-180.0, min(180.0, lon + r.uniform(-0.02, 0.02)))))
    for k, (lat, lon) in enumerate(places):
        cands.append((219000000 + k, T0 + 60 * k, T0 + 90000 + 60 * k, lat, lon, 1.0, None, None))
    df = spark.createDataFrame(cands, "mmsi long, ts_start long, ts_end long, avg_lat double, avg_lon double, duration_h double, draught_start double, draught_end double")
    got = sorted((x.m, x.n) for x in loiter.encounters(df, CFG).select(F.least("a.mmsi", "b.mmsi").alias("m"), F.greatest("a.mmsi", "b.mmsi").alias("n")).collect())
    at = lambda c: {"lat": c[3], "lon": c[4]}
    want = sorted((a[0], b[0]) for i, a in enumerate(cands) for b in cands[i + 1 :] if model.nm(at(a), at(b)) * 1852 <= 500.0)
    assert got == want and len(want) > 100


def test_land_cells_exclude_position_errors_from_the_score(spark):
    cells = spark.createDataFrame([(550, 120), (560, 120)], "cell_lat long, cell_lon long")
    f = flows.find(hand(spark).where("mmsi = 219000005"), CFG, cells)
    assert [r.gps_error for r in f.d.collect()] == [True]
    assert [(r.mmsi, r.dfsi) for r in f.risk.collect()] == [(219000005, 0.0)]


def test_empty_input(spark):
    f = flows.find(spark.createDataFrame([], SCHEMA), CFG)
    f.views()
    assert [df.count() for df in (f.a, f.b, f.c, f.d, f.candidates, f.risk)] == [0] * 6
    assert spark.sql("select count(*) n from dfsi").first().n == 0


def test_one_shuffle_serves_the_detectors(spark):
    plan = flows.find(hand(spark), CFG).d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Python" not in plan and "CartesianProduct" not in plan
    plan = flows.find(hand(spark), CFG).b._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
