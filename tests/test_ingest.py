"""Raw files to the store and back, writers, command line, stream."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from tracklake.cli import main
from tracklake.config import DEFAULT
from tracklake.functions import scalars
from tracklake.operators import clean
from tracklake.plans import bench, flows
from tracklake.sources import readers, writers
from tracklake.streaming import ingest as stream

HEADER = ["# Timestamp", "Type of mobile", "MMSI", "Latitude", "Longitude", "SOG", "Draught", "Ship type", "Name", "Destination", "Extra"]
GOOD = ["24/01/2026 00:00:01", "Class A", "219000001", "55", "12", "1.5", "7", "Cargo", "N", "D", "x"]


def row(**changes):
    names = dict(zip(("ts", "kind", "mmsi", "lat", "lon", "sog", "draught", "ship", "name", "dest", "extra"), range(11)))
    out = list(GOOD)
    for k, v in changes.items():
        out[names[k]] = v
    return out


def write(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerows(rows)
    return str(path)


def test_validation_of_rows(spark, tmp_path):
    kept = [
        row(), row(ts="4/1/2026 0:0:1"), row(ts="24/01/2026  00:00:02"), row(kind=" Class A "), row(mmsi="200000000"), row(mmsi="999999998"), row(lat="0", lon="1"), row(lat="90", lon="-180"),
        row(mmsi="219000002", sog="", draught="abc", name='A "B", C', dest=" to\tport "),
    ]
    dropped = [
        *[row(ts=t) for t in ("31/02/2026 00:00:00", "bad", "24/01/26 00:00:01", "2026-01-24 00:00:01", "")], *[row(kind=k) for k in ("class a", "Class B", "Base Station", "")],
        *[row(mmsi=m) for m in ("0", "111111111", "123456789", "222222222", "999999999", "199999999", "1000000000", "abc", "219000001.0", "")],
        row(lat="0", lon="0"), *[row(lat=x) for x in ("90.0001", "nan", "", "1.5d")], row(lon="180.0001"), HEADER, row()[:3],
    ]
    raw = readers.read_reports(spark, write(tmp_path / "a.csv", kept + dropped))
    got = {(r.mmsi, r.ts, r.lat, r.lon): r for r in clean.clean(raw).collect()}
    assert len(got) == len(kept) - 1  # one of them differs from the first in white space alone
    assert (219000001, 1769212801, 55.0, 12.0) in got and (219000001, 1767484801, 55.0, 12.0) in got and (219000001, 1769212802, 55.0, 12.0) in got
    x = next(r for r in got.values() if r.mmsi == 219000002)
    assert (x.sog, x.draught, x.name, x.dest, x.ship_type) == (0.0, 0.0, 'A "B", C', "to port", "Cargo")


def test_missing_columns_are_empty(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("MMSI,# Timestamp,Type of mobile,Latitude,Longitude\n219000001,24/01/2026 00:00:01,Class A,55,12\n")
    assert tuple(clean.clean(readers.read_reports(spark, str(p))).drop("seq").first()) == (219000001, 1769212801, 55.0, 12.0, 0.0, 0.0, "", "", "")


def test_dedup_keeps_the_first_in_argument_order(spark, tmp_path):
    late = write(tmp_path / "a.csv", [row(sog="9"), row(lat="56")])
    early = write(tmp_path / "z.csv", [row(sog="1"), row(sog="2")])
    rows = clean.ingested(readers.read_reports(spark, [early, late])).collect()
    assert sorted((r.lat, r.sog) for r in rows) == [(55.0, 1.0), (56.0, 1.5)]
    assert {r.shard for r in rows} == {219000001 % DEFAULT.shards}


def test_source_order_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        paths = [write(tmp_path / f"{n}.csv", [row(sog=str(k)) for k in range(200)]) for n in ("b", "a")]
        raw = readers.read_reports(spark, paths)
        assert raw.rdd.getNumPartitions() > 4
        assert [r.SOG for r in raw.orderBy("seq").collect()] == [str(k) for k in range(200)] * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_store_shards_results_and_command_line(spark, tmp_path):
    day1 = write(tmp_path / "1.csv", [row(ts="24/01/2026 22:00:00"), row(ts="24/01/2026 21:00:00", lat="55.1")])
    day2 = write(tmp_path / "2.csv", [row(ts="25/01/2026 03:00:00", lat="55.5"), row(ts="24/01/2026 22:00:00")])
    store = flows.ingest(spark, [day1, day2], str(tmp_path / "store"))
    assert [(r.ts - 1769212800) // 3600 for r in store.orderBy("mmsi", "ts", "seq").collect()] == [21, 22, 27]
    found = flows.detect_to(spark, store, str(tmp_path / "out"))
    assert found.a.count() == 1  # the gap crosses midnight and the files
    lines = open(glob.glob(str(tmp_path / "out/anomalies_A/part-*"))[0]).read().splitlines()
    assert lines[0].startswith("mmsi,gap_hours") and lines[1].startswith("219000001,5.0,")
    assert open(glob.glob(str(tmp_path / "out/anomalies_B/part-*"))[0]).read().startswith("mmsi_1,")  # a header though no rows
    writers.write_shards(store, str(tmp_path / "tsv"))
    assert [p.rsplit("/", 1)[1] for p in glob.glob(str(tmp_path / "tsv/shard*"))] == [f"shard_{219000001 % DEFAULT.shards:03d}.tsv"]
    text = open(glob.glob(str(tmp_path / "tsv/shard_*.tsv"))[0]).read().splitlines()
    assert text[0] == "219000001\t1769288400\t55.100000\t12.000000\t1.500\t7.000\tCargo\tN\tD"
    (tmp_path / "old").mkdir()
    (tmp_path / "old/shard_001.tsv").write_text("\n".join([text[0], "1\t2", "x\ty\tz\ta\tb\tc", "219000002\t5\t55\t12\t\t"]) + "\n")
    old = readers.read_shards(spark, str(tmp_path / "old")).orderBy("mmsi").collect()
    assert [(r.mmsi, r.sog, r.draught, r.dest) for r in old] == [(219000001, 1.5, 7.0, "D"), (219000002, 0.0, 0.0, "")]
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path))
    assert clean.shard_counts(store).collect()[0].n == 3


def test_shards_round_trip(spark, tmp_path):
    rows = [row(mmsi=str(219000000 + k % 7), ts=f"24/01/2026 {k % 24:02}:00:00", lat=str(55 + k / 100), name=f"n{k}") for k in range(60)]
    store = flows.ingest(spark, write(tmp_path / "1.csv", rows), str(tmp_path / "store"))
    columns = ["mmsi", "ts", "lat", "lon", "sog", "draught", "ship_type", "name", "dest"]
    want = sorted(map(tuple, store.select(*columns).collect()))
    for parts in (1, 3):
        folder = str(tmp_path / f"tsv{parts}")
        writers.write_shards(store, folder, parts)
        names = sorted(p.rsplit("/", 1)[1] for p in glob.glob(folder + "/shard_*"))
        assert len(names) >= 7 and len(names) == len({n[:9] for n in names}) or parts > 1
        back = readers.read_shards(spark, folder)
        assert sorted(map(tuple, back.select(*columns).collect())) == want
        for f in glob.glob(folder + "/shard_*.tsv"):
            keys = [tuple(map(int, x.split("\t")[:2])) for x in open(f)]
            assert keys == sorted(keys)
    # ties in time keep their order through a shard file: seq is made of the place in it
    assert [r.name for r in back.where("mmsi = 219000000").orderBy("ts", "seq").collect()] == [r.name for r in store.where("mmsi = 219000000").orderBy("ts", "seq").collect()]


def test_command_line_from_reports_to_results(spark, tmp_path, capsys):
    """Ingest to a store and shard files; detect from either gives the same results; a land mask marks a jump."""
    track = [row(ts="24/01/2026 00:00:00"), row(ts="24/01/2026 00:10:00", lat="56"), row(ts="24/01/2026 00:20:00"), row(ts="24/01/2026 08:00:00", lat="55.5", draught="9")]
    day = write(tmp_path / "1.csv", track)
    at = lambda name: str(tmp_path / name)
    assert main(["ingest", day, "--out", at("store"), "--shards-dir", at("tsv")]) == 0 and "4 pings" in capsys.readouterr().out
    (tmp_path / "land.csv").write_text("cell_lat,cell_lon\n560,120\n")
    results = {}
    for name, more in (("a", ["--store", at("store")]), ("b", ["--shards-dir", at("tsv")]), ("c", ["--shards-dir", at("tsv"), "--land", at("land.csv")])):
        assert main(["detect", *more, "--out", at(name)]) == 0
        read = lambda kind: sorted(map(tuple, spark.read.option("header", True).csv(f"{at(name)}/{kind}").collect()))
        results[name] = {kind: read(kind) for kind in ("anomalies_A", "anomalies_B", "anomalies_C", "anomalies_D", "dfsi", "dfsi_top")}
        assert len(glob.glob(f"{at(name)}/dfsi_top/part-*")) == 1
    assert results["a"] == results["b"] and [len(results["a"][k]) for k in ("anomalies_A", "anomalies_C", "anomalies_D")] == [1, 1, 1]
    assert results["a"]["anomalies_D"][0][-1] == "false" and results["c"]["anomalies_D"][0][-1] == "true"
    assert results["c"]["dfsi"] != results["a"]["dfsi"] and "219000001" in capsys.readouterr().out


def test_results_equal_those_of_the_lazy_flow(spark, tmp_path):
    from tracklake.plans import testbed

    pings = testbed.pings(spark, "/root/testdata/sf0.001").withColumn("ship_type", F.lit("x"))
    lazy, written = flows.find(pings), flows.detect_to(spark, pings, str(tmp_path / "out"))
    for name in ("a", "b", "c", "d", "candidates", "risk"):
        assert sorted(map(str, getattr(lazy, name).collect())) == sorted(map(str, getattr(written, name).collect())), name


def test_rounding_is_exact(spark):
    """Python's round, on the exact binary value: near ties, at ties, large and small numbers, none."""
    r = random.Random(2)
    xs = [2.675, 0.125, 0.375, 2.5, -2.5, 1.005, -0.001, 0.0, 1e15, 1e300, 4503599627370497.5, 0.285, 1.0000005, 123456.789012345, *[r.uniform(-1e4, 1e4) for _ in range(3000)]]
    xs += [k / 1000 + d for k in range(1, 2000, 5) for d in (0.0, 1e-16, -1e-16, 1e-13)] + [k + 0.5 for k in range(50)]
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("inf")]], "x double")
    for n in (0, 1, 2, 3, 6):
        for v in df.select("x", scalars.rounded(F.col("x"), n).alias("y")).collect():
            assert v.y == (v.x if v.x is None or v.x == float("inf") else round(v.x, n) + 0.0), (v.x, n)


def test_stripping_and_numbers(spark):
    cases = ["a", " a", "a\t", "\u00a0a\u2003", "", " ", "\u3000", "é", " é ", "a b", "\x1fa"]
    got = spark.createDataFrame([(c,) for c in cases], "x string").select("x", scalars.strip(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [c.strip("\x0b\x0c\r\n\t \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2028\u2029\u202f\u205f\u3000") for c in cases]
    x = spark.createDataFrame([("1.5",), ("1.5d",), ("2f",), ("inf",), ("nan",), ("x",), ("",), ("7",), ("-3",), ("7.0",)], "x string")
    got = x.select(scalars.parse_float(F.col("x")).alias("f"), scalars.parse_int(F.col("x")).alias("i")).collect()
    assert [str(r.f) for r in got] == ["1.5", "None", "None", "inf", "nan", "None", "None", "7.0", "-3.0", "7.0"] and [r.i for r in got] == [None] * 7 + [7, -3, None]


def test_no_column_is_parsed_twice(spark, tmp_path):
    """Filters don't take the parsing along: each pattern is in the plan as often as there are columns it reads."""
    raw = readers.read_reports(spark, write(tmp_path / "a.csv", [row()]))
    plan = clean.clean(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") == 6 and plan.count("$3-$2-$1 $4:$5:$6") == 1 and plan.count("regexp_replace") <= 11


def test_memory_trace_and_fit(spark, tmp_path):
    (tmp_path / "m.dat").write_text("CMDLINE x\nMEM 10.5 1\nMEM 99.25 2\nMEM bad 3\n")
    assert readers.peak_memory_mib(spark, str(tmp_path / "m.dat")).first().peak_mib == 99.25
    assert bench.worker_counts(4) == [1, 2, 4, 6, 8] and bench.worker_counts(12)[-1] == 12
    x = bench.with_fit(spark.createDataFrame([(1, 10.0), (2, 5.0)], "workers int, time_s double")).orderBy("workers").collect()
    assert [(r.speedup, r.p, r.law) for r in x] == [(1.0, 1.0, 1.0), (2.0, 1.0, 2.0)]


def test_sweep_of_one_point(tmp_path):
    path = write(tmp_path / "a.csv", [row(), row(lat="56")])
    rows = bench.split_sweep([path], 1, [8])
    assert rows[0]["split_mb"] == 8 and rows[0]["time_s"] > 0 and rows[0]["peak_ram_mib"] > 50
    assert bench.measured([str(tmp_path / "none.csv")], 1, 8) == (-1.0, -1.0)
    bench.write_rows(rows, str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_text().startswith("split_mb,time_s,peak_ram_mib")
    sweep = [{"workers": 1, "speedup": 1.0}, {"workers": 4, "speedup": 2.5}, {"workers": 8, "speedup": None}]
    assert round(bench.fitted_share(sweep), 6) == 0.8 and bench.fitted_share([]) is None
    assert isinstance(bench.charts([], [], str(tmp_path / "c")), list)


def test_stream_fills_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")
    write(tmp_path / "in/1.csv", [row(), row()])
    stream.start(spark, *args, header=HEADER).awaitTermination(60)
    write(tmp_path / "in/2.csv", [row(sog="3"), row(lat="56")])
    stream.start(spark, *args, header=HEADER).awaitTermination(60)
    assert sorted((r.lat, r.sog) for r in stream.stored(spark, args[1]).collect()) == [(55.0, 1.5), (56.0, 1.5)]


def test_cli_parses():
    with pytest.raises(SystemExit):
        main(["nothing"])
