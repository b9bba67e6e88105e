"""Command line: ``python -m tracklake.cli ingest | detect | bench``."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import bench, flows
from .sources import readers, writers


def session(workers: int | None = None, split_mb: int | None = None) -> SparkSession:
    """The session at hand, or a local one; a cluster's own settings are left alone."""
    b = SparkSession.builder.appName("tracklake").config("spark.sql.session.timeZone", "UTC")
    if workers or not os.environ.get("SPARK_MASTER"):
        b = b.master(f"local[{workers or '*'}]")
    if split_mb:
        b = b.config("spark.sql.files.maxPartitionBytes", f"{split_mb}m")
    return b.getOrCreate()


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracklake")
    sub = p.add_subparsers(dest="what", required=True)
    one = sub.add_parser("ingest", help="raw report files to the canonical store")
    one.add_argument("files", nargs="+")
    one.add_argument("--out", default="store")
    one.add_argument("--shards-dir", help="also write shard_NNN.tsv files there")
    two = sub.add_parser("detect", help="a store, or shard files, to result files")
    two.add_argument("--store", default="store")
    two.add_argument("--shards-dir", help="a folder of shard_*.tsv to read in place of the store")
    two.add_argument("--land", help="cells on land, as Parquet or CSV; jumps that end there are position errors")
    two.add_argument("--out", default="results")
    three = sub.add_parser("bench", help="sweeps of ingest over split sizes and workers")
    three.add_argument("files", nargs="+")
    three.add_argument("--out", default="bench", help="prefix of two CSV files and, with matplotlib, four charts")
    for s in (one, two, three):
        s.add_argument("--workers", type=int)
        s.add_argument("--split-mb", type=int)
    args = p.parse_args(argv)
    if args.what == "bench":
        most = args.workers or os.cpu_count() or 1
        splits, workers = bench.split_sweep(args.files, most), bench.worker_sweep(args.files, bench.worker_counts(most))
        bench.write_rows(splits, f"{args.out}_splits.csv")
        bench.write_rows(workers, f"{args.out}_workers.csv")
        bench.charts(splits, workers, f"{args.out}_")
        return 0
    spark = session(args.workers, args.split_mb)
    if args.what == "ingest":
        store = flows.ingest(spark, args.files, args.out)
        if args.shards_dir:
            writers.write_shards(store, args.shards_dir)
        print(store.count(), "pings")
    else:
        pings = readers.read_shards(spark, args.shards_dir) if args.shards_dir else readers.read_pings(spark, args.store)
        flows.detect_to(spark, pings, args.out, land_cells=readers.read_land(spark, args.land) if args.land else None)
        spark.read.option("header", True).csv(f"{args.out.rstrip('/')}/dfsi_top").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
