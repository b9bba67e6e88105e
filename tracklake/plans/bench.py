"""Ingest benchmarks: sweeps over split size and workers, memory sampling, Amdahl fit.

Each point runs in a process of its own, so a session's number of workers can change.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import threading
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amdahl, parallel_share

SPLITS_MB = (1, 8, 64)
WORKERS = (1, 2, 4, 6, 8)


def worker_counts(most: int) -> list[int]:
    return sorted({*WORKERS, max(8, most)})


def _tree_mib(pid: int) -> float:
    import psutil

    try:
        top = psutil.Process(pid)
        return sum(p.memory_info().rss for p in [top, *top.children(recursive=True)]) / 2**20
    except psutil.Error:
        return 0.0


def measured(paths: Sequence[str], workers: int, split_mb: int, timeout: float = 3600.0) -> tuple[float, float]:
    """Seconds and peak MiB (children included) of one ingest; (-1, -1) where it fails."""
    code = "import json, sys; from tracklake.cli import main; main(json.loads(sys.argv[1]))"
    with tempfile.TemporaryDirectory() as out:
        args = ["ingest", *paths, f"--out={out}/store", f"--workers={workers}", f"--split-mb={split_mb}"]
        env = os.environ | {"PYTHONPATH": f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"}
        began, peak = time.time(), 0.0
        run = subprocess.Popen([sys.executable, "-c", code, json.dumps(args)], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        done = threading.Event()

        def sample() -> None:
            nonlocal peak
            while not done.wait(0.2):
                peak = max(peak, _tree_mib(run.pid))

        watcher = threading.Thread(target=sample, daemon=True)
        watcher.start()
        try:
            failed = run.wait(timeout)
        except subprocess.TimeoutExpired:
            run.kill()
            failed = run.wait()
        done.set()
        watcher.join()
        return (-1.0, -1.0) if failed else (round(time.time() - began, 2), round(peak, 1))


def split_sweep(paths: Sequence[str], workers: int, splits: Sequence[int] = SPLITS_MB) -> list[dict]:
    return [dict(zip(("split_mb", "time_s", "peak_ram_mib"), (s, *measured(paths, workers, s)))) for s in splits]


def worker_sweep(paths: Sequence[str], counts: Sequence[int], split_mb: int = 64) -> list[dict]:
    """Rows (workers, time_s, speedup, t_seq, peak_ram_mib); the speed-up is against one worker."""
    rows, first = [], None
    for n in sorted({1, *counts}):
        t, mib = measured(paths, n, split_mb)
        first = t if first is None else first
        rows.append({"workers": n, "time_s": t, "speedup": round(first / t, 3) if t > 0 and first > 0 else None, "t_seq": first, "peak_ram_mib": mib})
    return rows


def with_fit(rows: DataFrame) -> DataFrame:
    """Rows (workers, time_s) with the speed-up, the parallel share fitted at the highest count, and the law's speed-up."""
    seq = rows.where("workers = 1").agg(F.max("time_s").alias("t_seq"))
    x = rows.crossJoin(F.broadcast(seq)).withColumn("speedup", F.try_divide("t_seq", "time_s"))  # one row
    top = x.orderBy(F.desc("workers")).limit(1).select(parallel_share(F.col("speedup"), F.col("workers")).alias("p"))
    return x.crossJoin(F.broadcast(top)).withColumn("law", amdahl(F.col("p"), F.col("workers")))


def write_rows(rows: list[dict], path: str) -> None:
    """Sweep results as a CSV file with a header."""
    import csv

    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]) if rows else [])
        w.writeheader()
        w.writerows(rows)


def fitted_share(rows: list[dict]) -> float | None:
    """The parallel share at the highest number of workers that was measured; None without one."""
    top = max((r for r in rows if r["speedup"]), key=lambda r: r["workers"], default=None)
    if top is None:
        return None
    n, s = top["workers"], top["speedup"]
    return 1.0 if n == 1 else min(1.0, max(0.0, (1 / s - 1) / (1 / n - 1)))


def charts(splits: list[dict], workers: list[dict], prefix: str) -> list[str]:
    """Four charts, ``prefix`` and a number each: time and memory by split size, speed-up with the
    fitted law, memory by workers.  None where matplotlib isn't installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return []
    p = fitted_share(workers)
    law = [None if p is None else 1 / ((1 - p) + p / r["workers"]) for r in workers]
    made = []
    for k, (rows, x, ys) in enumerate(
        ((splits, "split_mb", [("time_s", None)]), (splits, "split_mb", [("peak_ram_mib", None)]), (workers, "workers", [("speedup", None), ("law", law)]), (workers, "workers", [("peak_ram_mib", None)])), 1
    ):
        fig, ax = plt.subplots()
        for name, values in ys:
            ax.plot([r[x] for r in rows], values or [r[name] for r in rows], marker="o", label=name)
        ax.set_xlabel(x)
        ax.legend()
        made.append(f"{prefix}{k}.png")
        fig.savefig(made[-1])
        plt.close(fig)
    return made
