"""Ingest and detection, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..operators import clean, detect, loiter, risk, tracks
from ..sources import readers, writers


@dataclass(frozen=True)
class Findings:
    """Results as DataFrames; nothing has run yet."""

    a: DataFrame
    b: DataFrame
    c: DataFrame
    d: DataFrame
    candidates: DataFrame
    risk: DataFrame

    def views(self) -> None:
        """Register the results for SQL."""
        for name, df in (("anomalies_a", self.a), ("anomalies_b", self.b), ("anomalies_c", self.c), ("anomalies_d", self.d), ("loiter_candidates", self.candidates), ("dfsi", self.risk)):
            df.createOrReplaceTempView(name)


def ingest(spark: SparkSession, paths: str | Sequence[str], out: str, cfg: Config = DEFAULT) -> DataFrame:
    """Raw files to the canonical store at ``out``; all files in one job, so tracks cross midnight."""
    writers.write_pings(clean.ingested(readers.read_reports(spark, paths, cfg), cfg), out)
    return readers.read_pings(spark, out)


def find(pings: DataFrame, cfg: Config = DEFAULT, land_cells: DataFrame | None = None) -> Findings:
    """All detectors and the score over pings (with ``seq``), dealt by vessel once."""
    dealt = clean.by_vessel(pings)
    pairs = tracks.pairs(dealt)
    a, c, d = detect.going_dark(pairs, cfg), detect.draught_change(pairs, cfg), detect.identity_cloning(pairs, cfg, land_cells)
    cands = loiter.candidates(dealt, cfg)
    b = loiter.loitering_pairs(cands, cfg)
    stats = risk.track_stats(pairs, cfg) if land_cells is None else risk.vessel_stats(a, c, d)
    scores = risk.ranked(risk.scored(risk.with_pairs(stats, b), cfg))
    return Findings(a, b, c, d, cands, scores)


def detect_to(spark: SparkSession, pings: DataFrame, out: str, cfg: Config = DEFAULT, land_cells: DataFrame | None = None) -> Findings:
    """Write the five results of ``pings`` (a store, or shard files) as CSV below ``out``, and the top of the ranking.

    The pings are read and dealt by vessel once for the pairs that any detector reports and once for
    the loitering candidates; both are written, and results and score come from these small tables,
    which stay below ``out/parts``.
    """
    out = out.rstrip("/")
    dealt = clean.by_vessel(pings)
    kept = {"pairs": detect.with_event(tracks.pairs(dealt), cfg), "candidates": loiter.candidates(dealt, cfg)}
    for name, df in kept.items():
        df.write.mode("overwrite").parquet(f"{out}/parts/{name}")
        kept[name] = spark.read.schema(df.schema).parquet(f"{out}/parts/{name}")
    pairs, cands = kept["pairs"], kept["candidates"]
    a, c, d = detect.going_dark(pairs, cfg), detect.draught_change(pairs, cfg), detect.identity_cloning(pairs, cfg, land_cells)
    b = loiter.loitering_pairs(cands, cfg)
    scores = risk.ranked(risk.scored(risk.with_pairs(risk.vessel_stats(a, c, d), b), cfg))
    found = Findings(a, b, c, d, cands, scores)
    for name, df in (("anomalies_A", a), ("anomalies_B", b), ("anomalies_C", c), ("anomalies_D", d), ("dfsi", scores)):
        writers.write_result(df, f"{out}/{name}")
    writers.write_result(risk.top(scores, cfg), f"{out}/dfsi_top", files=1)
    return found
