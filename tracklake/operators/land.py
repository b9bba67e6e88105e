"""Positions on land, by a table of grid cells.

Without a table nothing is on land.  A table has rows (cell_lat, cell_lon): floor of the position
over the cell's size.  It is joined on those two keys; Spark broadcasts it where it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_DEGREES = 0.1


def flagged(df: DataFrame, cells: DataFrame | None, positions: list[tuple[str, str]], name: str) -> DataFrame:
    """``df`` with ``name``: whether any of the positions (lat and lon columns) is on land."""
    if cells is None:
        return df.withColumn(name, F.lit(False))
    known = cells.select(F.col("cell_lat").cast("long").alias("__a"), F.col("cell_lon").cast("long").alias("__b"), F.lit(True).alias("__on")).distinct()
    out, flag = df, F.lit(False)
    for k, (lat, lon) in enumerate(positions):
        at = known.select(F.col("__a").alias(f"__a{k}"), F.col("__b").alias(f"__b{k}"), F.col("__on").alias(f"__on{k}"))
        cell = lambda c: F.floor(F.col(c) / CELL_DEGREES).cast("long")
        out = out.join(at, (cell(lat) == F.col(f"__a{k}")) & (cell(lon) == F.col(f"__b{k}")), "left")
        flag = flag | F.coalesce(F.col(f"__on{k}"), F.lit(False))
    return out.withColumn(name, flag).select(*df.columns, name)
