"""Raw report files, shard files and memory traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..schema import PING


def read_reports(spark: SparkSession, paths: str | Sequence[str], cfg: Config = DEFAULT) -> DataFrame:
    """Raw report files with a header, all columns as text, with ``seq`` in source order.

    Columns are found by name; those that a file lacks are null.  A path may be a folder or a
    pattern: its files, which must share a header, are one scan in order of name; this is the way
    for thousands of files.  ``seq`` orders rows by the file's
    place in ``paths``, then by place in the file: it is made at the scan from the file, the start of
    its split and the row's number there, so it holds whatever order splits are read in.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for k, path in enumerate(paths):
        raw = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
        seq = F.struct(F.lit(k).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        wanted = [F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in vars(cfg.columns).values()]
        parts.append(raw.select(*wanted, seq.alias("seq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shard files ``shard_*.tsv`` of a folder as pings, with ``seq``.

    Rows of fewer than six fields, or with a number that can't be read, are left out.
    """
    jvm = spark.sparkContext._jvm
    folder = path.rstrip("/")
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/shard_*.tsv")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(f"no shard_*.tsv in {path}")
    line = spark.read.text(f"{folder}/shard_*.tsv")
    f = F.split("value", "\t", -1)
    number = lambda k: F.try_element_at(f, F.lit(k))
    x = line.select(
        number(1).try_cast("bigint").alias("mmsi"),
        number(2).try_cast("bigint").alias("ts"),
        number(3).try_cast("double").alias("lat"),
        number(4).try_cast("double").alias("lon"),
        *[F.when(F.trim(number(k)) == "", F.lit(0.0)).otherwise(number(k).try_cast("double")).alias(c) for k, c in ((5, "sog"), (6, "draught"))],
        *[F.coalesce(number(k), F.lit("")).alias(c) for k, c in ((7, "ship_type"), (8, "name"), (9, "dest"))],
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        F.size(f).alias("fields"),
    )
    whole = (F.col("fields") >= 6) & F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return x.where(whole & F.col("sog").isNotNull() & F.col("draught").isNotNull()).drop("fields")


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """The canonical store: Parquet by shard."""
    return spark.read.schema(T.StructType([*PING.fields, T.StructField("seq", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)


def read_land(spark: SparkSession, path: str) -> DataFrame:
    """Cells on land (cell_lat, cell_lon: floor of the position over 0.1 degrees), from Parquet or CSV with a header."""
    x = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return x.select(F.col("cell_lat").cast("long"), F.col("cell_lon").cast("long"))


def peak_memory_mib(spark: SparkSession, path: str) -> DataFrame:
    """One row: the highest figure of a memory trace's ``MEM`` lines; -1 if it has none."""
    f = F.split(F.col("value"), " ")
    x = spark.read.text(path).where(F.col("value").startswith("MEM "))
    return x.agg(F.coalesce(F.max(F.try_element_at(f, F.lit(2)).try_cast("double")), F.lit(-1.0)).alias("peak_mib"))
