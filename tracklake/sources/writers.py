"""The canonical store, shard files and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pings(pings: DataFrame, path: str) -> None:
    """Parquet partitioned by shard, each file in the order of vessel and time; replaces what is there.

    ``seq`` is stored as the row's place in its vessel's order, so ties in time keep their order.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("mmsi").orderBy("ts", "seq")
    ordered = pings.withColumn("seq", F.row_number().over(w).cast("long"))
    ordered.sortWithinPartitions("shard", "mmsi", "ts", "seq").write.mode("overwrite").partitionBy("shard").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a folder, and paths in it."""
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shard_lines(pings: DataFrame, *more: str) -> DataFrame:
    """(shard, value): tab-separated lines with fixed numbers of decimals."""
    value = F.format_string("%d\t%d\t%.6f\t%.6f\t%.3f\t%.3f\t%s\t%s\t%s", "mmsi", "ts", "lat", "lon", "sog", "draught", "ship_type", "name", "dest")
    return pings.sortWithinPartitions("shard", *more, "mmsi", "ts", "seq").select("shard", *more, value.alias("value"))


def write_shards(pings: DataFrame, path: str, parts: int = 1) -> None:
    """Files ``shard_NNN.tsv`` of tab-separated text, which :func:`readers.read_shards` reads; replaces what is there.

    Each is in the order of vessel and time.  Empty shards have none.  With ``parts`` above 1 a shard
    is dealt by vessel over so many tasks and files (``shard_NNN-K.tsv``); a task sorts what it writes.
    """
    fs, at = _files(pings.sparkSession, path)
    dealt = pings.withColumn("part", F.pmod(F.xxhash64("mmsi"), F.lit(parts)).cast("int"))
    lines = shard_lines(dealt.repartition("shard", "part"), "part")
    lines.write.mode("overwrite").partitionBy("shard", "part").text(path)
    for shard in fs.globStatus(at("shard=*")):
        for k, part in enumerate(fs.globStatus(at(f"{shard.getPath().getName()}/part=*/part-*"))):
            number = int(shard.getPath().getName().removeprefix("shard="))
            if not fs.rename(part.getPath(), at(f"shard_{number:03d}{f'-{k}' if k else ''}.tsv")):
                raise OSError(f"no such file can be made: shard_{number:03d}.tsv")
        fs.delete(shard.getPath(), True)


def write_result(result: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of CSV files with a header, also where there are no rows; infinity is ``inf``.

    Files are in the result's order.  ``files``: into so many, for results of bounded size only.
    """
    cols = []
    for name, kind in result.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    made = result.select(*cols)
    (made.coalesce(files) if files else made).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
