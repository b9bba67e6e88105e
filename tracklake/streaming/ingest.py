"""Continuous ingest: raw report files that arrive in a folder go to the canonical store.

The detectors are batch operators, as a track is only known whole; the stream keeps the store
they read.  Each micro-batch is one folder of the store, so a batch that is run again replaces
itself.  Dedup across batches is left to the read (``stored``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators import clean


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, cfg: Config = DEFAULT, header: list[str] | None = None) -> StreamingQuery:
    """Start the stream; ``header``: the files' columns in order, the known ones by default."""
    names = header or list(vars(cfg.columns).values())
    raw = spark.readStream.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).option("escape", '"').csv(folder)
    place = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("place", place)

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.struct("place.*", F.monotonically_increasing_id().alias("row")))
        clean.ingested(rows, cfg).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={number}")

    return raw.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The store's pings, deduplicated over batches: of equal ones the first that came."""
    x = spark.read.parquet(store)
    return clean.dedup(clean.by_vessel(x.withColumn("seq", F.struct("batch", "seq")).drop("batch")))
