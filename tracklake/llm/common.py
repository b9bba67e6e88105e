"""What the operators share: reading tables, durable intermediate tables, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and TAB to CR.
WHITE = bytes([0x20, *range(0x09, 0x0E)])


_shipped: set[str] = set()


#: Arrow batches hold whole texts: so many rows and bytes at most, unless the session says otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions pickled by name.

    Also bounds the session's Arrow batches where they still have Spark's defaults.
    """
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default).rstrip("bB") in (default, "64m", "64M", str(2**31 - 1)):
            spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="tracklake-ship-")) / "tracklake-code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder is made and set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracklake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder is the cluster's to clear
        pass


#: What this Python worker remembers between tasks, by operator.
remembered: dict[str, dict] = {}


def memory_of(operator: str) -> dict:
    """The worker's memory of one operator; that of any other is given up first.

    Workers serve one operator after the other; so what they remember never adds up.
    """
    if remembered.keys() - {operator}:
        for name in [n for n in remembered if n != operator]:
            del remembered[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # back to the system, where the C library can
    return remembered.setdefault(operator, {})


def pooled(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined until ``column`` holds ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/tracklake/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's process ends; they stay valid for every DataFrame made from them.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def presence(df: DataFrame, key: str, bits: int = 18) -> DataFrame:
    """At most ``2**bits`` rows (one int each) that cover every value of ``key``.

    A semi join with it, broadcast, thins a large table before an exact join by ``key``; as its
    size is bounded whatever the data, broadcasting is safe.  It lets some rows through that
    have no partner, never the other way.
    """
    return df.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int").alias("__slot")).distinct()


def thinned(df: DataFrame, key: str, by: DataFrame, by_key: str, bits: int = 18) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``by[by_key]``."""
    slots = F.broadcast(presence(by, by_key, bits))
    return df.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")).join(slots, "__slot", "left_semi").drop("__slot")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (id, component), the least id reachable.

    Alternates large-star and small-star steps over the edges, which never grow in number; the
    rounds needed grow with the logarithm of a component's size.  Every round is written to the
    shared folder, so a lost executor costs a round at most.  Nodes without edges don't appear.
    """
    e = durable(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    for _ in range(rounds):
        # a forest of stars: each a has one edge, and no b is an a
        ends = e.select("a", F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        if ends.where("low > 1 OR (low > 0 AND high > 0)").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", F.col("b").alias("c")).distinct())
        # large star: each node's larger neighbours are tied to its least neighbour or itself
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined, so that the join can split a hot node
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node and its smaller neighbours are tied to the least of them
        small = durable(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        tied = large.join(small, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = durable(tied.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), "edges")
    raise RuntimeError("components did not settle")
