"""Token counts as rollups that are maintained by deltas.

A change row says that a document's count enters (insert), leaves (delete) or is replaced
(revise: the old count leaves, the new one enters).  As signed rows these add up, so a batch is
summed to a few rows per source, language and tokenizer version, and totals are the sum of all
committed batches.

The store keeps standing totals.  A commit sums its batch, adds it to the totals in force, writes
the new totals to a folder of their own, and then creates the next numbered manifest, which names
them.  Creating that file is the commit: it fails if the file is there, so of two writers one goes on
and the other starts over from the new totals, and what a crash leaves behind is never named.  This
rests on the file system to refuse to create a file twice, as HDFS does; an object store has to
offer conditional writes, else there must be one writer.  Reading the totals opens one manifest and
reads one small table, however long the history.

A batch id that is committed already changes nothing if its sums are the same, as when a batch is
sent again, and is an error if they aren't.  A manifest names its batch, with a hash of its sums.
``compact`` moves the ids of manifests into one table and deletes these manifests and the totals they
name, but for those in force and of the commit before; it runs by itself every ``COMPACT_EVERY``
commits.  All paths go through Hadoop's file systems, so a store can be wherever Spark can write.

Nulls: a null source, language or version is a key of its own; a null count is 0 tokens; a null
text has 0 tokens and counts as a document.  Repeated rows add up.  An empty batch commits.  In
:func:`counted` other columns are passed on; a column named ``tokenizer`` or ``n_tokens`` is replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

KEYS = ["source", "lang", "tokenizer"]
TOTALS = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes (op, source, lang, tokenizer, n_tokens, and for a revision old_tokens).

    A revision may also move a document: old_source, old_lang and old_tokenizer, where these
    columns are there, say where the old count stands.
    """
    old = [F.col(f"old_{k}" if f"old_{k}" in changes.columns else k).alias(k) for k in KEYS]
    new = [F.col(k) for k in KEYS]
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    row = lambda keys, sign, c: F.struct(*keys, F.lit(sign).cast("long").alias("n_docs"), (sign * count(c)).alias("n_tokens"))
    former = row(old, -1, "old_tokens") if "old_tokens" in changes.columns else row(old, -1, "n_tokens")
    parts = F.when(F.col("op") == "insert", F.array(row(new, 1, "n_tokens"))).when(F.col("op") == "delete", F.array(row(new, -1, "n_tokens")))
    parts = parts.when(F.col("op") == "revise", F.array(former, row(new, 1, "n_tokens"))).otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.explode(parts).alias("x")).select("x.*")


def rolled(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


#: Commits between two compactions.
COMPACT_EVERY = 64
IDS = "batch string, digest string"


class Rollup:
    """Standing totals by source, language and tokenizer version, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _manifests(self) -> list[int]:
        where = self._at("manifest")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(where) if s.getPath().getName().isdigit()) if self._fs.exists(where) else []

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._at("manifest", f"{number:010d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _create(self, number: int, manifest: dict) -> bool:
        """Whether this writer is the one to create the manifest of that number."""
        self._fs.mkdirs(self._at("manifest"))
        try:
            stream = self._fs.create(self._at("manifest", f"{number:010d}"), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._at("manifest", f"{number:010d}")):
                return False
            raise e
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        return True

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.coalesce(8).write.parquet(f"{self.path}/{name}")  # a row per key
        return name

    def _state(self) -> tuple[int, dict, dict[str, str]]:
        """The last manifest's number and content, and batches with digests since the last compaction."""
        numbers = self._manifests()
        if not numbers:
            return 0, {"totals": None, "ids": None, "since": 0}, {}
        last = self._read(numbers[-1])
        since = [last if n == numbers[-1] else self._read(n) for n in numbers if n > last["since"]]
        return numbers[-1], last, {m["batch"]: m["digest"] for m in since}

    def _digest_of(self, batch: str, last: dict, recent: dict[str, str]) -> str | None:
        if batch in recent or not last["ids"]:
            return recent.get(batch)
        row = self.spark.read.schema(IDS).parquet(f"{self.path}/{last['ids']}").where(F.col("batch") == batch).first()
        return row.digest if row else None

    def batches(self) -> list[str]:
        """Ids of the committed batches, for inspection."""
        _, last, recent = self._state()
        old = [r.batch for r in self.spark.read.schema(IDS).parquet(f"{self.path}/{last['ids']}").collect()] if last["ids"] else []
        return sorted([*old, *recent])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if it is committed already, an error if with other sums."""
        if not batch:
            raise ValueError(f"not a batch id: {batch!r}")
        name = self._write(rolled(signed(changes)), "delta")
        try:
            delta = self.spark.read.schema(TOTALS).parquet(f"{self.path}/{name}")
            sums = delta.where("n_docs <> 0 OR n_tokens <> 0").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*TOTALS.names).cast("decimal(38,0)")).alias("x")).first()
            digest = f"{sums.n}:{sums.x}"
            while True:
                number, last, recent = self._state()
                known = self._digest_of(batch, last, recent)
                if known is not None and known != digest:
                    raise ValueError(f"batch {batch!r} is committed with other sums")
                if known is not None:
                    return False
                totals = self._write(rolled(self._totals(last).unionByName(delta)).where("n_docs <> 0 OR n_tokens <> 0"), "totals")
                if self._create(number + 1, last | {"batch": batch, "digest": digest, "totals": totals}):
                    break
        finally:
            self._fs.delete(self._at(name), True)
        if number + 1 - last["since"] >= COMPACT_EVERY:
            self.compact()
        return True

    def compact(self) -> None:
        """Move batch ids into one table; delete manifests, sums and totals that nothing names any more."""
        number, last, recent = self._state()
        if not recent:
            return
        ids = self.spark.createDataFrame(list(recent.items()), IDS)  # of at most COMPACT_EVERY batches, or so
        if last["ids"]:
            ids = self.spark.read.schema(IDS).parquet(f"{self.path}/{last['ids']}").unionByName(ids)
        named = [(n, self._read(n)) for n in self._manifests() if n <= number]
        stay = {m["totals"] for n, m in named if n >= number - 1}
        made = {"batch": None, "digest": None, "totals": last["totals"], "ids": self._write(ids, "ids"), "since": number + 1, "spare": sorted(stay - {last["totals"], None})}
        if not self._create(number + 1, made):
            return  # another writer was first; the next compaction does it
        for spare in last.get("spare", []):  # kept by the compaction before
            self._fs.delete(self._at(spare), True)
        for n, m in named:
            self._fs.delete(self._at("manifest", f"{n:010d}"), False)
            if m["totals"] and m["totals"] not in stay:
                self._fs.delete(self._at(m["totals"]), True)
        if last["ids"]:
            self._fs.delete(self._at(last["ids"]), True)

    def _totals(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{manifest['totals']}") if manifest["totals"] else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """The totals in force; keys whose documents have all left don't appear."""
        return self._totals(self._state()[1])


def counted(docs: DataFrame, path: str, pattern: str, tokenizer: str) -> DataFrame:
    """``docs`` without ``text``, but with tokenizer (the version's name) and n_tokens of every whole text.

    ``path`` and ``pattern``: a byte-level rank file that executors can open, and its pattern.
    """
    docs = docs.drop("tokenizer", "n_tokens")
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for b in batches:
            n = [len(encoding.encode_ordinary(t.as_py() or "")) for t in b.column("text")]
            cols = [b.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=[*(f.name for f in rest), "tokenizer", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())]))


def maintained(docs: DataFrame, store: str, path: str, pattern: str, name: str) -> DataFrame:
    """Totals of ``docs`` after three batches of changes, each sent twice.

    All documents enter under version ``name``; then exact copies of a text, all but the least
    doc_id, leave; then the counts of those that stay are revised to version ``name+end``, which
    also counts a closing token.
    """
    need = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))
    rows = durable(counted(need, path, pattern, name), "token-counts")
    first = durable(rows.groupBy("hash").agg(F.min("doc_id").alias("first")), "first")  # written, so that the join can split a hot text
    rows = durable(rows.join(first, "hash").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first"))), "token-changes")
    insert = rows.withColumn("op", F.lit("insert"))
    delete = rows.where("NOT stays").withColumn("op", F.lit("delete"))
    revise = rows.where("stays").select(
        F.lit("revise").alias("op"), "source", "lang", F.lit(f"{name}+end").alias("tokenizer"), (F.col("n_tokens") + 1).alias("n_tokens"), F.col("tokenizer").alias("old_tokenizer"), F.col("n_tokens").alias("old_tokens")
    )
    rollup = Rollup(docs.sparkSession, store)
    for batch, changes in (("1-load", insert), ("2-copies", delete), ("1-load", insert), ("3-closing", revise), ("2-copies", delete), ("3-closing", revise)):
        rollup.commit(batch, changes)
    return rollup.totals()


_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _encodings:
        import tiktoken

        from .bpe import read_ranks

        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]
