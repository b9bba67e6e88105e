"""Quality rules with thresholds that adapt to each language and source.

Per document, exact counts are made in one Arrow pass.  Of the documents that pass the base rule,
each signal goes into a log-bucket quantile sketch of its language and source: counts per bucket of
relative width 2 %, so two sketches merge by adding counts and the result doesn't depend on how rows
were dealt out.  Sketches of a language, and of all documents, are merged from those of the groups.

A fence comes from its sketch alone; there is no fixed cutoff.  From the median up the sketch's
quantiles are walked in steps of 1/``STEPS``.  While the next one is at most ``1 + spread`` times as
far from the median as the last, it belongs to the bulk; a wider gap ends the bulk.  The fence is as
far from the median as the next quantile could have been.  So what is usual in a source passes
there, whatever it is, and what stands apart from it doesn't; junk that is a few per cent of a group
doesn't move its fence.  As no step can be finer than the counts, each is widened by the sketch's
bucket and by ``UNITS``, what one occurrence counts for, in a document of the group's median size.
Fences of small groups lean on their language's, and these on that of all, as if ``PRIOR`` documents
of the parent were in the group.

A document is rejected where a count lies above the fence times its size by more than chance, again
``1 + spread`` occurrences.

Nulls: a null text has no words and fails the base rule; null languages and sources form groups of
their own; a null doc_id stays as a row.  Repeated rows each get a row.  Columns of the input
beyond doc_id, text, lang, source aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, durable, memory_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
SYMBOLS = b"#*$%&|<>"
#: Width of a sketch bucket: values in one differ by 2 % at most.
GAMMA = 1.02
#: signal: (numerator, denominator)
SIGNALS = {
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}
#: What one occurrence adds to a signal's numerator: a repeated window of three words covers six.
UNITS = {s: 6 if s == "repeat_share" else 1 for s in SIGNALS}
SIZES = sorted({under for _, under in SIGNALS.values()})
#: Quantiles of a walk; documents of the parent that a group's fence leans on.
STEPS, PRIOR = 200, 20
#: Groups beyond this many are joined by shuffle, not broadcast.
BROADCAST_GROUPS = 20_000


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_WHITE, _SYMBOL, _UPPER = _lut(WHITE), _lut(SYMBOLS), _lut(bytes(range(65, 91)))


def repeated_words(ids: np.ndarray, n: int = 3) -> int:
    """Words that lie in a window of ``n`` words found twice or more."""
    if len(ids) <= n:
        return 0
    key, width = ids[: len(ids) - n + 1].astype(np.int64), int(ids.max()) + 1
    for k in range(1, n):
        if int(key.max()) + 1 > (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * width + ids[k : len(ids) - n + 1 + k]
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, np.unique(again))
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(n):
        covered[k : len(ids) - n + 1 + k] |= hit
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw, dtype=np.uint8)
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    chars = int(((flat & 0xC0) != 0x80).sum()) - int(_WHITE[flat].sum())
    lines = raw.split(b"\n")
    once, dup, full = set(), 0, 0
    for line in lines:
        if line.strip():
            full += 1
            dup += line in once
            once.add(line)
    repeat = repeated_words(ids) if len(seen) < len(words) else 0
    return len(words), chars, int(_SYMBOL[flat].sum()), dup, repeat, full, int(_UPPER[flat].sum())


def _count_batches(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("quality")
        for b in batches:
            rows = [counts_of(x.as_py()) for x in b.column("row").field(at)]
            made = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS), COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("row"), made], names=["row", "q"])

    return run


def with_counts(docs: DataFrame) -> DataFrame:
    """(row, q): every row of ``docs``, with a struct of exact counts of its whole text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    q = T.StructField("q", T.StructType([T.StructField(x, T.LongType()) for x in COUNTS]))
    return rows.mapInArrow(_count_batches(docs.columns.index("text")), T.StructType([*rows.schema.fields, q]))


def _needed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source; a column that isn't there is null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def counts(docs: DataFrame) -> DataFrame:
    return with_counts(_needed(docs)).select("row.doc_id", "row.lang", "row.source", "q.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(name: str) -> Column:
    over, under = SIGNALS[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def sketches(counted: DataFrame) -> DataFrame:
    """One sketch per lang, source and signal (or size), as rows (lang, source, signal, bucket, n).

    Bucket 0 holds zeros, bucket b > 0 the values in (GAMMA**(b-1), GAMMA**b] millionths. Merge
    sketches with :func:`merge`: union, then add up.
    """
    bucket = lambda x: F.when(x <= 1e-6, F.lit(0)).otherwise(F.ceil(F.log(x * 1e6) / F.log(F.lit(GAMMA)))).cast("int")
    values = {s: _share(s) for s in SIGNALS} | {c: F.col(c).cast("double") for c in SIZES}
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bucket(x).alias("bucket")) for s, x in values.items()]))
    rows = counted.where(~base_failed()).select("lang", "source", each.alias("x")).select("lang", "source", "x.signal", "x.bucket")
    return rows.groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "source", "signal", "bucket").agg(F.sum("n").alias("n"))


def _walked(sketch: DataFrame, spread: float) -> DataFrame:
    """(level, lang, source, signal, n, own): the fence of every sketch of a group (level 0), a language (1) and all (2)."""
    null = F.lit(None).cast("string")
    levels = [F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), null), (null, null)))]
    x = sketch.select(F.explode(F.array(*levels)).alias("of"), "signal", "bucket", "n").groupBy("of.level", "of.lang", "of.source", "signal", "bucket").agg(F.sum("n").alias("n"))
    # a window runs over a group's buckets, of which there are some thousands at most whatever the number of documents
    group = Window.partitionBy("level", "lang", "source")
    one = Window.partitionBy("level", "lang", "source", "signal")
    x = x.withColumn("total", F.sum("n").over(one)).withColumn("upto", F.sum("n").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("value", F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5) / 1e6))
    x = x.withColumn("median", F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("value"))).over(one))
    x = x.withColumns({c: F.max(F.when(F.col("signal") == c, F.col("median"))).over(group) for c in SIZES})
    unit = F.coalesce(*[F.when(F.col("signal") == s, F.lit(float(UNITS[s])) / F.col(under)) for s, (_, under) in SIGNALS.items()])
    step = lambda n: F.floor(STEPS * n / F.col("total"))
    before = F.col("upto") - F.col("n")
    stops = x.where(F.col("signal").isin(*SIGNALS) & (F.col("value") >= F.col("median")) & (step(F.col("upto")) > step(before)) & (step(before) < STEPS - 1))
    stops = stops.withColumn("reach", F.col("median") + (1 + spread) * (F.col("value") - F.col("median") + unit + F.col("value") * (GAMMA - 1)))
    ends = F.coalesce(F.lead("value").over(one.orderBy("bucket")) > F.col("reach"), F.lit(True))
    return stops.withColumn("ends", ends).where("ends").groupBy("level", "lang", "source", "signal").agg(F.max("total").alias("n"), F.min("reach").alias("own"))


def fences(sketch: DataFrame, spread: float = 1.0) -> DataFrame:
    """Per lang and source one row with an upper fence for each signal."""
    x = durable(_walked(sketch, spread), "quality-walks")
    at = lambda k: x.where(F.col("level") == k).select(F.col("lang").alias(f"lang{k}"), F.col("signal").alias(f"signal{k}"), F.col("n").alias(f"n{k}"), F.col("own").alias(f"own{k}"))
    leant = lambda n, own, parent: (F.col(n) * F.col(own) + PRIOR * parent) / (F.col(n) + PRIOR)
    j = x.where("level = 0").join(at(1), F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("signal") == F.col("signal1"))).join(at(2), F.col("signal") == F.col("signal2"))
    j = j.withColumn("fence", leant("n", "own", leant("n1", "own1", F.col("own2"))))
    return j.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"max_{s}") for s in SIGNALS])


def _fenced(docs: DataFrame, fence: DataFrame, spread: float) -> DataFrame:
    """``docs`` (lang, source and counts) with ``base_failed`` and ``kept``."""
    small = fence.count() <= BROADCAST_GROUPS  # a row is under 150 bytes
    f = fence.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"max_{s}" for s in SIGNALS])
    j = docs.join(F.broadcast(f) if small else f, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    over = F.lit(False)
    for s, (count, size) in SIGNALS.items():
        over = over | F.coalesce(F.col(count) > F.col(f"max_{s}") * F.col(size) + (1 + spread) * UNITS[s], F.lit(False))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("of_lang", "of_source", *[f"max_{s}" for s in SIGNALS])


def judged(docs: DataFrame, spread: float = 1.0) -> DataFrame:
    """Every document's doc_id, lang, source and counts, with ``base_failed`` and ``kept``.

    ``kept`` is false where the base rule fails or a signal lies above the fence of the
    document's language and source.
    """
    c = durable(counts(docs), "quality-counts")
    return _fenced(c, durable(fences(sketches(c), spread), "quality-fences"), spread)


def keep_good(docs: DataFrame, spread: float = 1.0) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Texts are read twice, once for the sketches and once to filter, and never shuffled.
    """
    fence = durable(fences(sketches(counts(docs)), spread), "quality-fences")
    group = [(F.col(f"row.{c}") if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return _fenced(with_counts(docs).select("row", *group, "q.*"), fence, spread).where("kept").select("row.*")
