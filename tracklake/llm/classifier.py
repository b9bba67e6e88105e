"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into runs of ``RUN`` words, and each is compressed with either dictionary.  The sum of
the differences of the two sizes, over the text's length, says which kind of text it is nearer to.
A run that repeats says nothing new, so it counts once in the sum but each time in the length: what
is repeated comes to a difference near zero whatever dictionary knows its words.  Short texts lean on
the mean difference, as if ``PRIOR`` bytes of a usual text were added.  This normalised difference is
the only thing that the score goes by: a logistic curve over it, fitted on labelled rows that no
dictionary has seen, makes it a probability.

The fit uses at most ``FIT_ROWS`` labelled rows of each class, those of least hash of doc_id, with
their whole texts: two in three for the dictionaries, made by a task for each class, the others for
the curve.
Rows whose crc32(doc_id) mod 5 is 0 are never learnt from.

Nulls: a null text is scored as the empty text; a null doc_id is scored, counts as not held out,
and is never learnt from.  Repeated rows are scored each; of repeated labels the higher counts.
Where a class has fewer than ``LEAST_ROWS`` rows to learn from, every score is the share of good
rows, smoothed.  An empty table gives no rows.  Columns beyond doc_id and text aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

FIT_ROWS, LEAST_ROWS = 4000, 20
RUN, PRIOR = 16, 20
SAMPLE, DICTIONARY, LEVEL = 2048, 112_640, 3
#: Segments of the training text and substrings counted, in bytes; without them little text gives a dictionary of a few.
SEGMENT, SUBSTRING = 64, 8


@dataclass
class Model:
    """Dictionaries (bad, good), the mean difference a byte, and the curve's slope and constant."""

    dictionaries: tuple[bytes, bytes] | None
    mean: float
    slope: float
    constant: float


def _compressors(model: Model) -> list:
    import zstandard

    out = []
    for raw in model.dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: str | None, compressors: list) -> tuple[int, int]:
    """By how many bytes the text is shorter with the good dictionary than with the bad one, and its length."""
    words = (text or "").encode("utf-8").split()
    runs = Counter(b" ".join(words[k : k + RUN]) for k in range(0, len(words), RUN))
    bad, good = compressors
    return sum(len(bad.compress(x)) - len(good.compress(x)) for x in runs), sum(n * len(x) for x, n in runs.items())


def normalised(bytes_less: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return (bytes_less + PRIOR * mean) / (length + PRIOR)


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is the dictionary itself
        return b"".join(samples)[:DICTIONARY]


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's method, slightly held towards zero: slope and constant."""
    mean, spread = float(x.mean()), float(x.std()) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def _learnt(key: tuple, rows: pa.Table) -> pa.Table:
    """A class's dictionary, from its whole texts."""
    texts = [(t or "").encode("utf-8") for _, t in sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()), key=lambda x: x[0])]
    samples = [raw[k : k + SAMPLE] for raw in texts for k in range(0, len(raw), SAMPLE)]
    return pa.table({"good": [key[0].as_py()], "dictionary": pa.array([_dictionary(samples) if samples else b""], pa.binary())})


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    first = [known.where(f"quality {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for q in ("<= 0", "> 0")]
    chosen = durable(first[0].union(first[1]), "fit-labels")  # at most 2 * FIT_ROWS rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = rows.select("doc_id", "text", (F.col("quality") > 0).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) < 2).alias("learn"))
    rows = durable(rows, "fit-rows")
    counts = {r.good: r.n for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    unsure = Model(None, 0.0, 0.0, float(np.log((good + 1) / (bad + 1))))
    if min(good, bad) < LEAST_ROWS:
        return unsure
    made = {r.good: bytes(r.dictionary) for r in rows.where("learn").groupBy("good").applyInArrow(_learnt, "good boolean, dictionary binary").collect()}
    if not (made.get(True) and made.get(False)):
        return unsure
    model = Model((made[False], made[True]), 0.0, 0.0, 0.0)
    # a few numbers a row, of at most 2 * FIT_ROWS rows
    seen = np.array(sorted(rows.where("NOT learn").select("doc_id", "text", "good").mapInArrow(_measured(model), "doc_id long, good double, less double, length double").collect()), dtype=float).reshape(-1, 4)
    y, less, length = seen[:, 1], seen[:, 2], seen[:, 3]
    if not 0 < y.sum() < len(y):
        return unsure
    model.mean = float((less / np.maximum(length, 1)).mean())
    model.slope, model.constant = _curve(normalised(less, length, model.mean), y)
    return model


def _measured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _compressors(model)
        for b in batches:
            x = np.array([difference(t.as_py(), c) for t in b.column("text")], dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good").cast(pa.int8()).cast(pa.float64()), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "good", "less", "length"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _compressors(model) if model.dictionaries else None
        for b in batches:
            if c:
                x = np.array([difference(t.as_py(), c) for t in b.column("text")], dtype=float).reshape(-1, 2)
                z = normalised(x[:, 0], x[:, 1], model.mean) * model.slope + model.constant
            else:
                z = np.full(b.num_rows, model.constant)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
