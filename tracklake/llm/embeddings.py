"""Near-duplicate vectors by collision counting over one-dimensional projections.

1. Equal vectors become one point with a weight.  Points are normalised and projected on ``LINES``
   random directions.
2. Points are dealt to cells: in each of ``tables`` repetitions a cell is a tuple of extremes, for
   each of some groups of random directions the one on which the point's projection is largest, and
   its sign.  A pair at the cosine asked for shares a cell of some repetition with probability
   ``recall``.  The number of bits grows with the logarithm of the number of points, which keeps
   cells near ``CELL`` points and the pairs looked at far below all pairs.
3. In a cell points are sorted along the first line.  Each point's query-centred windows, one per
   line, all of the same width, are counted per pair: a wider window along the sorted line bounds the
   points looked at, the other lines follow in groups, and pairs that can't reach the count any more
   are let go.  The count asked for is calibrated: the highest that a pair at exactly the cosine
   asked for reaches with probability ``recall``, by the binomial law of independent lines.
4. Pairs that pass are verified by cosine in double precision.  A pair that meets in several
   repetitions counts in the first of them alone, by the cells that each point carries along, so
   numbers of links add up without a shuffle of pairs.  A cell hands on a number of links per point
   and, for components, a spanning forest of its links: at most one edge per point.

Large cells are split into blocks and dealt as pairs of blocks, so no task holds a whole cell.

Nulls: a vector that is null, zero, or holds null or non-finite components links with nothing.
Vectors of different lengths never link; those of each length are compared with each other.  A null
vec_id stays a row (of null component unless it links).  Repeated rows are vectors of their own,
linked as they are equal.  An empty table gives no rows.  Columns beyond vec_id and embedding aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable

#: Points in a cell that the bits aim at; points of a block; bits of an extreme at most.
CELL, BLOCK, EXTREME = 512, 2048, 7
LINES, SEED = 32, 20240131
#: Windows, of two deviations either way, that bound the points looked at: a pair at the cosine lies outside with probability 0.0002.
WIDE = 1.85


def parts_of(points: int) -> list[int]:
    """Bits of each extreme that makes up a cell: one of ``2**(bits-1)`` directions, and its sign."""
    bits = max(0, math.ceil(math.log2(max(1, points) / CELL)))
    return [EXTREME] * (bits // EXTREME) + [bits % EXTREME] * (bits % EXTREME > 0)


@cache
def same_extreme(cosine: float, bits: int, tries: int = 40_000) -> float:
    """The share of pairs at the cosine that have an extreme in common, less three deviations, by simulation.

    Projections on directions with independent normal components are normal with the cosine for correlation.
    """
    r = np.random.default_rng(SEED)
    a = r.standard_normal((tries, 2 ** (bits - 1)))
    b = cosine * a + math.sqrt(1 - cosine * cosine) * r.standard_normal(a.shape)
    p = float((_extreme(a) == _extreme(b)).mean())
    return p - 3 * math.sqrt(p * (1 - p) / tries)


def plan(points: int, cosine: float, recall: float) -> tuple[list[int], int]:
    """Bits of a cell's extremes and number of tables for so many points."""
    parts = parts_of(points)
    together = math.prod(same_extreme(cosine, b) for b in parts)
    return parts, 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def calibrated(cosine: float, recall: float, lines: int = LINES) -> tuple[float, int]:
    """Half the window's width and the count asked for.

    Along a line with independent normal components, the distance of two unit vectors at the
    cosine is normal too, with deviation sqrt(2 - 2 * cosine).
    """
    half = 2.0 * math.sqrt(2 - 2 * cosine)
    p = math.erf(2.0 / math.sqrt(2))
    below, least = 0.0, 0
    while below + (x := math.comb(lines, least) * p**least * (1 - p) ** (lines - least)) <= 1 - recall:
        below, least = below + x, least + 1
    return half, least


def _extreme(p: np.ndarray) -> np.ndarray:
    """For each row of projections the column of the largest, and its sign."""
    k = np.abs(p).argmax(1)
    return 2 * k + (p[np.arange(len(p)), k] > 0)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, LINES))


def _codes(x: np.ndarray, parts: list[int], tables: int) -> np.ndarray:
    """For each point its cell in each repetition."""
    r = np.random.default_rng([SEED, x.shape[1], 1])
    out = np.zeros((len(x), tables), dtype=np.int64)
    for turn in range(tables):
        for bits in parts:
            out[:, turn] = out[:, turn] << bits | _extreme(x @ r.standard_normal((x.shape[1], 2 ** (bits - 1))))
    return out


def passing(p: np.ndarray, q: np.ndarray, same: bool, half: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns of ``p`` and ``q`` (projections by line) that collide on ``least`` lines or more.

    Both are sorted along line 0.  ``same``: q is p, and each pair comes once.
    """
    lines, step, wide = len(p), 128, WIDE * half
    left, right = np.searchsorted(q[0], p[0] - wide, "left"), np.searchsorted(q[0], p[0] + wide, "right")
    low, high = np.searchsorted(q[0], p[0] - half, "left"), np.searchsorted(q[0], p[0] + half, "right")
    for k in range(0, p.shape[1], step):
        # what is further along the sorted line than any pair at the cosine isn't looked at
        first, last = int(left[k : k + step].min()), int(right[k : k + step].max())
        first = max(first, k) if same else first
        at = np.arange(first, last)
        count = ((at >= low[k : k + step, None]) & (at < high[k : k + step, None])).astype(np.int8)
        for j in range(1, 8):
            count += np.abs(p[j, k : k + step, None] - q[None, j, first:last]) <= half
        i, o = np.nonzero(count >= least - (lines - 8))
        total = count[i, o].astype(np.int16)
        i, o = i + k, o + first
        if same:
            later = o > i
            i, o, total = i[later], o[later], total[later]
        for j in range(8, lines, 8):
            total = total + (np.abs(p[j : j + 8, i] - q[j : j + 8, o]) <= half).sum(0)
            able = total >= least - (lines - min(lines, j + 8))
            i, o, total = i[able], o[able], total[able]
        if len(i):
            yield i, o


def _join(root: np.ndarray, i: np.ndarray, o: np.ndarray) -> None:
    """Tie the positions i and o: ``root`` leads each position to the least of its component."""
    while True:
        a, b = root[i], root[o]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root[:] = root[root]


def _cell_links(cosine: float, recall: float):
    """From a cell's one or two blocks to (node, links, root)."""
    half, least = calibrated(cosine, recall)

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        turn, dim = key[0].as_py(), key[1].as_py()
        node, weight, block = (cell.column(c).to_numpy() for c in ("node", "weight", "block"))
        x = _unit(cell.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
        code = np.frombuffer(b"".join(cell.column("code").to_pylist()), dtype=np.int64).reshape(len(node), -1)[:, :turn]
        lines = _lines(dim)
        order = np.lexsort((node, (x @ lines[:, 0]), block))  # by block, then along the first line
        node, weight, block, x, code = node[order], weight[order], block[order], x[order], code[order]
        p = np.ascontiguousarray((x @ lines).T.astype(np.float32))
        links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        two = np.flatnonzero(block != block[0])
        n = two[0] if len(two) else 0
        # sorted again as projected all at once, where the last bit may differ
        for part in (slice(0, n), slice(n, None)) if n else (slice(None),):
            again = np.argsort(p[0, part], kind="stable") + (part.start or 0)
            node[part], weight[part], x[part], code[part], p[:, part] = node[again], weight[again], x[again], code[again], p[:, again]
        for i, o in passing(p[:, :n] if n else p, p[:, n:], not n, half, least):
            o = o + n
            ok = ((x[i] * x[o]).sum(1) >= cosine) & ~(code[i] == code[o]).any(1)
            i, o = i[ok], o[ok]
            np.add.at(links, i, weight[o])
            np.add.at(links, o, weight[i])
            _join(root, i, o)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})

    return run


def _dealt(parts: list[int], tables: int):
    """A point's row for each repetition, with its cells in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                own = b.filter(pa.array(size == dim))
                code = _codes(_unit(own.column("x").flatten().to_numpy(zero_copy_only=False), dim), parts, tables)
                kept = pa.array([c.tobytes() for c in code], pa.binary())
                for turn in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(own.num_rows, turn, dtype=np.int32)), pa.array(np.full(own.num_rows, dim, dtype=np.int32)), pa.array(code[:, turn]), kept, *own.columns],
                        names=["turn", "dim", "cell", "code", *own.schema.names],
                    )

    return run


def grouped(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.998) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    ``recall``: asked of the cells and of the counts each, for a pair at exactly ``cosine``; pairs
    above it are missed less often.
    """
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("x")).withColumn("x", F.when(usable, F.col("x")))
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    points = durable(rows.where("node IS NOT NULL").groupBy("node").agg(F.any_value("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "points")
    parts, tables = plan(points.count(), cosine, recall)
    kind = dict(points.dtypes)["x"]
    cells = points.select("node", "weight", "x").mapInArrow(_dealt(parts, tables), f"turn int, dim int, cell long, code binary, node long, weight long, x {kind}")
    cell = ["turn", "dim", "cell"]
    sizes = cells.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    cells = cells.join(durable(sizes, "cells"), cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    # each block meets itself and, as one of two, every other block of its cell
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = cells.select(*cell, "code", "node", "weight", "x", "block", other)
    cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    found = cells.groupBy(*cell, "low", "high").applyInArrow(_cell_links(cosine, recall), "node long, links long, root long")
    found = durable(found, "vector-links")
    of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = points.select("node", "weight", "least").join(links, "node", "left").join(of, "node", "left")
    named = durable(named.select("node", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(durable(least, "least"), "component").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
