"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

Documents are tokenised, ended by one id and cut: full pieces first, then the rest.  Only the
histogram of piece lengths (at most ``size`` bins) reaches the driver.  There lengths are placed
longest first into the pack that is shortest so far, all packs of one pattern at once, which gives
packing patterns with counts; their number depends on ``size``, not on the corpus.  Each piece has
a rank among the pieces of its length, and the patterns, laid out as ranges of ranks, are looked
up by (length, rank).

Nulls: a null text is empty (its document is the closing id alone); a null doc_id stays.  Repeated
rows are packed each.  An empty table gives no rows.  Columns beyond doc_id and text aren't read.
"""

from __future__ import annotations

import heapq
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, memory_of, pooled

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers, about 400 bytes each, and bytes of the longest such word.
REMEMBERED, LONGEST = 500_000, 64
PUNCTUATION = string.punctuation.encode()
#: A stop or comma that ends a word after a letter is a piece of its own; a space before it changes no ids.
_STOP = re.compile(rb"(?<=[a-z])[.,](?=[ \n])")
#: Rows of three numbers that are broadcast at most.
BROADCAST_OFFSETS = 200_000
#: Bytes of text that are split into words at once.
AT_ONCE = 2_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte; a space stays."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {32: " "}


class WordIds:
    """Ids of whole texts by a byte-level tokenizer that drops white space, word by word.

    Text between ASCII white space is encoded once and remembered, which gives the ids of
    ``Tokenizer.encode`` on the whole text where no token spans white space.  ASCII capitals
    are folded first where the tokenizer folds them anyway.  Words of letters alone that are in
    composed form need neither normalising nor splitting: folded, they go many at a time to the
    tokenizer's model by a second tokenizer without these steps; each word then ends with the one
    token that closes a word.
    """

    def __init__(self, path: str, fold: bool = True, close: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run in parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.fold = Tokenizer.from_file(path), fold
        self.plain = Tokenizer(self.tokenizer.model)  # the model is shared
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(close)]] = True
        self.letters = _byte_letters()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if w.isalpha()] if self.fold else []  # ASCII letters, folded
        rest, texts, accented = [], [], []
        for w in words:
            if self.fold and w.isalpha():
                continue
            text = w.decode("utf-8")
            # a capital sigma folds by its place in the word in some libraries
            low = text.lower()
            if self.fold and low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
                plain.append(w)
                accented.append(low)
            else:
                rest.append(w)
                texts.append(text)
        out: dict[bytes, bytes] = {}
        if plain:
            joined = b" ".join(plain[: len(plain) - len(accented)]).lower().decode("ascii")
            if accented:
                joined += " " + " ".join(accented).encode("utf-8").decode("latin-1").translate(self.letters)
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), [0, *ends.tolist()]
                out = dict(zip(plain, map(raw.__getitem__, map(slice, at, at[1:]))))
            else:  # no such case is known
                rest, texts = rest + plain, texts + [w.decode("utf-8") for w in plain]
        if rest:
            made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            out.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(rest, made))
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of ``words``; punctuation that ends a word after a letter is a piece of its own."""
        need, parts = set(), []
        for w in words:
            core = w if w[-1:].isalpha() else w.rstrip(PUNCTUATION)
            if core and len(core) < len(w) and b"<|" not in w and core[-4:].decode("utf-8", "ignore")[-1:].lower()[-1:].isalpha():
                tail = w[len(core) :]
                parts.append((w, core, tail))
                need.add(core)
                need.add(tail)
            else:
                need.add(w)
        made = self._encode(list(need.difference(self.known)))
        known = self.known
        for w, core, tail in parts:
            made[w] = (made.get(core) or known[core]) + (made.get(tail) or known[tail])
        return made

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, little-endian unsigned 32-bit."""
        while texts:
            n = size = 0
            while n < len(texts) and (not n or size < AT_ONCE):
                size += len(texts[n] or "")
                n += 1
            now, texts = texts[:n], texts[n:]
            split = []
            for text in now:
                raw = (text or "").encode("utf-8")
                # names of special tokens are told apart by case
                if b"<|" not in raw:
                    raw = _STOP.sub(rb" \g<0>", raw.lower() if self.fold else raw)
                split.append(raw.split())
            words = set(chain.from_iterable(split))
            made = self._learn(words.difference(self.known))
            if len(self.known) + len(made) > REMEMBERED:  # what is in use now stays
                self.known = {w: self.known[w] for w in words if w in self.known}
            self.known.update(made)
            for x in split:
                yield b"".join(map(self.known.__getitem__, x))
            for w in made:
                if len(w) > LONGEST:
                    del self.known[w]


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of every document, with the partition and the place among its pieces of a length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of("packing")
        if tokenizer not in memory:
            memory[tokenizer] = WordIds(tokenizer)
        ids_of, part, places = memory[tokenizer], TaskContext.get().partitionId(), {}
        for b in pooled(batches, "text", AT_ONCE):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    place = places[length] = places.get(length, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, place))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def packing_patterns(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern, by shortest-pack-first over the histogram.

    Lengths go longest first, each into the shortest pack so far if it fits there, else into a new
    one; a pattern's packs are handled together.
    """
    packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # (fill, tie, count, lengths)
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                fill, _, count, lengths = heapq.heappop(packs)
                take = min(count, left)
                if take < count:
                    tie += 1
                    heapq.heappush(packs, (fill, tie, count - take, lengths))
            else:
                fill, lengths, take = 0, (), left
            tie += 1
            heapq.heappush(packs, (fill + length, tie, take, (*lengths, length)))
            left -= take
    return [(c, x) for _, _, c, x in sorted(packs)]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks per length: the sequence of the first, the number of sequences, the offset."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for x in lengths:
            rows.append((x << 44 | given.get(x, 0), sequence, offset))
            given[x] = given.get(x, 0) + count
            offset += x
        sequence += count
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return {"first": cols[:, 0].copy(), "sequence": cols[:, 1].copy(), "offset": cols[:, 2].copy()}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    ``tokenizer``: a file that executors can open, of the kind that drops white space.
    """
    spark = docs.sparkSession
    pieces = durable(cut_documents(docs, tokenizer, size, end_id), "pieces")
    counted = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # of a length there are as many rows as partitions that have it
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(_slots(packing_patterns(histogram, size)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            key = length << 44 | rank
            at = np.searchsorted(s["first"], key, side="right") - 1
            sequence = s["sequence"][at] + key - s["first"][at]
            keep = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(s["offset"][at])], names=[x.split()[0] for x in PACKED.split(", ")])

    # a row per length and partition that has it: broadcast where they are few, else dealt by both
    offsets = F.broadcast(offsets) if counted.count() <= BROADCAST_OFFSETS else offsets.hint("merge")
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(placed, PACKED)
