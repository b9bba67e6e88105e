"""Byte-level BPE in DuckDB, one database in memory per Python worker.

A partition's texts are split by the tokenizer's pattern; words not met before become rows
(word, position, token).  A recursive query joins neighbouring tokens with the merge table and
contracts, in every word at once, the leftmost pair of least rank, until no word has a pair left.
Ordered aggregation over the token rows writes the ids.  A document's ids are its words' ids in
order, and they are decoded as such: rows (document, position, id) join the vocabulary, and ordered
aggregation writes the bytes.

A query takes as many steps as its longest word has tokens to contract, so words over ``LONG`` bytes
are cut into overlapping pieces that go through it like words.  Two pieces that have a token in
common, at the same place, are joined there.  That is exact: every neighbouring pair of tokens in
the joined sequence then stands in the encoding of a piece, so no merge crosses a border between
tokens there, and none does in the whole word.  Where two pieces have no token in common (runs of
one letter) the word goes through a second query that contracts all disjoint occurrences of the
least rank in one step where that provably gives the same result (no token made from the merged one
has a lower rank); it takes as many steps as the word has ranks, which are few in such words.
50,000 random letters take under 6 s, and time grows with the length.

Nulls: a null text is empty: no ids, and the hash of nothing.  A null doc_id stays.  Repeated rows
are encoded each.  An empty table gives no rows.  Columns beyond doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_of, pooled

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"
#: Words above so many bytes are cut into pieces of so many bytes, which overlap by so many.
LONG, PIECE, OVERLAP = 256, 192, 64
#: Pieces that one query contracts: its rows add up over its steps.
PIECES_AT_ONCE = 250
#: Token rows decoded by one query.
IDS_AT_ONCE = 2_000_000
#: Words that one query contracts, and bytes of text split at once.
WORDS_AT_ONCE, TEXT_AT_ONCE = 30_000, 8_000_000
#: Words that a worker remembers, about 250 bytes each.
REMEMBERED = 400_000

_PAIRS = "from t where not done window w as (order by pos)"
#: best: the least rank of a word, in the high half, and the first position that has it.
SHORT_SQL = f"""
with recursive t(wid, pos, id, done) as (
    select wid, pos, id, false from init
    union all
    (with p as (select wid, pos, id, lead(id) over w as nid, lead(wid) over w as nwid, lag(pos) over w as ppos {_PAIRS}),
          c as (select p.wid, min(m.rank::bigint << 32 | p.pos) as best
                from p join merges m on m.l = p.id and m.r = p.nid where p.nwid = p.wid group by p.wid)
     select p.wid, p.pos, case when p.pos = (c.best & 4294967295) then (c.best >> 32)::int else p.id end, c.best is null
     from p left join c using (wid)
     where c.best is null or p.ppos is null or p.ppos <> (c.best & 4294967295)))
"""
LONG_SQL = f"""
with recursive t(wid, pos, id, done) as (
    select wid, pos, id, false from init
    union all
    (with p as (select wid, pos, id, lead(id) over w as nid, lead(wid) over w as nwid, row_number() over w as rn {_PAIRS}),
          h as (select p.wid, p.pos, p.rn, m.rank, m.apart from p join merges m on m.l = p.id and m.r = p.nid where p.nwid = p.wid),
          c as (select wid, min(rank::bigint << 32 | pos) as best from h group by wid),
          g as (select h.rn, h.pos, h.rn - row_number() over (order by h.pos) as run from h join c using (wid)
                where h.rank = (c.best >> 32) and (h.apart or h.pos = (c.best & 4294967295))),
          x as (select rn from (select rn, row_number() over (partition by run order by pos) as k from g) where k % 2 = 1)
     select p.wid, p.pos, case when x.rn is not null then (c.best >> 32)::int else p.id end, c.best is null
     from p left join c using (wid) left join x on x.rn = p.rn left join x y on y.rn = p.rn - 1
     where y.rn is null))
"""
#: Ids of a word as text.
RESULT_SQL = "select wid, string_agg(id::varchar, ' ' order by pos) as ids from t where done group by wid"
#: The bytes of a document's ids, a character for each.
DECODE_SQL = "select g.doc, string_agg(v.letters, '' order by g.pos) as letters from given_ids g join vocabulary v using (id) group by g.doc"
#: A byte's character: the one of that number, but for 0.
_LETTERS = {0: 256}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that joins to a token, with its rank.

    ``apart``: whether no token made from the joined one has a lower rank, so that disjoint
    occurrences can be contracted together.
    """
    rows = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            l, r = ranks.get(token[:k]), ranks.get(token[k:])
            if l is not None and r is not None:
                rows.append((l, r, rank))
    low = {x for l, r, rank in rows for x in (l, r) if rank <= x}
    l, r, rank = zip(*rows)
    return pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(rank, pa.int32()), "apart": pa.array([x not in low for x in rank])})


class Encoder:
    """Encodes and decodes; keeps what it has learnt of words."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        self.db.register("given", merge_table(self.ranks))
        self.db.execute("create table merges as select * from given")
        self.db.register("given", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "letters": [b.decode("latin-1").translate(_LETTERS) for b in self.ranks]}))
        self.db.execute("create table vocabulary as select * from given")
        self.db.unregister("given")
        self.known = np.array(sorted(self.ranks.values()), dtype=np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.size[list(self.ranks.values())] = [len(b) for b in self.ranks]
        #: word: its ids as text
        self.ids: dict[str, str] = {}

    def _contract(self, words: list[bytes], sql: str) -> list[str]:
        n, flat = np.array([len(w) for w in words]), np.frombuffer(b"".join(words), dtype=np.uint8)
        init = pa.table({"wid": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": np.arange(len(flat), dtype=np.int64), "id": self.single[flat]})
        self.db.register("init", init)
        made = self.db.sql(sql + RESULT_SQL).to_arrow_table()
        self.db.unregister("init")
        ids: list[str] = [""] * len(words)
        for w, x in zip(made["wid"].to_pylist(), made["ids"].to_pylist()):
            ids[w] = x
        return ids

    def _long(self, words: list[bytes]) -> list[str]:
        """Ids of words that are encoded in pieces."""
        starts = [range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP) for w in words]
        pieces = [w[k : k + PIECE] for w, at in zip(words, starts) for k in at]
        made = [x for k in range(0, len(pieces), PIECES_AT_ONCE) for x in self._contract(pieces[k : k + PIECES_AT_ONCE], SHORT_SQL)]
        out, n = [], 0
        for w, at in zip(words, starts):
            joined = self._joined([np.array(x.split(), dtype=np.int64) for x in made[n : n + len(at)]], at)
            n += len(at)
            out.append(self._contract([w], LONG_SQL)[0] if joined is None else " ".join(map(str, joined.tolist())))
        return out

    def _joined(self, pieces: list[np.ndarray], starts: range) -> np.ndarray | None:
        """The ids of a word from those of its pieces; None where two of them have no token in common."""
        parts, kept, ends = [], pieces[0], starts[0] + np.cumsum(self.size[pieces[0]])
        for ids, start in zip(pieces[1:], starts[1:]):
            now = start + np.cumsum(self.size[ids])
            _, a, b = np.intersect1d(ends, now, return_indices=True)
            same = np.flatnonzero(kept[a] == ids[b])  # of one end and one id, so of one start
            if not len(same):
                return None
            k = same[len(same) // 2]
            parts.append(kept[: a[k] + 1])
            kept, ends = ids[b[k] + 1 :], now[b[k] + 1 :]
        return np.concatenate([*parts, kept])

    def _learn(self, words: list[str]) -> dict[str, str]:
        ids: dict[str, str] = {}
        short: list[tuple[str, bytes]] = []
        long: list[tuple[str, bytes]] = []
        for w in words:
            b = w.encode("utf-8")
            if (k := self.ranks.get(b)) is not None:
                ids[w] = str(k)
            else:
                (short if len(b) <= LONG else long).append((w, b))
        for k in range(0, len(short), WORDS_AT_ONCE):
            some = short[k : k + WORDS_AT_ONCE]
            ids.update(zip((w for w, _ in some), self._contract([b for _, b in some], SHORT_SQL)))
        ids.update(zip((w for w, _ in long), self._long([b for _, b in long])))
        return ids

    def __call__(self, texts: list[str | None]) -> Iterator[str]:
        """For each text its ids, in decimal with a space between."""
        while texts:
            n = size = 0
            while n < len(texts) and (not n or size < TEXT_AT_ONCE):
                size += len(texts[n] or "")
                n += 1
            now, texts = texts[:n], texts[n:]
            split = [self.split(x or "") for x in now]
            words = set(chain.from_iterable(split))
            made = self._learn(sorted(words.difference(self.ids)))
            if len(self.ids) + len(made) > REMEMBERED:  # what is in use now stays
                self.ids = {w: self.ids[w] for w in words if w in self.ids}
            self.ids.update(made)
            for x in split:
                yield " ".join(map(self.ids.__getitem__, x))
            for w in made:
                if len(w) > LONG:
                    del self.ids[w]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids, which stand one document after the other in ``ids``."""
        if len(bad := np.setdiff1d(ids, self.known)):
            raise ValueError(f"no such ids: {bad[:5].tolist()}")
        out, doc = [b""] * len(counts), np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        for k in range(0, len(ids), IDS_AT_ONCE):  # a document can go on in the next part
            part = slice(k, k + IDS_AT_ONCE)
            self.db.register("given_ids", pa.table({"doc": doc[part], "pos": np.arange(len(ids[part]), dtype=np.int32), "id": ids[part]}))
            made = self.db.sql(DECODE_SQL).to_arrow_table()
            self.db.unregister("given_ids")
            for d, x in zip(made["doc"].to_pylist(), made["letters"].to_pylist()):
                out[d] += x.replace("\u0100", "\0").encode("latin-1")
        return out


def _encoder(path: str, pattern: str) -> Encoder:
    memory = memory_of("bpe")
    if (path, pattern) not in memory:
        memory[path, pattern] = Encoder(path, pattern)
    return memory[path, pattern]


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids) for every whole text; ``path`` is a rank file that executors can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pooled(batches, "text", TEXT_AT_ONCE):
            ids = [[int(x) for x in text.split()] for text in _encoder(path, pattern)(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _needed(docs).mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, decoded): the bytes of rows (doc_id, ids); an id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            flat, counts = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ids.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_encoder(path, pattern).decoded(flat, counts), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text; per document the number of ids and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pooled(batches, "text", TEXT_AT_ONCE):
            encoder = _encoder(path, pattern)
            made = list(encoder(b.column("text").to_pylist()))
            counts = np.array([x.count(" ") + 1 if x else 0 for x in made], dtype=np.int64)
            raw = encoder.decoded(np.fromstring(" ".join(filter(None, made)), dtype=np.int32, sep=" "), counts)
            hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (map(str.encode, made), raw)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), *hashes], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _needed(docs).mapInArrow(run, ENCODED)
