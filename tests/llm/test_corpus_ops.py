"""Operators over a corpus: line dedup, near-duplicates of texts and vectors, components, pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.llm import embeddings, lines, minhash, queries
from tracklake.llm.common import components, thinned

VECTOR = "vec_id long, embedding array<double>, label int, node string, cell int"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(300)] + [(5000, 5000), (-3, -7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in u.up if sum(u.find(x) == u.find(y) for y in u.up) == 1}
    assert got == {x: u.find(x) for x in u.up if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thinning_keeps_all_partners(spark):
    big, small = spark.range(20000), spark.range(0, 20000, 100).withColumnRenamed("id", "key")
    some = thinned(big, "id", small, "key")
    assert some.join(small, some.id == small.key).count() == 200 and some.count() < 2000


# --- 2 ---


def brute_lines(docs, lead=3, similar=0.6, alike=0.95, evidence=24, variety=5):
    """docs: (id, text) without repeated ids."""
    mask = lambda t: "<*>" if any(c.isascii() and c.isdigit() for c in t) else t
    needed = lambda n: max(2, 1 + -(-evidence // n))
    rows, often = [], Counter()
    for d, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            words = line.strip(" ").split(" ")
            if line.strip(" \t\r\x0b\x0c"):
                tokens = tuple(mask(t) for t in words)
                rows.append((d, text, k, words, tokens))
                often.update((len(tokens), tokens[:lead], j, t) for j, t in enumerate(tokens) if j >= lead and t != "<*>")

    def template(tokens):
        size = max(int(np.ceil(similar * len(tokens))), min(len(tokens), lead + 1))
        led = sum(t != "<*>" for t in tokens[:lead])
        rest = sorted((-often[len(tokens), tokens[:lead], j, t], j, t) for j, t in enumerate(tokens) if j >= lead and t != "<*>")[: size - led]
        return (len(tokens), tokens[:lead], tuple(sorted(x[1:] for x in rest))), led + len(rest)

    def recurring(key, constants, least, among):
        groups = defaultdict(list)
        for r in among:
            groups[key(r)].append(r)
        return {g: min(x[:3:2] for x in xs) for g, xs in groups.items() if len({x[1] for x in xs}) >= max(least, needed(constants(xs[0])))}

    rows = [r for r in rows if any(t != "<*>" for t in r[4])]
    wide = recurring(lambda r: template(r[4])[0], lambda r: template(r[4])[1], variety, rows)
    rest = [r for r in rows if template(r[4])[0] not in wide]
    own = recurring(lambda r: r[4], lambda r: sum(t != "<*>" for t in r[4]), 2, rest)
    at = {r[:3:2]: r for r in rows}
    text_of, size = dict(docs), lambda t: t.count(" ") + t.count("\n") + 1
    found, drop, shared = defaultdict(set), defaultdict(set), defaultdict(Counter)
    for r in rows:
        first = wide.get(template(r[4])[0]) or own.get(r[4])
        if first is None:
            continue
        found[r[0]].add(r[2])
        if r[1] != text_of[first[0]]:
            drop[r[0]].add(r[2])
            shared[r[0], text_of[first[0]]].update(words=len(r[3]), same=sum(x == y for x, y in zip(r[3], at[first][3])))
        elif r[2] != first[1]:
            drop[r[0]].add(r[2])
    for (d, other), n in shared.items():
        if 2 * n["words"] >= max(size(text_of[d]), size(other)) and n["same"] >= alike * n["words"]:
            drop[d] = set()
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        out[d] = (sum(bool(x.strip()) for x in lines), len(found[d]), len(drop[d]), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in drop[d]))
    return out


def line_report(spark, rows):
    return {r.doc_id: (r.n_lines, r.n_recurring, r.n_dropped, r.text) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_line_templates(spark, prose):
    rows = []
    for k in range(40):
        text = [prose(1000 + k, 12), prose(2000 + k, 9)]
        if k % 2 == 0:
            text.insert(1, f"Posted by user {k} on 2024-01-{k:02} in news")
        if k % 4 == 0:
            text.append("All rights reserved by us")
        if k % 10 == 0:
            text.append("ok then")
        text.append(f"{k} 1{k}")  # fields alone are no evidence
        rows.append((k, "\n".join(text)))
    rows += [(100 + k, rows[1][1]) for k in range(30)]  # copies aren't recurring lines
    rows += [(200, "All rights reserved by us"), (201, None), (202, ""), (203, " \n ")]
    got, want = line_report(spark, rows), brute_lines(rows)
    assert got == want
    # 19 posts and 10 notices, one of them a document that is nothing else; "ok then" in 4 texts isn't enough
    assert sum(g[2] for g in got.values()) == 19 + 10 and got[200][2] == 1 and "Posted" in got[0][3] and "Posted" not in got[2][3]
    assert all(got[100 + k][3] == got[1][3] for k in range(30))


def test_short_lines_go_by_evidence(spark, prose):
    """One word in 25 texts, three words in 9; fewer texts aren't enough."""
    rows = [(k, "\n".join([prose(3000 + k, 12), *["Les."] * (k < 25), *["All rights reserved."] * (k < 9), *["Of it, then."] * (k < 8), *["Oui."] * (k < 24)])) for k in range(40)]
    got = line_report(spark, rows)
    assert got == brute_lines(rows)
    left = Counter(x for r in got.values() for x in r[3].split("\n"))
    assert (left["Les."], left["All rights reserved."], left["Of it, then."], left["Oui."]) == (1, 1, 8, 24)


def test_several_templates_in_a_leaf(spark, prose):
    """Templates of one length and head: of 9 and 8 texts, of 60 and 40, and six whose most frequent tokens mix."""
    pair = ["Please subscribe to our weekly newsletter today friends", "Please subscribe to the daily digest of readers"]
    two = ["Read more about our news from here or by post", "Read more about cats than you ever wanted to know"]
    six = [" ".join(["Sent to you", *[f"{c}{chr(97 + (k * 7 + j) % 5)}" for j in range(9)]]) for k, c in enumerate("abcdef")]
    body = lambda k, line: f"{prose(5000 + k, 12)}\n{line}\n{prose(6000 + k, 9)}"
    rows = [(k, body(k, two[k >= 60])) for k in range(100)] + [(200 + k, body(200 + k, six[k % 6])) for k in range(42)] + [(300 + k, body(300 + k, pair[k >= 9])) for k in range(17)]
    got = line_report(spark, rows)
    assert got == brute_lines(rows)
    assert {d for d, r in got.items() if r[2] == 0} == {0, 60, 200, 201, 202, 203, 204, 205, 300, 309} and all(r[1] for r in got.values())
    assert sum(r[2] for d, r in got.items() if 300 <= d < 309) == 8 and sum(r[2] for d, r in got.items() if d >= 309) == 7


def test_fields_and_passages_go_and_near_copies_stay(spark, prose):
    r = random.Random(3)
    words = prose(1, 60).split()
    form = lambda k: " ".join(w if j % 4 else f"{k}{j}" for j, w in enumerate(words))
    rows = [(k, form(k)) for k in range(100)]  # one template, other numbers: no near copies
    passages = [prose(9000 + k, 55) for k in range(6)]
    rows += [(200 + k, "\n".join([passages[k % 6], prose(7000 + k, 30), passages[(k + 1) % 6]])) for k in range(6)]  # put together
    base = [prose(8000 + k, 25) for k in range(12)]
    for k in range(8):  # near copies
        text = [x.split() for x in base]
        for x in r.sample(text, 4):
            x[r.randrange(3, len(x))] = f"new{chr(97 + k)}"
        rows.append((300 + k, "\n".join(map(" ".join, text))))
    rows += [(400, f"{prose(1234, 80)}\n{passages[0]}")]
    got = line_report(spark, rows)
    assert got == brute_lines(rows)
    assert sum(got[k][2] for k in range(100)) == 99 and got[0][2] == 0
    assert all(sum(p in g[3] for g in got.values()) == 1 for p in passages)
    assert all(got[300 + k][2] == 0 < got[300 + k][1] for k in range(8))


def test_line_rows(spark, odd, none):
    got = lines.deduplicated(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    assert lines.report(none).count() == lines.deduplicated(none).count() == 0
    clash = {c: F.lit(f"own {c}") for c in ("id", "hash", "drop", "row", "lines", "split", "n", "whole", "group", "kind", "__slot")}
    got = lines.deduplicated(odd.drop("n_words", "node").withColumns(clash))
    assert {tuple(r[c] for c in clash) for r in got.collect()} == {tuple(f"own {c}" for c in clash)}


def test_line_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_recurring, r.n_dropped, r.text) for r in queries.op2_line_dedup(spark, d).collect()}
    assert got == brute_lines(rows)


# --- 4 ---


def brute_groups(docs, width, percent=80):
    """docs: (row, id, text); per row the set's size and the least id of its component."""
    sets = []
    for _, _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    u, where = Union(), defaultdict(list)
    for i, s in enumerate(sets):
        u.find(i)
        both = Counter(j for g in s for j in where[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for g in s:
            where[g].append(i)
    least = {}
    for i, (_, d, _) in enumerate(docs):
        if d is not None:
            least[u.find(i)] = min(d, least.get(u.find(i), d))
    return [(len(s), least.get(u.find(i)) if s else docs[i][1]) for i, s in enumerate(sets)]


def near(prose):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = prose(g, r.choice([3, 6, 30, 120, 400])).split()
        for _ in range(r.choice([1, 2, 8, 40])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["new", "words", "here"])
            rows.append(" ".join(w))
    r.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_equal_brute_force(spark, prose, width):
    rows = near(prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups([(k, k, t) for k, t in rows], width)
    for stars in (0, 1):
        got = sorted(minhash.grouped(docs, width=width, stars=stars).collect())
        assert [(r.n_shingles, r.component_id) for r in got] == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_buckets_lose_no_link(spark):
    """One bucket of three sets: the centre is near neither, the others are near each other."""
    a, b, c = set(range(100)), set(range(50, 150)), set(range(55, 155))
    rows = [(5, n, 10 + n, 0, sorted(s), [5]) for n, s in enumerate((a, b, c))]
    df = spark.createDataFrame(rows, "bucket long, node long, component long, block int, found array<long>, bands array<long>")
    for blocks in (df.selectExpr("*", "0 low", "0 high"), df.withColumn("block", F.expr("int(node = 2)")).selectExpr("*", "0 low", "1 high")):
        got = blocks.groupBy("bucket", "low", "high").applyInArrow(minhash._across(80), "a long, b long").collect()
        assert [{r.a, r.b} for r in got] == [{1, 2}]


def test_open_buckets_with_components_of_one_size(spark):
    """Two components of two, interleaved, one member of each near the other's: the link is found."""
    sets = [set(range(0, 100)), set(range(200, 300)), set(range(40, 140)), set(range(45, 145))]
    rows = [(5, n, 10 + n % 2, 0, sorted(s), [5], 0, 0) for n, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "bucket long, node long, component long, block int, found array<long>, bands array<long>, low int, high int")
    got = df.groupBy("bucket", "low", "high").applyInArrow(minhash._across(80), "a long, b long").collect()
    assert [{r.a, r.b} for r in got] == [{2, 3}]


def test_near_copy_rows(spark, odd, none):
    rows = [(k, r.doc_id, r.text) for k, r in enumerate(odd.collect())]
    got = minhash.grouped(odd, width=4).collect()
    want = brute_groups(rows, 4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((rows[k][1], *w) for k, w in enumerate(want))
    kept = minhash.keep_one(odd, width=5)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 2 not in ids and 10 not in ids and ids[1] == 1 and ids[None] == 2 and {3, 4, 5, 6, 7, 8, 9, 11} <= set(ids)
    assert minhash.grouped(none).count() == minhash.keep_one(none).count() == 0


def test_near_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(k, r.doc_id, r.text) for k, r in enumerate(spark.read.parquet(f"{d}/documents.parquet").collect())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_minhash(spark, d).collect()}
    assert got == {i: w for (_, i, _), w in zip(rows, brute_groups(rows, 4))}


def test_sketch_estimates_the_share_in_common():
    r = np.random.default_rng(1)
    refill, hits, n = minhash._refill(80), 0.0, 60
    for size in (5, 40, 400):
        hits = 0.0
        for _ in range(n):
            x = np.unique(r.integers(0, 1 << 63, 9 * size, dtype=np.uint64) * np.uint64(2))
            a, b = x[: 9 * size // 10 * 9 // 9], x
            a = np.sort(r.choice(x, len(x) * 8 // 10, replace=False))
            hits += (minhash.sketch(a, 80, refill) == minhash.sketch(b, 80, refill)).mean()
        assert abs(hits / n - 0.8) < 0.05


# --- 5 ---


def brute_vectors(rows, cosine=0.9):
    ok = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = [(k, v / np.abs(v).max()) for k, v in ok]
    ok = [(k, v / np.linalg.norm(v)) for k, v in ok]
    u, n = Union(), Counter()
    for i, (k, v) in enumerate(ok):
        u.find(k)
        for m, w in ok[:i]:
            if len(v) == len(w) and float(v @ w) >= cosine:
                u.join(k, m)
                n[k] += 1
                n[m] += 1
    least = {}
    for k, _ in ok:
        least[u.find(k)] = min(x for x in (rows[k][0], least.get(u.find(k))) if x is not None)
    good = {k for k, _ in ok}
    return {(rows[k][0], n[k], least[u.find(k)] if k in good else rows[k][0]) for k in range(len(rows))}


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(40):
        c = r.standard_normal(24)
        for _ in range(int(r.choice([1, 2, 10, 60]))):
            rows.append((len(rows), (c + r.choice([0.0, 0.1, 0.3]) * r.standard_normal(24) * (g % 3 > 0)).tolist()))
    rows += [(len(rows) + k, v) for k, v in enumerate([None, [], [0.0] * 24, [1.0] * 3, [None] * 24, [float("nan")] * 24, [float("inf")] * 24, rows[0][1], [2 * x for x in rows[0][1]], [1e-200 * x for x in rows[5][1]], [2.0] * 3, [1.0, 1.0, 1.01], [1.0, -1.0, 1.0], [3.0], [1.0]])]
    df = spark.createDataFrame([(*x, 0, "n", 1) for x in rows], VECTOR)
    want = brute_vectors(rows)
    got = {(x.vec_id, x.n_links, x.component_id) for x in embeddings.grouped(df).collect()}
    links = sum(x[1] for x in want)
    assert sum(x[1] for x in got) >= 0.99 * links and all(x.kept == (x.vec_id == x.component_id) for x in embeddings.grouped(df).collect())
    assert len(got & want) >= 0.98 * len(want)


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    r = np.random.default_rng(4)
    base = r.standard_normal(16)
    rows = [(k, (base + 0.02 * r.standard_normal(16)).tolist()) for k in range(300)]
    got = embeddings.grouped(spark.createDataFrame([(*x, 0, "n", 1) for x in rows], VECTOR)).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0)}


def test_recall_at_the_cosine_itself(spark):
    """Pairs at 0.9 to 0.92, the hardest, among many others."""
    r = np.random.default_rng(6)
    rows = []
    for _ in range(1500):
        a = r.standard_normal(64)
        a /= np.linalg.norm(a)
        b = r.standard_normal(64)
        b -= (a @ b) * a
        c = r.uniform(0.9005, 0.92)
        rows += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist()]
    got = embeddings.grouped(spark.createDataFrame([(k, v, 0, "n", 1) for k, v in enumerate(rows)], VECTOR)).collect()
    assert sum(x.n_links for x in got) >= 0.98 * len(rows)


def test_recall_among_100000_vectors(spark):
    """1500 planted pairs at 0.9 to 0.95 among 100,000 vectors, in as many cells as that number asks for."""
    r = np.random.default_rng(8)
    x = r.standard_normal((100_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:1500], x[1500:3000]
    b = b - (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = r.uniform(0.9001, 0.95, (1500, 1))
    x[1500:3000] = c * a + np.sqrt(1 - c * c) * b
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(8)
    got = {v.vec_id: v.component_id for v in embeddings.grouped(df).where("n_links > 0").collect()}
    assert np.mean([got.get(1500 + k) == k for k in range(1500)]) >= 0.98 and len(got) <= 3000
    parts, tables = embeddings.plan(100_000, 0.9, 0.995)
    assert sum(parts) == 8 and tables <= 12 and embeddings.plan(10**9, 0.9, 0.995)[1] <= 60


def test_vector_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, "n", 1), (1, [1.0, 0.0], 0, "n", 1), (None, [1.0, 0.0], None, None, None), (None, None, None, None, None)], VECTOR)
    assert Counter(map(tuple, embeddings.grouped(df).collect())) == Counter({(1, 2, 1, True): 2, (None, 2, 1, False): 1, (None, 0, None, True): 1})
    assert embeddings.grouped(df.limit(0)).count() == 0


# --- the pipeline ---


def test_pipeline_stages(spark, odd, none):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            assert out.count() > 0 or docs is none
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert packed.columns[:2] == ["doc_id", "start"] and (packed.count() > 0) == (docs is odd)


def test_pipeline_equals_the_stages_by_hand(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tracklake.llm import pii, quality

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [(k, x[3]) for k, x in brute_lines(rows).items()]
    rows = [(i, t) for (i, t), (_, c) in zip(rows, brute_groups([(k, *x) for k, x in enumerate(rows)], 5)) if i == c]
    from tokenizers import Tokenizer
    from public_tokenizers import path

    library, want = Tokenizer.from_file(path("word_bpe_49k.json")), {}
    for i, t in rows:
        want[i] = len(library.encode(pii.redact(t, pii.all_spans(t, pii.trained())[1]), add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, d).collect()} == want


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup"])
def test_texts_are_joined_by_shuffle_at_any_size(spark, prose, name):
    """Else what small inputs show of shuffle and disk isn't what large ones take."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(k, prose(k % 4, 60)) for k in range(8)], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert out.count() == (8 if name == "line_dedup" else 4)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "start", "length"]
