import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import bm25
from rowloom.llm.bm25 import Best, Kinds, Queries, Shard, _shard_row, terms_of, top_k


def brute(rows, queries, k):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    n = len(docs)
    average = sum(sum(c.values()) for _, c in docs) / max(1, n)
    df = Counter(w for _, c in docs for w in c)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for q, terms in asked.items():
        hits = []
        for i, c in docs:
            dl = sum(c.values())
            s = sum(math.floor(10_000 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2) / (c[w] + 1.2 * (0.25 + 0.75 * dl / average)) + 0.5) for w in terms if w in c)
            if s > 0:
                hits.append((-s, i is not None, i))
        out += [(q, r + 1, i, -s / 10_000) for r, (s, _, i) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k])]
    return sorted(out, key=str)


def test_against_brute_force(make, spark, monkeypatch):
    rng = random.Random(1)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 80)))) for i in range(300)] + [(None, "w1 w2 w3"), (900, None), (901, "w1 w2 W3"), (901, "w1 w2 W3")]
    queries = [(i, t) for i, t in rows if i is not None and i % 9 == 0] + [(7, "w1"), (7, "w5000 zzz"), (8, "nothing here"), (None, "w1")]
    monkeypatch.setattr(bm25, "QUERY_TERMS", 300)
    got = top_k(make(rows), spark.createDataFrame(queries, "query_id long, text string"), 5).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, queries, 5)


def test_pruning_skips_and_stays_exact(monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{int(rng.paretovariate(0.5))}" for _ in range(9000)]
    rows = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(3000)]
    df = Counter(w for _, t in rows for w in set(terms_of(t)))
    own = sorted(set(terms_of(rows[5][1])), key=lambda w: (df[w], w))
    terms = own[:8] + own[-2:]  # rare words and the two most frequent
    query = b" ".join(terms).decode()
    h = np.array([bm25.term_hash(w) for w in terms], np.uint64).view(np.int64)
    idf = np.array([math.log(1 + (3000 - df[w] + 0.5) / (df[w] + 0.5)) for w in terms])
    q = Queries.of(np.zeros(len(h), np.int64), h, idf, 60.0, 10)
    best, scored, total = [], 0, 0
    for at in (0, 1500):
        shard = Shard(_shard_row([i for i, _ in rows[at : at + 1500]], [t for _, t in rows[at : at + 1500]]), q)
        best = shard.search(q.places, 10, best)
        scored, total = scored + shard.scored, total + len(shard.members)
    assert [(0, r + 1, -d, s / 10_000) for r, (s, d) in enumerate(best)] == sorted(brute(rows, [(0, query)], 10), key=lambda x: x[1])
    assert scored < 0.5 * total


def searched(rows, size):
    """Hits of the rows whose id is divisible by 100, and the part of their postings that was looked at."""
    terms = [set(terms_of(t)) for _, t in rows]
    df = Counter(w for own in terms for w in own)
    n, average = len(rows), sum(len(terms_of(t)) for _, t in rows) / len(rows)
    asked = [(i, w) for (i, _), own in zip(rows, terms, strict=True) if i % 100 == 0 for w in own]
    h = np.array([bm25.term_hash(w) for _, w in asked], np.uint64).view(np.int64)
    q = Queries.of(np.array([i for i, _ in asked]), h, np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for _, w in asked]), average, 10)
    best, scored, postings = [[] for _ in q.ids], 0, 0
    for at in range(0, n, size):
        shard = Shard(_shard_row([i for i, _ in rows[at : at + size]], [t for _, t in rows[at : at + size]]), q)
        best = [shard.search(q.places[q.starts[j] : q.starts[j + 1]], 10, own) for j, own in enumerate(best)]
        scored, postings = scored + shard.scored, postings + shard.postings
    return [(int(q.ids[j]), r + 1, -d, s / 10_000) for j, own in enumerate(best) for r, (s, d) in enumerate(own)], scored / postings


def documents(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]


def test_whole_texts_as_queries(spark):
    rows = documents(spark, "sf0.01")
    assert sorted(searched(rows, 400)[0], key=str) == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert searched(documents(spark, "sf0.1"), bm25.SHARD_DOCS)[1] < 0.5


def test_odd_rows(make, spark, odd_rows):
    queries = [(i, t) for i, t in odd_rows if i in (1, 4, 6, 9)]
    got = top_k(make(odd_rows), spark.createDataFrame(queries, "query_id long, text string"), 4).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows, queries, 4)
    none = spark.createDataFrame([], "query_id long, text string")
    assert top_k(make(odd_rows), none).collect() == []
    assert top_k(make([]), spark.createDataFrame(queries, "query_id long, text string")).collect() == []


def test_kinds_of_texts_do_not_share_shards():
    rng = random.Random(3)
    vocab = [[f"{c}{int(rng.paretovariate(0.7))}" for _ in range(3000)] for c in "pqr"]
    of = [rng.choice((0, 0, 1, 2)) for _ in range(600)]
    texts = [" ".join(rng.choices(vocab[j], k=80)) for j in of]
    found = Kinds(texts).of(texts)
    assert len(set(found)) == len(set(zip(of, found, strict=True))) == 3
    assert set(Kinds(texts[:1]).of([None, "", *texts])) == {0}
    one = [t for t, j in zip(texts, of, strict=True) if j == 0]
    assert set(Kinds(one).of(one)) == {0}


@pytest.mark.parametrize("small", [{}, {"LOOSE": 1}, {"LOOSE": 10**9}, {"DENSE_SIZE": 5000}, {"LISTED": 2000, "AT_ONCE": 100}, {"LISTS": 0}, {"LISTS": 10**9, "TOGETHER": 3}])
@pytest.mark.parametrize("warm", [False, True])
def test_queries_searched_together(monkeypatch, small, warm):
    for name, n in small.items():
        monkeypatch.setattr(bm25, name, n)
    rng = random.Random(4)
    vocab = [f"w{int(rng.paretovariate(0.4))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 120)))) for i in range(500)]
    asked = [r for r in rows if r[0] % 20 == 0] + [(900, " ".join(sorted(set(vocab)))), (901, "w1"), (902, "none")]
    df = Counter(w for _, t in rows for w in set(terms_of(t)))
    n, average = len(rows), sum(len(terms_of(t)) for _, t in rows) / len(rows)
    pairs = [(i, w) for i, t in asked for w in set(terms_of(t)) if df[w]]
    q = Queries.of(np.array([i for i, _ in pairs]), np.array([bm25.term_hash(w) for _, w in pairs], np.uint64).view(np.int64), np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for _, w in pairs]), average, 10)
    want = brute(rows, asked, 10)
    least = np.ones(len(q.ids), np.int64)
    if warm:  # scores that ten documents are known to reach
        for i, r, _, s in want:
            if r == 10:
                least[np.searchsorted(q.ids, i)] = round(s * 10_000)
    best = Best(least, 10)
    for at in range(0, n, 200):
        Shard(_shard_row([i for i, _ in rows[at : at + 200]], [t for _, t in rows[at : at + 200]]), q).search_all(q.places, q.starts, best)
    rank = np.arange(len(best.query)) - np.searchsorted(best.query, best.query) + 1
    assert sorted(zip(q.ids[best.query].tolist(), rank.tolist(), best.doc.tolist(), (best.score / 10_000).tolist(), strict=True), key=str) == want


def test_long_sums_stay_whole():
    rows = [(i, " ".join(f"t{j}" for j in range(4000) if (i + j) % 9 == 0)) for i in range(90)]  # each term in a ninth of them
    asked = [(1000, " ".join(f"t{j}" for j in range(4000)))]
    terms = [f"t{j}".encode() for j in range(4000)]
    q = Queries.of(np.full(4000, 1000), np.array([bm25.term_hash(w) for w in terms], np.uint64).view(np.int64), np.full(4000, math.log(1 + 80.5 / 10.5)), 4000 / 9, 10)
    shard = Shard(_shard_row([i for i, _ in rows], [t for _, t in rows]), q)
    best = Best(np.ones(1, np.int64), 10)
    shard.search_all(q.places, q.starts, best)
    assert [(1000, r + 1, d, s / 10_000) for r, (d, s) in enumerate(zip(best.doc.tolist(), best.score.tolist(), strict=True))] == sorted(brute_at(rows, asked, 4000 / 9), key=lambda x: x[1])


def brute_at(rows, queries, average):
    assert abs(sum(len(terms_of(t)) for _, t in rows) / len(rows) - average) < 1
    return brute(rows, queries, 10)


def test_first_shards_raise_what_hits_must_reach(make, spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 80)))) for i in range(400)]
    queries = [r for r in rows if r[0] % 10 == 0]
    monkeypatch.setattr(bm25, "FIRST", 1)
    got = top_k(make(rows).repartition(5), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, queries, 3)


def test_shards_of_like_texts_have_fewer_postings_looked_at(spark):
    rows = documents(spark, "sf0.1")
    asked = [(i, w) for i, t in rows if i % 100 == 0 for w in set(terms_of(t))]
    df = Counter(w for _, t in rows for w in set(terms_of(t)))
    n, average = len(rows), sum(len(terms_of(t)) for _, t in rows) / len(rows)
    h = np.array([bm25.term_hash(w) for _, w in asked], np.uint64).view(np.int64)
    q = Queries.of(np.array([i for i, _ in asked]), h, np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for _, w in asked]), average, 10)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["k", "text"])
    shards = [Shard(r, q) for b in bm25._indexed(iter([batch])) for r in b.to_pylist()]
    assert sorted(d for s in shards for d in s.docs.tolist()) == sorted(i for i, _ in rows)
    best = Best(np.ones(len(q.ids), np.int64), 10)
    for s in shards:
        s.search_all(q.places, q.starts, best)
    assert [(int(q.ids[j]), d, s / 10_000) for j, d, s in zip(best.query, best.doc.tolist(), best.score.tolist(), strict=True)] == [(i, d, s) for i, _, d, s in sorted(searched(rows, 4096)[0])]
    looked = sum(s.scored for s in shards) / sum(s.postings for s in shards)
    assert looked < 0.36, looked
