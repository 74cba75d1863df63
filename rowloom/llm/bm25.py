"""Exact BM25 top-k search: an inverted index in shards of like texts, block-max dynamic pruning of many queries at once, one merge by global statistics."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, lean, real_id, scratch_path, stored

K1, B = 1.2, 0.75
#: Scores are sums of whole ten-thousandths, so that no order of summing changes a rank.
UNIT = 10_000
#: A shard ends at so many documents or bytes of text; so many documents of like length make a block.
SHARD_DOCS, SHARD_BYTES, BLOCK = 4096, 12_000_000, 2
#: A term in at least this part of a shard's documents is frequent there: its greatest impacts in blocks are held.
FREQUENT = 6
#: A term in at least this part has its impacts by document in a dense row; there are at most so many numbers in all.
DENSE, DENSE_SIZE = 24, 24_000_000
#: So many queries, or queries of so many postings of terms that are not frequent, are searched together.
TOGETHER, LISTED = 256, 2_000_000
#: Postings, or impacts of frequent terms, that are looked up at once.
AT_ONCE = 50_000
#: Bounds that leave over this part of the documents are followed by the impacts of all; bounds are widened by ``SLACK``.
LOOSE, SLACK = 20, 2.0**-9
#: A posting of a list costs as much as so many numbers of a matrix product.
LISTS = 1000
#: Texts that are tried as centres of a kind of texts.
KINDS = 32
#: Terms of queries that are broadcast at a time (16 bytes each); more queries make more blocks of queries.
QUERY_TERMS = 1_200_000
#: One shard in so many is searched first.
FIRST = 16
_HIT = "query long, doc long, score long"
_SHARD = "docs binary, lengths binary, terms binary, starts binary, members binary, uses binary, n long, words long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def term_hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word)


def _shard_row(docs: list[int], texts: list[str | None]) -> dict:
    ids = _Ids()
    parts = []
    for t in texts:
        words = terms_of(t)
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    by_length = sorted(range(len(docs)), key=lambda i: len(parts[i]))  # so that a block's greatest impact is near all of them
    docs, parts = [docs[i] for i in by_length], [parts[i] for i in by_length]
    lengths = [len(p) for p in parts]
    hashes = np.array([term_hash(w) for w in ids], dtype=np.uint64)
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner = np.repeat(np.arange(len(docs)), lengths)
    keys, uses = np.unique(rank[np.concatenate(parts)] << 20 | owner, return_counts=True) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts = np.searchsorted(keys >> 20, np.arange(len(ids) + 1))
    raw = lambda x, kind: np.asarray(x, kind).tobytes()
    return {
        "docs": raw(docs, "<i8"), "lengths": raw(lengths, "<i4"), "terms": raw(hashes[order], "<u8"), "starts": raw(starts, "<i4"),
        "members": raw(keys & 0xFFFFF, "<u2"), "uses": raw(uses, "<i4"), "n": len(docs), "words": int(sum(lengths)),
    }


_SHARD_ARROW = pa.schema([(c, pa.binary()) for c in ("docs", "lengths", "terms", "starts", "members", "uses")] + [("n", pa.int64()), ("words", pa.int64())])


class Kinds:
    """Kinds of texts that mostly share their words, such as those of one language, found in some of them.

    Centres of the hashed words of the texts' beginnings, of which close ones become one; a kind of under a 32nd of
    the texts goes to the others. It decides only which documents share a shard.
    """

    def __init__(self, texts: list[str | None]):
        x = self._words(texts)
        centres = x[:: max(1, len(x) // KINDS)]
        for _ in range(3):
            of = (x @ centres.T).argmax(axis=1)
            sums = (of == np.arange(len(centres))[:, None]).astype(np.float32) @ x
            size = np.bincount(of, minlength=len(centres))
            sums, size = sums[size > 0], size[size > 0]
            unit = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
            near, left = unit @ unit.T > 0.8, np.argsort(-size, kind="stable").tolist()
            merged = []
            while left:
                own = [j for j in left if near[left[0], j] or j == left[0]]
                left = [j for j in left if j not in own]
                merged.append((int(size[own].sum()), sums[own].sum(axis=0)))
            big = [c for n, c in merged if n * 32 >= len(x)] or [merged[0][1]]
            centres = np.array([c / max(1e-9, float(np.linalg.norm(c))) for c in big])
        self.centres = centres

    @staticmethod
    def _words(texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), 1024), np.float32)
        for i, t in enumerate(texts):
            x[i, [crc32(w) & 1023 for w in terms_of((t or "")[:500])]] = 1
        return x / np.maximum(1, np.sqrt(x.sum(axis=1, keepdims=True)))

    def of(self, texts: list[str | None]) -> list[int]:
        return (self._words(texts) @ self.centres.T).argmax(axis=1).tolist() if len(self.centres) > 1 else [0] * len(texts)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, held = None, {}
    for b in batches:
        for at in range(0, b.num_rows, SHARD_DOCS):
            ids, texts = (b.column(i).slice(at, SHARD_DOCS).to_pylist() for i in (0, 1))
            kinds = kinds or Kinds(texts)
            for k, t, kind in zip(ids, texts, kinds.of(texts), strict=True):
                own = held.setdefault(kind, [[], [], 0])
                own[0].append(k)
                own[1].append(t)
                own[2] += len(t or "")
                if len(own[0]) >= SHARD_DOCS or own[2] >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([_shard_row(*held.pop(kind)[:2])], schema=_SHARD_ARROW)
                elif sum(x[2] for x in held.values()) >= 2 * SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([_shard_row(*held.pop(max(held, key=lambda x: held[x][2]))[:2])], schema=_SHARD_ARROW)
    for docs, texts, _ in held.values():
        yield pa.RecordBatch.from_pylist([_shard_row(docs, texts)], schema=_SHARD_ARROW)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: a row for each shard with its documents (of one kind, by length), lengths, sorted terms and postings.

    A null text is a document without terms, a null doc_id is kept as ``NULL_ID``, repeated rows are documents each, an
    empty table gives no shards, other columns are ignored.
    """
    return stored(keyed_text(docs).select("k", "text").mapInArrow(lean("", _indexed), _SHARD), "inverted-index")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            terms = np.frombuffer(r["terms"], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.diff(np.frombuffer(r["starts"], "<i4")).astype(np.int64))], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 200):
            ids, terms = [], []
            for k, t in zip(b.column(0).to_pylist()[i : i + 200], b.column(1).to_pylist()[i : i + 200], strict=True):
                own = {term_hash(w) for w in set(terms_of(t))}
                ids += [k] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(terms, np.uint64).view(np.int64))], ["query", "term"])


@dataclass
class Queries:
    """A block of queries: ids, the distinct terms of all with their idf, and each query's terms by place."""

    ids: np.ndarray
    terms: np.ndarray
    idf: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    average: float
    k: int
    #: Scores that k documents are known to reach, by query.
    least: np.ndarray | None = None

    @classmethod
    def of(cls, query: np.ndarray, term: np.ndarray, idf: np.ndarray, average: float, k: int) -> Queries:
        order = np.argsort(query, kind="stable")
        ids, starts = np.unique(query[order], return_index=True)
        terms, first, places = np.unique(term[order].view(np.uint64), return_index=True, return_inverse=True)
        return cls(ids, terms, idf[order][first], np.append(starts, len(query)), places.reshape(-1), average, k)


def impacts(idf: np.ndarray, uses: np.ndarray, lengths: np.ndarray, average: float) -> np.ndarray:
    """BM25 weights in ``UNIT`` parts."""
    return np.floor(UNIT * idf * (uses * (K1 + 1)) / (uses + K1 * (1 - B + B * lengths / average)) + 0.5).astype(np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    n, starts = n[n > 0], starts[n > 0]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    at = np.cumsum(n)[:-1]
    steps[at] = starts[1:] - starts[:-1] - n[:-1] + 1
    return np.cumsum(steps)


class Best:
    """The k best hits of every query so far, by falling score and then by document."""

    def __init__(self, least: np.ndarray, k: int):
        #: What a hit of each query must reach: a score that k documents are known to reach, 1 at least.
        self.least, self.k = least.copy(), k
        self.query = self.doc = self.score = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, doc, score = (np.concatenate(x) for x in ((self.query, query), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        keep = rank < self.k
        self.query, self.doc, self.score = query[keep], doc[keep], score[keep]


class Shard:
    """One shard's postings of a block of queries' terms.

    Rare terms keep lists of postings. Others have their impacts by document in a row of ``dense``, and the
    frequent ones of these in ``greatest`` their greatest impact in each block of documents.
    """

    def __init__(self, row: dict, q: Queries):
        self.docs = np.frombuffer(row["docs"], "<i8")
        lengths = np.frombuffer(row["lengths"], "<i4").astype(np.float64)
        terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i4").astype(np.int64)
        _, mine, theirs = np.intersect1d(terms, q.terms, assume_unique=True, return_indices=True)
        self.local = np.full(len(q.terms), -1, np.int64)
        self.local[theirs] = np.arange(len(mine))
        df = starts[mine + 1] - starts[mine]
        at = _ranges(starts[mine], starts[mine + 1])
        members = np.frombuffer(row["members"], "<u2")[at].astype(np.int64)
        uses = np.frombuffer(row["uses"], "<i4")[at].astype(np.float64)
        owner = np.repeat(np.arange(len(mine)), df)
        weights = impacts(q.idf[theirs][owner], uses, lengths[members], q.average)
        self.df, self.ends = df, np.cumsum(df)
        self.members, self.weights = members.astype(np.int32), weights.astype(np.float64)
        self.most = np.maximum.reduceat(weights, self.ends - df) if len(mine) else np.zeros(0, np.int64)
        blocks = -(-len(self.docs) // BLOCK)
        self.width = blocks * BLOCK
        dense = np.argsort(df, kind="stable")
        dense = dense[max(np.searchsorted(df[dense] * DENSE, len(self.docs)), len(dense) - DENSE_SIZE // max(1, self.width)) :]  # the frequent ones last
        self.row = np.full(len(mine), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        #: The first frequent term's row.
        self.middle = int(np.searchsorted(df[dense] * FREQUENT, len(self.docs)))
        self.dense = np.zeros((len(dense), self.width), np.float32)  # whole numbers below 2^23
        p = np.flatnonzero(self.row[owner] >= 0)
        self.dense[self.row[owner[p]], members[p]] = weights[p]
        self.by_doc = np.ascontiguousarray(self.dense[self.middle :].T).reshape(-1)
        self.greatest = np.maximum.reduce([self.dense[self.middle :, i::BLOCK] for i in range(BLOCK)])
        #: Postings of the queries searched so far, and those of them that were looked at.
        self.postings = self.scored = 0

    def search(self, places: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, -doc) of ``best`` and this shard for one query's terms, best first."""
        found = Best(np.array([best[k - 1][0] if len(best) >= k else 1]), k)
        self.search_all(places, np.array([0, len(places)]), found)
        return sorted([*best, *zip(found.score.tolist(), (-found.doc).tolist(), strict=True)], reverse=True)[:k]

    def search_all(self, places: np.ndarray, starts: np.ndarray, best: Best) -> None:
        """Adds to ``best`` this shard's hits of all queries; query j has the terms ``places[starts[j] : starts[j + 1]]``."""
        t = self.local[places]
        own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[t >= 0]
        t = t[t >= 0]
        listed = np.cumsum(np.bincount(own, weights=np.where(self.row[t] < self.middle, self.df[t], 0), minlength=len(starts) - 1))
        a = 0
        while a < len(starts) - 1:
            b = max(a + 1, min(a + TOGETHER, int(np.searchsorted(listed, (listed[a - 1] if a else 0) + LISTED, side="right"))))
            lo, hi = np.searchsorted(own, (a, b))
            if lo < hi:
                query, at, score = self._hits(t[lo:hi], own[lo:hi] - a, best.least[a:b], best.k)
                best.add(query + a, self.docs[at], score)
            a = b

    def _sums(self, t: np.ndarray, owner: np.ndarray, queries: int) -> np.ndarray:
        """By query and document the impacts of terms from their lists."""
        score = np.zeros((queries, self.width))
        each = np.cumsum(np.bincount(owner, weights=self.df[t], minlength=queries))
        a = 0
        while a < queries:  # so many that all their arrays stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(each, (each[a - 1] if a else 0) + AT_ONCE, side="right")))
            lo, hi = np.searchsorted(owner, (a, b))
            if lo < hi:
                df = self.df[t[lo:hi]]
                p = _ranges(self.ends[t[lo:hi]] - df, self.ends[t[lo:hi]])
                at = np.repeat((owner[lo:hi] - a) * self.width, df)
                at += np.take(self.members, p)
                score[a:b] = np.bincount(at, weights=np.take(self.weights, p), minlength=(b - a) * self.width).reshape(b - a, self.width)
                self.scored += len(p)
            a = b
        return score

    def _add(self, score: np.ndarray, t: np.ndarray, owner: np.ndarray, lo: int, hi: int) -> None:
        """Adds to ``score`` the impacts of terms of the rows lo to hi by matrix products, whose sums stay whole in single precision."""
        if not len(t):
            return
        most = self.most[t]
        done = np.cumsum(most) - most
        part = (done - done[np.searchsorted(owner, owner)]) >> 23  # impacts are below 2^23
        for i in range(int(part.max()) + 1):
            own, at = np.unique(owner[part == i], return_inverse=True)
            asked = np.zeros((len(own), hi - lo), np.float32)
            asked[at, self.row[t[part == i]] - lo] = 1
            if len(own) == len(score):
                score += asked @ self.dense[lo:hi]
            else:
                score[own] += asked @ self.dense[lo:hi]
        self.scored += int(self.df[t].sum())

    def _completed(self, score: np.ndarray, live: np.ndarray, rows: np.ndarray, asks: np.ndarray) -> np.ndarray:
        """The scores at some places with the impacts of the queries' frequent terms, looked up there alone."""
        sums = score.reshape(-1)[live].astype(np.int64)
        query, at = np.divmod(live, self.width)
        start, end = np.searchsorted(asks, query), np.searchsorted(asks, query, side="right")
        each = np.cumsum(end - start)
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(each, (each[a - 1] if a else 0) + AT_ONCE)))
            n = end[a:b] - start[a:b]
            held = np.take(self.by_doc, rows[_ranges(start[a:b], end[a:b])] + np.repeat(at[a:b] * len(self.greatest), n))
            self.scored += int(np.count_nonzero(held))
            done = np.concatenate((np.zeros(1), np.cumsum(held, dtype=np.float64)))
            sums[a:b] += np.diff(done[np.concatenate(([0], np.cumsum(n)))]).astype(np.int64)
            a = b
        return sums

    @staticmethod
    def _raised(least: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """``least``, or a query's k-th best score where that is more."""
        least = least.copy()
        more = np.flatnonzero(np.count_nonzero(score >= least[:, None], axis=1) >= k)
        if len(more):
            least[more] = np.maximum(least[more], np.partition(score[more], -k, axis=1)[:, -k].astype(np.int64))
        return least

    def _hits(self, t: np.ndarray, owner: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document's place, score) of all documents that reach ``least`` and may be among a query's k best.

        ``least`` is what a hit must reach: the k-th best score so far, and then the k-th best of the sums in this
        shard, which only grow. A query whose greatest impacts together stay under it is done. Rare terms are summed
        for all documents from lists, and dense ones that are not frequent from lists or by a matrix product. From then
        on only documents are looked at whose sum can still reach ``least`` with the greatest impacts that the frequent
        terms have in their block; one product gives these bounds for all queries, widened by ``SLACK`` since it is in
        single precision. Where they leave over a ``LOOSE``-th of the documents, another gives the impacts of all.
        """
        none = (np.zeros(0, np.int64),) * 3
        self.postings += int(self.df[t].sum())
        all_of = np.bincount(owner, weights=self.most[t], minlength=len(least))
        asking = np.flatnonzero(all_of >= least)
        if not len(asking):
            return none
        if len(asking) < len(least):
            place = np.full(len(least), -1)
            place[asking] = np.arange(len(asking))
            t, owner = t[place[owner] >= 0], place[owner[place[owner] >= 0]]
            least = least[asking]
        queries, blocks = len(asking), self.greatest.shape[1]
        frequent = self.row[t] >= self.middle
        # a query with few postings in the dense rows is better off with lists
        common = (self.row[t] >= 0) & ~frequent
        dense = np.bincount(owner[common], weights=self.df[t[common]], minlength=queries) * LISTS >= self.middle * self.width
        common &= dense[owner]
        rare = ~frequent & ~common
        score = self._sums(t[rare], owner[rare], queries)
        self._add(score, t[common], owner[common], 0, self.middle)
        least = self._raised(least, score, k)
        rows, asks = self.row[t[frequent]] - self.middle, owner[frequent]
        asked = np.zeros((queries, len(self.greatest)), np.float32)
        asked[asks, rows] = 1 + SLACK
        bound = (asked @ self.greatest)[:, :, None]
        reach = lambda: np.flatnonzero(score.reshape(queries, blocks, BLOCK) + bound >= least[:, None, None])
        live = reach()
        if len(live) * LOOSE > queries * len(self.docs):  # the best so far show what their frequent terms make of them
            m = min(4 * k, self.width)
            top = np.argpartition(score, -m, axis=1)[:, -m:] + np.arange(queries)[:, None] * self.width
            least = self._raised(least, self._completed(score, top.reshape(-1), rows, asks).reshape(queries, m), k)
            live = reach()
        if len(live) * LOOSE > queries * len(self.docs):
            self._add(score, t[frequent], owner[frequent], self.middle, len(self.dense))
            least = self._raised(least, score, k)
            live = np.flatnonzero(score >= least[:, None])
            sums = score.reshape(-1)[live].astype(np.int64)
        else:
            sums = self._completed(score, live, rows, asks)
        query, at = np.divmod(live, self.width)
        found = sums >= least[query]
        return asking[query[found]], at[found], sums[found]


def _one_thread() -> None:
    """Keeps the matrix products of a worker to one thread: its task has one core, and waiting threads would spin."""
    with contextlib.suppress(Exception), open("/proc/self/maps") as maps:
        for path in {line.split()[-1] for line in maps if "openblas" in line}:
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib := ctypes.CDLL(path), name):
                    getattr(lib, name)(1)


def _searched(q: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        best = Best(np.ones(len(q.ids), np.int64) if q.least is None else q.least, q.k)
        for b in batches:
            for i in range(b.num_rows):
                Shard(b.slice(i, 1).to_pylist()[0], q).search_all(q.places, q.starts, best)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[best.query], pa.int64()), pa.array(best.doc, pa.int64()), pa.array(best.score, pa.int64())], ["query", "doc", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row per hit: query_id, rank (from 1), doc_id, score; the k best documents of each query.

    ``queries`` has query_id and text; rows that share a query_id are one query of all their terms.
    A document scores the sum of BM25 (k1 1.2, b 0.75) over the query's distinct terms, each rounded
    to 1/10000; only documents that score above 0 are hits. Equal scores rank by doc_id. Document
    counts and lengths are those of the whole table, so shards merge exactly. A null text has no
    terms; a null doc_id is ranked before other ids and stays null; repeated rows are hits each; no
    documents or queries give no rows; other columns are ignored.
    """
    index = build_index(docs)
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query"), F.col("text")).where("query is not null").mapInArrow(_query_terms, "query long, term long").distinct(), "query-terms")
    size = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("shards")).first()
    n, average = size["n"], max(1e-9, size["words"] / max(1, size["n"]))
    frequency = index.select("terms", "starts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    blocks = max(1, -(-asked.count() // QUERY_TERMS))
    weighed = stored(asked.join(frequency, "term").select("query", "term", "df", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")), "queries")
    path = scratch_path(docs.sparkSession, "hits")
    # some shards are searched first, so that all others know scores that hits must reach
    first = stored(index.where(F.pmod(F.xxhash64("docs"), F.lit(FIRST)) == 0), "first-shards") if size["shards"] >= FIRST else None
    for block in range(blocks):  # a block's hits are written before the next one's terms come
        t = weighed.where(F.col("block") == block).select("query", "term", "df").toArrow()  # about QUERY_TERMS rows
        df = t.column("df").to_numpy().astype(np.float64)
        q = Queries.of(t.column("query").to_numpy(), t.column("term").to_numpy(), np.log(1 + (n - df + 0.5) / (df + 0.5)), average, k)
        if first is not None:
            known = first.mapInArrow(lean("", _searched(q)), _HIT).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
            known = known.where(F.col("rank") == k).select("query", "score").toArrow()  # a row a query at most
            q.least = np.ones(len(q.ids), np.int64)
            q.least[np.searchsorted(q.ids, known.column("query").to_numpy())] = known.column("score").to_numpy()
        index.mapInArrow(lean("", _searched(q)), _HIT).write.mode("append").parquet(path)
    out = docs.sparkSession.read.schema(_HIT).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("long").alias("rank"), real_id("doc").alias("doc_id"), (F.col("score") / UNIT).alias("score"))
