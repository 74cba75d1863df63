"""Repeated passages: what op7 (words, the first occurrence stays) and op8 (bytes, none stays) have in common.

Every window (20 words, 400 bytes) has an anchor: the place of the smallest rolling hash among its first
positions, so equal windows have equal anchors and neighbouring windows mostly share one. The windows
that share an anchor are a block: the seed extended both ways as far as they reach. Round one compares
whole blocks (one row per block and batch); where a seed has blocks that differ, round two compares the
windows of its distinct blocks. Nothing is paired: rows meet by hash, merged before every shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, lean, sized, stored

#: Bytes of text that a task merges before it emits rows.
MERGED_BYTES = 3_000_000
#: What a row says. A block (or window) that repeats in its own batch is marked, and its ranges are settled there.
BLOCK, REPEATED, SETTLED, CONTESTED = range(4)
_ROW = "key long, h long, k long, pos long, meta int"
_NAMES = ["key", "h", "k", "pos", "meta"]


def sliding_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the smallest of hashes[i : i + width] (32 bits), the leftmost of equal ones."""
    least = hashes.astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Batch:
    """Some documents' units (words or bytes) one after the other; ``starts`` has where each begins, and the end."""

    window: int
    spread: int
    starts: np.ndarray

    def anchors(self) -> np.ndarray:
        raise NotImplementedError

    def piece(self, a: int, b: int) -> bytes:
        """What is compared of units a to b."""
        raise NotImplementedError

    def digest(self, a: int, b: int, seed: int) -> int:
        from xxhash import xxh3_64_intdigest

        return xxh3_64_intdigest(self.piece(a, b), seed)

    def seed_end(self, anchor: int) -> int:
        """The end of what all windows of an anchor share from it on."""
        raise NotImplementedError

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first and last window start, anchor) of every block, in order."""
        n = int(self.starts[-1])
        if n < self.window:
            return (np.zeros(0, np.int64),) * 4
        anchor = self.anchors()
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        valid = np.flatnonzero(np.arange(n) + self.window <= self.starts[1:][doc])
        if not len(valid):
            return (np.zeros(0, np.int64),) * 4
        a, d = anchor[valid], doc[valid]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
        at = np.flatnonzero(first)
        last = np.concatenate((at[1:], [len(valid)])) - 1
        return d[at], valid[at], valid[last], a[at]


class Words(Batch):
    """Words ``[^\\x20\\x09-\\x0D]+``; anchors are grams of 8 words among a window's first 13."""

    window, gram, spread = 20, 8, 13

    def __init__(self, texts: list[str | None]):
        self.words: list[bytes] = []
        counts = []
        for t in texts:
            w = (t or "").encode("utf-8", "replace").split()
            counts.append(len(w))
            self.words += w
        self.starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        self.ends = (ends - 1).tolist()
        self.begins = [0, *ends.tolist()]

    def anchors(self) -> np.ndarray:
        from zlib import crc32

        h = mixed(np.fromiter(map(crc32, self.words), np.uint64, len(self.words)) + np.uint64(1))
        grams = np.zeros(len(h) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            part = h[j : len(h) - self.gram + 1 + j]
            grams += part << np.uint64(7 * j) | part >> np.uint64(64 - 7 * j) if j else part
        return sliding_least(mixed(grams) >> np.uint64(32), self.spread)

    def piece(self, a: int, b: int) -> bytes:
        return self.joined[self.begins[a] : self.ends[b - 1]]

    def seed_end(self, anchor: int) -> int:
        return anchor + self.gram


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _BACK)):
                _powers[i] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))))
    return _powers[0][:n], _powers[1][:n]


class Bytes(Batch):
    """UTF-8 bytes; a rolling hash of 16 bytes triggers where it is the least of a window's first 128."""

    window, gram, spread = 400, 16, 128

    def __init__(self, texts: list[str | None]):
        held = [(t or "").encode("utf-8", "replace") for t in texts]
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in held], dtype=np.int64)))
        self.joined = b"".join(held)

    def anchors(self) -> np.ndarray:
        b = np.frombuffer(self.joined, np.uint8).astype(np.uint64) + np.uint64(1)
        up, back = _power(len(b))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * up)))
        rolling = (sums[self.gram :] - sums[: -self.gram]) * back[: len(b) - self.gram + 1]
        return sliding_least(mixed(rolling) >> np.uint64(32), self.spread)

    def piece(self, a: int, b: int) -> bytes:
        return self.joined[a:b]

    def seed_end(self, anchor: int) -> int:
        return anchor + self.window - self.spread + 1


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _merged(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Rows of several batches, or parts of one, of about ``MERGED_BYTES`` of text each."""
    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + MERGED_BYTES - size, side="left")) + 1
            end = min(end, b.num_rows)
            held.append(b.slice(at, end - at))
            size += int(lengths[at:end].sum())
            at = end
            if size >= MERGED_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _in_batch(key, h, k, pos, first_stays: bool):
    """Which rows stand for their (key, h) in this batch, which repeat, and which of them are settled here."""
    order = np.lexsort((pos, k, h, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
    group = np.cumsum(new) - 1
    lead = order[new]
    again = np.zeros(len(order), bool)  # not the first of its group, nor a repeat of the row that is
    again[order] = ~new & ((k[order] != k[lead][group]) | (pos[order] != pos[lead][group]))
    if first_stays:
        return lead, np.zeros(len(lead), bool), again
    several = np.bincount(group, weights=again[order]) > 0
    settled = np.zeros(len(order), bool)
    settled[order] = several[group]
    return lead, several, settled


def _rows(key, h, k, pos, meta) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(pos, pa.int64()), pa.array(meta.astype(np.int32), pa.int32())], _NAMES)


def _emit(kind: type[Batch], first_stays: bool):
    """Round one: a row for each distinct block of a batch, and the ranges that the batch settles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _merged(batches, 2):
            units = kind(t.column(2).to_pylist())
            k, th = (t.column(i).to_numpy() for i in (0, 1))
            doc, lo, hi, anchor = units.blocks()
            if not len(doc):
                continue
            key = _signed([units.digest(a, units.seed_end(a), 1) for a in anchor.tolist()])
            h = _signed([units.digest(a, b, 2) for a, b in zip(lo.tolist(), (hi + kind.window).tolist(), strict=True)])
            start = lo - units.starts[doc]
            yield from _told(key, h, k[doc], start << 32 | th[doc] & 0xFFFFFFFF, hi - lo, first_stays)

    return run


def _told(key, h, k, pos, more, first_stays) -> Iterator[pa.RecordBatch]:
    lead, several, settled = _in_batch(key, h, k, pos, first_stays)
    yield _rows(key[lead], h[lead], k[lead], pos[lead], more[lead] << 3 | np.where(several, REPEATED, BLOCK))
    if settled.any():
        i = np.flatnonzero(settled)
        i = i[np.lexsort((pos[i], pos[i] & 0xFFFFFFFF, k[i]))]
        s, e = pos[i] >> 32, (pos[i] >> 32) + more[i]
        new = np.ones(len(i), bool)  # neighbouring ranges of a document become one
        new[1:] = (k[i][1:] != k[i][:-1]) | (pos[i][1:] & 0xFFFFFFFF != pos[i][:-1] & 0xFFFFFFFF) | (s[1:] > e[:-1] + 1)
        at = np.flatnonzero(new)
        e = np.maximum.reduceat(e, at)
        # dealt by a hash of the document, so that settled ranges load no one task
        yield _rows(mixed(k[i][at].astype(np.uint64)).view(np.int64), pos[i][at], k[i][at], pos[i][at], e - s[at] << 3 | SETTLED)


def _settle(first_stays: bool, contest: bool):
    """Rows sorted by key, h, k and pos. What repeats is settled; of a key with several h, their first rows are contested."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first row of the group that the batch before left open; whether its key had another h; whether it was told as contested
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key, h, k, pos = (b.column(i).to_numpy() for i in range(4))
            meta = b.column(4).to_numpy().astype(np.int64)
            ready = meta & 7 == SETTLED
            if last is not None:  # the open group's first row goes before this batch
                key, h, k, pos, meta = (np.concatenate(([x], y)) for x, y in zip(last[:5], (key, h, k, pos, meta), strict=True))
                ready = np.concatenate(([False], ready))
                n += 1
            # settled rows stand apart from the blocks of a key that happens to be the same
            kinds = np.flatnonzero(~ready)
            out = [(k[ready], pos[ready], meta[ready])]
            if len(kinds):
                kk, hh, dd, pp, mm = key[kinds], h[kinds], k[kinds], pos[kinds], meta[kinds]
                new = np.ones(len(kk), bool)
                new[1:] = (kk[1:] != kk[:-1]) | (hh[1:] != hh[:-1])
                group = np.cumsum(new) - 1
                lead = np.flatnonzero(new)
                again = ~new & ((dd != dd[lead][group]) | (pp != pp[lead][group]))
                marked = mm & 7 == REPEATED
                group_marked = np.bincount(group, weights=marked) > 0
                several = (np.bincount(group, weights=again) > 0) | group_marked
                carried = last is not None
                settled = again if first_stays else several[group] & ~marked
                i = np.flatnonzero(settled)
                out.append((dd[i], pp[i], mm[i] >> 3 << 3 | SETTLED))
                many = told = False
                if contest:
                    lead_key = kk[lead]
                    same_before = np.concatenate(([carried and last[5]], lead_key[1:] == lead_key[:-1]))
                    tell = same_before | np.concatenate((lead_key[1:] == lead_key[:-1], [False]))
                    if carried and last[6]:
                        tell[0] = False
                    # the open group at the end is told with the next batch, unless it is already known to be contested
                    j = lead[tell]
                    out.append((dd[j], pp[j], mm[j] >> 3 << 3 | CONTESTED))
                    many, told = bool(same_before[-1]), bool(tell[-1] or (len(lead) == 1 and carried and last[6]))
                z = lead[-1]
                state = REPEATED if several[-1] and not first_stays else mm[z] & 7
                last = (kk[z], hh[z], dd[z], pp[z], mm[z] >> 3 << 3 | state, many, told)
            a, p, m = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array((p & 0xFFFFFFFF).astype(np.int64)), pa.array((p >> 32).astype(np.int64)), pa.array((p >> 32) + (m >> 3)), pa.array((m & 7).astype(np.int32))], ["k", "th", "lo", "hi", "state"])

    return run


_RANGE = "k long, th long, lo long, hi long, state int"


def _windows(kind: type[Batch], first_stays: bool):
    """Round two: a row for each distinct window of the contested blocks of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for t in _merged(batches, 2):
            units = kind(t.column(2).to_pylist())
            k, th = (t.column(i).to_numpy() for i in (0, 1))
            key, h, doc, start = [], [], [], []
            for d, ranges in enumerate(t.column(3).to_pylist()):
                base = int(units.starts[d])
                for r in ranges or ():
                    for p in range(r["lo"], r["hi"] + 1):
                        x = xxh3_128_intdigest(units.piece(base + p, base + p + kind.window))
                        key.append(x >> 64)
                        h.append(x & 0xFFFFFFFFFFFFFFFF)
                        doc.append(d)
                        start.append(p)
            if doc:
                at = np.array(doc)
                pos = np.array(start, np.int64) << 32 | th[at] & 0xFFFFFFFF
                yield from _told(_signed(key), _signed(h), k[at], pos, np.zeros(len(at), np.int64), first_stays)

    return run


def repeated_ranges(docs: DataFrame, kind: type[Batch], first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """(keyed texts, ranges): by (k, th) an array of (lo, hi), the window starts whose content also starts elsewhere
    (with ``first_stays``: earlier, by doc_id and start). Documents with a seed that stands elsewhere too have a row
    even if no whole window of theirs does; their array is empty."""
    keyed = keyed_text(docs).withColumn("th", F.col("th").bitwiseAND(F.lit(0xFFFFFFFF)))
    order = ["key", "h", "k", "pos"]
    one = keyed.select("k", "th", "text").mapInArrow(lean("", _emit(kind, first_stays)), _ROW)
    told = stored(sized(one.repartition("key").sortWithinPartitions(*order).mapInArrow(lean("", _settle(first_stays, True)), _RANGE), docs), "blocks")
    contested = told.where(F.col("state") == CONTESTED).groupBy("k", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    texts = keyed.join(contested, ["k", "th"]).select("k", "th", "text", "ranges")
    two = texts.mapInArrow(lean("", _windows(kind, first_stays)), _ROW).repartition("key").sortWithinPartitions(*order).mapInArrow(lean("", _settle(first_stays, False)), _RANGE)
    found = told.unionByName(two)
    return keyed, found.groupBy("k", "th").agg(F.collect_list(F.when(F.col("state") == SETTLED, F.struct("lo", "hi"))).alias("ranges"))


def covered(n: int, ranges: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that starts in one of the ranges."""
    marks = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        marks[r["lo"]] += 1
        marks[min(n, r["hi"] + window)] -= 1
    return np.cumsum(marks[:-1]) > 0
