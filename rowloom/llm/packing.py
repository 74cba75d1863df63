"""Packing documents into sequences: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import token_pieces

Plan = list[tuple[tuple[int, ...], int]]
#: Rows of a group that are ranked together.
RANKED = 20_000
#: Most documents of a pattern, and second lengths that are tried for each longest one.
FEW, SECONDS = 12, 24
#: The part of all tokens, in the shortest documents, that fills the gaps of the residual.
RESERVE = 32


def patterns(left: dict[int, int], size: int, waste: int = 0) -> list[tuple[int, ...]]:
    """Patterns of at most ``FEW`` lengths that leave at most ``waste`` of ``size``, longest length first.

    For every length of the histogram as the longest: alone, and with each of up to ``SECONDS`` second
    lengths, taken at even steps from those that fit, completed by the longest lengths that still fit.
    A pattern never asks for more of a length than the histogram holds.
    """
    there = sorted(n for n, c in left.items() if c)
    out: dict[tuple[int, ...], None] = {}

    def completed(pattern: list[int]) -> None:
        room = size - sum(pattern)
        top = len(there)
        while room > waste and len(pattern) < FEW:
            i = bisect_right(there, min(room, pattern[-1]), 0, top) - 1
            while i >= 0 and pattern.count(there[i]) >= left[there[i]]:
                i -= 1
            if i < 0:
                return
            pattern.append(there[i])
            room -= there[i]
            top = i + 1
        if room <= waste:
            out[tuple(pattern)] = None

    for longest in reversed(there):
        if size - longest <= waste:
            out[(longest,)] = None
            continue
        n = bisect_right(there, min(longest, size - longest))
        if size - longest in left and left[size - longest]:
            completed([longest])
        for i in sorted({round(x) for x in np.linspace(0, n - 1, min(n, SECONDS))}, reverse=True):
            if there[i] < longest or left[longest] > 1:
                completed([longest, there[i]])
    return list(out)


def nnls(members: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring sum(x * pattern) near ``counts`` in least squares.

    Accelerated projected gradient descent; only the patterns' few entries are stored.
    """
    if not members:
        return np.zeros(0)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    length = np.concatenate([np.array(m) for m in members])
    weight = 1.0 / np.maximum(1.0, counts)  # relative errors: rare lengths count as much as frequent ones
    shared = np.bincount(length, minlength=len(counts))
    # a matrix without negative entries is at most the diagonal of its row sums: a step size for each pattern
    rate = 1.0 / np.maximum(1e-12, np.bincount(owner, weights=(weight * shared)[length], minlength=len(members)))
    x = np.zeros(len(members))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        error = (np.bincount(length, weights=y[owner], minlength=len(counts)) - counts) * weight
        new = np.maximum(0.0, y - rate * np.bincount(owner, weights=error[length], minlength=len(members)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def best_fit(left: dict[int, int], size: int, open_bins: Plan = ()) -> Plan:
    """Best-fit decreasing over a histogram: equal lengths go to equal bins at once."""
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: Plan = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            done.append((pattern, n))
            return
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([pattern, n])

    for pattern, n in open_bins:
        put(pattern, n, size - sum(pattern))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                each = size // length
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, full, size - each * length)
                if rest:
                    put((length,) * rest, 1, size - rest * length)
                break
            room = rooms[i]
            pattern, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(i)
            fits = room // length
            if fits * m <= n:
                put(pattern + (length,) * fits, m, room - fits * length)
                n -= fits * m
            else:
                full, rest = divmod(n, fits)
                if full:
                    put(pattern + (length,) * fits, full, room - fits * length)
                if rest:
                    put(pattern + (length,) * rest, 1, room - rest * length)
                if m - full - bool(rest):
                    put(pattern, m - full - bool(rest), room)
                n = 0
    return done + [(p, m) for held in bins.values() for p, m in held]


def rounded(members: list[tuple[int, ...]], fit: np.ndarray, left: Counter[int], size: int, slack: int) -> tuple[Plan, int]:
    """Whole repeat counts: fits rounded down, then one more by largest remainder, within the histogram ``left``
    (which is reduced) and while the patterns' waste stays within ``slack``; with what is left of the slack."""
    times: Counter[int] = Counter()

    def take(i: int, n: int) -> None:
        nonlocal slack
        need, waste = Counter(members[i]), size - sum(members[i])
        n = min([n, *(left[x] // k for x, k in need.items()), *([slack // waste] if waste else [])])
        if n > 0:
            times[i] += n
            slack -= n * waste
            for x, k in need.items():
                left[x] -= k * n

    whole = np.floor(fit + 1e-9).astype(np.int64)
    for i in np.flatnonzero(whole).tolist():
        take(i, int(whole[i]))
    for i in np.lexsort((np.arange(len(fit)), whole - fit)).tolist():
        if fit[i] > 0:
            take(i, 1)
    return [(members[i], n) for i, n in times.items()], slack


def fitted(histogram: dict[int, int], size: int) -> tuple[Plan, dict[int, int]]:
    """(sequences by patterns, what they leave of the histogram).

    Patterns are enumerated, fitted and rounded, and again on what is left, until a round adds few. All
    waste together stays within the free room of the fewest sequences there can be, so that the patterns
    cost no sequence. The shortest documents, a ``RESERVE``-th of all tokens, are kept out of patterns: with
    lengths that no pattern fits they are the residual, whose gaps they fill.
    """
    left = Counter({n: c for n, c in histogram.items() if c})
    out: Plan = []
    tokens = sum(n * c for n, c in left.items())
    slack, wanted = -tokens % size, tokens // RESERVE
    reserve: Counter[int] = Counter()
    for n in sorted(left):
        reserve[n] = min(left[n], wanted // n)
        wanted -= reserve[n] * n
        left[n] -= reserve[n]
        if left[n]:
            break
    for waste in (0, size // 512):
        while members := patterns(left, size, min(waste, slack)):
            counts = np.zeros(size + 1)
            for n, c in left.items():
                counts[n] = c
            new, slack = rounded(members, nnls(members, counts), left, size, slack)
            out += new
            if sum(n for _, n in new) * 500 <= sum(n for _, n in out):  # the next rounds would add less and less
                break
    return out, {n: c for n, c in (left + reserve).items() if c}


def plan(histogram: dict[int, int], size: int) -> Plan:
    """(lengths of a sequence, number of such sequences) for all pieces of a histogram.

    The sequences of fitted patterns and best-fit ones for the residual. Best-fit over the whole
    histogram is computed as well and returned where it needs fewer sequences.
    """
    by_pattern, residual = fitted(histogram, size)
    mixed = by_pattern + best_fit(residual, size)
    whole = best_fit({n: c for n, c in histogram.items() if c}, size)
    return min(mixed, whole, key=lambda p: sum(n for _, n in p))


def _slots(packed: Plan) -> dict[str, np.ndarray]:
    """The plan as runs of ranks of each length: piece r of length L, lo <= r < hi, goes to sequence first + (r - lo) // per."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in packed:
        at = 0
        for length, per in Counter(pattern).items():  # equal lengths stand together
            rows.append((length << 44 | used[length], sequence, per, at, length))
            used[length] += per * times
            at += per * length
        sequence += times
    rows.sort()
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(("key", "first", "per", "at", "length"))}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(slots["key"], length << 44 | rank, side="right") - 1
            turn, slot = np.divmod((length << 44 | rank) - slots["key"][i], slots["per"][i])
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(slots["first"][i] + turn), pa.array(slots["at"][i] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """``pieces`` with a rank from 0 within each length; a frequent length is ranked in parts of about ``RANKED`` rows."""
    parts = max(1, -(-n // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    # one row for each length and part, so at most the number of parts in a window
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("rn", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``size`` is cut. Each sequence holds
    at most ``size`` ids and its pieces lie without gaps from 0. The driver sees the histogram of
    lengths alone (at most ``size`` rows). A null or empty text is a document of ``end_id`` alone; a
    null doc_id stays null; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, size, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = _slots(plan(histogram, size))
    out = ranked(pieces, sum(histogram.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
