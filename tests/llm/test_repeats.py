import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import repeats
from rowloom.llm.repeats import Bytes, Words, sliding_least
from rowloom.llm.substrings import drop_repeated_bytes, drop_repeated_words


def brute_words(rows):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    out = []
    for i, w in docs:
        cut = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                cut[p : p + 20] = [True] * 20
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for i, b in docs:
        for p in range(len(b) - 399):
            seen.setdefault(b[p : p + 400], set()).add((i, p))
    out = []
    for i, b in docs:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if len(seen[b[p : p + 400]]) > 1:
                cut[p : p + 400] = True
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        runs = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out.append((i, len(b), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words_of(docs):
    return sorted(map(tuple, drop_repeated_words(docs, digest=True).collect()), key=str)


def bytes_of(docs):
    return sorted((tuple(r)[:5] for r in drop_repeated_bytes(docs, digest=True).collect()), key=str)


def test_seeds_tell_of_shorter_repeats(make):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    shared, longer = own(400)[:395], own(200)
    rows = [(i, f"{own(150)} {shared} {own(150)}" if i < 4 else f"{own(90)} {longer}" if i < 6 else own(300)) for i in range(12)]
    got = {r["doc_id"]: (r["n_removed"] > 0, r["shares_seed"]) for r in drop_repeated_bytes(make(rows)).collect()}
    assert got == {i: (4 <= i < 6, int(i < 6)) for i in range(12)}


def texts(seed, n, passages, unit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 90) * unit)) for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared).split()
            a = rng.randint(0, max(0, len(s) - 5)) if rng.random() < 0.5 else 0
            parts += [word() for _ in range(rng.randint(0, 40))] + s[a : a + rng.randint(5, 100 * unit)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("merged", [3_000_000, 2_000])
def test_words_against_brute_force(make, monkeypatch, merged):
    rows = texts(1, 60, 8, 1) + [(900, "a b " * 40), (901, "z " * 70), (None, "q " * 30), (903, "z " * 45)]
    monkeypatch.setattr(repeats, "MERGED_BYTES", merged)
    assert words_of(make(rows)) == brute_words(rows)


def test_bytes_against_brute_force(make):
    rows = texts(2, 50, 8, 2) + [(900, "ab" * 450), (901, "z" * 900), (902, None), (903, "é" * 300), (904, "z" * 401)]
    assert bytes_of(make(rows)) == brute_bytes(rows)


def test_odd_rows(make, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 60_000] + [(70, "w1 w2 w3 " * 300), (71, "w1 w2 w3 " * 290)]
    assert words_of(make(rows)) == brute_words(rows)
    assert bytes_of(make(rows)) == brute_bytes(rows)
    assert words_of(make([])) == bytes_of(make([])) == []


def test_texts_are_returned_without_digest(make):
    same = " ".join(f"w{i}" for i in range(200))
    got = {r["doc_id"]: r["kept_text"] for r in drop_repeated_words(make([(1, same), (2, "x " + same + " y")])).collect()}
    assert got == {1: same, 2: "x y"}
    assert {bytes(r["kept"]) for r in drop_repeated_bytes(make([(1, same), (2, "x " + same)])).collect()} == {b"", b"x "}


def run(kind, first_stays, rows, merged, size):
    """Both rounds in this process, with batches of ``size`` rows, so that groups span batches."""
    repeats.MERGED_BYTES = merged
    th = [hash(t) & 0xFFFFFFFF for _, t in rows]
    table = pa.table({"k": pa.array([i for i, _ in rows], pa.int64()), "th": pa.array(th, pa.int64()), "text": [t for _, t in rows]})

    def settled(batches, contest):
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("h", pa.int64()), ("k", pa.int64()), ("pos", pa.int64()), ("meta", pa.int32())]))
        t = t.sort_by([(c, "ascending") for c in ("key", "h", "k", "pos")]).combine_chunks()
        return [r for b in repeats._settle(first_stays, contest)(iter(t.to_batches(size))) for r in b.to_pylist()]

    told = settled(repeats._emit(kind, first_stays)(iter(table.to_batches(3))), True)
    open_blocks = {}
    for r in told:
        if r["state"] == repeats.CONTESTED:
            open_blocks.setdefault(r["k"], []).append({"lo": r["lo"], "hi": r["hi"]})
    second = table.append_column("ranges", pa.array([open_blocks.get(i, []) for i, _ in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
    told += settled(repeats._windows(kind, first_stays)(iter(second.to_batches(3))), False)
    out = set()
    for r in told:
        if r["state"] == repeats.SETTLED:
            out |= {(r["k"], p) for p in range(r["lo"], r["hi"] + 1)}
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
@pytest.mark.parametrize("merged", [500, 100_000])
def test_groups_that_span_batches(monkeypatch, size, merged):
    monkeypatch.setattr(repeats, "MERGED_BYTES", merged)
    rows = texts(size, 30, 4, 1)
    first, starts = {}, {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 19):
            starts[(i, p)] = first.setdefault(tuple(w[p : p + 20]), (i, p))
    assert run(Words, True, rows, merged, size) == {k for k, v in starts.items() if k != v}
    seen = {}
    for i, t in rows:
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((i, p))
    assert run(Bytes, False, rows, merged, size) == {x for v in seen.values() if len(v) > 1 for x in v}


def test_sliding_least():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 13, 128):
        assert sliding_least(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(300 - width + 1)]
