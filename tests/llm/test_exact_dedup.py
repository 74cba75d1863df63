import hashlib
import random
from collections import defaultdict

from rowloom.llm.exact_dedup import MAX_DEPTH, directory, drop_copies, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep, points = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, keep, len(members), i == keep and n == points, hashlib.sha256(norm.encode()).hexdigest()) for i, n in members]
    return sorted(out, key=str)


def test_against_brute_force(make, odd_rows):
    got = sorted(map(tuple, exact_groups(make(odd_rows)).collect()), key=str)
    assert got == brute(odd_rows)


def test_random_groups(make):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5)))) for i in range(400)]
    assert sorted(map(tuple, exact_groups(make(rows), capacity=3).collect()), key=str) == brute(rows)
    kept = {r[0] for r in drop_copies(make(rows)).select("doc_id").collect()}
    assert kept == {r[0] for r in brute(rows) if r[3]}


def test_empty(make):
    assert exact_groups(make([])).collect() == []
    assert drop_copies(make([])).collect() == []


def test_collisions_are_told_apart_by_bytes(make):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 4)))) for i in range(300)]
    got = [tuple(r)[:4] for r in exact_groups(make(rows), capacity=20, key_bits=1, digest_bits=0).collect()]
    assert sorted(got, key=str) == [r[:4] for r in brute(rows)]


def test_hot_group_and_least_doc_id(make):
    rows = [(i - 2**63, "same text") for i in range(1500)] + [(i, f"text {i % 700}") for i in range(1500)] + [(None, "same text ")]
    assert sorted(map(tuple, exact_groups(make(rows), capacity=100).collect()), key=str) == brute(rows)


def test_rows_that_share_an_id(make):
    got = drop_copies(make([(0, "B"), (1, "A"), (1, "B"), (2, "A"), (5, "same text"), (5, "same text"), (None, "alone"), (None, "B"), (7, None), (7, "")]))
    left = [(r["doc_id"], r["text"] or "") for r in got.collect()]
    assert sorted(left, key=str) == sorted([(0, "B"), (1, "A"), (5, "same text"), (None, "alone"), (7, "")], key=str)
    assert got.columns == make([]).columns


def test_directory_splits_only_what_overflows():
    size = 1 << MAX_DEPTH
    got = directory({0: 90, 1: 90, size - 1: 50}, 100)
    assert got[0][0] != got[1][0] and got[0][1] == MAX_DEPTH
    assert got[size - 1][1] == 1 and got[size // 2] == got[size - 1]
    assert len({b for b, _ in directory({}, 10)}) == 1
    assert directory({5: 10**9}, 10)[5][1] == MAX_DEPTH
