import random

import xxhash

from rowloom.llm.simhash import BKTree, components, drop_near_copies, fingerprint, fingerprint_links, shard_links, simhash_groups


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """fps: {node: fingerprint} -> node: smallest node reachable."""
    top = {i: i for i in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    nodes = sorted(fps)
    for a in nodes:
        for b in nodes:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in nodes}


def test_fingerprint(odd_rows):
    for _, t in odd_rows:
        assert fingerprint(t or "") == slow_fingerprint(t)


def test_groups_against_brute_force(make):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(25)]
    rows = [(i, None if i % 60 == 7 else " ".join(rng.choice("xyz") if rng.random() < 0.01 else w for w in rng.choice(base))) for i in range(150)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(make(rows)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = brute(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = {r["doc_id"] for r in drop_near_copies(make(rows)).select("doc_id").collect()}
    assert kept == set(want.values())


def test_rows_that_share_an_id(make):
    a, b, c = ("one two three four five", "six seven eight nine ten", "x y z")
    got = drop_near_copies(make([(0, b), (1, a), (1, b), (2, a), (5, c), (5, c), (None, a), (None, "only here"), (8, None), (8, "")]))
    left = [(r["doc_id"], r["text"] or "") for r in got.collect()]
    assert sorted(left, key=str) == sorted([(0, b), (1, a), (5, c), (None, "only here"), (8, "")], key=str)
    assert got.columns == make([]).columns
    assert drop_near_copies(make([])).collect() == []


def test_odd_rows(make, odd_rows):
    got = simhash_groups(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1, None: 1}
    assert simhash_groups(make([])).collect() == []


def test_hot_shards_are_split_without_losing_links(spark):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 300:
        x = center
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {k: v for k, v in brute({s: f for s, f in zip(signed, fps, strict=True)}).items() if k != v}
    for shard in (5, 100, 2000):
        links = fingerprint_links(df, shard=shard)
        assert {r["node"]: r["root"] for r in components(links).collect()} == want


def test_tree_finds_all_within_radius():
    rng = random.Random(6)
    fps = [rng.getrandbits(12) for _ in range(300)]
    tree = BKTree()
    for f in fps:
        tree.add(f)
    for q in fps[:50]:
        assert set(tree.near(q, 3)) == {f for f in fps if (f ^ q).bit_count() <= 3}
    assert len(shard_links(sorted(set(fps)), 12)) == len(set(fps)) - 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{i: 0 for i in range(1, 201)}, 500: 400}


def test_a_dense_shard_is_split_in_its_task():
    rng = random.Random(8)
    fps = sorted({rng.getrandbits(14) << 3 for _ in range(900)})
    whole = dict(shard_links(fps, 2))
    assert dict(shard_links(fps, 2, most=20)) == whole and whole
    want = brute(dict(zip(range(len(fps)), fps, strict=True)))
    assert dict(shard_links(fps, 3, most=50)) == {fps[i]: fps[j] for i, j in want.items() if i != j}
