import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowloom.llm.packing import best_fit, fitted, nnls, pack, plan
from rowloom.llm.tokens import WordEncoder, drops_blanks, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = WordEncoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["don't,", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "A1b2!!", "é,", "ß.", "  x", "\x1c", "İ.", "|##", "'s.", "x'."]), st.text("abAB'.,!0 \t|", max_size=12)), max_size=8))
def test_words_apart_have_the_librarys_ids(parts):
    text = "".join(parts)
    got = np.frombuffer(next(OURS.ids([text])), "<u4").tolist()
    assert got == ids(text)


def test_counts(make, odd_rows, tmp_path):
    rows = odd_rows + [(20, "a<|endoftext|>b " * 600)]
    want = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows), key=str)
    assert sorted(map(tuple, token_counts(make(rows), PATH).collect()), key=str) == want
    assert token_counts(make([]), PATH).collect() == []


def test_cache_is_appended_and_reused(make, spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts(make([(1, "a b"), (2, "a  b "), (3, "c")]), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    got = token_counts(make([(1, "a b"), (4, "new text")]), PATH, cache).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 2, 4: 2}
    assert spark.read.parquet(cache).count() == 3
    assert {r["n_tokens"] for r in token_counts(make([(1, "a b")]), PATH, cache).collect()} == {2}
    model = public_tokenizers.path("piece_bpe_32k.model")
    token_counts(make([(1, "a b")]), model, cache).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_pack(make, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, "word " * rng.randint(0, 300)) for i in range(200)]
    got = pack(make(rows), PATH, size=512).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    want = Counter()
    for i, t in rows:
        full = ids(t) + [1]
        for n, s in enumerate(range(0, len(full), 512)):
            part = full[s : s + 512]
            want[(i, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    total = sum(k[3] * v for k, v in want.items())
    assert len(sequences) <= 1.03 * total / 512 + 1
    assert pack(make([]), PATH).collect() == []


def check_plan(histogram, size):
    packed = plan(histogram, size)
    held = Counter()
    for pattern, n in packed:
        assert sum(pattern) <= size and n > 0
        for x in pattern:
            held[x] += n
    assert held == Counter({k: v for k, v in histogram.items() if v})
    return sum(n for _, n in packed)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 1000), max_size=40))
def test_plan_places_every_piece(histogram):
    n = check_plan(histogram, 64)
    assert n <= sum(c for _, c in best_fit({k: v for k, v in histogram.items() if v}, 64))
    assert n >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_plan_is_nearly_full_at_scale():
    rng = random.Random(7)
    h = Counter(min(4096, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(100_000))
    assert check_plan(h, 4096) <= 1.001 * sum(k * v for k, v in h.items()) / 4096 + 1


def test_nnls_reaches_an_exact_fit():
    members = [(3, 1), (2, 2), (2, 1, 1)]
    counts = np.array([0, 50, 30, 20, 0], float)
    x = nnls(members, counts, 5000)
    got = np.zeros(5)
    for m, n in zip(members, x, strict=True):
        for v in m:
            got[v] += n
    assert (x >= 0).all() and np.abs(got - counts).max() < 0.5


def test_most_sequences_come_from_patterns():
    rng = random.Random(9)
    for rows in (300, 3_000, 60_000):
        h = Counter(min(4096, max(1, int(rng.lognormvariate(5.8, 1.1)))) for _ in range(rows))
        packed, by_pattern = plan(h, 4096), fitted(h, 4096)[0]
        total = sum(n for _, n in packed)
        assert total == -(-sum(k * v for k, v in h.items()) // 4096)
        assert packed[: len(by_pattern)] == by_pattern
        assert sum(n for _, n in by_pattern) >= 0.75 * total


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts(make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert drops_blanks(PATH) and not drops_blanks(path) and not drops_blanks(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer.from_file(path)
    rows = [(1, "a  b\n\nc"), (2, "a b\nc"), (3, " a b c "), (4, None), (5, "a  b\n\nc")]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(make(rows), path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert np.frombuffer(next(WordEncoder(path).ids(["a  b\n c"])), "<u4").tolist() == library.encode("a  b\n c").ids


def test_a_content_of_most_rows_and_the_least_doc_id(make):
    rows = [(i - 2**63, "the same") for i in range(1200)] + [(i, f"word{i}") for i in range(900)]
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(make(rows), PATH).collect())
    assert got == sorted((i, len(ids(t))) for i, t in rows)
