import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm.pieces import MARK, Model, PieceEncoder, Trie, decode, encode, encoding_report

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = PieceEncoder(PATH)


def ids(text, e=OURS):
    return np.frombuffer(next(e.ids([text])), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeinorst THE.,\n", max_size=80), st.text("ab  ▁é\t0", max_size=40)))
def test_ids_and_texts_are_the_librarys(text):
    got = ids(text)
    assert got == LIBRARY.encode(text)
    assert OURS.decode(np.array(got, "<u4").tobytes()) == LIBRARY.decode(got)


def test_real_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows:
        assert ids(r["text"]) == LIBRARY.encode(r["text"])


def test_words_of_pieces():
    rng = random.Random(1)
    pieces = list(OURS.model.ids)
    words = sorted({MARK + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))).replace(MARK, "") for _ in range(3000)} - {MARK})
    for w, got in zip(words, OURS.trie.encode(words), strict=True):
        assert got == LIBRARY.encode(w[1:]), w


def test_shared_prefixes_are_walked_once():
    trie = Trie(OURS.model)
    list(trie.encode(["▁there", "▁thereby", "▁therefore"]))
    assert trie.visited == 6 + 2 + 4


def brute_viterbi(m, word):
    best = [(0.0, [])] + [(-1e30, None)] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            i = m.ids.get(word[s:e])
            score = m.scores[i] if i is not None else (m.least - 10.0 if s == e - 1 else None)
            if score is not None and best[s][0] + score > best[e][0] + 1e-9:
                best[e] = (best[s][0] + score, best[s][1] + [word[s:e]])
    return best[-1][0]


def test_unigram_scores_are_the_best():
    model = Model(PATH, unigram=True)
    trie = Trie(model)
    words = sorted(["▁hello", "▁help", "▁helping", "▁✓x", "▁internationalisation"])
    for w, got in zip(words, trie.encode(words), strict=True):
        known = sum(model.scores[i] for i in got if i not in model.byte.values())
        unknown = sum(c not in model.ids for c in w)
        assert known + unknown * (model.least - 10.0) == pytest.approx(brute_viterbi(model, w))


def test_table(make, odd_rows):
    rows = odd_rows
    got = sorted(map(tuple, encoding_report(make(rows), PATH).collect()), key=str)
    want = []
    for i, t in rows:
        x = LIBRARY.encode(t or "")
        want.append((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True))
    assert got == sorted(want, key=str)
    encoded = encode(make(rows), PATH)
    back = decode(encoded, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert encoding_report(make([]), PATH).collect() == []


def test_long_runs_of_blanks_take_little_time():
    import time

    for n in (1, 2, 15, 16, 17, 33, 1000, 4097):
        assert ids(" " * n + "word") == LIBRARY.encode(" " * n + "word"), n
        assert ids("a" + " " * n) == LIBRARY.encode("a" + " " * n), n
    began = time.perf_counter()
    got = ids("a" + " " * 100_000 + "b")
    assert time.perf_counter() - began < 20 and got == LIBRARY.encode("a" + " " * 100_000 + "b")
