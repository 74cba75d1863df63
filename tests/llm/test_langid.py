import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowloom.llm import langid
from rowloom.llm.langid import Lattice, Scorer, Vocabulary, identify, keep_identified, train, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return train(docs, PATH)


def test_sum_over_all_segmentations():
    vocab = {"a": 1, "b": 2, "ab": 3, "aba": 4}
    prob = np.array([[1e-7, 1e-7], [0.5, 0.1], [0.2, 0.2], [0.2, 0.3], [0.1, 0.4]])
    words = ["ab", "abab", "abx", "b", "aba"]

    def brute(word, lang, only=None):
        total, uses = 0.0, np.zeros(5)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            pieces, at = [], 0
            for i, c in enumerate([*cuts, 1]):
                if c:
                    pieces.append(word[at : i + 1])
                    at = i + 1
            ids = [vocab.get(p, 0 if len(p) == 1 else None) for p in pieces]
            if None not in ids:
                p = float(np.prod([prob[i, lang] for i in ids]))
                total += p
                uses += p * np.bincount(ids, minlength=5)
        return total, uses / total

    lattice = Lattice(words, vocab)
    got = lattice.totals(prob)
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(brute(w, lang)[0])
    want = sum(n * brute(w, 1)[1] for w, n in zip(words, [1, 2, 3, 4, 5], strict=True))
    assert lattice.expected(prob[:, 1:], np.arange(1, 6), 5) == pytest.approx(want)


def test_held_out_accuracy(docs, model):
    got = identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id")
    n, right = got.where("held_out and lang_pred <> 'und'").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
    assert got.where((F.col("lang_pred") == "und") & F.col("text").rlike(r"\p{L}")).count() == 0


def test_learns_only_from_training_rows(docs, model):
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = train(other, PATH)
    assert again.languages == model.languages and np.allclose(again.prob, model.prob)


def test_odd_rows(make, odd_rows, model):
    got = identify(make(odd_rows), model).collect()
    assert len(got) == len(odd_rows)
    und = sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"), key=str)
    assert und == sorted([1, 2, 3, 10, 14, 15, None], key=str)
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert identify(make([]), model).collect() == []
    nothing = train(make([]), PATH)
    assert {r["lang_pred"] for r in identify(make([(1, "some text")]), nothing).collect()} == {"und"}
    kept = keep_identified(make(odd_rows), model, 0.0)
    assert kept.count() == len(odd_rows) - len(und) and kept.columns == make([]).columns


def test_vocabulary_is_fixed():
    v = vocabulary(PATH)
    assert len(v) > 15_000 and sorted(v.values()) == list(range(1, len(v) + 1))


def test_letters_are_those_of_category_l(make, model):
    got = {r["doc_id"]: r["lang_pred"] for r in identify(make([(1, "\u00b2\u00bd"), (2, "\u2160 \u3007"), (3, "\u00b2a\u00bd"), (4, "\u02b0"), (5, "1_2")]), model).collect()}
    assert [i for i, lang in got.items() if lang == "und"] == [1, 2, 5]


def test_long_words_are_summed_whole():
    from fractions import Fraction

    vocab = {"a": 1, "ab": 2, "b": 3, "abab": 4}
    prob = np.array([[1e-7, 1e-7], [0.01, 1e-5], [0.2, 1e-6], [0.001, 1e-4], [0.05, 1e-3]])
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abx"), n)) for n in (1, 5, 15, 16, 17, 32, 33, 300, 1500)]
    got = Lattice(words, vocab).log_totals(prob, Vocabulary(vocab).longest)
    for i, w in enumerate(words):
        for lang in (0, 1):
            sums = [Fraction(1)]
            for end in range(1, len(w) + 1):
                pieces = [(n, vocab.get(w[end - n : end], 0 if n == 1 else None)) for n in range(1, min(4, end) + 1)]
                sums.append(sum(sums[end - n] * Fraction(prob[j, lang]) for n, j in pieces if j is not None))
            total = sums[-1]
            log = float(np.log(float(total * 10 ** (shift := 9 * len(w)))) - shift * np.log(10)) if len(w) < 30 else (total.numerator.bit_length() - total.denominator.bit_length()) * np.log(2)
            assert got[i, lang] == pytest.approx(log, abs=1.0 if len(w) >= 30 else 1e-6)


def test_one_very_long_word(model):
    assert len(list(Scorer(model).predict(["the" * 40_000, "the cat and the dog are here " + "x" * 60_000]))) == 2
