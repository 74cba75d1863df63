"""Language identification by unigram piece models whose segmentations are summed, not chosen."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified_text, kept, lean, stored
from .pieces import MARK, Automaton, Model

_WORDS = re.compile(r"[^\W\d_]+")
#: Runs of more letters are fitted (not scored) in parts, since forward and backward sums of one need the same scale.
PART = 48
#: Positions after which sums are scaled anew, and cells (words times positions) of a lattice.
STEP, CELLS = 16, 40_000
#: Words whose scores a worker keeps.
KEPT = 150_000
UNKNOWN = 1e-7


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of letters of a public SentencePiece vocabulary, numbered in order; 0 is an unknown character."""
    out: dict[str, int] = {}
    for p in Model(path).ids:
        p = p.lower()
        if (p.lstrip(MARK).isalpha() or p == MARK) and p.count(MARK) <= 1 and p not in out:
            out[p] = len(out) + 1
    return out


def runs_of(word: str) -> list[str]:
    """The runs of letters (Unicode category L) of a word, lower-cased and marked."""
    out = []
    for run in _WORDS.findall(word.lower()):
        if run.isalpha():
            out.append(MARK + run)
        else:  # numerals that are no digits
            out += [MARK + x for x in "".join(c if c.isalpha() else " " for c in run).split()]
    return out


def parts_of(word: str) -> list[str]:
    """The runs of a word in parts of at most ``PART`` characters."""
    return [run[i : i + PART] for run in runs_of(word) for i in range(0, len(run), PART)]


class Vocabulary:
    """The pieces that end at each node of their automaton, in flat arrays; a node without a piece of
    one character has the unknown one."""

    def __init__(self, vocab: dict[str, int]):
        self.automaton = Automaton(vocab)
        ends = [e if any(n == 1 for n, _ in e) else [*e, (1, 0)] for e in self.automaton.ends]
        self.first = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
        self.longest = max(map(len, vocab), default=1)
        self.lengths = np.array([n for e in ends for n, _ in e], np.int64)
        self.ids = np.array([i for e in ends for _, i in e], np.int64)


class Lattice:
    """All segmentations of some words: edges (word, start, end, piece) by end."""

    def __init__(self, words: list[str], vocab: dict[str, int] | Vocabulary):
        v = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.n, self.most = len(words), int(self.length.max(initial=0))
        node = np.array(v.automaton.walk(words), np.int64)
        word = np.repeat(np.arange(self.n), self.length)
        end = np.arange(len(node)) - np.repeat(np.cumsum(self.length) - self.length, self.length) + 1
        count = v.first[node + 1] - v.first[node]
        at = np.repeat(v.first[node] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        self.w, self.e, self.p = np.repeat(word, count), np.repeat(end, count), v.ids[at]
        self.s = self.e - v.lengths[at]

    def _by(self, key: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key * self.n + self.w, kind="stable") if self.n else np.zeros(0, np.int64)
        cuts = np.searchsorted(key[order], np.arange(self.most + 2))
        return [order[cuts[i] : cuts[i + 1]] for i in range(self.most + 1)]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """(words, positions, languages): the summed probability of each prefix."""
        out = np.zeros((self.n, self.most + 1, prob.shape[1]))
        out[:, 0] = 1.0
        for end, edges in enumerate(self._by(self.e)):
            if len(edges):
                w = self.w[edges]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out[w[first], end] = np.add.reduceat(out[w, self.s[edges]] * prob[self.p[edges]], first, axis=0)
        return out

    def backward(self, prob: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.most + 1, prob.shape[1]))
        out[np.arange(self.n), self.length] = 1.0
        for start, edges in reversed(list(enumerate(self._by(self.s)))):
            if len(edges):
                w = self.w[edges]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out[w[first], start] = np.add.reduceat(out[w, self.e[edges]] * prob[self.p[edges]], first, axis=0)
        return out

    def totals(self, prob: np.ndarray) -> np.ndarray:
        """(words, languages): the probability of each word, over all its segmentations."""
        return self.forward(prob)[np.arange(self.n), self.length] if self.n else np.zeros((0, prob.shape[1]))

    def log_totals(self, prob: np.ndarray, longest: int) -> np.ndarray:
        """The logarithms of ``totals`` for words of any length, no piece being longer than ``longest``.

        Every ``STEP`` positions the sums that later positions can still ask for are scaled to 1 at most.
        """
        out = np.zeros((self.n, self.most + 1, prob.shape[1]))
        out[:, 0] = 1.0
        logs = np.zeros((self.n, prob.shape[1]))
        for end, edges in enumerate(self._by(self.e)):
            if not len(edges):
                continue
            w = self.w[edges]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            out[w[first], end] = np.add.reduceat(out[w, self.s[edges]] * prob[self.p[edges]], first, axis=0)
            if not end % STEP:
                on = np.flatnonzero(self.length > end)
                last = out[on, max(0, end - longest + 1) : end + 1]
                top = last.max(axis=1)
                out[on, max(0, end - longest + 1) : end + 1] = last / top[:, None]
                logs[on] += np.log(top)
        return np.log(np.maximum(out[np.arange(self.n), self.length], 1e-300)) + logs

    def expected(self, prob: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece in one language (``prob`` has one column) over words that occur ``counts`` times."""
        f, b = self.forward(prob)[:, :, 0], self.backward(prob)[:, :, 0]
        total = np.maximum(f[np.arange(self.n), self.length], 1e-300)
        share = f[self.w, self.s] * prob[self.p, 0] * b[self.w, self.e] / total[self.w] * counts[self.w]
        return np.bincount(self.p, weights=share, minlength=size)


@dataclass
class LanguageModel:
    """Piece probabilities (pieces, languages); row 0 is an unknown character."""

    languages: list[str]
    vocab_path: str
    prob: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """A worker's scores of words, kept in a table of bounded size."""

    def __init__(self, model: LanguageModel):
        self.model, self.vocab = model, Vocabulary(vocabulary(model.vocab_path))
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.used = 1  # row 0: a word without letters

    def learn(self, words: set[bytes]) -> None:
        if len(self.rows) + len(words) > KEPT:
            self._clear()
        new = [w for w in words if w not in self.rows]
        numbers: dict[str, int] = {}  # of the distinct parts
        parts, owner = [], []
        for w in new:
            own = runs_of(w.decode("utf-8", "replace"))
            if not own:
                self.rows[w] = 0
                continue
            self.rows[w] = self.used
            for p in own:
                parts.append(numbers.setdefault(p, len(numbers)))
                owner.append(self.used)
            self.used += 1
        while len(self.scores) < self.used:
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        if numbers:
            ordered = sorted(numbers, key=len)  # words of like length share a lattice
            logs = np.zeros((len(ordered), self.scores.shape[1]))
            at = 0
            while at < len(ordered):
                end = at + 1
                while end < len(ordered) and (end - at + 1) * len(ordered[end]) <= CELLS:
                    end += 1
                logs[[numbers[x] for x in ordered[at:end]]] = Lattice(ordered[at:end], self.vocab).log_totals(self.model.prob, self.vocab.longest)
                at = end
            np.add.at(self.scores, np.array(owner), logs[np.array(parts)])

    def predict(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[str, float]]:
        """The language and its score for each text. The score is the posterior (equal priors) with the
        log-likelihoods divided by the root of the number of words, since words are not independent."""
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            held = [(t or "").encode("utf-8", "replace").split() for t in (some if isinstance(some, list) else some.to_pylist())]
            self.learn(set().union(*held))
            for words in held:
                rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
                rows = rows[rows > 0]
                if not len(rows) or not self.model.languages:
                    yield "und", 0.0
                    continue
                total = np.zeros(len(self.model.languages))
                for i in range(0, len(rows), 20_000):
                    total += self.scores[rows[i : i + 20_000]].sum(axis=0)
                z = (total - total.max()) / len(rows) ** 0.5
                best = int(np.argmax(total))
                yield self.model.languages[best], float(np.exp(z[best]) / np.exp(z).sum())


_scorers: dict[str, Scorer] = kept("language")


def _scorer(model: LanguageModel) -> Scorer:
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w in (text or "").split():
                    for p in parts_of(w):
                        seen[(lang, p)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def _expected(vocab_path: str, languages: list[str], prob: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(vocabulary(vocab_path))
        sums = np.zeros_like(prob)
        for b in batches:
            lang = np.array([languages.index(x) for x in b.column(0).to_pylist()], np.int64)
            words, n = b.column(1).to_pylist(), b.column(2).to_numpy()
            for own in range(len(languages)):
                at = np.flatnonzero(lang == own)
                for i in range(0, len(at), 5000):
                    j = at[i : i + 5000]
                    sums[:, own] += Lattice([words[x] for x in j], vocab).expected(prob[:, own : own + 1], n[j], len(prob))
        piece, own = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(own), pa.array(sums[piece, own])], ["piece", "lang", "n"])

    return run


def train(docs: DataFrame, vocab_path: str, rows_per_language: int = 3000, rounds: int = 2) -> LanguageModel:
    """Piece probabilities from the text and lang of documents whose crc32(doc_id) mod 5 is not 0.

    Learns every value of lang, each from at most ``rows_per_language`` rows taken by a hash of doc_id.
    Expectation maximisation starts from equal probabilities; expected counts are summed on the
    executors and the driver gets one number per piece and language. For the fit alone, runs of over
    ``PART`` letters are cut into parts.

    Rows with a null text, lang or doc_id are not learned from; repeated rows count each; other columns
    are ignored; from a table without labels comes a model of no language, which finds every text ``und``.
    """
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (~held_out(docs["doc_id"]))).select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"]).alias("at"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    names = sorted(counts)
    vocab = vocabulary(vocab_path)
    prob = np.full((len(vocab) + 1, max(1, len(names))), 1.0 / len(vocab))
    prob[0] = UNKNOWN
    if not names:
        return LanguageModel([], vocab_path, prob)
    # about the rows wanted by a threshold on the hash, then no more than that by rank: the window sees a bounded part
    share = F.coalesce(*(F.when(F.col("lang") == n, F.lit(min(1.0, 1.2 * rows_per_language / counts[n]))) for n in names))
    few = labelled.where(F.pmod("at", F.lit(1 << 30)) < share * (1 << 30))
    from pyspark.sql import Window

    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("rank") <= rows_per_language)
    words = stored(few.select("lang", "text").mapInArrow(lean("", _words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    for _ in range(rounds):
        sums = np.full(prob.shape, 0.05)
        for r in words.mapInArrow(lean("", _expected(vocab_path, names, prob)), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():  # at most pieces times languages
            sums[r["piece"], r["lang"]] += r["n"]
        sums[0] = 0.0
        prob = sums / sums.sum(axis=0)
        prob[0] = UNKNOWN
    return LanguageModel(names, vocab_path, prob)


def held_out(doc_id) -> object:
    """Whether a row is for measuring only. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _predicted(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            got = list(scorer.predict(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    ``und`` with score 0 where the text is null or has no letter (Unicode category L). All
    segmentations of every run of letters are summed, whatever its length. Only the text is read. A null
    doc_id stays null and counts as held out; repeated rows each give a row; an empty table gives
    none; other columns are ignored. Ties go to the language first in the alphabet.
    """
    got = identified_text(docs).mapInArrow(lean("language", _predicted(model)), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _judged(model: LanguageModel, least: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            got = scorer.predict(b.column(text_at))
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without those whose language is ``und`` or scores under ``least``.

    Null, empty and letterless texts are ``und``; repeated rows are judged alike and each stays or goes; a null
    doc_id matters to nothing; an empty table gives no rows.
    """
    return docs.mapInArrow(lean("language", _judged(model, least, docs.columns.index("text"))), docs.schema)
