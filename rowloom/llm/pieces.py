"""SentencePiece encoding and decoding by one forward pass over the prefixes of sorted distinct words."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified_text, lean
from .tokens import WORDS_KEPT, encoder

MARK = "▁"
#: What stands before the first piece of a word.
START = -(1 << 30)
#: Pairs of pieces that a worker remembers as apart or not.
PAIRS_KEPT = 600_000
#: Characters of text whose words are sorted together.
CHUNK = 8_000_000
_WORD = re.compile(" +[^ ]*")


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str, unigram: bool | None = None):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = lib.id_to_piece(list(range(n)))
        self.scores = lib.get_score(list(range(n)))
        plain = [not (lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i) or lib.is_byte(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.longest = max(map(len, self.ids))
        self.unigram = self._is_unigram(path) if unigram is None else unigram
        self.least = min(self.scores[i] for i in self.ids.values())

    @staticmethod
    def _is_unigram(path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        return proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte[b] for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown]


class Automaton:
    """All pieces in one automaton: where a character leads from a node (``goto``), the node of the
    longest shorter suffix (``shorter``), and (length, id) of the pieces that end at a node, longest first (``ends``)."""

    def __init__(self, ids: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for piece, i in ids.items():
            node = 0
            for c in piece:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append([])
                node = self.goto[node][c]
            self.ends[node].append((len(piece), i))
        self.shorter = [0] * len(self.goto)
        level = list(self.goto[0].values())
        while level:
            below = []
            for node in level:
                self.ends[node] += self.ends[self.shorter[node]]
                for c, child in self.goto[node].items():
                    self.shorter[child] = self._step(self.shorter[node], c)
                    below.append(child)
            level = below

    def _step(self, node: int, c: str) -> int:
        while True:
            to = self.goto[node].get(c)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.shorter[node]

    def walk(self, words: list[str]) -> list[int]:
        """The node after each character of each word, one word after the other."""
        goto, shorter = self.goto, self.shorter
        out: list[int] = []
        add = out.append
        for word in words:
            node = 0
            for c in word:
                while (to := goto[node].get(c)) is None and node:
                    node = shorter[node]
                node = to or 0
                add(node)
        return out


class Trie:
    """Encodes sorted words depth first: the state of each prefix is kept while words share it.

    Sorted words visit the trie of their characters in depth-first order, so a word starts from the
    states of the prefix it shares with the one before. In a unigram model the state of a prefix is
    its best score and last piece (Viterbi). In a BPE model it is the last piece of the prefix's own
    encoding: the one piece that ends there and stays apart from the last piece before it.
    """

    def __init__(self, model: Model):
        self.model = model
        self.apart: dict[int, bool] = {}
        self.visited = 0
        self.automaton = Automaton(model.ids)

    def merged(self, text: str) -> list[str]:
        """BPE by definition: join the neighbours of best score, the leftmost of equals, until none join.

        Pairs wait in a heap, so a text of n characters takes n log n steps; a pair that has changed
        since it was put there is passed over.
        """
        ids, scores = self.model.ids, self.model.scores
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                j = ids.get(both := parts[i] + parts[after[i]])
                if j is not None:
                    heappush(heap, (-scores[j], i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _text(self, i: int) -> str:
        return self.model.pieces[i] if i >= 0 else chr(~i)

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE over both pieces' characters gives just these two pieces; ``left`` 0 is the start of a word."""
        if len(self.apart) > PAIRS_KEPT:
            self.apart.clear()
        r = self._text(right)
        got = self.merged(r) == [r] if left == START else self.merged(self._text(left) + r) == [self._text(left), r]
        self.apart[left << 24 | right] = got
        return got

    def encode(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the sorted words, in which blanks are marks."""
        m = self.model
        unigram, apart = m.unigram, self.apart
        goto, shorter, ends = self.automaton.goto, self.automaton.shorter, self.automaton.ends
        # state of each prefix of the word before: start and id of its last piece (the complement of the
        # code point where no piece covers it), score, and the automaton's node
        states: list[tuple] = [(0, START, 0.0, 0)]
        before = ""
        for word in words:
            if not unigram and word.startswith(MARK * 2):  # runs of marks have pieces of equal score
                yield self._ids([m.ids.get(p, ~ord(p[0])) for p in self.merged(word)])
                continue
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            self.visited += len(word) - shared
            node = states[shared][3]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                while (to := goto[node].get(c)) is None and node:
                    node = shorter[node]
                node = to or 0
                start, last = end - 1, ~ord(c)
                score = states[start][2] + m.least - 10.0 if unigram else 0.0  # of an unknown character
                for length, i in ends[node]:
                    if unigram:
                        now = states[end - length][2] + m.scores[i]
                        if now > score:
                            start, last, score = end - length, i, now
                        continue
                    left = states[end - length][1]
                    fits = apart.get(left << 24 | i)
                    if self._stays_apart(left, i) if fits is None else fits:
                        start, last = end - length, i
                        break
                states.append((start, last, score, node))
            before = word
            ids, end = [], len(word)
            while end:
                end, i = states[end][:2]
                ids.append(i)
            yield self._ids(ids[::-1])

    def _ids(self, found: list[int]) -> list[int]:
        if min(found) >= 0:
            return found
        out: list[int] = []
        for i in found:
            out += [i] if i >= 0 else self.model.spelled(chr(~i))
        return out


class PieceEncoder:
    """A worker's encoder: ids of whole texts from the ids of their distinct marked words."""

    def __init__(self, path: str, unigram: bool | None = None):
        self.model = Model(path, unigram)
        self.trie = Trie(self.model)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > WORDS_KEPT:
            self.old, self.words = self.words, {}
        new = words - self.words.keys()
        known = new & self.old.keys()
        self.words.update((w, self.old[w]) for w in known)
        marked = sorted((w.replace(" ", MARK), w) for w in new - known)
        for (_, w), ids in zip(marked, self.trie.encode([m for m, _ in marked]), strict=True):
            self.words[w] = array("I", ids).tobytes() if byteorder == "little" else np.array(ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null and empty have none."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(_WORD.findall(" " + t.replace(MARK, " ")) if t else [])
            size += len(t or "")
            if size > CHUNK:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[str]]) -> Iterator[bytes]:
        self.learn(set().union(*held) if held else set())
        get = self.words.__getitem__
        for words in held:
            yield b"".join(map(get, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, marks as blanks, less the first blank."""
        m = self.model
        if not hasattr(self, "raw"):
            back = {i: bytes([b]) for b, i in m.byte.items()}
            self.raw = [back.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(m.pieces)]
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, PieceEncoder)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = list(e.ids(texts))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id and ids (array of int) of its whole text, as the model's own library gives them.

    A null or empty text has the empty array; a null doc_id stays null; repeated rows each give a row; an
    empty table gives none; other columns are ignored. Texts are never cut.
    """
    return identified_text(docs).mapInArrow(lean("tokens", _encoded(model_path)), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, PieceEncoder)
        for b in batches:
            texts = [e.decode(np.array(i or [], "<u4").tobytes()) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): pieces joined, runs of byte pieces read as UTF-8.

    Null and empty ids give the empty text, a null doc_id stays null, repeated rows each give a row, an empty
    table gives none, other columns are ignored.
    """
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean("tokens", _decoded(model_path)), "doc_id long, text string")


def _reported(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, PieceEncoder)
        for b in batches:
            n, crc, same = [], [], []
            texts = b.column(1).to_pylist()
            for t, ids in zip(texts, e.ids(texts), strict=True):
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(e.decode(ids) == (t or "").replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def encoding_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip.

    ``round_trip`` says whether decoding the ids gives the text again (a mark character in a text
    comes back as a blank, as in the library). A null or empty text has no pieces; a null doc_id
    stays null; repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    return identified_text(docs).mapInArrow(lean("tokens", _reported(model_path)), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
