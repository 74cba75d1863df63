"""Token counts and ids of whole texts, with caches for what has been encoded before."""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator
from sys import byteorder
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified_text, kept, lean, scratch_path, spread_join, stored, texts_of

#: Entries of a generation of a worker's cache of encoded words. Two are kept, so its memory is bounded.
WORDS_KEPT = 300_000
_ENDS = b".,!?;:#$%&*|"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    at = dict(zip(shown + hidden, shown + [256 + i for i in range(len(hidden))], strict=True))
    return [chr(at[b]) for b in range(256)]


_BYTE_CHARS = _byte_chars()


def _is_plain(text: str) -> bool:
    """Latin letters alone, lower-case and composed: normalising and splitting leave them as one piece."""
    return text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text)


class Generations(dict):
    """A cache of what ``make`` gives for a key. When full it becomes the old generation, from which what is used comes back."""

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def drops_blanks(path: str) -> bool:
    """Whether a tokenizer file is known to encode a text as its words in turn, white space dropped.

    That holds where white space is normalised to blanks, letters are lower-cased and only runs
    without white space are kept by the splitting rule. Of any other file nothing is assumed.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        shape = json.load(f)
    norms = (shape.get("normalizer") or {}).get("normalizers", [])
    splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in norms] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"]:
        return False
    kept = splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return bool(kept) and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " " and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]


class WordEncoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library.

    Where the tokenizer drops white space (``drops_blanks``) no token crosses it, so a text's ids are
    those of its words in turn, and the library encodes each distinct word once. Any other
    tokenizer encodes whole texts. Ids are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the model can be asked directly for plain words: letters that the tokenizer lower-cases, keeps together and spells in bytes
        self.plain = drops_blanks(path)
        self.words = Generations(self._word, WORDS_KEPT)
        self.ends = Generations(self._whole, 10_000)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)

    def _whole(self, word: bytes) -> bytes:
        return self._packed(self.library.encode(word.decode(), add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        """The ids of a word. One of plain letters and closing marks is encoded apart from its marks, by the model alone."""
        core = word.rstrip(_ENDS)
        if core.isalpha():  # ASCII letters
            spelled = core.lower().decode()
        else:
            low = core.decode().lower()
            if not _is_plain(low):
                return self._whole(word)
            spelled = "".join(map(_BYTE_CHARS.__getitem__, low.encode()))
        ids = self._packed([t.id for t in self.library.model.tokenize(spelled)])
        return ids if len(core) == len(word) else ids + self.ends[word[len(core) :]]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null gives none."""
        get = self.words.__getitem__
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            yield b"".join(map(get, raw.split())) if self.plain else self._whole(raw)


_encoders: dict[tuple[str, str], WordEncoder] = kept("tokens")


def encoder(path: str, kind: type = WordEncoder):
    """This Python worker's encoder for a tokenizer file."""
    key = (path, kind.__name__)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


class PieceCounter:
    """Ids by the ``sentencepiece`` library, text by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        import numpy as np

        for t in texts:
            yield np.array(self.library.encode(t or "", num_threads=1), dtype="<u4").tobytes()


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, PieceCounter if path.endswith(".model") else WordEncoder)
        for b in batches:
            n = [len(i) // 4 for i in e.ids(texts_of(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The SHA-256 of the normalised content (for a tokenizer that drops white space: its runs as one
    blank, ends trimmed) and of the tokenizer's file are looked up in the Parquet table at
    ``cache_path``. What is missing is encoded once per distinct content and appended there. The
    same call over grown documents encodes only what is new. Without a path a fresh cache in the
    shared folder serves this call alone. Writers that run at once may append one content twice;
    both rows hold the same count and one is read.

    A null text counts as empty (0 tokens), a null doc_id stays null, repeated rows each give a row,
    an empty table gives none, other columns are ignored. Texts are never cut.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    text = F.coalesce(docs["text"], F.lit(""))
    norm = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_blanks(tokenizer_path) else text
    rows = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(norm, 256)).alias("digest")), "digests")
    sizes = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows")), "digest-sizes")
    seen = _read_cache(spark, cache_path, version)
    contents = docs.select(F.unhex(F.sha2(norm, 256)).alias("digest"), norm.alias("norm"))
    missing = contents if seen is None else contents.join(seen.select("digest"), "digest", "left_anti")
    encoded = missing.dropDuplicates(["digest"]).select("digest", "norm").mapInArrow(lean("tokens", _count(tokenizer_path)), "digest binary, n_tokens long")
    encoded.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    known = stored(sizes.join(_read_cache(spark, cache_path, version).dropDuplicates(["digest"]), "digest"), "known")
    return spread_join(rows, known, ["digest"], "n_rows", rows.count()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("version string, digest binary, n_tokens long").parquet(path).where(F.col("version") == version).select("digest", "n_tokens")


def _pieces(path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            k, piece, start, length, crc = [], [], [], [], []
            for doc, ids in zip(b.column(0).to_pylist(), e.ids(texts_of(b.column(1))), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * longest)):
                    part = ids[at : at + 4 * longest]
                    k.append(doc)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only where longer than ``longest``.

    A null or empty text is ``end_id`` alone; a null doc_id stays null; repeated rows each give their pieces; an
    empty table gives none; other columns are ignored.
    """
    return identified_text(docs).mapInArrow(lean("tokens", _pieces(tokenizer_path, longest, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
