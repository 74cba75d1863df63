"""Substring dedup over words (the first occurrence stays) and over bytes (none stays)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import real_id, sized
from .repeats import Bytes, Words, covered, repeated_ranges


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept = [], [], []
        for text, ranges in zip(b.column(1), b.column(2), strict=True):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            n.append(len(words))
            cut = covered(len(words), ranges.as_py(), Words.window) if ranges.is_valid else None
            gone.append(int(cut.sum()) if cut is not None else 0)
            kept.append(b" ".join(words if cut is None else [w for w, c in zip(words, cut.tolist(), strict=True) if not c]).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["k", "n_words", "n_removed", "kept_text"])


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept_words(batches):
        sha = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha, pa.string())], ["k", "n_words", "n_removed", "kept_sha256"])


def drop_repeated_words(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (or kept_sha256 of it with ``digest``).

    A word goes if a window of 20 consecutive words of its document covers it whose word sequence
    also starts earlier: in a document of smaller doc_id, or before it in the same one. Windows are
    judged on the input. Kept words are joined by one blank. A null text has no words; a null doc_id
    comes before all others and stays null; repeated rows (same doc_id and text) are one document
    and each give its row; rows that share a doc_id but not a text are one document's occurrences
    by start, then by text hash; an empty table gives no rows; other columns are ignored.
    """
    keyed, ranges = repeated_ranges(docs, Words, True)
    out = keyed.join(ranges, ["k", "th"], "left").select("k", "text", "ranges")
    last = "kept_sha256" if digest else "kept_text"
    got = out.mapInArrow(_hashed_words if digest else _kept_words, f"k long, n_words long, n_removed long, {last} string")
    return sized(got.select(real_id().alias("doc_id"), "n_words", "n_removed", last), docs)


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, runs, seeds, kept, sha = [], [], [], [], [], []
        for text, ranges in zip(b.column(1), b.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            n.append(len(raw))
            seeds.append(int(ranges.is_valid))
            if ranges.is_valid:
                cut = covered(len(raw), ranges.as_py(), Bytes.window)
                gone.append(int(cut.sum()))
                runs.append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()))
                raw = np.frombuffer(raw, np.uint8)[~cut].tobytes()
            else:
                gone.append(0)
                runs.append(0)
            kept.append(raw)
            sha.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(seeds, pa.int64()), pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_seed", "kept"])


def _without_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept_bytes(batches):
        yield pa.RecordBatch.from_arrays(b.columns[:6], b.schema.names[:6])


def drop_repeated_bytes(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_seed and, without ``digest``, the kept bytes.

    A byte goes if a 400-byte string of its document covers it that also starts anywhere else, in
    any document or the same one; overlaps count and all occurrences go. Matches never cross
    documents and are judged on the input. Kept bytes may split a character, hence binary.

    The method is that of ``repeats``, by hash: it needs the equality of 400-byte strings, not the order that
    suffix arrays give. ``shares_seed`` is 1 where a seed, the 273 bytes from an anchor of the document on, stands
    elsewhere too: it tells of all repeats that are removed and of some that are too short for that, of none in a
    document under 400 bytes.

    A null text is empty; a null doc_id stays null; repeated rows (same doc_id and text) are one
    document and each give its row; an empty table gives no rows; other columns are ignored.
    """
    keyed, ranges = repeated_ranges(docs, Bytes, False)
    out = keyed.join(ranges, ["k", "th"], "left").select("k", "text", "ranges")
    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_seed long"
    got = out.mapInArrow(_without_bytes, schema) if digest else out.mapInArrow(_kept_bytes, schema + ", kept binary")
    return sized(got.select(real_id().alias("doc_id"), *got.columns[1:]), docs)
