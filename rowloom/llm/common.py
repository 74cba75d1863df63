"""Helpers shared by the corpus operators: scratch tables, internal document keys and small expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts before every real id; stands for a null doc_id inside operators that order occurrences by id (a
#: document whose id is this number itself is taken for one without an id there).
NULL_ID = -(2**63)
#: A key that holds over 1 / HOT of all rows is hot. There are fewer than HOT such keys, whatever the table.
HOT = 1000
#: Stored bytes of text whose results share a file.
PARTITION_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only if driver and executors are one process;
    on a cluster executors would write to their own disks, so that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rowloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/rowloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame) -> DataFrame:
    """(k, th, text): the id without nulls, a hash of the text and the text itself (null as empty).

    Rows with equal (k, th) are repeats of one row, so facts found for one hold for all.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


#: What a Python worker keeps from task to task, by operator.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The worker's table of an operator, emptied when the worker comes to serve another one."""
    return _kept.setdefault(owner, {})


def lean(owner: str, run):
    """``run`` over Arrow batches in a worker that forgets what other operators kept and returns freed memory at the end."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, table in _kept.items():
            if other != owner:
                table.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(Exception):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return held


def texts_of(column: pa.Array, rows: int = 500) -> Iterator[str | None]:
    """The texts of a column, some rows at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def identified_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the id as it is and the text (null as empty)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def real_id(k: Column | str = "k") -> Column:
    """The doc_id that an internal key stands for."""
    c = F.col(k) if isinstance(k, str) else k
    return F.when(c != NULL_ID, c)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sized(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in one partition for every ``PARTITION_BYTES`` that Catalyst estimates ``source`` to have, or in as many as it has."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(size // PARTITION_BYTES + 1, 1_000_000))


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which have one row per key and in ``size`` the key's number of rows.

    The facts of hot keys, fewer than ``HOT`` rows by definition, are broadcast, so that their rows stay where they
    are; all other keys, each at most 1 / HOT of the rows, meet by a shuffle.
    """
    hot = F.col(size) * HOT > total
    few = F.broadcast(facts.where(hot))
    if facts.where(hot).isEmpty():
        return rows.join(facts, on)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(facts.where(~hot), on))


def kept_once(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep`` (id, th, n) names by doc_id and ``xxhash64`` of the text, all columns.

    ``n`` counts the rows with that id and hash. Of rows that repeat both id and text one stays.
    """
    keep = keep.select(F.col("id").alias("_rl_id"), F.col("th").alias("_rl_th"), F.col("n").alias("_rl_n"))
    text = F.coalesce(docs["text"], F.lit(""))
    held = docs.withColumn("_rl_text_hash", F.xxhash64(text))
    met = held.join(keep, held["doc_id"].cast("long").eqNullSafe(keep["_rl_id"]) & (held["_rl_text_hash"] == keep["_rl_th"]))
    if keep.where("_rl_n > 1").isEmpty():
        return met.select(*(docs[c] for c in docs.columns))
    again = met.where("_rl_n > 1").withColumn("_rl_text", F.coalesce(F.col("text"), F.lit(""))).dropDuplicates(["_rl_id", "_rl_text"])
    own = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return met.where("_rl_n = 1").select(*own).unionByName(again.select(*own))
