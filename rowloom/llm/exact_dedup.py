"""Exact deduplication by an extendible-hash index on shared files; DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, kept_once, spread_join, stored

#: The directory has at most 2**MAX_DEPTH entries; the default capacity of a bucket keeps it far below that.
MAX_DEPTH, FEWEST, MOST_BUCKETS = 16, 4096, 1 << 13
#: Ranks are made of n_points times this and the distance of doc_id from 2**63, which is less.
_STEP, _TOP = Decimal(10**20), Decimal(2**63)


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """The bucket of every ``max_depth``-bit key prefix, as (bucket, local depth).

    Starts with one bucket; an overfull bucket is split by its next bit, doubling the directory
    as needed, until it fits or the depth is reached. A bucket that still overflows holds few
    distinct keys: hot keys, whose rows are merged before they come to the owner (see ``Index``).
    """
    size = 1 << max_depth
    out: list[tuple[int, int]] = [(0, 0)] * size
    todo, next_id = [(0, 0)], 0
    prefix_sum = [0]
    for p in range(size):
        prefix_sum.append(prefix_sum[-1] + counts.get(p, 0))
    while todo:
        prefix, depth = todo.pop()
        lo, hi = prefix << (max_depth - depth), (prefix + 1) << (max_depth - depth)
        if depth < max_depth and prefix_sum[hi] - prefix_sum[lo] > capacity:
            todo += [(prefix << 1 | 1, depth + 1), (prefix << 1, depth + 1)]
        else:
            out[lo:hi] = [(next_id, depth)] * (hi - lo)
            next_id += 1
    return out


@dataclass
class Index:
    """``entries``: key, digest, doc_id, th, n_points, norm, a row per document. ``owners``: bucket, key, digest,
    group_size, best, a row per distinct normalised text. ``clashing``: whether two texts share a key and digest."""

    entries: DataFrame
    owners: DataFrame
    total: int
    clashing: bool


def _rank() -> Column:
    """Greatest for the row that stays: by code points, then by the distance of doc_id from 2**63; 0 of that for none."""
    left = F.coalesce(F.lit(_TOP) - F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(0))).cast("decimal(20,0)")
    return F.col("n_points").cast("decimal(10,0)") * F.lit(_STEP) + left


def index(docs: DataFrame, capacity: int | None = None, key_bits: int = 64, digest_bits: int = 256) -> Index:
    """Builds the index: entries by document, dealt to buckets, and a chain of distinct texts for every key.

    ``key`` is a 64-bit hash of the normalised text whose high bits choose the bucket through the
    directory. An owner task gets a range of buckets and keys, chains the entries of each key and
    tells their texts apart by comparing bytes (they are grouping keys). Rows of a hot key (over
    1 / HOT of all, so fewer than HOT keys) are merged where they are read before they go to an owner; all others go
    there straight. ``capacity`` is the rows of a bucket, by default the greater of 4096 and a
    2**13-th of all rows, so that the directory, which the driver builds and broadcasts, keeps a
    bounded size. Fewer ``key_bits`` and ``digest_bits`` make collisions, for tests.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    norm = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.char_length(text).alias("n_points"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"))
    key = F.xxhash64("norm").bitwiseAND(F.lit(-1 << (64 - key_bits)))
    digest = F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bits // 8)
    held = stored(norm.select("doc_id", "th", "n_points", key.alias("key"), digest.alias("digest"), "norm"), "entries")
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = {r["p"]: r["count"] for r in held.groupBy(prefix.alias("p")).count().collect()}  # at most 2**MAX_DEPTH rows
    total = sum(counts.values())
    full = directory(counts, capacity or max(FEWEST, -(-total // MOST_BUCKETS)))
    depth = max(d for _, d in full)  # the directory's own depth: it doubled so many times
    step = 1 << (MAX_DEPTH - depth)
    # 2**MAX_DEPTH rows at most: a fixed bound, hence the broadcast
    buckets = F.broadcast(spark.createDataFrame([(p, full[p * step][0]) for p in range(1 << depth)], "p long, bucket int"))
    entries = held.withColumn("p", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")).join(buckets, "p").drop("p")
    # fewer than HOT rows, each a key of over 1 / HOT of the rows
    hot = F.broadcast(stored(held.groupBy("key").count().where(F.col("count") * HOT > total).select("key"), "hot-keys"))
    group = ["bucket", "key", "digest", "norm"]
    ranked = entries.select(*group, _rank().alias("rank"))
    merged = [F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best")]
    owned = ranked.join(hot, "key", "left_anti").repartitionByRange("bucket", "key").groupBy(*group).agg(*merged)
    owners = stored(owned.unionByName(ranked.join(hot, "key", "left_semi").groupBy(*group).agg(*merged)).drop("norm"), "index")
    clashing = not owners.groupBy("key", "digest").count().where("count > 1").isEmpty()
    return Index(held, owners, total, clashing)


def _joined(found: Index) -> DataFrame:
    """Every entry with its text's group: keep_id, keep_points, group_size."""
    points = F.floor(F.col("best") / F.lit(_STEP))
    code = (F.col("best") % F.lit(_STEP)).cast("decimal(20,0)")
    keep = F.when(code > 0, (F.lit(_TOP) - code).cast("long"))
    on = ["key", "digest"]
    facts = ["group_size", keep.alias("keep_id"), points.cast("long").alias("keep_points")]
    owners, entries = found.owners.select(*on, *facts), found.entries
    if not found.clashing:
        return spread_join(entries.drop("norm"), owners, on, "group_size", found.total)
    # texts that share key and digest are chained: their rows find their link of the chain by the text's bytes
    chained = owners.groupBy(*on).count().where("count > 1").select(*on)
    plain = spread_join(entries.drop("norm").join(chained, on, "left_anti"), owners.join(chained, on, "left_anti"), on, "group_size", found.total)
    rows = stored(entries.join(chained, on, "left_semi"), "chained")
    links = rows.withColumn("rank", _rank()).groupBy(*on, "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"))
    linked = spread_join(rows, stored(links.select(*on, "norm", *facts), "links"), [*on, "norm"], "group_size", found.total)
    return plain.unionByName(linked.drop("norm"))


def exact_groups(docs: DataFrame, capacity: int | None = None, key_bits: int = 64, digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``. Of equal texts the row with most
    code points in its original text stays, then the smallest doc_id. A null text counts as empty,
    so null, empty and blank texts form one group. Null doc_ids come after all others: such a row
    is kept only if its group has no better one, and keep_id is then null. Repeats of one row (same
    doc_id) each count in group_size, and exactly the rows whose doc_id is keep_id and whose text has
    the most code points are marked kept. An empty table gives no rows; other columns are ignored.
    """
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept")
    out = _joined(index(docs, capacity, key_bits, digest_bits))
    return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns: the one that ``exact_groups`` marks kept.

    Rows are told apart by doc_id and text: where several rows are marked, which share a doc_id, the one whose
    original text has the smallest ``xxhash64`` stays, and of rows that repeat both doc_id and text, one. Null texts
    count as empty; a row without a doc_id stays only if its group has no better one; an empty
    table gives no rows.
    """
    marked = _joined(index(docs, capacity)).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
    rows = marked.groupBy("key", "digest", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("key", "digest", F.col("doc_id").alias("id")).agg(F.min("th").alias("th"), F.min_by("n", "th").alias("n"))
    return kept_once(docs, stored(best.select("id", "th", "n"), "keep"))
