"""SimHash fingerprints, their links by BK-trees over shards, and the groups the links make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_once, lean, spread_join, stored

#: A shard of more fingerprints is split by further bits.
SHARD = 2_000
#: Rows of a small table's file.
ROWS_PER_FILE = 8192
#: Shingles of one text that are hashed at a time.
SLICE = 20_000


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of the XXH64 (seed 42) of a text's word shingles, repeats included; A-Z are lower-cased.

    A bit is 1 if set in over half of the hashes. Fewer words than a shingle make one shingle; none
    give zero. The words of a long text are hashed ``SLICE`` at a time.
    """
    import xxhash

    parts = text.encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < words:
        return digest(b" ".join(parts), 42)
    ones, total = np.zeros(64, dtype=np.int64), n - words + 1
    for first in range(0, total, SLICE):
        some = parts[first : first + SLICE + words - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(some) - words + 1]
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64) if len(bits) > 250 else bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], ["doc_id", "th", "fp"])

    return run


class BKTree:
    """Fingerprints under edges named by the integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = [fp, {}]
            return
        node = self.root
        while d := (node[0] ^ fp).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [fp, {}]
                return
            node = child

    def near(self, fp: int, radius: int) -> Iterator[int]:
        """The stored fingerprints within ``radius``; only edges that can lead to one are followed."""
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ fp).bit_count()
            if d <= radius:
                yield at
            if children:
                todo += [node for edge, node in children.items() if d - radius <= edge <= d + radius]


def _tree_links(fps: list[int], radius: int, top: dict[int, int]) -> None:
    """Joins in ``top`` (each fingerprint's way to its least) what one BK-tree finds within ``radius``."""
    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    tree = BKTree()
    for fp in fps:
        for other in tree.near(fp, radius):
            a, b = find(fp), find(other)
            if a != b:
                top[max(a, b)] = min(a, b)
        tree.add(fp)


def shard_links(fps: np.ndarray, radius: int, most: int = SHARD) -> list[tuple[int, int]]:
    """(fingerprint, least of its group) for what links within ``radius`` join in one shard: stars, not all pairs.

    A tree never holds more than ``most`` fingerprints: a shard of more is dealt, inside its task, by each of four
    blocks of the bits in which its fingerprints differ at all. Fingerprints that differ in at most
    three bits are equal in one of the blocks, so no link is lost.
    """
    fps = np.asarray(fps, np.uint64)
    top = {x: x for x in fps.tolist()}
    todo = [fps]
    while todo:
        own = todo.pop()
        varying = int(np.bitwise_or.reduce(own ^ own[0]))
        free = [i for i in range(64) if varying >> i & 1]
        if len(own) <= most or len(free) < 8:
            _tree_links(own.tolist(), radius, top)
            continue
        size = -(-len(free) // 4)
        for at in range(0, len(free), size):
            mask = np.uint64(sum(1 << i for i in free[at : at + size]))
            order = np.argsort(own & mask, kind="stable")
            held = own[order]
            cuts = np.flatnonzero(np.diff(held & mask)) + 1
            todo += [x for x in np.split(held, cuts) if len(x) > 1]
    out = []
    for x in top:
        least = x
        while top[least] != least:
            least = top[least]
        if least != x:
            out.append((x, least))
    return out


def _shards(radius: int):
    def links(held: np.ndarray) -> np.ndarray:
        return np.array(shard_links(held.view(np.uint64), radius), np.uint64).reshape(-1, 2).view(np.int64)

    def row(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the shard that the batch before left open
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if keys[at] != key:
                    if sum(map(len, held)) > 1:
                        out.append(links(np.concatenate(held)))
                    key, held = keys[at], []
                held.append(fps[at:end])
            yield from row(out)
        if sum(map(len, held)) > 1:
            yield from row([links(np.concatenate(held))])

    return run


def _bits(fp: Column, at: list[int]) -> Column:
    """The named bits of ``fp`` side by side, the first lowest."""
    out, i = F.lit(0).cast("long"), 0
    while i < len(at):
        n = 1
        while i + n < len(at) and at[i + n] == at[i] + n:
            n += 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << n) - 1)), i))
        i += n
    return out


def _blocks(path: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The bits in the blocks that a path chooses, and those that remain."""
    taken, rest = [], list(range(64))
    for p in path:
        size = -(-len(rest) // 4)
        own = rest[p * size : (p + 1) * size]
        taken += own
        rest = [x for x in rest if x not in set(own)]
    return taken, rest


def _paths(level: int) -> list[tuple[int, ...]]:
    return [()] if not level else [(*p, i) for p in _paths(level - 1) for i in range(4)]


def _keyed(fps: DataFrame, level: int) -> DataFrame:
    """(key, fp): fp under each choice of one block of four at each level. Any two fingerprints that
    differ in at most three bits share a key, since three bits leave one of four blocks untouched."""
    paths = _paths(level)
    keys = F.array(*(_bits(F.col("fp"), _blocks(p)[0]).bitwiseOR(F.lit(i << 55)) for i, p in enumerate(paths)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def fingerprint_links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints ``fp`` within ``radius`` (0 to 3) of each other.

    Shards are the values of two nested blocks (28 of 64 bits). One with more than ``shard``
    fingerprints is split by a third block (9 bits more) and, where that does not do, a fourth (7
    more); below that a shard has 20 free bits, so its size is bounded (2**20, 8 MB) whatever the
    corpus, and its task deals it to trees of at most ``SHARD`` fingerprints. The trees live in the task
    that owns the shard.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the blocks find fingerprints that differ in at most three bits")
    parts, keyed = [], _keyed(fps, 2)
    for level in (2, 3):
        hot = stored(keyed.groupBy("key").count().where(F.col("count") > shard).select("key"), "hot-shards")
        if hot.isEmpty():
            break
        parts.append(keyed.join(hot, "key", "left_anti"))
        # which path led to a hot key does not matter below it: all its fingerprints are dealt anew
        again = keyed.join(hot, "key", "left_semi").select("fp").distinct()
        keyed = _keyed(again, level + 1)
    parts.append(keyed)
    out = None
    for p in parts:
        got = p.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(lean("", _shards(radius)), "u long, v long")
        out = got if out is None else out.unionByName(got)
    return out


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as about ``ROWS_PER_FILE`` rows each ask for, or as it has: small tables go to few files."""
    return df.coalesce(rows // ROWS_PER_FILE + 1)


def components(links: DataFrame, rows: int = 1 << 40) -> DataFrame:
    """(node, root): for each node of the links (u, v) that isn't its component's smallest, that smallest.

    Large-star and small-star rounds until nothing changes; each round is written to the shared
    folder. A round aggregates each node's smallest neighbour before it is joined back, so a hub
    needs no task of its own. Rounds grow with the logarithm of the longest chain; without links there is none.
    ``rows`` is about how many links there are at most, if known.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        near = both.join(least, "u")
        if large:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()

    def summed(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(few_files(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows), "links")
    state = summed(edges)
    while state[0]:
        edges = stored(few_files(star(star(edges, True), False), state[0]), "stars")
        state, before = summed(edges), state
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classed(docs: DataFrame, radius: int, words: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows (doc_id, th, fp); per distinct fingerprint (fp, n, least, root) its number of rows, smallest doc_id and group; how many rows."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = stored(rows.mapInArrow(lean("", _fingerprints(words)), "doc_id long, th long, fp long"), "fingerprints")
    rows = prints.count()
    classes = stored(few_files(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), rows), "classes")
    roots = components(fingerprint_links(classes.select("fp"), radius), rows)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    return prints, rooted, rows


def simhash_groups(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Documents of equal fingerprints are one class; links join classes, so copies are never paired.
    A null, empty or blank text has the zero fingerprint, which is linked like any other. A null
    doc_id stays null and is never a component_id unless its component has no other; repeated rows
    each give a row; an empty table gives none; other columns are ignored.
    """
    prints, classes, rows = _classed(docs, radius, words)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "n", "component_id")
    out = spread_join(prints.select("doc_id", "fp"), stored(few_files(named, rows), "named"), ["fp"], "n", rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group, all columns: the one of smallest doc_id.

    Rows are told apart by doc_id and text: where rows share the smallest doc_id but not the text, the
    one whose text has the smallest ``xxhash64`` stays; of rows that repeat both, one. A row without a
    doc_id stays only if its group has no row with one. A null text counts as empty, and all texts without
    a word are one group; an empty table gives no rows.
    """
    prints, classes, total = _classed(docs, radius, words)
    # of each fingerprint its first row, ids before none, then of each group the first of those
    rows = prints.groupBy("fp", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    first = rows.groupBy("fp").agg(F.min_by(F.struct("doc_id", "th", "n"), order).alias("r")).select("fp", "r.*")
    best = first.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "n"), order).alias("r"))
    return kept_once(docs, stored(few_files(best.select(F.col("r.doc_id").alias("id"), F.col("r.th").alias("th"), F.col("r.n").alias("n")), total), "keep"))
