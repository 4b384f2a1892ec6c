"""Exact and near deduplication: the first by position is kept.

Near duplicates follow the greedy rule: a record is dropped if its set of 3-grams has a Jaccard
similarity of at least the threshold with an earlier record that is itself kept. The similar pairs
come from an exact set-similarity join (prefixes, rarest piece first; lengths, places and a bitmap of
the whole set settle a meeting within the join, so only what is nearly similar leaves it); the greedy
rule is resolved over the records that have any neighbour at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from siftloom.functions import text as t
from siftloom.functions.idfilter import maybe_in
from siftloom.functions.textbatch import TextBatch, chunks, mix64
from siftloom.session import cut, ship_package, work_table

SIMILARITY, GRAM = 0.85, 3
#: Hash buckets of the document frequencies, a power of two: bounds what is sent to the executors (4 bytes each). They are added up by blocks.
BUCKETS, BLOCK = 1 << 22, 1 << 16
#: Bits of a code point, and what stands for the letters that a text shorter than a piece lacks: no code point.
POINT_BITS, NO_POINT = 21, 0x1FFFFF
#: Open pairs that the driver settles by itself.
FEW_PAIRS = 1 << 17


def exact_status(df: DataFrame, pos: str, column: str) -> DataFrame:
    """Adds first_pos: the position of the first record with the same key (E1); null counts as empty.

    Only (key, smallest position) is aggregated, on the map side first, and joined back, so a key that holds a
    third of all rows costs no more than its rows.
    """
    keyed = df.withColumn("_key", F.unhex(t.dedup_key(column)))
    firsts = keyed.groupBy("_key").agg(F.min(pos).alias("first_pos"))
    return keyed.join(firsts, "_key").drop("_key")


def exact_dedup(df: DataFrame, pos: str, column: str) -> DataFrame:
    return exact_status(df, pos, column).where(F.col(pos) == F.col("first_pos")).drop("first_pos")


def plain(column: str) -> Column:
    """The text that pieces are taken from: without white space, lower case."""
    return F.lower(t.compact(column))


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of three characters of each text, as numbers (E3): owner, piece (ordered by both), pieces of each text.

    Three code points fill 63 bits, so no two pieces have the same number. A shorter text is its own only piece.
    """
    batch = TextBatch.of(texts)
    n, size = len(batch), np.diff(batch.off)
    points = np.concatenate((batch.cps, np.zeros(GRAM, np.uint32))).astype(np.int64)
    owner = np.concatenate((batch.owner(), np.full(GRAM, n)))
    at = np.flatnonzero(owner[: len(batch.cps)] == owner[GRAM - 1 : len(batch.cps) + GRAM - 1])
    short = np.flatnonzero(size < GRAM)
    g, own = np.zeros(len(at) + len(short), np.int64), np.concatenate((owner[at], short))
    for j in range(GRAM):
        lacking = np.where(size[short] > j, points[np.minimum(batch.off[short] + j, len(points) - 1)], NO_POINT)
        g = g << POINT_BITS | np.concatenate((points[at + j], lacking))
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (own[1:] != own[:-1]))) if len(g) else np.zeros(0, bool)
    return own[new], g[new], np.bincount(own[new], minlength=n)


def buckets_of(g: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(g) >> np.uint64(7)).astype(np.int64) & (buckets - 1)


def bitmaps(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each set: each bit is the parity of the pieces that fall on it, so two sets differ in at least as many pieces as their bitmaps in bits."""
    bit = mix64(g) & np.uint64(127)
    one, first = np.uint64(1) << (bit & np.uint64(63)), bit < 64
    start = np.cumsum(n) - n
    low, high = (np.bitwise_xor.reduceat(np.where(own, one, np.uint64(0)), start) for own in (first, ~first))
    return low.view(np.int64), high.view(np.int64)


def piece_frequencies(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Texts with a piece of each hash bucket, counted by partition, then summed by blocks of buckets: a table of fixed size."""
    block = min(BLOCK, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int32)
        for b in batches:
            for at, to in chunks(b.column(0)):
                total += np.bincount(buckets_of(pieces(b.column(0).slice(at, to - at))[1], buckets), minlength=buckets).astype(np.int32)
        for k in range(buckets // block):
            part = total[k * block : (k + 1) * block]
            if len(some := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.astype(np.uint16).tobytes()]), pa.array([part[some].tobytes()])], ["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault(k, np.zeros(block, np.int32))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()])], ["block", "n"])

    out = np.zeros(buckets, np.int32)
    for r in texts.select("plain").mapInArrow(count, "block int, at binary, n binary").repartition("block").mapInArrow(add, "block int, n binary").collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.n, np.int32)
    return out


def prefixes(texts: DataFrame, threshold: float, buckets: int = BUCKETS) -> DataFrame:
    """(pos, n, i, g, low, high): the first n - ceil(t n) + 1 pieces of each set, rarest first, without those that no other text has.

    i is the piece's place, low and high are the set's bitmap. Order and cut happen within the row, by the broadcast table
    of frequencies, so only prefixes are shuffled.
    """
    known = texts.sparkSession.sparkContext.broadcast(piece_frequencies(texts, buckets))
    kind = texts.schema["pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in chunks(b.column(1)):
                own, g, n = pieces(b.column(1).slice(at, to - at))
                low, high = bitmaps(g, n)
                often = known.value[buckets_of(g, buckets)]
                order = np.lexsort((g, often, own))
                g, often = g[order], often[order]
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                kept = np.flatnonzero((place < n[own] - np.ceil(threshold * n[own] - 1e-9) + 1) & (often > 1))
                of = own[kept]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + of)), pa.array(n[of], pa.int32()), pa.array(place[kept], pa.int32()), pa.array(g[kept]), pa.array(low[of]), pa.array(high[of])], ["pos", "n", "i", "g", "low", "high"])

    return texts.select("pos", "plain").mapInArrow(run, f"pos {kind}, n int, i int, g bigint, low bigint, high bigint")


def meetings(heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that share a piece of their prefixes and that lengths, places and bitmaps cannot tell apart.

    Similar sets of x and y pieces differ in at most x + y - 2 ceil(t / (1 + t) (x + y)) of them. The pieces before the first
    common one differ, so do the pieces behind differing bits. All this is decided within the join: nothing else is stored.
    """
    x, y = heads.toDF("x", "nx", "ix", "g", "lx", "hx"), heads.toDF("y", "ny", "iy", "g", "ly", "hy")
    apart = F.expr(f"nx + ny - 2 * cast(ceil({threshold / (1 + threshold)!r}D * (nx + ny) - 1e-9D) as int)")
    once = F.expr("nx < ny or (nx = ny and x < y)")
    bits = F.expr("bit_count(lx ^ ly) + bit_count(hx ^ hy)")
    same = x.join(y, "g").where(once & (F.col("nx") >= threshold * F.col("ny") - 1e-9) & (F.col("ix") + F.col("iy") <= apart) & (bits <= apart))
    return same.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similarity(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, pa, pb) with the plain texts of both."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in chunks(b.column(2)):
                (oa, ga, na), (ob, gb, nb) = (pieces(b.column(c).slice(at, to - at)) for c in (2, 3))
                own, g = np.concatenate((oa, ob)), np.concatenate((ga, gb))
                order = np.lexsort((g, own))
                own, g = own[order], g[order]
                common = np.bincount(own[1:][(own[1:] == own[:-1]) & (g[1:] == g[:-1])], minlength=to - at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(common / (na + nb - common))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def similar_pairs(df: DataFrame, pos: str, column: str, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) with a < b of all pairs at or above the threshold (E4), exactly.

    Pieces are ordered by document frequency (of their bucket, then by number: any order that all sets share will do); two
    similar sets share a piece among the first |A| - ceil(t |A|) + 1 of each. Only plain texts are stored, pieces are made
    from them whenever they are asked for; only the texts of pairs that nearly surely are similar are shuffled.
    """
    ship_package(df.sparkSession)
    texts = work_table(df.select(F.col(pos).alias("pos"), plain(column).alias("plain")), "plain-texts")
    near = work_table(meetings(prefixes(texts, threshold), threshold), "near-pairs")
    some = maybe_in(texts, "pos", near.select(F.col("a").alias("pos")).unionAll(near.select(F.col("b").alias("pos"))))
    both = near.join(some.select(F.col("pos").alias("a"), F.col("plain").alias("pa")), "a").join(some.select(F.col("pos").alias("b"), F.col("plain").alias("pb")), "b")
    return similarity(both).where(F.col("similarity") >= threshold)


def settled(pairs: pa.Table) -> list:
    """The positions that the greedy rule drops, given all pairs (a, b) with a < b, from the earliest b on."""
    gone: set = set()
    for b, a in sorted(zip(pairs.column("b").to_pylist(), pairs.column("a").to_pylist(), strict=True)):
        if a not in gone:
            gone.add(b)
    return list(gone)


def greedy_removed(pairs: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """(pos): the records that the greedy rule drops, given all similar pairs (a, b) with a < b.

    Each round keeps the records without an open earlier neighbour, drops their neighbours and leaves the pairs of others
    open, until few are left; the earliest open record is settled in each, so there is an end.
    """
    kind = pairs.schema["a"].dataType
    left, removed = cut(pairs.select("a", "b")), []
    while left.limit(few + 1).count() > few:
        firsts = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = cut(left.join(firsts, "a", "left_semi").select(F.col("b").alias("pos")).distinct())
        left = cut(left.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"))
        removed.append(gone)
    rest = pa.table({"pos": pa.array(settled(left.toArrow()), to_arrow_type(kind))})
    return reduce(DataFrame.unionAll, removed, pairs.sparkSession.createDataFrame(rest, StructType([StructField("pos", kind)])))


def dedup_status(df: DataFrame, pos: str, column: str, threshold: float = SIMILARITY) -> DataFrame:
    """(pos, status): keep, exact_dup or near_dup for every record (E5)."""
    exact = exact_status(df, pos, column).select(F.col(pos).alias("pos"), "first_pos", F.col(column).alias("text"))
    firsts = exact.where("pos = first_pos").select("pos", "text")
    removed = greedy_removed(similar_pairs(firsts, "pos", "text", threshold)).withColumn("near", F.lit(True))
    return exact.join(removed, "pos", "left").select("pos", F.when(F.col("pos") != F.col("first_pos"), "exact_dup").when(F.col("near"), "near_dup").otherwise("keep").alias("status"))


def streaming_exact_dedup(stream: DataFrame, column: str, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Exact dedup of a stream by the same key; state is dropped behind the watermark."""
    return stream.withWatermark(event_time, lateness).withColumn("_key", t.dedup_key(column)).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


