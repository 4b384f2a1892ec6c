"""Problem 2: near-duplicate records with small edits.

Exact copies (equal letters and digits, lower case) are first collapsed into classes by a
map-side aggregation. Class texts become TF-IDF weighted sets of 3-character pieces, with document
frequencies counted over all classes in hashed buckets (a table that grows with the classes, up to
a bound). Improved consistent weighted sampling draws HASHES samples of each set; BANDS bands of
ROWS samples are the keys under which candidates meet. A piece found everywhere still weighs half
as much as the rarest, so a pair that shares only frequent text keeps a weighted similarity near
its plain one and meets as well. Weighted Jaccard similarity is computed of every pair found; the
exact share of common pieces alone decides.

Two neighbours of one class are verified, too, where the class has at most DENSE neighbours; classes
with more are drawn again with their neighbours by other samples and under narrower bands, so a family of any
size costs its number of members and of similar pairs, never more.

Similar classes are expanded to their rows only for the pair form of the result. Rows without any
letter or digit are in no pair; null counts as empty; texts of one or two letters are similar only
to equal ones. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.idfilter import maybe_in, without
from siftloom.functions.textbatch import TextBatch, chunks, mix64
from siftloom.session import cut, work_table

#: Characters of a piece; plain similarity of a pair.
PIECE, SIMILARITY = 3, 0.7
#: Samples drawn; samples in a band; bands (the samples are dealt to them evenly, so bands overlap).
HASHES, ROWS, BANDS = 40, 5, 16
#: Neighbours from which a class counts as dense; the same of its second drawing.
DENSE, DENSE_HASHES, DENSE_ROWS, DENSE_BANDS = 32, 96, 4, 72
#: Bins of the sketch, one bit each; bits in which the sketches of a similar pair differ at most (19 are expected at the
#: least similarity, with a deviation of 4; 48 at a similarity of a quarter).
BINS, MOST_BITS_APART = 128, 36
#: Buckets of the document frequencies, as powers of two: at least, at most.
LEAST_BUCKETS, MOST_BUCKETS = 18, 22
#: Bits of a 64-bit sort key that name the text within its chunk; the others are the piece, the same in every chunk.
OWNER_BITS = 24
#: Random variates of one sample; steps a unit of the logarithm to which weights are rounded, and their number.
POOL, STEPS, LEVELS = 1 << 12, 24, 48


def normal(*columns: str) -> Column:
    """The columns joined, in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns])), r"[^\p{L}\p{Nd}]+", "")


def normal_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(id, text, h1, h2) of every row with any letter or digit, written once."""
    texts = df.select(F.col(key).alias("id"), normal(*columns).alias("text"))
    # filtered when read, since a filter before would normalise every text twice
    return work_table(texts.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "normal-rows").where("text != ''")


def copies(rows: DataFrame) -> DataFrame:
    """(id, rep, n) of every row of normal_rows whose text stands in several; rep is the smallest id, n their number.

    Texts are told apart by 128 bits of hashes, which alone are shuffled; hot texts are counted on the map side first.
    """
    several = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut(maybe_in(rows.select("id", "h1", "h2"), "h1", several.select("h1")).join(several, ["h1", "h2"]).select("id", "rep", "n"))


def classes_of(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(rep, text): one row for each distinct text."""
    return without(rows.select(F.col("id").alias("rep"), "text"), "rep", several.where("id != rep").select(F.col("id").alias("rep")))


def packed_pieces(batch: TextBatch) -> np.ndarray:
    """Sorted (text, piece hash) words of all pieces of every text, repeated ones as often as they stand there."""
    n = len(batch.cps) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = batch.owner()
    c = batch.cps.astype(np.uint64)
    odd = (np.random.default_rng(4).integers(0, 1 << 63, PIECE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = c[:n] * odd[0]
        for j in range(1, PIECE):
            h += c[j : j + n] * odd[j]
    ok = own[:n] == own[PIECE - 1 :]
    return np.sort((own[:n][ok].astype(np.uint64) << np.uint64(64 - OWNER_BITS)) | (h[ok] >> np.uint64(OWNER_BITS)))


def piece_sets(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece hash, text, times) of the distinct pieces of every text, ordered by text."""
    packed = packed_pieces(batch)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return packed & np.uint64((1 << (64 - OWNER_BITS)) - 1), (packed >> np.uint64(64 - OWNER_BITS)).astype(np.int64), times


def sketches(pieces: np.ndarray, texts: np.ndarray, count: int) -> np.ndarray:
    """sketches[text]: BINS bits in 64-bit words, one bit of the least piece in each range of the piece hashes; 0 where a range is empty."""
    out = np.zeros(count * BINS // 64, np.uint64)
    if len(pieces):
        bits = BINS.bit_length() - 1
        place = (texts << bits) | (pieces >> np.uint64(64 - OWNER_BITS - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        at = place[first]
        bit = (mix64(pieces[first], 6) & np.uint64(1)) << (at & 63).astype(np.uint64)
        word = at >> 6
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[starts]] = np.bitwise_or.reduceat(bit, starts)
    return out.reshape(count, BINS // 64)


def bucket_of(pieces: np.ndarray, buckets: int) -> np.ndarray:
    return (pieces & np.uint64(buckets - 1)).astype(np.int64)


def buckets_for(texts: int) -> int:
    return 1 << min(MOST_BUCKETS, max(LEAST_BUCKETS, int(texts).bit_length() + 1))


def document_frequencies(classes: DataFrame, buckets: int) -> np.ndarray:
    """Texts with a piece of each bucket, over all classes; counted by partition, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, to in chunks(b.column(0)):
                pieces, _, _ = piece_sets(TextBatch.of(b.column(0).slice(at, to - at)))
                total += np.bincount(bucket_of(pieces, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["bucket", "n"])

    rows = classes.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def idf_table(df: np.ndarray, texts: int) -> np.ndarray:
    """Weight of the pieces of each bucket: 1 if they stand in every text, 2 if in one only, by inverse document frequency."""
    return (1 + np.log((texts + 1) / (df + 1)).clip(0) / math.log(texts + 2)).astype(np.float32)


@functools.cache
def variates(hashes: int, k: int) -> np.ndarray:
    """For one sample: the scores of improved consistent weighted sampling by (level of the weight, slot of the piece).

    r and c are gamma variates, beta a uniform one; a score orders as ln a does, as an unsigned number, and depends on
    the weight only through its rounding y, so equal scores mean the same (piece, y).
    """
    rng = np.random.default_rng((hashes, k))
    r, ln_c, beta = rng.gamma(2.0, 1.0, POOL), np.log(rng.gamma(2.0, 1.0, POOL)), rng.random(POOL)
    ln_w = (np.arange(LEVELS) / STEPS)[:, None]
    ln_a = ln_c - r * (np.floor(ln_w / r + beta) - beta) - r
    return (ln_a + 200).astype(np.float32).view(np.uint32).ravel()


def samples(pieces: np.ndarray, texts: np.ndarray, weights: np.ndarray, count: int, hashes: int, block: int = 1 << 15) -> np.ndarray:
    """samples[k, text]: the sample that hash function k draws, another for every number of hashes; a text without pieces gets its own number."""
    out = np.repeat(mix64(np.arange(count, dtype=np.uint64), 99).astype(np.uint32)[None], hashes, axis=0)
    if not len(pieces):
        return out
    starts = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
    have = texts[starts]
    base = (np.clip(np.rint(np.log(weights) * STEPS), 0, LEVELS - 1) * POOL).astype(np.uint32)
    short = mix64(pieces).astype(np.uint32)
    odd = np.random.default_rng((77, hashes)).integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = np.uint32(32 - int(math.log2(POOL)))
    # blocks end with a text, so that each fits the cache and is reduced by itself
    edges = np.append(starts, len(pieces))
    cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(pieces), block)), len(starts)))
    pools = [variates(hashes, k) for k in range(hashes)]
    with np.errstate(over="ignore"):
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = edges[i], edges[j]
            s, w, own, who = short[lo:hi], base[lo:hi], starts[i:j] - lo, have[i:j]
            at = np.empty(hi - lo, np.uint32)
            for k in range(hashes):
                np.multiply(s, odd[k], out=at)
                np.right_shift(at, shift, out=at)
                np.add(at, w, out=at)
                out[k, who] = np.minimum.reduceat(pools[k].take(at, mode="clip"), own)
    return out


@functools.cache
def bands(hashes: int, rows: int, count: int) -> list[np.ndarray]:
    """The samples that make up each band."""
    rng = np.random.default_rng((5, rows))
    dealt = np.concatenate([rng.permutation(hashes)[: hashes // rows * rows] for _ in range(-(-count * rows // (hashes // rows * rows)))])
    return list(dealt[: count * rows].reshape(count, rows))


def band_keys(classes: DataFrame, idf: Broadcast, hashes: int = HASHES, rows: int = ROWS, count: int = BANDS) -> DataFrame:
    """(rep, k, s1, s2: sketch) for every class and band; the band is part of the key k."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for b in batches:
            for at, to in chunks(b.column(1)):
                ids, texts_in = b.column(0).slice(at, to - at), to - at
                pieces, texts, times = piece_sets(TextBatch.of(b.column(1).slice(at, texts_in)))
                some = np.flatnonzero(np.bincount(texts, minlength=texts_in))
                sketch = [pa.array(x) for x in sketches(pieces, texts, texts_in)[some].view(np.int64).T]
                drawn = samples(pieces, texts, (1 + np.log(times)) * weight[bucket_of(pieces, len(weight))], texts_in, hashes)
                own = ids.take(pa.array(some))
                for band, chosen in enumerate(bands(hashes, rows, count)):
                    key = np.full(len(some), band, np.uint64)
                    for x in chosen:
                        key = (key ^ drawn[x, some]) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                    yield pa.RecordBatch.from_arrays([own, pa.array(mix64(key).view(np.int64)), *sketch], ["rep", "k", "s1", "s2"])

    return classes.select("rep", "text").mapInArrow(run, f"rep {kind}, k bigint, s1 bigint, s2 bigint")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of classes that share a band key and whose sketches are near enough.

    The two sides of the self-join read one exchange; adaptive execution splits hot keys.
    """
    left = keys.select(F.col("rep").alias("a"), "k", F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    right = keys.select(F.col("rep").alias("b"), "k", F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    near = left.join(right, "k").where((F.col("a") < F.col("b")) & (apart <= MOST_BITS_APART))
    return near.select("a", "b").distinct()


def plain_similarity(a: TextBatch, b: TextBatch) -> np.ndarray:
    """Share of common pieces of each pair of normal texts."""
    x, y = (w[np.append(True, w[1:] != w[:-1])] if len(w) else w for w in (packed_pieces(a), packed_pieces(b)))
    both = np.sort(np.concatenate([x, y]))
    common = both[1:][both[1:] == both[:-1]]
    shift = np.uint64(64 - OWNER_BITS)
    count = lambda w: np.bincount((w >> shift).astype(np.int64), minlength=len(a))
    common = count(common)
    return common / np.maximum(count(x) + count(y) - common, 1)


def weighted_similarity(a: TextBatch, b: TextBatch, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of normal texts, by the weights that the samples are drawn with."""
    (pa_, ta, ca), (pb, tb, cb) = piece_sets(a), piece_sets(b)
    wa, wb = (1 + np.log(ca)) * idf[bucket_of(pa_, len(idf))], (1 + np.log(cb)) * idf[bucket_of(pb, len(idf))]
    shift = np.uint64(64 - OWNER_BITS)
    ka, kb = (ta.astype(np.uint64) << shift) | pa_, (tb.astype(np.uint64) << shift) | pb
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    same = np.flatnonzero(kb[at] == ka) if len(kb) else np.zeros(0, np.int64)
    least = np.bincount(ta[same], np.minimum(wa[same], wb[at[same]]), len(a))
    return least / np.maximum(np.bincount(ta, wa, len(a)) + np.bincount(tb, wb, len(a)) - least, 1e-9)


def similar_classes(df: DataFrame, key: str, columns: list[str], similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes (rep, text), copies (id, rep, n), pairs (a, b, similarity, weighted) with a < b) of a table."""
    rows = normal_rows(df, key, *columns)
    several = copies(rows)
    classes = classes_of(rows, several)
    count = classes.count()
    idf = df.sparkSession.sparkContext.broadcast(idf_table(document_frequencies(classes, buckets_for(count)), count))
    drawn = cut(candidate_pairs(band_keys(classes, idf)))
    found = cut(verified(drawn, classes, idf, similarity))
    ends = found.select("a", "b").unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = cut(ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    few = ends.join(degree.where(F.col("n") <= DENSE).select("a"), "a", "left_semi")
    # bands may miss a pair whose two sides are both similar to a third class: such pairs are verified, too
    more = few.select(F.col("a").alias("mid"), F.col("b").alias("a")).join(few.select(F.col("a").alias("mid"), "b"), "mid").where("a < b").select("a", "b")
    # neighbours of a class with more are drawn again
    dense = cut(ends.join(degree.where(F.col("n") > DENSE).select("a"), "a", "left_semi").select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    many = dense.count()
    if many:
        again = maybe_in(classes, "rep", dense, many).join(dense, "rep")
        more = more.unionAll(candidate_pairs(band_keys(again, idf, DENSE_HASHES, DENSE_ROWS, DENSE_BANDS)))
    more = cut(more.distinct().join(drawn, ["a", "b"], "left_anti"))
    return classes, several, found.unionAll(verified(more, classes, idf, similarity))


def verified(pairs: DataFrame, classes: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """(a, b, similarity, weighted) of the candidates (a, b) that are similar; the weighted similarity decides nothing.

    Only texts that may be in a candidate are shuffled.
    """
    kind = classes.schema["rep"].dataType.simpleString()
    ids = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep")))
    some = maybe_in(classes.select("rep", "text"), "rep", ids)
    texts = pairs.join(some.toDF("a", "ta"), "a").join(some.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in chunks(whole.column(2)):
                b = whole.slice(at, to - at)
                plain = plain_similarity(TextBatch.of(b.column(2)), TextBatch.of(b.column(3)))
                ok = plain >= similarity - 1e-9
                b = b.filter(pa.array(ok))
                heavy = weighted_similarity(TextBatch.of(b.column(2)), TextBatch.of(b.column(3)), idf.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain[ok]), pa.array(heavy)], ["a", "b", "similarity", "weighted"])

    return texts.mapInArrow(run, f"a {kind}, b {kind}, similarity double, weighted double")


def members(classes: DataFrame, several: DataFrame) -> DataFrame:
    """(id, rep, n) of every row in a class."""
    alone = without(classes.select(F.col("rep").alias("id")), "id", several.select("id"))
    return several.unionAll(alone.select("id", F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("n")))


def similar_rows(df: DataFrame, key: str, columns: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows of equal or similar texts."""
    _, several, pairs = similar_classes(df, key, columns, similarity)
    equal = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    # the only row of a class bears its name
    near = pairs.join(several.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").join(several.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return near.unionAll(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
