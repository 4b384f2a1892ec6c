"""Problem 3: duplicates hidden by formatting differences.

The bytes of a batch are decoded to symbols and stream through a lookup table that folds (letter
case, full-width forms) and skips (white space, invisible characters, punctuation, markup) into
rolling polynomial hashes: a skipped symbol adds nothing and does not move the power on, so the hash
of a span is the difference of two running sums over the raw text and no canonical string, array of
kept symbols included, is ever built. Labelled fields (lines, one line, JSON) are hashed by field,
and the fields' hashes are summed, so that their order and notation do not matter.

Only (key, hashes) is aggregated. Every row of a group of equal hashes is then compared with the
group's first row by two pointers that skip in both texts what does not count; rows that differ
after all form groups of their own, round by round, so a hash collision loses nothing. Texts are
fetched for rows with equal hashes only.

Kept signs: a point or comma directly between digits stays if it is a point; operator signs stay
between operands (a token with a digit, a single letter, a bracket or a backslash); within a pair
of $ every sign stays. Null texts are no copies of anything; texts without any kept symbol
(empty, blank, only punctuation) are copies of one another. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.idfilter import maybe_in, without
from siftloom.functions.textbatch import DIGIT, MIX, SKIP, TextBatch, chunks, mix64, powers, tables
from siftloom.session import cut, work_table

#: Operator signs, and what else is a sign between a pair of $.
OPERATORS = "+-*/=^<>×÷±≤≥≠≈√∑"
SIGNS_IN_DOLLARS = OPERATORS + "\\{}_()[]|!%&,.:;'"
MINUS = {0x2212: "-", 0x2010: "-", 0x2011: "-", 0xFF0B: "+", 0xFF1D: "=", 0xFE63: "-"}
QUOTES = "\"'“”„‟‘’‚‛「」『』«»＂＇`"

#: A field's label: at most 48 characters without sentence marks, so that prose before a colon is no label.
_LABEL = r"[^\W\d_][^\n:：;；,，。.!?！？{}\"]{0,47}"
_FIELD_START = re.compile(rf"(?:^|[\n;；])[^\w\n;；]*({_LABEL}?)[^\w\n;；:：]*[:：]")
_JSON_START = re.compile(rf"(?:^|[,，،、{{])[^\w,，،、{{]*[{re.escape(QUOTES)}]\s*({_LABEL}?)\s*[{re.escape(QUOTES)}]\s*[:：]")


def _spaces(cps: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """White space and invisible characters."""
    return (cps <= 32) | (cps == 0x7F) | (cps == 0x85) | (cps == 0xA0) | (cps == 0xAD) | (cps == 0x1680) | ((cps >= 0x2000) & (cps <= 0x200F)) | ((cps >= 0x2028) & (cps <= 0x202F)) | ((cps >= 0x205F) & (cps <= 0x2064)) | (cps == 0x3000) | (cps == 0xFEFF)


def kept_symbols(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, mask of the symbols that count) of a batch."""
    fold, kinds = tables()
    cps = fold[batch.cps]
    for a, b in MINUS.items():
        cps = np.where(cps == a, np.uint32(ord(b)), cps)
    kind = kinds[cps]
    keep = kind != SKIP
    n = len(cps)
    if not n:
        return cps, keep
    own = batch.owner()
    left_same = np.concatenate(([False], own[1:] == own[:-1]))
    right_same = np.append(left_same[1:], False)
    digit = kind == DIGIT
    # a decimal point stands directly between two digits
    keep |= (cps == ord(".")) & np.concatenate(([False], digit[:-1])) & np.append(digit[1:], False) & left_same & right_same
    # between a pair of $, every sign counts
    dollar = cps == ord("$")
    if dollar.any():
        run = np.cumsum(dollar)
        before = run - np.concatenate(([0], run))[batch.off[own]]
        paired = (batch.sums(dollar) // 2 * 2)[own]
        inside = (before % 2 == 1) & (before <= paired) & ~dollar
        keep |= inside & np.isin(cps, np.array([ord(c) for c in SIGNS_IN_DOLLARS], np.uint32))
    sign = np.isin(cps, np.array([ord(c) for c in OPERATORS], np.uint32)) & ~keep
    at = np.flatnonzero(sign)
    if len(at):
        solid = np.flatnonzero(~_spaces(cps, kind))
        place = np.searchsorted(solid, at)
        prev = np.where(place > 0, solid[np.maximum(place - 1, 0)], -1)
        nxt = np.where(place + 1 < len(solid), solid[np.minimum(place + 1, len(solid) - 1)], -1)
        keep[at] = _operand(cps, kind, own, prev, at, -1) & _operand(cps, kind, own, nxt, at, 1)
    return cps, keep


def _operand(cps: np.ndarray, kind: np.ndarray, own: np.ndarray, place: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
    """Whether the symbol at place belongs to an operand: a bracket, or a token with a digit or of one letter."""
    ok = (place >= 0) & (own[np.maximum(place, 0)] == own[at])
    p = np.maximum(place, 0)
    bracket = np.isin(cps[p], np.array([ord(c) for c in (")]}" if way < 0 else "([{\\√∑")], np.uint32))
    latin = (kind[p] != SKIP) & (cps[p] < 0x0250)
    nb = np.clip(p + way, 0, len(cps) - 1)
    goes_on = (nb != p) & (own[nb] == own[p]) & (kind[nb] != SKIP) & (cps[nb] < 0x0250)
    digit_near = (kind[p] == DIGIT) | (goes_on & (kind[nb] == DIGIT))
    return ok & (bracket | (latin & (digit_near | ~goes_on)))


def field_spans(text: str) -> list[tuple[int, int]]:
    """Spans of a text's labelled fields (label with value), or the whole text if it has fewer than two distinct labels."""
    if text.count(":") + text.count("：") < 2:
        return [(0, len(text))]
    head = text.lstrip().lstrip("​*#>` ").lstrip()
    starts = [m.start(1) for m in (_JSON_START if head[:1] in "{｛" and head else _FIELD_START).finditer(text)]
    if len(starts) < 2 or any(c.isalnum() for c in text[: starts[0]]):
        return [(0, len(text))]
    return list(zip(starts, [*starts[1:], len(text)], strict=True))


def canonical_hash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text, equal for texts that differ only in formatting."""
    batch = TextBatch.of(texts)
    cps, keep = kept_symbols(batch)
    prefixes, down, run = skipping_hashes(cps, keep)
    lo, hi, who = [], [], []
    colon = (cps == ord(":")) | (cps == ord("："))
    multi = batch.sums(colon) >= 2
    strings = texts.to_pylist() if multi.any() else []
    plain = np.flatnonzero(~multi)
    lo.append(batch.off[:-1][plain])
    hi.append(batch.off[1:][plain])
    who.append(plain)
    for i in np.flatnonzero(multi):
        at = int(batch.off[i])
        spans = np.array(field_spans(strings[i]), np.int64) + at
        lo.append(spans[:, 0])
        hi.append(spans[:, 1])
        who.append(np.full(len(spans), i))
    a, b, w = np.concatenate(lo), np.concatenate(hi), np.concatenate(who)
    out = []
    for k, p in enumerate(prefixes):
        total = np.zeros(len(batch), np.uint64)
        with np.errstate(over="ignore"):
            span = mix64((p[b] - p[a]) * down[run[a]] + MIX * (run[b] - run[a]).astype(np.uint64), k + 1)
            np.add.at(total, w, span)
        out.append(total.view(np.int64))
    return out[0], out[1]


def skipping_hashes(cps: np.ndarray, keep: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(two running polynomial sums over all symbols, inverse powers, symbols kept before each place).

    A symbol's power is the number of symbols kept before it; skipped symbols add zero.
    """
    run = np.concatenate(([0], np.cumsum(keep)))
    up, down = powers(int(run[-1]) + 1)
    power = np.where(keep, up[run[:-1]], np.uint64(0))
    sums = []
    with np.errstate(over="ignore"):
        for s in (1, 2):
            sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(cps.astype(np.uint64) + np.uint64(s << 32)) * power, dtype=np.uint64))))
    return sums, down, run


def same_span(ca: list[int], ka: list[bool], x: tuple[int, int], cb: list[int], kb: list[bool], y: tuple[int, int]) -> bool:
    """Two pointers walk both spans and skip what does not count."""
    (i, a), (j, b) = x, y
    while True:
        while i < a and not ka[i]:
            i += 1
        while j < b and not kb[j]:
            j += 1
        if i >= a or j >= b:
            return i >= a and j >= b
        if ca[i] != cb[j]:
            return False
        i, j = i + 1, j + 1


def same_texts(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether each pair of texts differs only in formatting; fields are matched in any order."""
    ba, bb = TextBatch.of(a), TextBatch.of(b)
    (ca, ka), (cb, kb) = kept_symbols(ba), kept_symbols(bb)
    same = [False] * len(ba)
    colons = [t.sums((c == ord(":")) | (c == ord("："))) for t, c in ((ba, ca), (bb, cb))]
    for r in range(len(ba)):
        (a0, a1), (b0, b1) = ba.off[r : r + 2].tolist(), bb.off[r : r + 2].tolist()
        one, two = (ca[a0:a1].tolist(), ka[a0:a1].tolist()), (cb[b0:b1].tolist(), kb[b0:b1].tolist())
        if same_span(*one, (0, a1 - a0), *two, (0, b1 - b0)):
            same[r] = True
        elif min(colons[0][r], colons[1][r]) >= 2:
            left, fa = field_spans(b[r].as_py() or ""), field_spans(a[r].as_py() or "")
            same[r] = len(fa) == len(left)
            for x in fa if same[r] else ():
                hit = next((y for y in left if same_span(*one, x, *two, y)), None)
                if hit is None:
                    same[r] = False
                    break
                left.remove(hit)
    return np.array(same, bool)


def same_text(a: str, b: str) -> bool:
    return bool(same_texts(pa.array([a], pa.large_string()), pa.array([b], pa.large_string()))[0])


def hashed(df: DataFrame, key: str, column: str, bits: int = 64) -> DataFrame:
    """(id, h1, h2) of every non-null text, written once; bits: how much of the hashes is kept (fewer only to try collisions)."""
    kind = df.schema[key].dataType.simpleString()
    mask = np.int64((1 << bits) - 1) if bits < 64 else np.int64(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in chunks(b.column(1)):
                part = b.slice(at, to - at)
                h1, h2 = canonical_hash(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1 & mask), pa.array(h2 & mask)], ["id", "h1", "h2"])

    return work_table(df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), column).mapInArrow(run, f"id {kind}, h1 bigint, h2 bigint"), "hashes")


def verified_copies(df: DataFrame, key: str, column: str, bits: int = 64) -> DataFrame:
    """(first, id): each copy beside the first row of its group, id other than first."""
    kind = df.schema[key].dataType.simpleString()
    open_rows = hashed(df, key, column, bits)
    texts = df.select(F.col(key).alias("id"), F.col(column).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in chunks(whole.column(2)):
                b = whole.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(same_texts(b.column(2), b.column(3)))], ["first", "id", "h1", "h2", "same"])

    done = None
    while True:
        # map-side aggregation first; a hot hash then meets its few rows of groups in a join that adaptive execution splits
        groups = open_rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        copies = cut(maybe_in(open_rows, "h1", groups.select("h1")).join(groups, ["h1", "h2"]).where("id != first").select("first", "id", "h1", "h2"))
        firsts = copies.select(F.col("first").alias("id")).distinct()
        some = maybe_in(texts, "id", copies.select("id").unionAll(firsts))
        pairs = copies.join(some.withColumnRenamed("t", "text"), "id").join(some.select(F.col("id").alias("first"), F.col("t").alias("first_text")), "first")
        judged = cut(pairs.select("first", "id", "first_text", "text", "h1", "h2").mapInArrow(run, f"first {kind}, id {kind}, h1 bigint, h2 bigint, same boolean"))
        good = judged.where("same").select("first", "id")
        done = good if done is None else done.unionAll(good)
        open_rows = judged.where("not same").select("id", "h1", "h2")
        if open_rows.isEmpty():
            return done


def format_groups(df: DataFrame, key: str, column: str) -> DataFrame:
    """(first_key, copies, text) for each distinct text up to formatting; copies counts its rows.

    Only the rows that may be in a group of several are shuffled; all others pass straight through.
    """
    copies = verified_copies(df, key, column)
    counts = cut(copies.groupBy("first").agg((F.count(F.lit(1)) + 1).alias("copies")))
    texts = df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("text"))
    ids = cut(copies.select("id").unionAll(counts.select(F.col("first").alias("id"))))
    alone = without(texts, "id", ids).select(F.col("id").alias("first_key"), F.lit(1).cast("bigint").alias("copies"), "text")
    several = maybe_in(texts, "id", ids).join(counts.withColumnRenamed("first", "id"), "id").select(F.col("id").alias("first_key"), "copies", "text")
    return alone.unionAll(several)


def format_copies(df: DataFrame, key: str, column: str) -> DataFrame:
    """(first_key, key): each copy beside its group's first row, verified symbol by symbol."""
    return verified_copies(df, key, column).toDF("first_key", key)
