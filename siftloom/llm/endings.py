"""End-of-text n-gram likelihood: does a text stop where texts of this kind stop?

Every token of every text is a context for what follows it: a boundary (sentence mark or line
end) or more text. Rare words and rare Chinese characters are masked, digits folded, so that
"depends on the <rare> compiler" counts as one context. The likelihood of an ending is the share
of boundaries after its context: the clause so far (its first two and last two tokens and how many
rare words it has) if that is known, else the longest known run of last tokens. What follows the
last token of a text does not count, since that text may itself be cut.

Texts are tokenised by whole Arrow batches; words and contexts are hashes. Over a table nothing is
left out: words are counted in all texts, and the contexts that some ending asks for are counted in
all texts, too. Contexts that nobody asks for are never counted, so no model has to hold them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.textbatch import TextBatch, chunks, mix64, prefix_hash, span_hash, tables
from siftloom.session import work_table

#: Share of texts that must hold a word or character pair for it to be common, and the least number of them.
COMMON_WORD, COMMON_PAIR, LEAST_TEXTS = 0.004, 0.01, 3
#: Lengths of contexts; times a context must have been seen, as a number and as a share of all texts (as 4 in 4,000).
CONTEXTS, MIN_SEEN, SEEN_PART = (1, 2, 3, 4, 6, 8, 11), 4, 0.001
#: Share of boundaries from which an entry may end, by size of the context (4: also longer ones); contexts seen less often are rare, as a number and as a share of all texts (as 60 in 4,000).
LEAST_SHARE, RARE, RARE_PART = {1: 0.15, 2: 0.05, 3: 0.03, 4: 0.01}, 60, 0.015
#: Sizes of the contexts of an ending, in the order in which they are looked up; 99 stands for the clause.
SIZES = (99, *reversed(CONTEXTS))
#: Bits of the filter for contexts that are asked for: smallest and largest as powers of two (32 MB), bits for each context.
LEAST_BITS, MOST_BITS, BITS_PER_CONTEXT = 16, 28, 16
#: Rows of one batch at most, as a power of two; distinct keys that a task holds before it passes them on.
ROW_BITS, HELD = 20, 1_000_000

SENTENCE_END = "。！？!?.｡"
_SPACE, _WORD, _NUMBER, _CJK, _LINE, _MARK, _BOUNDARY, _CLAUSE, _COLON, _RARE = range(10)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x32400):
        ch = chr(c)
        out[c] = _CJK if 0x3400 <= c <= 0x9FFF else _SPACE if ch.isspace() else _NUMBER if ch.isdecimal() else _WORD if ch.isalnum() else _MARK
    for k, marks in ((_BOUNDARY, "。！？!?."), (_CLAUSE, "，,；;"), (_COLON, "：:"), (_LINE, "\n")):
        out[[ord(c) for c in marks]] = k
    return out


def _raw(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, value, text) of every token: a word's hash of 44 bits, another symbol's code point; numbers and line ends have none."""
    cps, n = batch.cps, len(batch.cps)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind, same = _classes()[cps], np.ones(n, bool)
    same[batch.off[:-1][np.diff(batch.off) > 0]] = False
    dot = np.flatnonzero((cps[1:-1] == 46) | (cps[1:-1] == 44)) + 1
    dot = dot[(kind[dot - 1] == _NUMBER) & (kind[dot + 1] == _NUMBER) & same[dot] & same[dot + 1]]
    kind[dot] = _NUMBER
    begins = (kind == _CJK) | (kind >= _MARK)
    new = ~same
    new[1:] |= kind[1:] != kind[:-1]
    begins |= new & (kind != _SPACE)
    at = np.flatnonzero(begins)
    kinds = kind[at]
    value = np.where((kinds == _NUMBER) | (kinds == _LINE), 0, cps[at]).astype(np.uint64)
    letter = np.flatnonzero(kind == _WORD)
    if len(letter):
        start = np.flatnonzero(new[letter])
        value[kinds == _WORD] = span_hash(prefix_hash(tables()[0][cps[letter]]), start, np.append(start[1:], len(letter))) >> np.uint64(20)
    return kinds, value, batch.owner()[at]


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of their counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts of keys over many batches; what add returns is passed on, so that a task holds few."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self.parts = [self._whole()]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                return self.take()
        return None

    def _whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _runs(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.size = self._whole(), [], 0
        return out


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for at, to in chunks(texts):
        for a in range(at, to, 1 << ROW_BITS):
            yield texts.slice(a, min(to, a + (1 << ROW_BITS)) - a)


def words_of(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of texts that hold it) of all words, as even keys, and of all pairs of Chinese characters, as odd ones."""
    kind, value, own = _raw(batch)
    word = kind == _WORD
    cjk = _classes()[batch.cps] == _CJK
    pair, who = np.flatnonzero(cjk[1:] & cjk[:-1]), batch.owner()
    pair = pair[who[pair] == who[pair + 1]]
    out = []
    row = np.uint64(ROW_BITS)
    for odd, keys, texts in ((0, value[word], own[word]), (1, batch.cps[pair].astype(np.uint64) << np.uint64(21) | batch.cps[pair + 1], who[pair])):
        seen, _ = _runs(keys << row | texts.astype(np.uint64))
        key, n = _runs(seen >> row)
        out.append((key << np.uint64(1) | np.uint64(odd), n))
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def least_texts(n: int) -> tuple[float, float]:
    """How many of n texts must hold a common word, and a common pair."""
    return max(LEAST_TEXTS, COMMON_WORD * n), max(LEAST_TEXTS, COMMON_PAIR * n)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Endings:
    """Tokens and contexts of texts, given the common words and pairs (keys of words_of). At most as many as 250 times the words of a mean text."""

    def __init__(self, common: np.ndarray):
        common = np.sort(common.astype(np.uint64))
        self.words, self.pairs = (common[(common & np.uint64(1)) == odd] >> np.uint64(1) for odd in (0, 1))

    def _tokens(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, code, first token of its text) of every token; neighbouring rare ones are one."""
        kind, value, own = _raw(batch)
        word = np.flatnonzero(kind == _WORD)
        kind[word[~_among(value[word], self.words)]] = _RARE
        cjk = kind == _CJK
        keep = ~cjk
        at = np.flatnonzero(cjk[1:] & cjk[:-1] & (own[1:] == own[:-1]))
        at = at[_among(value[at] << np.uint64(21) | value[at + 1], self.pairs)]
        keep[at] = keep[at + 1] = True
        kind[~keep] = _RARE
        stays = np.ones(len(kind), bool)
        stays[1:] = (kind[1:] != _RARE) | (kind[:-1] != _RARE) | (own[1:] != own[:-1])
        kind, value, own = kind[stays], value[stays], own[stays]
        code = mix64(np.where(kind == _RARE, 0, value).astype(np.uint64) | kind.astype(np.uint64) << np.uint64(56))
        first = np.zeros(len(kind), np.int64)
        first[1:] = np.where(own[1:] != own[:-1], np.arange(1, len(kind)), 0)
        return kind, code, np.maximum.accumulate(first) if len(first) else first

    @staticmethod
    def _contexts(kind: np.ndarray, code: np.ndarray, first: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in SIZES, tokens, hash of the context that ends with the token); the two lowest bits are free. With a filter only what may be wanted."""
        live, poly, done = at, np.zeros(len(at), np.uint64), 0
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(max(CONTEXTS) + 1, _ODD, np.uint64))
            for k in CONTEXTS:
                room = live - first[live] >= k - 1
                live, poly = live[room], poly[room]
                for j in range(done, k):
                    poly = poly + code[live - j] * power[j]
                done = k
                h = mix64(poly, k) & ~np.uint64(3)
                if wanted is not None:  # a context is only asked for together with the shorter ones
                    hit = may_hold(wanted, h)
                    live, poly, h = live[hit], poly[hit], h[hit]
                yield SIZES.index(k), live, h
            stop = (kind == _LINE) | (kind >= _BOUNDARY) & (kind <= _COLON)
            start = np.maximum(np.maximum.accumulate(np.where(stop, np.arange(1, len(kind) + 1), 0)), first) if len(kind) else first
            at = at[at - start[at] >= 2]
            s, rare = start[at], np.concatenate(([0], np.cumsum(kind == _RARE)))
            many = np.minimum(rare[at + 1] - rare[s], 4).astype(np.uint64)
            h = mix64(code[s] * power[0] + code[s + 1] * power[1] + code[at - 1] * power[2] + code[at] * power[3] + many * power[4], 99) & ~np.uint64(3)
            if wanted is not None:
                hit = may_hold(wanted, h)
                at, h = at[hit], h[hit]
            yield 0, at, h

    def asked(self, texts: list[str]) -> np.ndarray:
        """For each text the contexts at its end, by SIZES; 0 where there is none."""
        out = [np.zeros((0, len(SIZES)), np.uint64)]
        for part in pieces(pa.array(texts, pa.large_string())):
            batch = TextBatch.of(part)
            kind, code, first = self._tokens(batch)
            hashes = np.zeros((len(part), len(SIZES)), np.uint64)
            solid = np.flatnonzero(kind != _LINE)
            heads, row = np.unique(first, return_inverse=True)
            last = np.full(len(heads), -1, np.int64)
            last[row[solid]] = solid  # the last assignment stays
            # texts without any token have no head
            has = np.flatnonzero(np.bincount(_raw(batch)[2], minlength=len(part)) > 0)
            text_of = dict(zip(heads.tolist(), has.tolist(), strict=True))
            for col, at, h in self._contexts(kind, code, first, last[last >= 0]):
                hashes[[text_of[x] for x in first[at].tolist()], col] = h
            out.append(hashes)
        return np.concatenate(out)

    def seen(self, batch: TextBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(context with 1 before a boundary and 2 before a clause mark in its lowest bits, times)."""
        kind, code, first = self._tokens(batch)
        at = np.flatnonzero((kind[:-1] != _BOUNDARY) & (kind[:-1] != _LINE) & (first[1:] == first[:-1]))
        after = kind[1:]
        flag = np.where((after == _BOUNDARY) | (after == _LINE), 1, np.where(after == _CLAUSE, 2, 0)).astype(np.uint64)
        found = [h | flag[places] for _, places, h in self._contexts(kind, code, first, at, wanted)]
        return _runs(np.concatenate(found))


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(2)) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_end(n: np.ndarray, ends: np.ndarray, marks: np.ndarray, texts: int) -> np.ndarray:
    """Whether an entry without a closing mark may end, from the counts of its contexts by SIZES (one row each).

    The first context that is known decides. Complete entries far outnumber cut ones, and a cut falls on any token
    alike, so already a small share of boundaries after a context speaks for an end; the shorter the context, the
    larger the share that is asked for. A clause so far always followed by a clause mark may end too, unless it is so
    frequent that it never ends.
    """
    known = n >= max(MIN_SEEN, SEEN_PART * texts)
    which, rows = known.argmax(1), np.arange(len(n))
    size = np.array(SIZES)[which]
    n, ends, marks = n[rows, which], ends[rows, which], marks[rows, which]
    least = np.array([LEAST_SHARE[min(s, 4)] for s in SIZES])[which]
    return known.any(1) & ((ends >= least * n) | (size >= 6) & (n < max(RARE, RARE_PART * texts)) & (ends + marks >= 0.85 * n))


class EndModel(Endings):
    """Fitted on a list of texts, with all their contexts; for a table see ask and answered."""

    def __init__(self, texts: list[str]):
        parts = [TextBatch.of(p) for p in pieces(pa.array(texts, pa.large_string()))]
        self.texts, tally = len(texts), Tally()
        tally.parts = [words_of(b) for b in parts]
        key, n = tally.take()
        word, pair = least_texts(self.texts)
        super().__init__(key[n >= np.where(key & np.uint64(1), pair, word)])
        tally.parts = [self.seen(b) for b in parts]
        self.keys, self.times = tally.take()

    def counts(self, asked: np.ndarray) -> list[np.ndarray]:
        """Times seen, before a boundary, before a clause mark."""
        by = []
        for flag in range(3):
            key = asked | np.uint64(flag)
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            by.append(np.where((asked > 0) & (self.keys[at] == key), self.times[at], 0) if len(self.keys) else np.zeros(asked.shape, np.int64))
        return [by[0] + by[1] + by[2], by[1], by[2]]

    def may_ends(self, asked: np.ndarray) -> np.ndarray:
        return may_end(*self.counts(asked), self.texts)

    def may_end(self, text: str) -> bool:
        return bool(self.may_ends(self.asked([text]))[0])


def _bitmap(contexts: DataFrame) -> np.ndarray:
    """The filter of a column h of contexts; its words are set by the executors."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_CONTEXT * contexts.count()).bit_length()))
    place = contexts.select(F.expr(f"shiftrightunsigned(h, 2) & {(1 << bits) - 1}").alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def answered(parts: list[tuple[DataFrame, str]], asked: DataFrame, endings: Endings, texts: int) -> DataFrame:
    """(asked, may_end) for the distinct arrays in asked, from all texts of the (table, column) parts.

    Only contexts that some ending asks for are passed on by the tasks; a join then drops the few that the filter lets through.
    """
    asked = work_table(asked.select("asked").distinct(), "asked")
    each = asked.select("asked", F.posexplode("asked").alias("pos", "h")).where("h <> 0")
    contexts = each.select("h").distinct()
    sc = asked.sparkSession.sparkContext
    wanted, model = sc.broadcast(_bitmap(contexts)), sc.broadcast(endings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        rows = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int64))], ["k", "n"])
        for b in batches:
            for part in pieces(b.column(0)):
                if full := tally.add(*model.value.seen(TextBatch.of(part), wanted.value)):
                    yield rows(full)
        yield rows(tally.take())

    every = [df.select(F.col(c).alias("text")).where("text is not null").mapInArrow(run, "k bigint, n bigint") for df, c in parts]
    counted = functools.reduce(DataFrame.unionAll, every).groupBy("k").agg(F.sum("n").alias("n"))
    by = counted.groupBy(F.expr("k & ~3L").alias("h")).agg(F.sum("n").alias("n"), F.expr("sum(if(k & 3 = 1, n, 0))").alias("ends"), F.expr("sum(if(k & 3 = 2, n, 0))").alias("marks"))
    known = each.join(by.where(F.col("n") >= max(MIN_SEEN, SEEN_PART * texts)), "h").groupBy("asked").agg(F.min(F.struct("pos", "n", "ends", "marks")).alias("x"))
    levels = F.array(*[F.lit(LEAST_SHARE[min(s, 4)]) for s in SIZES])
    size, n = F.element_at(F.array(*map(F.lit, SIZES)), F.col("x.pos") + 1), F.col("x.n")
    may = (F.col("x.ends") >= F.element_at(levels, F.col("x.pos") + 1) * n) | (size >= 6) & (n < max(RARE, RARE_PART * texts)) & (F.col("x.ends") + F.col("x.marks") >= 0.85 * n)
    return asked.join(known.select("asked", may.alias("may_end")), "asked", "left").select("asked", F.coalesce("may_end", F.lit(False)).alias("may_end"))
