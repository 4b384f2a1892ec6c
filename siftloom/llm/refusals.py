"""A fitted model of refusals: which texts decline to answer and give none.

Naive Bayes over character n-grams with two classes, refusals and other answers. It is fitted on all texts,
labelled by phrases that certainly decline (defect_rules.seed_refusal), from counts by bucket; what else such texts say (whom to ask instead, why not, an apology) becomes evidence too, so refusals in other words are
found. The evidence is summed over the whole text: a refusal of any length stays one, while an answer after an
apology or a "cannot" outweighs it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from siftloom.llm import defect_rules as rules
from siftloom.llm.endings import pieces
from siftloom.functions.textbatch import CJK, DIGIT, MIX, SKIP, TextBatch, mix64, tables

#: Hash buckets, lengths of n-grams, rows of the background that stand against one observation, largest evidence of one n-gram in nats.
BUCKETS, GRAMS, PRIOR, MOST = 1 << 17, (3, 6), 2.0, 2.0
#: Evidence from which a text is a refusal, in nats a letter (a Chinese character counts twice), and refusals that the texts must hold for a fit.
LEAST, FEWEST = 0.12, 8


@functools.cache
def _symbols() -> np.ndarray:
    """code point -> folded letter, 48 for a digit, 32 for all else."""
    fold, kinds = tables()
    kind = kinds[fold]
    return np.where(kind == SKIP, 32, np.where(kind == DIGIT, 48, fold)).astype(np.uint32)


def grams_of(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams over folded letters; digits are one symbol, all else one separator."""
    short = TextBatch(_symbols()[batch.cps], batch.off).squeezed(32)
    cps, size = short.cps.astype(np.uint64), np.diff(short.off)
    out, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h, done = cps, 1
    for n in GRAMS:
        if len(cps) < n:
            break
        while done < n:  # a hash of twice the length is joined from two
            step = done if 2 * done <= n else 1
            longer = h[: len(cps) - done - step + 1] * np.uint64(pow(int(MIX), step, 1 << 64))
            longer += (h if step == done else cps)[done : done + len(longer)]
            h, done = longer, done + step
        bucket = mix64(h[short.begins(n)], n)
        bucket &= np.uint64(BUCKETS - 1)
        out.append(bucket.view(np.int64))
        who.append(np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0)))
    return np.concatenate(out), np.concatenate(who)


def counts_of(texts: pa.Array, batch: TextBatch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By class (other texts, refusals): texts that hold an n-gram of each bucket, and the number of texts."""
    seed = rules.seed_refusals(texts)
    bucket, who = grams_of(batch or TextBatch.of(texts))
    pairs = np.sort((who * BUCKETS + bucket).astype(np.uint32 if len(seed) * BUCKETS <= 1 << 32 else np.uint64))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs  # a text counts once for each of its n-grams
    cell = (pairs & (BUCKETS - 1)) + BUCKETS * seed[pairs // BUCKETS].astype(np.int64)
    return np.bincount(cell, minlength=2 * BUCKETS).reshape(2, BUCKETS), np.bincount(seed.astype(int), minlength=2)


class RefusalModel:
    """evidence[bucket]: log odds of an n-gram in refusals against other texts, 0 where it tells nothing."""

    def __init__(self, texts: list[str]):
        grams, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for part in pieces(pa.array(texts, pa.large_string())):
            for total, more in zip((grams, n), counts_of(part), strict=True):
                total += more
        self.fit(grams, n)

    @classmethod
    def of_counts(cls, grams: np.ndarray, n: np.ndarray) -> "RefusalModel":
        out = cls.__new__(cls)
        out.fit(grams, n)
        return out

    def fit(self, grams: np.ndarray, n: np.ndarray) -> None:
        """From the sums of counts_of."""
        self.evidence = np.zeros(BUCKETS, np.float32)
        if n[1] < FEWEST or not n[0]:
            return
        no, yes = grams.astype(float)
        part = (yes.sum() + 1) / (yes.sum() + no.sum() + 2)
        share = (yes + PRIOR * part) / (yes + no + PRIOR)  # n-grams that are hardly seen stay at the background
        self.evidence = np.clip(np.log(share / part) - np.log((1 - share) / (1 - part)), -MOST, MOST).astype(np.float32)

    def refuse(self, texts: pa.Array, batch: TextBatch | None = None) -> np.ndarray:
        """Which texts are refusals: by all their n-grams, and by the distinct ones, too, so that no repetition makes one."""
        batch = batch or TextBatch.of(texts)
        kind = tables()[1][batch.cps]
        size = batch.sums((kind != SKIP) & (kind != DIGIT)) + batch.sums(kind == CJK)
        bucket, who = grams_of(batch)
        least = LEAST * np.maximum(size, 1) + 1
        out = np.bincount(who, self.evidence[bucket], len(batch)) >= least
        if out.any():
            some = out[who]
            pairs = np.unique(who[some] * BUCKETS + bucket[some])
            out &= np.bincount(pairs // BUCKETS, self.evidence[pairs % BUCKETS], len(batch)) >= least
        return out
