"""Character n-gram naive Bayes for the language of a text, fitted on all labelled texts, scored by whole batches."""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa

from siftloom.functions.textbatch import CJK, DIGIT, SKIP, TextBatch, mix64, tables

#: Hash buckets of n-grams, longest n-gram.
BUCKETS, LONGEST = 1 << 16, 3
#: Labelled rows that make a language, as a number and as a share of all, so that odd labels make none.
LEAST_ROWS, LEAST_PART = 5, 0.01


def normal_label(label: str | None) -> str | None:
    """"zh-CN" and "EN" count as zh and en; blank ones, and those that say there is none, as none."""
    low = (label or "").strip().lower().split("-")[0].split("_")[0]
    return None if low in ("", "und", "unknown", "none", "null", "mul", "zxx") else low


@functools.cache
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """(code point -> folded letter, 32 for all else; code point -> bucket of a single letter)."""
    fold, kind = tables()
    k = kind[fold]
    return np.where((k != SKIP) & (k != DIGIT), fold, 32).astype(np.uint32), _buckets(np.arange(len(fold), dtype=np.uint64), 1)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    out = mix64(h, n)
    out &= np.uint64(BUCKETS - 1)
    return out.view(np.int64)


def gram_buckets(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams of letters; other symbols are one separator, digits none at all."""
    symbols, single = _symbols()
    short = TextBatch(symbols[batch.cps], batch.off).squeezed(32)
    letter, size, rows = short.cps != 32, np.diff(short.off), np.arange(len(short))
    out, who = [single[short.cps[letter]]], [np.repeat(rows, short.sums(letter))]
    cps = h = short.cps.astype(np.uint64)
    for n in range(2, LONGEST + 1):
        if len(cps) < n:
            break
        h = h[:-1] << np.uint64(21)
        h |= cps[n - 1 :]
        out.append(_buckets(h[short.begins(n)], n))  # no two separators stand together, so each holds a letter
        who.append(np.repeat(rows, np.maximum(size - n + 1, 0)))
    return np.concatenate(out), np.concatenate(who)


def languages_of(rows: dict[str, int]) -> list[str]:
    """The normal labels that make a language, by their numbers of labelled rows; at most 1 / LEAST_PART."""
    return sorted(y for y, n in rows.items() if n >= max(LEAST_ROWS, LEAST_PART * sum(rows.values())))


def cells_of(texts: pa.Array, language: np.ndarray, languages: int) -> np.ndarray:
    """How often an n-gram of a bucket stands in texts of a language, at bucket * languages + language."""
    bucket, who = gram_buckets(TextBatch.of(texts))
    return np.bincount(bucket * languages + language[who], minlength=BUCKETS * languages)


class LanguageModel:
    """languages: those of the labels; weights[bucket, language]: log-probability of an n-gram; all have the same prior."""

    def __init__(self, texts: list[str], labels: list[str | None]):
        named = [(t, y) for t, y in zip(texts, map(normal_label, labels), strict=True) if y]
        languages = languages_of(Counter(y for _, y in named))
        known = [(t, languages.index(y)) for t, y in named if y in languages]
        self.fit(languages, cells_of(pa.array([t for t, _ in known], pa.large_string()), np.array([y for _, y in known], np.int64), len(languages)) if known else np.zeros(0, np.int64))

    @classmethod
    def of_counts(cls, languages: list[str], cells: np.ndarray) -> "LanguageModel":
        out = cls.__new__(cls)
        out.fit(languages, cells)
        return out

    def fit(self, languages: list[str], cells: np.ndarray) -> None:
        """From the sums of cells_of."""
        self.languages = languages
        counts = np.full((BUCKETS, max(len(languages), 1)), 0.2)
        if languages:
            counts += cells.reshape(BUCKETS, -1)
        self.weights = np.log(counts / counts.sum(0)).astype(np.float32)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods by language, weight of the evidence: letters, a Chinese character as three)."""
        batch = TextBatch.of(texts)
        bucket, who = gram_buckets(batch)
        logs = np.stack([np.bincount(who, w[bucket], len(batch)) for w in np.ascontiguousarray(self.weights.T)], axis=1)
        kind = tables()[1][batch.cps]
        return logs, batch.sums((kind != SKIP) & (kind != DIGIT)) + 2 * batch.sums(kind == CJK)
