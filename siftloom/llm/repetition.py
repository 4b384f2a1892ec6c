"""Problem 1: repetition inside a single document.

Rule statistics of each text (share of letters and digits in passages that stood earlier in the
same text, longest repeated run, share of repeated short windows, share of repeated 4-grams) are
computed for whole Arrow batches. An isolation forest over these statistics gives every text a
mean path length; the path-length threshold is calibrated on labelled rows: a bounded sample of
the table, and texts made repetitive on purpose, both labelled by the exact rule. Texts beyond the
threshold are then checked by the exact rule (share >= MIN_SHARE).

Null and empty texts have share 0 and are no cases. Extra columns are ignored. A text repeated in
several rows counts in each row. Texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.textbatch import CJK, TextBatch, chunks, mix64, prefix_hash, span_hash, tables, window_starts

#: Fixed values of the problem: a passage is so many letters or digits; a case has at least this share of them repeated.
PASSAGE_CJK, PASSAGE_OTHER, MIN_SHARE = 12, 30, 0.3
#: A text counts as Chinese if at least this share of its letters and digits is CJK.
CJK_SHARE = 0.3
#: Rows of the sample that the forest and its threshold are fitted on; trees; rows a tree.
SAMPLE_ROWS, TREES, TREE_ROWS = 3000, 64, 256
#: Longest text of a sample that models are fitted on: bounds what reaches the driver. Every text is judged, whatever its length.
SAMPLE_CHARS = 20_000
#: Lowers the calibrated score threshold, so that rows a little more usual than any labelled case still get checked.
SLACK = 0.02

STATS = ("share", "longest", "short_share", "gram4_share")


def repeated(let: TextBatch, prefix: np.ndarray, own: np.ndarray, size_of: np.ndarray) -> np.ndarray:
    """For each letter: whether a window of the text's passage size that covers it stood earlier in the same text."""
    n = len(let.cps)
    cover = np.zeros(n + 1, np.int64)
    for size in np.unique(size_of):
        st = window_starts(let, int(size))
        st = st[size_of[own[st]] == size]
        if len(st) < 2:
            continue
        h = span_hash(prefix, st, st + size) ^ mix64(own[st], 7)
        # one plain sort of (hash, place): equal windows become neighbours, the earliest first; whole hashes are compared after
        bits = np.uint64(max(1, int(len(st)).bit_length()))
        packed = np.sort((h >> bits << bits) | np.arange(len(st), dtype=np.uint64))
        near = np.flatnonzero((packed[1:] >> bits) == (packed[:-1] >> bits))
        low = np.uint64((1 << int(bits)) - 1)
        a, b = (packed[near] & low).astype(np.int64), (packed[near + 1] & low).astype(np.int64)
        later = st[b[h[a] == h[b]]]
        if not len(later):
            continue
        cover += np.bincount(later, minlength=n + 1)
        cover -= np.bincount(later + size, minlength=n + 1)
    return np.cumsum(cover[:n]) > 0


def stats_of(texts: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    let = TextBatch.of(texts).letters()
    kind = tables()[1]
    n = np.diff(let.off)
    many = np.maximum(n, 1)
    cjk = let.sums(kind[let.cps] == CJK)
    chinese = cjk >= CJK_SHARE * many
    own, prefix = let.owner(), prefix_hash(let.cps)
    hit = repeated(let, prefix, own, np.where(chinese, PASSAGE_CJK, PASSAGE_OTHER))
    short = repeated(let, prefix, own, np.where(chinese, 6, 15))
    share = let.sums(hit) / many
    # runs of repeated letters: a run ends where the flag falls or the text ends
    step = np.concatenate(([0], np.cumsum(hit)))
    ends = np.flatnonzero(hit & np.append(~hit[1:] | (own[1:] != own[:-1]), True)) if len(hit) else np.zeros(0, np.int64)
    starts = np.flatnonzero(hit & np.insert(~hit[:-1] | (own[1:] != own[:-1]), 0, True)) if len(hit) else np.zeros(0, np.int64)
    longest = np.zeros(len(let))
    if len(ends):
        np.maximum.at(longest, own[ends], step[ends + 1] - step[starts])
    gram = repeated(let, prefix, own, np.full(len(let), 4))
    return np.stack([share, longest / many, let.sums(short) / many, let.sums(gram) / many], axis=1)


class IsolationForest:
    """Random axis-parallel splits; a short mean path means that a row is easily told from the others."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], depth, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _mean_path(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Arrays over nodes: feature (-1: leaf), cut, left child, right child, path length at a leaf."""
        nodes: list[list[float]] = []

        def add(part: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, level + float(self._mean_path(len(part)))])
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
            usable = np.flatnonzero(high > low)
            if level < depth and len(part) > 1 and len(usable):
                f = int(rng.choice(usable))
                cut = rng.uniform(low[f], high[f])
                left = part[:, f] < cut
                nodes[at][0], nodes[at][1] = f, cut
                nodes[at][2] = add(part[left], level + 1)
                nodes[at][3] = add(part[~left], level + 1)
            return at

        add(rows, 0)
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), int)
            while True:
                f = feature[at]
                live = f >= 0
                if not live.any():
                    break
                goes = rows[np.arange(len(rows)), np.maximum(f, 0)] < cut[at]
                at = np.where(live, np.where(goes, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self._mean_path(self.size)), 1e-9))


def bounded_sample(df: DataFrame, key: str, column: str, rows: int) -> list[str]:
    """About that many non-null texts of at most SAMPLE_CHARS characters, chosen by a hash of the key from the whole table."""
    n = df.count()
    take = df.select(F.col(column).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h")).where(F.char_length("text") <= SAMPLE_CHARS)
    if n > rows:
        take = take.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * 1.3 * rows / n))
    return [r.text for r in take.orderBy("h").limit(rows).collect()]


def made_repetitive(texts: list[str]) -> list[str]:
    """Labelled cases on purpose: passages of a text said again, to different shares."""
    out = []
    for i, t in enumerate(texts):
        half = t[: max(40, len(t) // 2)]
        out.append((t + half * (1 + i % 3), half * 6, t + (t[:24] + "，") * (3 + i % 20), t[:9] * 40)[i % 4])
    return out


def fit(df: DataFrame, key: str, column: str) -> tuple[IsolationForest, float]:
    """The forest, and the score from which a text is checked; the forest is fitted on the plain sample."""
    sample = bounded_sample(df, key, column, SAMPLE_ROWS)
    plain = stats_of(pa.array(sample, pa.large_string()))
    forest = IsolationForest(plain)
    labelled = np.concatenate([plain, stats_of(pa.array(made_repetitive(sample[:400]), pa.large_string()))])
    cases = labelled[labelled[:, 0] >= MIN_SHARE]
    return forest, float(forest.score(cases).min()) - SLACK if len(cases) else 0.0


def repetition(df: DataFrame, key: str, column: str, model: tuple[IsolationForest, float] | None = None) -> DataFrame:
    """(key, STATS..., score, is_case) for every row; see the module for nulls and empty texts."""
    forest, limit = model or fit(df, key, column)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{s} double" for s in STATS) + ", score double, is_case boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in chunks(b.column(1)):
                part = b.slice(at, to - at)
                stats = stats_of(part.column(1))
                score = forest.score(stats)
                case = (score >= limit) & (stats[:, 0] >= MIN_SHARE)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(stats[:, k]) for k in range(len(STATS))), pa.array(score), pa.array(case)], [key, *STATS, "score", "is_case"])

    return df.select(key, column).mapInArrow(run, schema)
