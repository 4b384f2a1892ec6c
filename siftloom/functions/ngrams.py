"""Repetition rates of character n-grams for whole Arrow batches: windows are hashed and counted in numpy."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom.functions.textbatch import TextBatch, chunks, prefix_hash, span_hash, window_starts

SIZES = (3, 4, 5)
#: Code points of Python's white space.
WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _white() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[WHITE] = True
    return out


def rates(texts: pa.Array, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """1 - distinct / all windows of each size over a text's characters without white space; 0 without windows."""
    out = np.zeros((len(texts), len(sizes)))
    for at, to in chunks(texts):
        batch = TextBatch.of(texts.slice(at, to - at))
        batch = batch.kept(~_white()[batch.cps])
        prefix, own, n = prefix_hash(batch.cps), batch.owner(), np.diff(batch.off)
        bits = np.uint64(max(1, len(batch).bit_length()))
        for k, size in enumerate(sizes):
            st = window_starts(batch, size)
            packed = np.sort(span_hash(prefix, st, st + size) >> bits | own[st].astype(np.uint64) << (np.uint64(64) - bits))
            new = np.concatenate(([True], packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, bool)
            distinct = np.bincount((packed[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(batch))
            windows = np.maximum(n - size + 1, 0)
            out[at:to, k] = np.where(windows > 0, 1 - distinct / np.maximum(windows, 1), 0.0)
    return out


def repetition(c: Column) -> Column:
    """A struct of the rates of sizes 3, 4 and 5 of a text column; null counts as empty."""

    @F.pandas_udf("struct<char_3:double,char_4:double,char_5:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(rates(pa.array(s, pa.large_string(), from_pandas=True)), columns=[f"char_{n}" for n in SIZES])

    return run(c)
