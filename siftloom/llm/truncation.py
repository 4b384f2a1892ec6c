"""Problem 5: text cut off by field limits or mid-transfer.

Hidden storage limits come first: the length of every text is recomputed under alternative encodings
(code points, UTF-8 bytes, UTF-16 units, GB 18030 bytes), with HTML entities, JSON escapes and CRLF
line ends, and counted by source. A length that far more texts of a source have than its
neighbouring lengths is a limit of that source, in whichever encodings they show. The endings of the
rows at a limit are inspected next: any that does not close is cut. Everywhere else the ending is
judged by itself: open code blocks, formulas and brackets, broken characters and ellipses, and the
end-of-text likelihood of endings.EndModel.

Null, blank and placeholder texts are no cases, nor are short answers, refusals and copies of the
question. Every row is judged for itself, so repeated rows agree. Sources may be null; they count
as one source. Texts of any length: lengths cover the whole text, code marks and brackets too.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm import defect_rules as rules
from siftloom.llm.endings import SENTENCE_END, EndModel
from siftloom.functions.textbatch import TextBatch, chunks
from siftloom.session import cut, work_table

#: A peak has at least so many rows and is so many times as frequent as the mean of its neighbours within WINDOW.
PEAK_ROWS, PEAK_TIMES, WINDOW, SHORTEST_LIMIT = 8, 6.0, 20, 40

ENCODINGS = ("chars", "utf8", "utf16", "gb18030", "html_chars", "html_utf8", "json_chars", "json_utf8", "json_ascii", "crlf_chars", "crlf_utf8")

_CLOSED = re.compile(r"(?:[。！？!?｡]|(?<!\d)\.|\d\.(?=$))[\s”’\"'」』*）)]*$")
_ASIDE = re.compile(r"[。！？!?.]\s*[（(][^（()）\n]*[)）]\s*$")
_FORMULA_LINE = re.compile(r"^[\w\s^*/+\-().{}\\,|]*=\s*[\w^*/+\-().{}\\, ]*[\w})]$|^\\(?:frac|sum|int|sqrt|prod|lim)[^㐀-鿿]*[)}\d]$")
_FINAL_LINE = re.compile(r"^\W*(?:最终答案|答案|final answer|respuesta final|endergebnis|antwort|answer)\W*[:：]\W*\w+", re.I)
_CLOSERS_AFTER, _MARKS = "”’\"'」』*）)", "。！？!?｡."
_ELLIPSIS = re.compile(r"(?:\[?(?:\.{3,}|…+|。{3,})\]?|�+)\s*$")
_ELLIPSES = tuple(x + y for x in ("...", "…", "。。。") for y in ("", "]")) + ("�",)
_ENTRY = re.compile(r"^\s*(?:[-*•·+]\s|[(（]?\d{1,4}[.、)）:：]|第\s*\d+\s*[步点条项][:：，,]?|(?:step|schritt|paso|punkt|point|punto)\s+\d+\s*[:.])", re.I)
_OPENERS, _CLOSERS = "（(「『“【《[{", "）)」』”】》]}"


#: Classes of code points that are rare enough to be counted one by one.
_QUOTE, _AMP, _ANGLE, _APOS, _SHORT_ESCAPE, _LINE_END, _CONTROL, _TWO_BYTES, _ASTRAL, _FOUR_GB, _TWO_FOUR_GB = range(1, 12)


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x10000):
        if not 0xD800 <= c < 0xE000:
            four = len(chr(c).encode("gb18030")) == 4
            out[c] = (_TWO_FOUR_GB if four else _TWO_BYTES) if c < 0x800 else _FOUR_GB if four else 0
    out[0x10000:] = _ASTRAL
    out[:32] = _CONTROL
    for c, k in ((34, _QUOTE), (38, _AMP), (60, _ANGLE), (62, _ANGLE), (39, _APOS), (92, _SHORT_ESCAPE), (8, _SHORT_ESCAPE), (9, _SHORT_ESCAPE), (12, _SHORT_ESCAPE), (13, _SHORT_ESCAPE), (10, _LINE_END)):
        out[c] = k
    return out


def lengths(texts: pa.Array, batch: TextBatch | None = None) -> np.ndarray:
    """Length of each text under every one of ENCODINGS."""
    b = batch or TextBatch.of(texts)
    n, m = np.diff(b.off), len(b)
    cls = _classes()[b.cps]
    at = np.flatnonzero(cls)
    k = cls[at]
    own = np.searchsorted(b.off, at, "right") - 1
    # empty texts share their start with the next one: searchsorted on the right gives the text that holds the place
    count = np.bincount(own * 12 + k, minlength=m * 12).reshape(m, 12) if m else np.zeros((0, 12), np.int64)
    utf8 = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    two, astral, four = count[:, _TWO_BYTES] + count[:, _TWO_FOUR_GB], count[:, _ASTRAL], count[:, _FOUR_GB] + count[:, _TWO_FOUR_GB]
    three = (utf8 - n - two - 3 * astral) // 2
    gb = n + two + three + astral + 2 * (astral + four)
    html = 5 * count[:, _QUOTE] + 4 * count[:, _AMP] + 3 * count[:, _ANGLE] + 5 * count[:, _APOS]
    json = count[:, _QUOTE] + count[:, _SHORT_ESCAPE] + count[:, _LINE_END] + 5 * count[:, _CONTROL]
    line = count[:, _LINE_END]
    if len(at) and (carriage := at[(b.cps[at] == 13)]).size:  # line ends that are CRLF already
        done = carriage[(carriage + 1 < len(b.cps)) & (b.cps[np.minimum(carriage + 1, len(b.cps) - 1)] == 10)]
        line = line - np.bincount(np.searchsorted(b.off, done, "right") - 1, minlength=m)
    ascii_ = 5 * (two + three) + 11 * astral
    return np.stack([n, utf8, n + astral, gb, n + html, utf8 + html, n + json, utf8 + json, n + json + ascii_, n + line, utf8 + line], axis=1)


def length_table(df: DataFrame, column: str, source: str) -> DataFrame:
    """(source, lengths: one for each of ENCODINGS) of every non-null text; the texts are read once, then only this is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in chunks(b.column(1)):
                part = lengths(b.column(1).slice(at, to - at))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), len(ENCODINGS)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), rows], ["source", "lengths"])

    rows = df.select(F.col(source).cast("string").alias("source"), F.col(column).alias("text")).where("text is not null")
    return work_table(rows.mapInArrow(run, "source string, lengths array<bigint>"), "lengths")


def hidden_limits(table: DataFrame) -> DataFrame:
    """(source, encoding, length, n, usual) of the hidden limits: peaks of the lengths of a source under any encoding.

    The same limit shows, weaker, in related encodings: every row is explained by the strongest peak it stands at, and a
    peak stays if the rows that no stronger one explains are still a peak. So one source may have several limits.
    """
    counts = table.select("source", F.posexplode("lengths").alias("encoding", "length")).groupBy("source", "encoding", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source", "encoding").orderBy("length").rangeBetween(-WINDOW, WINDOW)
    usual = counts.withColumn("usual", (F.sum("n").over(near) - F.col("n")) / F.lit(2 * WINDOW))
    stands = (F.col("n") >= PEAK_ROWS) & (F.col("n") > PEAK_TIMES * F.col("usual") + PEAK_ROWS / 2)
    peaks = cut(usual.where(stands & (F.col("length") >= SHORTEST_LIMIT)))
    weight = (F.col("n") - F.col("usual")) * (1 - 0.02 * F.col("encoding"))
    lists = peaks.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(weight.alias("weight"), "encoding", "length")), asc=False).alias("peaks"))
    at = table.join(F.broadcast(lists.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    first = F.get(F.filter("peaks", lambda p: F.element_at("lengths", p["encoding"] + 1) == p["length"]), 0)
    own = at.select("source", first.alias("p")).where("p is not null").groupBy("source", F.col("p.encoding").alias("encoding"), F.col("p.length").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    own = own.alias("o").join(peaks.drop("n").alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.encoding") == F.col("p.encoding")) & (F.col("o.length") == F.col("p.length")))
    return own.select("o.source", "o.encoding", "o.length", "o.n", "p.usual").where(stands)


def open_bracket(line: str) -> bool:
    """Whether a bracket of the line is never closed; list labels like "1)" close without opening and do not count."""
    depth = 0
    for ch in line:
        if ch in _OPENERS:
            depth += 1
        elif ch in _CLOSERS and depth:
            depth -= 1
    return depth > 0


def _closes(t: str) -> bool:
    """Whether a text without white space at its end closes a sentence; the expression is only asked where marks follow one."""
    return t[-1] in _MARKS or t[-1] in _CLOSERS_AFTER and _CLOSED.search(t) is not None


def breaks_off(text: str, model: EndModel, at_limit: bool = False) -> bool:
    """Whether the text stops before its end; blank texts and short answers do not."""
    t = text.rstrip()
    if not t:
        return False
    fences = t.count("```")
    if fences % 2:
        return True
    if t.endswith("```"):
        return False
    line = t[t.rfind("\n") + 1 :]
    cut = _ELLIPSIS.search(t) if t.endswith(_ELLIPSES) else None
    if cut:
        rest = t[: cut.start()].rstrip()
        if not any(c.isalnum() for c in rest) or rest[-1:] in SENTENCE_END + "?!":
            return t[cut.start()] == "�" and any(c.isalnum() for c in rest)
        return True
    prose = t if not fences else re.sub(r"```.*?```", " ", t, flags=re.S)
    if prose.count("$") % 2:
        return True
    if t[-1] in ")）" and _ASIDE.search(t):
        return False
    if _closes(t):
        if t[-1] == "." and len(t) > 1 and t[-2].isdigit():
            return not model.may_end(t[:-1])
        return False
    if t[-1] in "$":
        return False
    if _FINAL_LINE.match(line):
        return t[-1] in "=+-*/\\^{(（："
    body = line.strip()
    if _FORMULA_LINE.match(body) and body.count("{") == body.count("}") and body.count("(") <= body.count(")") and not (at_limit and "\n" in t):
        return False
    if open_bracket(line):
        return True
    if rules.short_answer(t):
        return False
    if t[-1] in "：:，,、；;-–—=+/\\^_{(（“「":
        return True
    if t[-1] in "）)”\"」』*]`}":
        inner = t.rstrip("）)”\"」』*]`} ")
        if inner[-1:] in SENTENCE_END + "?!":
            return False
        if t[-1] in "*`" and body.startswith(t[-1]):
            return False
        t = inner
    if at_limit:
        return True
    if body.startswith("#"):
        return not model.may_end(t)
    if not _ENTRY.match(line):
        return True
    entries = [x for x in text.rstrip().split("\n")[:-1] if _ENTRY.match(x)]
    if entries and all(x.rstrip()[-1:] in SENTENCE_END for x in entries):
        return True
    return not model.may_end(t)
