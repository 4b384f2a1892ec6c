"""Text measures as Column expressions: everything stays in the JVM, one character array a text.

All functions take a Column and treat null as the empty text. White space is Python's class
(constants.WS_JAVA); lines end at a newline only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import ngrams


def let(value: Column, body) -> Column:
    """body applied to a value that is computed once: a lambda variable holds it, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def one_decimal(c: Column) -> Column:
    """A number with one decimal as C and Python print it: by its exact binary value, ties to even.

    Ten times the value is a sum of two exact products; what that sum loses decides where it seems a tie.
    """
    number = F.coalesce(c.cast("double"), F.lit(0.0))

    def digits(x: Column) -> Column:
        a, b = F.abs(x) * 8, F.abs(x) * 2
        total = a + b
        lost = (a - (total - (total - a))) + (b - (total - a))
        tie = total - F.floor(total) - 0.5
        up = (tie > 0) | ((tie == 0) & ((lost > 0) | ((lost == 0) & (F.floor(total) % 2 == 1))))
        n = F.floor(total) + up.cast("bigint")
        return F.concat(F.when((x < 0), "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    return let(number, digits)


def strip(c: Column) -> Column:
    """Trimmed on both sides by Python's white space."""
    return F.regexp_replace(c, f"^{k.WS_JAVA}+|{k.WS_JAVA}+$(?!\\n)", "")


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), k.WS_JAVA + "+", "")


def count_chars(c: Column | str) -> Column:
    """Characters that are no white space."""
    return F.char_length(compact(c)).cast("bigint")


def sentences(c: Column | str) -> Column:
    """Sentences with their marks, trimmed, blank ones dropped."""
    d = k.SENTENCE_MARKS
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(f"[^{d}]*[{d}]|[^{d}]+$"), F.lit(0)), strip), lambda x: x != "")


def sentence_count(c: Column | str) -> Column:
    """Number of sentences without building them: every mark ends one, and a remainder that isn't blank is one more."""
    rest = F.regexp_replace(F.regexp_replace(text(c), f"(?s)^.*[{k.SENTENCE_MARKS}]", ""), k.WS_JAVA + "+", "")
    return (F.regexp_count(text(c), F.lit(f"[{k.SENTENCE_MARKS}]")) + (rest != "").cast("int")).cast("bigint")


def paragraphs(c: Column | str) -> Column:
    """Blocks between line ends, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text(c), "\n+"), strip), lambda x: x != "")


def tokenize(c: Column | str) -> Column:
    """Tokens of a text: its characters, the fallback where no word segmenter is installed."""
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.split(text(c), ""))


def grams(chars: Column, n: int, joiner: str = "") -> Column:
    """All windows of n tokens, joined (I4, I5); none if there are fewer."""

    def windows(a: Column) -> Column:
        part = lambda i: [F.get(a, i + j) for j in range(n)]
        all_of = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat_ws(joiner, *part(i)) if joiner else F.concat(*part(i)))
        return F.when(F.size(a) >= n, all_of).otherwise(F.array().cast("array<string>"))

    return let(chars, windows)


def char_array(c: Column | str) -> Column:
    return tokenize(compact(c))


def repetition_rate(gram: Column) -> Column:
    """1 - distinct / all, 0 without grams."""
    return let(gram, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def char_repetition(c: Column | str, n: int) -> Column:
    """The rate of n-grams of characters: sizes 3 to 5 by whole batches, others by arrays."""
    if n in ngrams.SIZES:
        return ngrams.repetition(text(c))[f"char_{n}"]
    return repetition_rate(grams(char_array(c), n))


def paragraph_lengths(c: Column | str) -> Column:
    """Characters without white space of each paragraph that is not blank."""
    plain = F.regexp_replace(text(c), f"[{k.WS_JAVA}&&[^\\n]]+", "")
    return F.filter(F.transform(F.split(plain, "\n+"), lambda p: F.char_length(p).cast("double")), lambda x: x > 0)


def present(c: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds, in list order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p))


def template_endings(c: Column | str, phrases: list[str] | None = None) -> Column:
    """Template phrases in the last 200 characters (I8)."""
    return present(F.right(text(c), F.lit(200)), phrases or k.TEMPLATE_ENDINGS)


def assistant_phrases(c: Column | str) -> Column:
    """Assistant phrases anywhere."""
    return present(text(c), k.ASSISTANT_PHRASES)


def line_count(c: Column | str, pattern: str) -> Column:
    """Matches of a pattern at line starts."""
    return F.regexp_count(text(c), F.lit(f"(?md){pattern}")).cast("bigint")


def headings(c: Column | str) -> Column:
    return line_count(c, f"^#{{1,6}}{k.WS_JAVA}")


def list_items(c: Column | str) -> Column:
    """Bullets and numbered entries (part of I11)."""
    return line_count(c, f"^{k.WS_JAVA}*[-*]{k.WS_JAVA}") + line_count(c, f"^{k.WS_JAVA}*\\p{{Nd}}+[.、]{k.WS_JAVA}")


#: The marks of what a cut leaves out.
OMITTED = ("\n\n[...此处省略约 ", " 字，预分析报告包含全文统计数据...]\n\n")
CUT_OUT = "\n\n[…中间省略…]\n\n"


def smart_truncate(c: Column | str, most: int) -> Column:
    """Head (60 %) and tail (30 %) of a text longer than most characters, with the number of those left out."""
    t, head, tail = text(c), int(most * 0.6), int(most * 0.3)
    left_out = (F.char_length(t) - (head + tail)).cast("string")
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(OMITTED[0]), left_out, F.lit(OMITTED[1]), F.right(t, F.lit(tail)) if tail else t))


def hard_truncate(c: Column | str, most: int) -> Column:
    """Head (65 %) and what is left but 80 as tail; without room for a tail a plain cut, with room for none the whole text again."""
    t, head = text(c), most * 65 // 100
    tail = most - head - 80
    cut = F.substring(t, 1, most) if tail < 0 else F.concat(F.substring(t, 1, head), F.lit(CUT_OUT), F.right(t, F.lit(tail)) if tail else t)
    return F.when(F.char_length(t) <= most, t).otherwise(cut)


def final_answer(c: Column | str) -> Column:
    """What stands after the last final-answer mark, else nothing."""
    return F.when(F.contains(text(c), F.lit(k.FINAL_ANSWER_MARK)), strip(F.substring_index(text(c), k.FINAL_ANSWER_MARK, -1))).otherwise(F.lit(""))


#: The five answer patterns, in order.
ANSWER_PATTERNS = [r"【答案】(.+?)【/答案】", rf"最终答案[是为：:]{k.WS_JAVA}*(.+?)(?:\n|$)", rf"[Aa]nswer[：:]{k.WS_JAVA}*(.+?)(?:\n|$)", rf"因此[，,]{k.WS_JAVA}*(.+?)(?:\n|$)", rf"所以[，,]{k.WS_JAVA}*(.+?)(?:\n|$)"]


def extract_answer(c: Column | str) -> Column:
    """The answer by the first pattern that matches, else the last line."""
    t = text(c)
    found = [F.when(F.regexp_like(t, F.lit("(?sd)" + p)), strip(F.regexp_extract(t, "(?sd)" + p, 1))) for p in ANSWER_PATTERNS]
    return F.coalesce(*found, strip(F.element_at(F.split(strip(t), "\n"), -1)))


def normalize_answer(c: Column | str) -> Column:
    """Without white space and common marks, lower case."""
    return F.lower(F.regexp_replace(text(c), f"[。，、；：！？]|{k.WS_JAVA}", ""))


def dedup_key(c: Column | str) -> Column:
    """Key of exact duplicates: digest of the text without white space, lower case."""
    return F.md5(F.lower(compact(c)))


def words_present(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w.lower())).cast("int") for w in words])


def difficulty_score(c: Column | str) -> Column:
    """Weighted keywords, formulas, length and question marks."""
    t = text(c)
    low = F.lower(t)
    formulas = F.regexp_count(t, F.lit(r"\$[^$]+\$")) + F.regexp_count(t, F.lit(r"(?d)\\\(.*?\\\)"))
    n = F.char_length(t)
    marks = F.regexp_count(t, F.lit("[？?]"))
    return (
        k.HARD_WEIGHT * words_present(low, k.HARD_WORDS) + k.MEDIUM_WEIGHT * words_present(low, k.MEDIUM_WORDS) + k.EASY_WEIGHT * words_present(low, k.EASY_WORDS)
        + F.when(formulas >= 3, 2).when(formulas >= 1, 1).otherwise(0)
        + F.when(n > 300, 2).when(n > 100, 1).otherwise(0)
        + F.when(marks >= 3, 2).otherwise(0)
    ).cast("bigint")


def level_of(score: Column) -> Column:
    return F.when(score >= 5, "hard").when(score >= 2, "medium").otherwise("easy")
