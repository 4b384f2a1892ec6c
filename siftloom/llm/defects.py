"""Problem 6: broken prompt and response pairs.

The languages of prompt and response are compared by their posteriors under a character n-gram
naive Bayes model; the end-of-text n-gram likelihood flags truncation (see truncation.breaks_off).
Refusals are told by a naive Bayes model of their own (refusals.py); empty and copying answers follow
the rules in defect_rules. The languages are those of the labels.

All models are fitted on all rows of their tables, from counts that the executors add up; every row is judged over its
whole text. Null answers are empty; a null question leaves only what the answer
alone shows. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm import defect_rules as rules
from siftloom.llm import truncation
from siftloom.llm.endings import Endings, EndModel, Tally, answered, least_texts, pieces, words_of
from siftloom.llm.language import BUCKETS as LANGUAGE_BUCKETS
from siftloom.llm.language import LanguageModel, cells_of, languages_of, normal_label
from siftloom.llm.refusals import BUCKETS, RefusalModel, counts_of
from siftloom.functions.textbatch import TextBatch, chunks
from siftloom.session import work_table

#: Evidence (letters, Chinese ones as three) and nats a letter by which another language must win.
LEAST_LETTERS, LEAST_NATS = 28, 0.25
DEFECTS = ("empty", "truncated", "refusal", "copied_question", "wrong_language")

#: Names of languages, by which a prompt asks for one.
NAMES = {
    "en": "英文 英语 English Englisch inglés anglais inglese inglês",
    "de": "德文 德语 German Deutsch alemán allemand tedesco alemão",
    "es": "西班牙文 西班牙语 西语 Spanish Castilian Spanisch español castellano espagnol spagnolo espanhol",
    "zh": "中文 汉语 普通话 国语 华语 Chinese Mandarin Chinesisch Mandarín chino chinois cinese chinês",
    "fr": "法文 法语 French Französisch francés français francese francês",
    "it": "意大利文 意大利语 Italian Italienisch italiano italien",
    "pt": "葡萄牙文 葡萄牙语 Portuguese Portugiesisch portugués português portugais portoghese",
    "ru": "俄文 俄语 Russian Russisch ruso russe russo",
    "ja": "日文 日语 Japanese Japanisch japonés japonais giapponese japonês",
    "ko": "韩文 韩语 Korean Koreanisch coreano coréen",
    "ar": "阿拉伯文 阿拉伯语 Arabic Arabisch árabe arabe arabo",
    "nl": "荷兰文 荷兰语 Dutch Niederländisch neerlandés néerlandais olandese",
}
_ASKED = {k: re.compile("|".join(n if n[0] > "\u3000" else rf"\b{n}\b" for n in v.split()), re.I) for k, v in NAMES.items()}
_NO_LANGUAGE = re.compile(r"```.*?(?:```|$)|\$[^$\n]*\$|\\[A-Za-z]+|https?://\S+", re.S)


#: What is counted over all texts: words_of; buckets of n-grams in other texts and in refusals; numbers of these texts.
_WORDS, _OTHER, _REFUSAL, _TEXTS = range(4)


def models(parts: list[tuple[DataFrame, str]]) -> tuple[Endings, RefusalModel, int]:
    """The common words of endings, the model of refusals, and the number of texts; from all non-null texts of (table, column) parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, n = Tally(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "k", "n"])

        for b in batches:
            for part in pieces(b.column(0)):
                batch = TextBatch.of(part)
                if full := words.add(*words_of(batch)):
                    yield rows(_WORDS, *full)
                for total, more in zip((grams, n), counts_of(part, batch), strict=True):
                    total += more
        yield rows(_WORDS, *words.take())
        for kind, total in ((_OTHER, grams[0]), (_REFUSAL, grams[1]), (_TEXTS, n)):
            some = np.flatnonzero(total)
            yield rows(kind, some, total[some])

    every = [df.select(F.col(c).alias("text")).where("text is not null").mapInArrow(run, "kind int, k bigint, n bigint") for df, c in parts]
    counted = work_table(functools.reduce(DataFrame.unionAll, every).groupBy("kind", "k").agg(F.sum("n").alias("n")), "words")
    texts = np.zeros(2, np.int64)
    for r in counted.where(F.col("kind") == _TEXTS).collect():
        texts[r.k] = r.n
    word, pair = least_texts(int(texts.sum()))
    got = counted.where((F.col("kind") != _WORDS) | (F.col("n") >= F.when(F.col("k") % 2 == 1, pair).otherwise(word))).toArrow()
    kind, k, n = (got[c].to_numpy() for c in ("kind", "k", "n"))
    grams = np.zeros((2, BUCKETS), np.int64)
    for row, x in enumerate((_OTHER, _REFUSAL)):
        grams[row, k[kind == x]] = n[kind == x]
    return Endings(k[kind == _WORDS]), RefusalModel.of_counts(grams, texts), int(texts.sum())


def language_model(labelled: DataFrame, text: str, label: str) -> LanguageModel:
    """Fitted on all labelled texts; their n-grams are counted by bucket and language."""
    rows = labelled.select(F.col(text).alias("t"), F.col(label).alias("y")).where("t is not null and y is not null")
    named: Counter = Counter()
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():
        if y := normal_label(r.y):
            named[y] += r.n
    languages = languages_of(named)
    at, many = {y: i for i, y in enumerate(languages)}, len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LANGUAGE_BUCKETS * many, np.int64)
        for b in batches:
            own = np.array([at.get(normal_label(y), -1) for y in b.column(1).to_pylist()], np.int64)
            known = b.column(0).filter(pa.array(own >= 0))
            own = own[own >= 0]
            for a, z in chunks(known):
                total += cells_of(known.slice(a, z - a), own[a:z], many)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["k", "n"])

    cells = np.zeros(LANGUAGE_BUCKETS * many, np.int64)
    if many:
        got = rows.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        cells[got["k"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel.of_counts(languages, cells)


def limits_by_source(df: DataFrame, column: str, source: str) -> DataFrame:
    """(source, limits: "encoding:length" pairs), written once so that its size is known to the planner."""
    peaks = truncation.hidden_limits(truncation.length_table(df, column, source))
    return work_table(peaks.groupBy("source").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws(":", "encoding", "length")))).alias("limits")), "limits")


def _without_code(text: str) -> str:
    return _NO_LANGUAGE.sub(" ", text) if "`" in text or "$" in text or "\\" in text or "http" in text else text


def _spoken(answer: str, question: str | None) -> str:
    """The part of an answer that has a language of its own: no code, formulas, nor the question said again first."""
    if question and len(question) > 8 and answer.lstrip().startswith(question.strip()):
        answer = answer.lstrip()[len(question.strip()) :]
    return _without_code(answer)


def wrong_language(questions: list[str | None], answers: list[str | None], model: LanguageModel) -> np.ndarray:
    """Answers whose most likely language is neither the question's nor one that the question asks for."""
    said = [_spoken(a, q) if a and q else "" for a, q in zip(answers, questions, strict=True)]
    distinct: dict[str | None, int] = {}
    at = np.array([distinct.setdefault(q, len(distinct)) for q in questions], dtype=np.int64)
    logs, weight = model.scores(pa.array(said, pa.large_string()))
    asked, evidence = model.scores(pa.array([_without_code(q or "") for q in distinct], pa.large_string()))
    asked, evidence = asked[at], evidence[at]
    best, own = logs.argmax(1), asked.argmax(1)
    rows = np.arange(len(said))
    sure = (logs[rows, best] - logs[rows, own] >= LEAST_NATS * np.maximum(weight, 1)) & (weight >= LEAST_LETTERS) & (evidence >= LEAST_LETTERS // 2)
    sure &= best != own
    for i in np.flatnonzero(sure):
        asks = _ASKED.get(model.languages[best[i]])
        sure[i] = asks is None or not asks.search(questions[i])
    return sure


def near_limits(answers: pa.Array, limits: list[str | None], batch: TextBatch | None = None) -> np.ndarray:
    """Which answers have exactly a length that is a hidden limit of their source."""
    out = np.zeros(len(limits), bool)
    if any(limits):
        lengths = truncation.lengths(answers, batch)
        groups: dict[str, list[int]] = {}
        for i, x in enumerate(limits):
            if x:
                groups.setdefault(x, []).append(i)
        for x, rows in groups.items():
            at = np.array(rows)
            for pair in x.split():
                encoding, length = map(int, pair.split(":"))
                out[at] |= lengths[at, encoding] == length
    return out


class _Asked:
    """Takes the place of EndModel: notes the endings that depend on it."""

    def __init__(self):
        self.texts: list[str] = []

    def may_end(self, text: str) -> bool:
        self.texts.append(text)
        return True


def _judged(pairs: DataFrame, key: str, limits: DataFrame | None, ends: Broadcast, languages: Broadcast | None, refusals: Broadcast | None) -> DataFrame:
    """(key, defects array, asked): asked has the contexts of an ending that only their counts decide; truncated if it may not end."""
    kind = pairs.schema[key].dataType.simpleString()
    rows = pairs.select(key, "question", "answer", F.col("source").cast("string").alias("source"))
    if limits is None:
        rows = rows.withColumn("limits", F.lit(None).cast("string"))
    else:
        rows = rows.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    rows = rows.select(key, "question", "answer", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lang = ends.value, languages.value if languages else None
        for whole in batches:
            for at, to in chunks(whole.column(2)):
                b = whole.slice(at, to - at)
                questions, answers, limit = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
                batch = TextBatch.of(b.column(2))
                at_limit = near_limits(b.column(2), limit, batch)
                declines = rules.seed_refusals(b.column(2))
                refuses = refusals.value.refuse(b.column(2), batch) if refusals else np.zeros(len(answers), bool)
                wrong = wrong_language(questions, answers, lang) if lang else np.zeros(len(answers), bool)
                out, open_rows, noted = [], [], _Asked()
                for i, (q, a) in enumerate(zip(questions, answers, strict=True)):
                    if rules.is_empty(a):
                        out.append(["empty"])
                        continue
                    found = ["wrong_language"] if wrong[i] else []
                    copied = rules.copies_question(a, q) or bool(rules.COPY_MARK.search(a))
                    if copied and q:
                        found = ["copied_question"]
                    elif declines[i] or (refuses[i] and not rules.short_answer(a)):
                        found.append("refusal")
                    elif not copied:
                        if truncation.breaks_off(a, noted, bool(at_limit[i])):
                            found.append("truncated")
                        elif len(noted.texts) > len(open_rows):
                            open_rows.append(i)
                    out.append(found)
                asked: list[list[int] | None] = [None] * len(out)
                contexts = model.asked(noted.texts)
                if isinstance(model, EndModel):
                    for i, may in zip(open_rows, model.may_ends(contexts), strict=True):
                        if not may:
                            out[i].append("truncated")
                else:
                    for i, x in zip(open_rows, contexts.view(np.int64).tolist(), strict=True):
                        asked[i] = x
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string())), pa.array(asked, pa.list_(pa.int64()))], [key, "defects", "asked"])

    return rows.mapInArrow(run, f"`{key}` {kind}, defects array<string>, asked array<bigint>")


def judge(pairs: DataFrame, key: str, limits: DataFrame | None, ends: Broadcast, languages: Broadcast | None, refusals: Broadcast | None = None) -> DataFrame:
    """(key, defects array) from (key, question, answer, source); truncated is left out for copies, refusals and empty answers.

    ends: a fitted EndModel. Without a model of refusals only phrases that certainly decline count.
    """
    return _judged(pairs, key, limits, ends, languages, refusals).select(key, "defects")


def judge_tables(parts: list[tuple[str, DataFrame, DataFrame | None]], key: str, known: list[tuple[DataFrame, str]], languages: Broadcast | None) -> DataFrame:
    """(table_name, key, defects array) of the (name, pairs, limits) parts, as judge; all models but the languages' are fitted on all texts of the (table, column) parts in known.

    Rows are judged once; those whose ending only counts decide wait for the counts of the contexts they ask for.
    """
    endings, refusals, texts = models(known)
    spark = parts[0][1].sparkSession
    ends, declines = broadcast(spark, endings), broadcast(spark, refusals)
    every = [_judged(pairs, key, limits, ends, languages, declines).select(F.lit(name).alias("table_name"), key, "defects", "asked") for name, pairs, limits in parts]
    rows = work_table(functools.reduce(DataFrame.unionAll, every), "judged")
    waiting = rows.where("asked is not null")
    late = waiting.join(answered(known, waiting, endings, texts), "asked")
    late = late.select("table_name", key, F.when(F.col("may_end"), F.col("defects")).otherwise(F.concat("defects", F.array(F.lit("truncated")))).alias("defects"))
    return rows.where("asked is null").drop("asked").unionAll(late)


def broadcast(spark: SparkSession, model: object) -> Broadcast:
    """Models are of bounded size: common words, language.BUCKETS and refusals.BUCKETS weights."""
    return spark.sparkContext.broadcast(model)
