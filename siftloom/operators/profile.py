"""Text profiles of generated answers, rule judge, rule corrections, long-answer classes, difficulty.

Every operator adds columns to its input, keeps all rows, and treats a null text as empty. The
n-gram rates of a text come from one pass over whole Arrow batches; all else stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import ngrams
from siftloom.functions import text as t

SIZES = ngrams.SIZES


def repetition_profile(df: DataFrame, column: str) -> DataFrame:
    """char_3..5, word_3..5 (equal to the character rates under the fallback tokens), half_split_repeat, total_chars.

    half_split_repeat is the 4-gram rate of the whole text, whatever its name suggests.
    """
    out = df.withColumn("_r", ngrams.repetition(t.text(column)))
    for name in ("char", "word"):
        for n in SIZES:
            out = out.withColumn(f"{name}_{n}", F.round(F.col(f"_r.char_{n}") + 1e-12, 4))
    return out.withColumn("half_split_repeat", F.when(F.char_length(t.text(column)) > 1, F.col("char_4")).otherwise(0.0)).withColumn("total_chars", t.count_chars(column)).drop("_r")


def worst_rate() -> Column:
    return F.greatest(*[F.col(f"char_{n}") for n in SIZES])


def worst_name() -> Column:
    """The first of the highest rates in the order char3, word3, char4, word4, char5, word5."""
    return F.when(F.col("char_3") == worst_rate(), "char_3gram").when(F.col("char_4") == worst_rate(), "char_4gram").otherwise("char_5gram")


def structure_profile(df: DataFrame, column: str) -> DataFrame:
    """Counts of paragraphs, sentences, headings and list items, mean and deviation of paragraph lengths."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    spread = lambda a, m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.greatest(F.size(a), F.lit(1)))
    measure = t.let(t.paragraph_lengths(column), lambda a: t.let(total(a) / F.greatest(F.size(a), F.lit(1)), lambda m: F.struct(F.size(a).alias("n"), m.alias("mean"), spread(a, m).alias("std"))))
    return (
        df.withColumn("_p", measure)
        .withColumn("paragraph_count", F.col("_p.n").cast("bigint"))
        .withColumn("sentence_count", t.sentence_count(column))
        .withColumn("avg_paragraph_length", F.round("_p.mean", 1))
        .withColumn("paragraph_length_std", F.round("_p.std", 1))
        .withColumn("heading_count", t.headings(column))
        .withColumn("list_item_count", t.list_items(column))
        .withColumn("chars_per_sentence", F.round(t.count_chars(column) / F.greatest(F.col("sentence_count"), F.lit(1)), 1))
        .drop("_p")
    )


def style_profile(df: DataFrame, column: str, endings: list[str] | None = None) -> DataFrame:
    """Template endings and assistant phrases with their counts."""
    return (
        df.withColumn("template_endings", t.template_endings(column, endings or k.EVALUATOR_ENDINGS))
        .withColumn("template_ending_count", F.size("template_endings").cast("bigint"))
        .withColumn("assistant_phrases", t.assistant_phrases(column))
        .withColumn("assistant_phrase_count", F.size("assistant_phrases").cast("bigint"))
    )


def full_profile(df: DataFrame, column: str) -> DataFrame:
    return style_profile(structure_profile(repetition_profile(df, column), column), column)


def analysis_text(df: DataFrame, column: str, label: str = "", most: int | None = None) -> DataFrame:
    """The profile as lines for a judge's prompt (I13); needs the columns of full_profile.

    label names the answer; texts of more than most characters are shown cut and get a notice.
    """
    listed = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    notice = F.concat(F.lit("- [注意] 原文较长("), F.col("total_chars"), F.lit("字)，已截断展示，以下统计数据基于全文"))
    percent = lambda c: F.format_string("%.2f%%", c * 100)
    lines = F.concat_ws(
        "\n",
        F.lit("## 规则预分析报告" + (f"（回答 {label}）" if label else "")),
        F.when(F.char_length(t.text(column)) > most, notice) if most else F.lit(None),
        F.concat(F.lit("- 总字数: "), F.col("total_chars")),
        F.concat(F.lit("- 最高 n-gram 重复率: "), worst_name(), F.lit(" = "), percent(worst_rate())),
        F.concat(F.lit("- 前后半段重复率: "), percent(F.col("half_split_repeat"))),
        F.concat(F.lit("- 段落数 "), F.col("paragraph_count"), F.lit(", 句子数 "), F.col("sentence_count"), F.lit(", 平均段落长度 "), F.format_string("%.1f", F.col("avg_paragraph_length")), F.lit(" 字")),
        F.when(F.col("heading_count") > 0, F.concat(F.lit("- Markdown 标题 "), F.col("heading_count"), F.lit(" 个"))),
        F.when(F.col("list_item_count") > 0, F.concat(F.lit("- 列表项 "), F.col("list_item_count"), F.lit(" 个"))),
        F.when(F.col("template_ending_count") > 0, F.concat(F.lit("- [警告] 模板化结尾: "), listed("template_endings"))),
        F.when(F.col("assistant_phrase_count") > 0, F.concat(F.lit("- [警告] 助手化用语: "), listed("assistant_phrases"))),
    )
    return df.withColumn("analysis", lines)


def rule_corrections(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores repetition and naturalness lowered by the rules, with floor 1 (I14); needs the columns of full_profile."""
    worst = worst_rate()
    repetition = F.when(worst > threshold, F.greatest(F.lit(1.0), F.col("repetition") - F.least(F.lit(2.0), (worst - threshold) * 5))).otherwise(F.col("repetition"))
    tpl, ast = F.col("template_ending_count"), F.col("assistant_phrase_count")
    natural = F.when(tpl > 0, F.greatest(F.lit(1.0), F.col("naturalness") - 0.5 * tpl)).otherwise(F.col("naturalness"))
    natural = F.when(ast > 2, F.greatest(F.lit(1.0), natural - 0.3 * F.least(ast, F.lit(5)))).otherwise(natural)
    return df.withColumn("repetition_corrected", repetition).withColumn("naturalness_corrected", natural)


def rule_score(df: DataFrame, column: str, threshold: float = 0.3, shortest: int = 50, longest: int = 50000) -> DataFrame:
    """Score 1 to 5 by rules alone (I15); also the offline judge."""
    rate = t.char_repetition(column, 4)
    out = df.withColumn("length", t.count_chars(column)).withColumn("sentence_count", t.sentence_count(column)).withColumn("_rate", rate)
    tpl = F.size(t.template_endings(column))
    ast = F.size(t.assistant_phrases(column))
    score = (
        F.lit(5.0)
        - F.when(~F.col("length").between(shortest, longest), 1.5).otherwise(0.0)
        - F.when(F.col("_rate") >= threshold, F.least(F.lit(2.0), (F.col("_rate") - threshold) * 5)).otherwise(0.0)
        - 0.5 * tpl
        - 0.3 * F.least(ast, F.lit(3))
        - F.when((F.col("sentence_count") < 3) & (F.col("length") > 100), 0.5).otherwise(0.0)
    )
    return out.withColumn("rule_score", F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), score)), 2)).drop("_rate")


def rule_winner(a: Column, b: Column) -> Column:
    """A or B if its rule score is more than 0.2 higher, else tie (I16); compared on the rounded scores."""
    return F.when(a > b + 0.2, "A").when(b > a + 0.2, "B").otherwise("tie")


def long_answer_classes(df: DataFrame) -> DataFrame:
    """Severity of repetition, balance, structure, style diagnosis and issues (I23); needs the columns of full_profile."""
    worst, mean, std = worst_rate(), F.col("avg_paragraph_length"), F.col("paragraph_length_std")
    para, sent = F.col("paragraph_count"), F.col("sentence_count")
    tpl, ast = F.col("template_ending_count"), F.col("assistant_phrase_count")
    out = (
        df.withColumn("severity", F.when(worst > 0.5, "critical").when(worst > 0.3, "high").when(worst > 0.15, "moderate").otherwise("normal"))
        .withColumn("balance", F.when(mean == 0, "unknown").when(std / F.nullif(mean, F.lit(0.0)) > 1.5, "unbalanced").when(std / F.nullif(mean, F.lit(0.0)) > 0.8, "moderate").otherwise("balanced"))
        .withColumn("quality", F.when((para <= 1) & (sent > 5), "poor").when((para >= 3) & (sent >= 5), "good").otherwise("acceptable"))
        .withColumn("diagnosis", F.when((tpl > 2) & (ast > 3), k.DIAGNOSES["both"]).when(tpl > 1, k.DIAGNOSES["template"]).when(ast > 2, k.DIAGNOSES["assistant"]).otherwise(k.DIAGNOSES["normal"]))
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("severity").isin("high", "critical"), k.ISSUES["repetition"]),
            F.when(tpl > 1, k.ISSUES["template"]),
            F.when(ast > 2, k.ISSUES["assistant"]),
            F.when(F.col("quality") == "poor", k.ISSUES["structure"]),
        )
    )
    return out.withColumn("issues", issues)


def difficulty(df: DataFrame, column: str) -> DataFrame:
    """difficulty_score, difficulty_level and signals: the keywords found, and long, dense or many-part questions."""
    low, raw = F.lower(t.text(column)), t.text(column)
    found = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w)))
    formulas = F.regexp_count(raw, F.lit(r"\$[^$]+\$")) + F.regexp_count(raw, F.lit(r"(?d)\\\(.*?\\\)"))
    signals = F.concat(
        found(k.HARD_WORDS), found(k.MEDIUM_WORDS), found(k.EASY_WORDS),
        F.array_compact(F.array(F.when(formulas >= 3, "formulas"), F.when(F.char_length(raw) > 300, "long"), F.when(F.regexp_count(raw, F.lit("[？?]")) >= 3, "parts"))),
    )
    return df.withColumn("difficulty_score", t.difficulty_score(column)).withColumn("difficulty_level", t.level_of(F.col("difficulty_score"))).withColumn("signals", signals)
