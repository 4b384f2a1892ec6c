"""Reports over evaluated items: run report, step statistics, summaries by version and pair, wide sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.operators import align, votes



def mean_of(*columns: str):
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / len(columns)


def run_report(items: DataFrame) -> DataFrame:
    """One row: totals, scores, pass rate, reworks (F1), from items with question, answer, evaluation, rework_count."""
    e = F.col("evaluation")
    scored = e["total_score"].isNotNull()
    r = align.output_issues(items).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.size("issues") > 0).alias("items_with_errors"),
        F.count_if(scored).alias("scored_items"),
        F.round(F.avg(e["total_score"]), 2).alias("avg_score"),
        F.max(e["total_score"]).alias("max_score"),
        F.min(e["total_score"]).alias("min_score"),
        F.count_if(scored & e["passed"]).alias("pass_count"),
        F.coalesce(F.sum("rework_count"), F.lit(0)).cast("bigint").alias("total_reworks"),
        F.count_if(F.col("rework_count") > 0).alias("items_reworked"),
    )
    return r.withColumn("pass_rate", F.when(F.col("scored_items") > 0, F.format_string("%.1f%%", F.col("pass_count") * 100.0 / F.col("scored_items"))))


def failed_items(items: DataFrame) -> DataFrame:
    """Items that were evaluated and did not pass."""
    return items.where(F.col("evaluation").isNotNull() & ~F.col("evaluation.passed"))


def pending_items(items: DataFrame) -> DataFrame:
    """Items with an answer to judge."""
    return items.where(t.text("answer") != "")


def step_report(items: DataFrame) -> DataFrame:
    """One row: steps, correct steps, accuracy, coherence, share of right final answers, reworks (F5), from cot_evaluation."""
    e = F.col("cot_evaluation")
    r = items.where(e.isNotNull()).agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(e["total_steps"]), F.lit(0)).cast("bigint").alias("total_steps"),
        F.coalesce(F.sum(e["correct_steps"]), F.lit(0)).cast("bigint").alias("correct_steps"),
        F.round(F.avg(e["chain_coherence"]), 4).alias("avg_coherence"),
        F.round(F.avg(F.coalesce(e["final_answer_correct"], F.lit(False)).cast("double")), 4).alias("final_answer_rate"),
        F.count_if(F.col("rework_count") > 0).alias("reworked"),
    )
    return r.withColumn("step_accuracy", F.when(F.col("total_steps") > 0, F.round(F.col("correct_steps") / F.col("total_steps"), 4)).otherwise(0.0))


def single_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """By version: count, mean, dimension means, quality bins, uncertainty (F9), from single_rounds."""
    m = results.withColumn("_m", mean_of(*k.DIMENSIONS))
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("_m") + votes.NUDGE, 3).alias("mean_score"),
        *[F.round(F.avg(d) + votes.NUDGE, 3).alias(d) for d in k.DIMENSIONS],
        F.count_if(F.round("_m", 9) < 2.5).alias("low"),
        F.count_if((F.round("_m", 9) >= 2.5) & (F.round("_m", 9) < 3.5)).alias("mid"),
        F.count_if(F.round("_m", 9) >= 3.5).alias("high"),
        F.count_if("uncertain").alias("uncertain_count"),
        F.round(F.avg(F.col("uncertain").cast("double")) + votes.NUDGE, 3).alias("uncertain_rate"),
        F.round(F.avg("max_std") + votes.NUDGE, 3).alias("avg_max_std"),
    )


def pairwise_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: total, win and tie rates, mean agreement (F10), from pairwise_rounds."""
    n = F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        n.alias("total"),
        F.round(F.count_if(F.col("winner") == "A") / n, 6).alias("win_rate_a"),
        F.round(F.count_if(F.col("winner") == "B") / n, 6).alias("win_rate_b"),
        F.round(F.count_if(F.col("winner") == "tie") / n, 6).alias("tie_rate"),
        F.round(F.avg("agreement") + votes.NUDGE, 3).alias("avg_agreement"),
    )


def by_category(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """(category, total, a, b, tie) of pairwise results; prompts without a category count as unknown."""
    known = align.keep_last(prompts, ["prompt_id"], "text", "category")
    return results.join(known, "prompt_id", "left").groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"), F.count_if(~F.col("winner").isin("A", "B")).alias("tie"))


def version_table(results: DataFrame) -> DataFrame:
    """(model_version, total, mean, one mean for each dimension)."""
    return results.groupBy("model_version").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(mean_of(*k.DIMENSIONS)) + votes.NUDGE, 3).alias("mean"), *[F.round(F.avg(d) + votes.NUDGE, 3).alias(d) for d in k.DIMENSIONS])


def dimension_diff(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dim, mean_a, mean_b, diff, arrow): difference of the sides by dimension, flat within 0.1."""
    a = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"a_{d}").alias("a"), F.col(f"b_{d}").alias("b")) for d in k.DIMENSIONS]))
    g = results.select(*keys, a.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "dim").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    diff = F.round(F.col("a") - F.col("b"), 9)
    return g.select(*keys, "dim", F.round(F.col("a") + votes.NUDGE, 3).alias("mean_a"), F.round(F.col("b") + votes.NUDGE, 3).alias("mean_b"), F.round(F.col("a") - F.col("b") + votes.NUDGE, 3).alias("diff"), F.when(diff > 0.1, "↑").when(diff < -0.1, "↓").otherwise("≈").alias("arrow"))


def pairwise_sheet(results: DataFrame) -> DataFrame:
    """The 21 columns of the pairwise table (B6), from pairwise_rounds joined with one judged row's judge and reasoning."""
    mean = lambda s: F.round(mean_of(*[f"{s}_{d}" for d in k.DIMENSIONS]) + votes.NUDGE, 3)
    return results.select("prompt_id", "model_a", "model_b", "winner", *[f"a_{d}" for d in k.DIMENSIONS], mean("a").alias("a_mean"), *[f"b_{d}" for d in k.DIMENSIONS], mean("b").alias("b_mean"), F.col("agreement").alias("winner_agreement"), "judge_id", F.substring(t.text("reasoning"), 1, 200).alias("reasoning"))


def single_sheet(results: DataFrame) -> DataFrame:
    """The columns of the single table (B7), from single_rounds joined with full_profile."""
    worst = F.greatest("char_3", "char_4", "char_5")
    return results.select("prompt_id", "model_version", *k.DIMENSIONS, F.round(mean_of(*k.DIMENSIONS) + votes.NUDGE, 3).alias("mean"), "uncertain", "max_std", F.round(worst, 4).alias("repetition_worst"), F.col("template_ending_count").alias("template_count"), F.col("assistant_phrase_count").alias("assistant_count"), "paragraph_count", "sentence_count")


def wide_scores(long: DataFrame, key: str, label: str, count: int, columns: dict[str, str]) -> DataFrame:
    """(key, C1_x, C1_y, ..., Cn_z) from one row for each candidate (H9, B12): an aggregation over fixed labels."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(label) == f"C{i}", F.col(c))).alias(f"C{i}_{name}") for i in range(1, count + 1) for c, name in columns.items()])


def long_answer_summary(classes: DataFrame, score: str) -> DataFrame:
    """One row: mean, population std, issue rate of long answers (F18), from long_answer_classes."""
    return classes.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score) + votes.NUDGE, 3).alias("score_mean"), F.round(F.stddev_pop(score), 3).alias("score_std"), F.round(F.avg((F.size("issues") > 0).cast("double")), 3).alias("issue_rate"))


def class_distribution(classes: DataFrame) -> DataFrame:
    """(kind, value, n): histograms of issues, severity, structure and style in one pass."""
    pairs = F.concat(F.transform("issues", lambda x: F.struct(F.lit("issue").alias("kind"), x.alias("value"))), F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).alias("value")) for n, c in (("severity", "severity"), ("structure", "quality"), ("style", "diagnosis"))]))
    return classes.select(F.explode(pairs).alias("_p")).groupBy("_p.kind", "_p.value").agg(F.count(F.lit(1)).alias("n"))


def token_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, prompt_tokens, completion_tokens, total_tokens, per_call)."""
    g = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"), F.sum("completion_tokens").cast("bigint").alias("completion_tokens"))
    return g.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("per_call", F.round(F.col("total_tokens") / F.col("calls"), 2))


