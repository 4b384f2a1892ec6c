"""Aggregation of repeated judgements: medians, votes, double scores, agreement, self-consistency.

Votes are counted by (key, value) with a map-side combine before they are ranked, so no list of a
group's rows is ever built. Ties go to "tie" or to the value seen first, as each rule says; first
seen means the smallest position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k

#: Added before rounding, so that halves are rounded up whatever their binary form.
NUDGE = 1e-9


def long_scores(df: DataFrame, keys: list[str], scores: str) -> DataFrame:
    """(keys, dim, score) of a score struct; a missing struct or score counts as 0."""
    stack = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(f"{scores}.{d}"), F.lit(0.0)).alias("score")) for d in k.DIMENSIONS]))
    return df.select(*keys, stack.alias("_d")).select(*keys, "_d.*")


def single_rounds(df: DataFrame, keys: list[str], scores: str, uncertain: float = 1.5) -> DataFrame:
    """(keys, one median for each dimension, num_rounds, max_std, uncertain) of repeated single judgements."""
    value = lambda d: F.coalesce(F.col(f"{scores}.{d}"), F.lit(0.0))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_rounds"), *[F.median(value(d)).alias(d) for d in k.DIMENSIONS], F.greatest(*[F.stddev_pop(value(d)) for d in k.DIMENSIONS]).alias("_std"))
    return out.select(*keys, *[F.round(F.col(d) + NUDGE, 1).alias(d) for d in k.DIMENSIONS], "num_rounds", F.round(F.col("_std") + NUDGE, 3).alias("max_std"), (F.round("_std", 9) > uncertain).alias("uncertain"))


def vote_counts(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))


def plurality(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """(keys, winner, agreement, num_rounds): the value with most votes, tie if two lead (F8)."""
    best = vote_counts(df, keys, value, pos).groupBy(*keys).agg(F.max("n").alias("top"), F.sum("n").alias("num_rounds"), F.max_by(value, F.struct("n", -F.col("first"))).alias("best"), F.array_sort(F.collect_list(-F.col("n"))).alias("ns"))
    alone = (F.size("ns") == 1) | (F.col("ns")[0] < F.get("ns", F.lit(1)))
    return best.select(*keys, F.when(alone, F.col("best")).otherwise("tie").alias("winner"), F.round(F.col("top") / F.col("num_rounds") + NUDGE, 3).alias("agreement"), "num_rounds")


def pairwise_rounds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Plurality winner with the medians of both sides (F8), from decoded rows with winner, scores_a, scores_b."""
    value = lambda s, d: F.coalesce(F.col(f"scores_{s}.{d}"), F.lit(0.0))
    medians = df.groupBy(*keys).agg(*[F.round(F.median(value(s, d)) + NUDGE, 1).alias(f"{s}_{d}") for s in "ab" for d in k.DIMENSIONS], F.count_if(F.coalesce("position_swapped", F.lit(False))).alias("position_swaps"))
    return plurality(df, keys, "winner", "row_id").join(medians, keys)


def majority(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner): A or B if it has more votes than each other outcome, else tie."""
    c = df.groupBy(*keys).agg(F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"), F.count_if(F.col("winner") == "tie").alias("t"))
    return c.select(*keys, F.when((F.col("a") > F.col("b")) & (F.col("a") > F.col("t")), "A").when((F.col("b") > F.col("a")) & (F.col("b") > F.col("t")), "B").otherwise("tie").alias("winner"))


def mean_score(side: str) -> Column:
    """Mean of the six dimensions of a score struct, missing ones as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{side}.{d}"), F.lit(0.0)) for d in k.DIMENSIONS]) / len(k.DIMENSIONS)


def average_rounds(df: DataFrame, keys: list[str], margin: float = 0.1) -> DataFrame:
    """(keys, mean_a, mean_b, winner): the side whose mean score is more than margin higher."""
    m = df.groupBy(*keys).agg(F.avg(mean_score("scores_a")).alias("mean_a"), F.avg(mean_score("scores_b")).alias("mean_b"))
    diff = F.round(F.col("mean_a") - F.col("mean_b"), 9)
    return m.select(*keys, F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.when(diff > margin, "A").when(diff < -margin, "B").otherwise("tie").alias("winner"))


def judge_majority(df: DataFrame, keys: list[str], pos: str = "row_id") -> DataFrame:
    """(keys, winner, judges): most votes, the first seen of equals; no two judges agreeing among more than two gives tie."""
    c = vote_counts(df, keys, "winner", pos).groupBy(*keys).agg(F.max_by("winner", F.struct("n", -F.col("first"))).alias("best"), F.max("n").alias("top"), F.sum("n").alias("judges"))
    return c.select(*keys, F.when((F.col("top") == 1) & (F.col("judges") > 2), "tie").otherwise(F.col("best")).alias("winner"), "judges")


def judge_weighted(df: DataFrame, keys: list[str], primary: str, weight: float = 2.0, margin: float = 0.5) -> DataFrame:
    """(keys, winner): votes weighted, the primary judge more; a lead below margin gives tie (F14). Unknown winners count as ties."""
    w = F.when(F.col("judge_id") == primary, weight).otherwise(1.0)
    kind = F.when(F.col("winner").isin("A", "B"), F.col("winner")).otherwise("tie")
    c = df.groupBy(*keys).agg(*[F.sum(F.when(kind == v, w).otherwise(0.0)).alias(v) for v in ("A", "B", "tie")])
    order = F.array_sort(F.array(*[F.struct((-F.col(v)).alias("w"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(("A", "B", "tie"))]))
    return c.withColumn("_o", order).select(*keys, F.when(F.col("_o")[1]["w"] - F.col("_o")[0]["w"] < margin, "tie").otherwise(F.col("_o")[0]["v"]).alias("winner"))


def judge_conservative(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner, unanimous): the judges' common winner, else tie."""
    c = df.groupBy(*keys).agg(F.min("winner").alias("lo"), F.max("winner").alias("hi"))
    return c.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("tie").alias("winner"), (F.col("lo") == F.col("hi")).alias("unanimous"))


def judge_agreement(df: DataFrame, keys: list[str], pos: str = "row_id") -> DataFrame:
    """(judge_1, judge_2, shared, agreement) for each pair of judges over what both judged (F16); the first verdict of a judge counts.

    Verdicts of one comparison are joined by their key; with the few judges a comparison has, pairs stay few.
    """
    one = df.groupBy(*keys, "judge_id").agg(F.min_by("winner", pos).alias("winner"))
    a, b = one.withColumnsRenamed({"judge_id": "judge_1", "winner": "w1"}), one.withColumnsRenamed({"judge_id": "judge_2", "winner": "w2"})
    return a.join(b, keys).where("judge_1 < judge_2").groupBy("judge_1", "judge_2").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg((F.col("w1") == F.col("w2")).cast("double")), 6).alias("agreement"))


def unanimous_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """(comparisons, unanimous, rate) over all comparisons (F16)."""
    c = judge_conservative(df, keys)
    return c.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if("unanimous").alias("unanimous"), F.round(F.coalesce(F.avg(F.col("unanimous").cast("double")), F.lit(0.0)), 6).alias("rate"))


def self_consistency(df: DataFrame, keys: list[str], answer: str, pos: str, least: float = 0.6) -> DataFrame:
    """(keys, best_answer, confidence, is_consistent, paths): the most frequent answer, the first seen of equals."""
    c = vote_counts(df, keys, answer, pos).groupBy(*keys).agg(F.max_by(answer, F.struct("n", -F.col("first"))).alias("best_answer"), F.max("n").alias("top"), F.sum("n").alias("paths"))
    return c.select(*keys, "best_answer", F.round(F.col("top") / F.col("paths") + NUDGE, 2).alias("confidence"), (F.col("top") / F.col("paths") >= least).alias("is_consistent"), "paths")


def weighted_total(dimensions: Column | str) -> Column:
    """Sum of score times the dimension's weight (F2)."""
    c = F.col(dimensions) if isinstance(dimensions, str) else dimensions
    weight = lambda d: reduce(lambda acc, kv: acc.when(d == kv[0], kv[1]), k.DIMENSION_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(k.OTHER_WEIGHT)
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["score"], F.lit(0.0)) * weight(x["dimension"]))


def double_score(df: DataFrame, a: str, b: str, arbiter: str | None = None, gap: float = 2.0) -> DataFrame:
    """Adds merged_total, merged_passed, merged_dimensions, merged_suggestion of two evaluations.

    More than gap apart, the arbiter alone counts (null without one); else the mean, passed only by both, and the
    first suggestion unless it says none. Dimensions pair by position up to the shorter list, scores averaged to one
    decimal, the first reason unless it is blank; if none pair, the first evaluation's stay.
    """
    one, two = F.col(f"{a}.dimensions"), F.col(f"{b}.dimensions")
    both = F.least(F.size(F.coalesce(one, F.array().cast(df.schema[a].dataType["dimensions"].dataType))), F.size(F.coalesce(two, F.array().cast(df.schema[b].dataType["dimensions"].dataType))))
    pair = lambda x, y: F.struct(x["dimension"].alias("dimension"), F.round((F.coalesce(x["score"], F.lit(0.0)) + F.coalesce(y["score"], F.lit(0.0))) / 2 + NUDGE, 1).alias("score"), F.when(F.coalesce(x["reason"], F.lit("")) != "", x["reason"]).otherwise(y["reason"]).alias("reason"))
    merged = F.when(both > 0, F.zip_with(F.slice(one, F.lit(1), both), F.slice(two, F.lit(1), both), pair)).otherwise(one)
    apart = F.abs(F.col(f"{a}.total_score") - F.col(f"{b}.total_score")) > gap
    third = lambda f: F.col(f"{arbiter}.{f}") if arbiter else F.lit(None)
    none = F.coalesce(F.col(f"{a}.suggestion"), F.lit("")).isin("", k.NO_SUGGESTION)
    return df.withColumns(
        {
            "merged_total": F.when(apart, third("total_score")).otherwise(F.round((F.col(f"{a}.total_score") + F.col(f"{b}.total_score")) / 2, 2)),
            "merged_passed": F.when(apart, third("passed")).otherwise(F.col(f"{a}.passed") & F.col(f"{b}.passed")),
            "merged_dimensions": F.when(apart, third("dimensions")).otherwise(merged),
            "merged_suggestion": F.when(apart, third("suggestion")).when(none, F.col(f"{b}.suggestion")).otherwise(F.col(f"{a}.suggestion")),
        }
    )


def step_stats(df: DataFrame, steps: str, checks: str, threshold: float = 7.0) -> DataFrame:
    """Adds correct_steps, first_error_step, step_accuracy and step_passed from step verifications.

    checks is an array of (step_number, is_correct), overall_score and final_answer_correct columns as in the reply;
    a missing overall score is ten times the accuracy.
    """
    right = F.size(F.filter(F.coalesce(F.col(checks), F.array().cast(df.schema[checks].dataType)), lambda x: x["is_correct"]))
    wrong = F.filter(F.col(checks), lambda x: ~x["is_correct"])
    n = F.size(F.coalesce(F.col(steps), F.array().cast(df.schema[steps].dataType)))
    accuracy = F.when(n == 0, 0.0).otherwise(right / n)
    overall = F.coalesce(F.col("overall_score"), accuracy * 10) if "overall_score" in df.columns else accuracy * 10
    final = F.coalesce(F.col("final_answer_correct"), F.lit(False)) if "final_answer_correct" in df.columns else F.lit(False)
    return df.withColumn("correct_steps", right).withColumn("first_error_step", F.get(wrong, F.lit(0))["step_number"]).withColumn("step_accuracy", F.round(accuracy, 4)).withColumn("step_passed", (overall >= threshold) & final)


def temperatures(n: int, base: float = 0.7, spread: float = 0.3) -> list[float]:
    """Sampling temperatures around base, rounded and clamped."""
    return [max(0.1, min(1.2, round(base + (i - n // 2) * (spread / n), 2))) for i in range(n)]
