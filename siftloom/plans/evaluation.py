"""Evaluation programs with a model as judge: single answers and pairs over several rounds, corpus items scored twice.

Every call is stored before anything is read from it; a failed call or a reply without JSON is left out of its
round, never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.operators import align, parse, summary, votes
from siftloom.plans import judging

#: The messages that ask for a score and for an arbiter's one; the arbiter's says what the two calls gave.
SCORE_MESSAGE = ("请评估以下问答对的答案质量：\n\n## 问题\n", "\n\n## 回答\n")
ARBITER_MESSAGE = ("以下是两位评审员对同一问答的评分，请你作为仲裁员给出最终评分：\n\n## 问题\n", "\n\n## 回答\n", "\n\n## 评审 A 评分: ", "\n## 评审 B 评分: ", "\n\n请综合两方意见，输出你的最终评分。")
#: Temperature of the first call, what the second one adds, and its highest.
TEMPERATURE, HOTTER, HOTTEST = 0.3, 0.15, 0.6

EVALUATION = "dimensions array<struct<dimension:string,score:double,reason:string>>, total_score double, suggestion string"


def judge_answers(outputs: DataFrame, prompts: DataFrame, judge: judging.Model, rounds: int = 3) -> dict[str, DataFrame]:
    """Single mode: every answer judged several times at rising temperatures; medians over the rounds that gave scores."""
    joined = align.single_join(outputs, prompts)
    asked = judging.rounds(joined, rounds).withColumn("message", F.concat(F.lit("## 问题\n"), t.text("text"), F.lit("\n\n## 回答\n"), t.text("response")))
    replied = judging.call(asked, judge, table="judged").where(parse.lenient_json("reply").isNotNull())
    results = votes.single_rounds(judging.parsed_scores(replied), ["prompt_id", "model_version"], "scores")
    return {"results": results, "summary": summary.single_summary(results, ["model_version"]), "usage": usage(replied, ["model_version"])}


def judge_pairs(outputs: DataFrame, prompts: DataFrame, baseline: str, candidate: str, judge: judging.Model, rounds: int = 3) -> dict[str, DataFrame]:
    """Pairwise mode: both answers to a prompt compared in several rounds, exchanged in every other one.

    Winners and scores are turned back to the models before the rounds' plurality and medians are taken.
    """
    asked = judging.pairwise_messages(align.align_pair(outputs, prompts, baseline, candidate), rounds)
    replied = judging.call(asked, judge, table="compared").withColumn("_json", parse.lenient_json("reply")).where("_json is not null")
    side = lambda s: F.struct(*[parse.score_of("_json", d, f"scores_{s}").alias(d) for d in k.DIMENSIONS]).alias(f"scores_{s}")
    winner = replied.withColumn("_w", F.get_json_object("_json", "$.winner"))
    read = winner.select("prompt_id", F.col("round").alias("row_id"), "position_swapped", F.coalesce(align.clean_winner("_w"), F.lit("tie")).alias("winner"), side("a"), side("b"))
    results = votes.pairwise_rounds(align.decode_blind(read), ["prompt_id"])
    named = results.withColumns({"model_a": F.lit(baseline), "model_b": F.lit(candidate)})
    return {"results": named, "summary": summary.pairwise_summary(named, ["model_a", "model_b"]), "usage": usage(replied, ["round"])}


def usage(replied: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, prompt_chars, completion_chars) of stored calls."""
    return replied.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_chars").alias("prompt_chars"), F.sum("completion_chars").alias("completion_chars"))


def _evaluation(reply: str, threshold: float) -> Column:
    """(total_score, passed, dimensions, suggestion) of a reply; null if it holds no JSON. Dimensions give the total if there are any."""
    parsed = F.from_json(parse.lenient_json(reply), EVALUATION)

    def read(r: Column) -> Column:
        dims = F.coalesce(r["dimensions"], F.array().cast("array<struct<dimension:string,score:double,reason:string>>"))
        total = F.when(F.size(dims) > 0, votes.weighted_total(dims)).otherwise(F.coalesce(r["total_score"], F.lit(0.0)))
        return F.when(r.isNotNull(), F.struct(F.round(total, 2).alias("total_score"), (total >= threshold).alias("passed"), dims.alias("dimensions"), t.text(r["suggestion"]).alias("suggestion")))

    return t.let(parsed, read)


def score_twice(items: DataFrame, judge: judging.Model, threshold: float = 7.0) -> DataFrame:
    """Adds evaluation to items (pos, question, answer): the mean of two calls, or an arbiter's if they are more than 2 apart.

    One failed call leaves the other's result; with both failed the evaluation is null.
    """
    message = F.concat(F.lit(SCORE_MESSAGE[0]), t.text("question"), F.lit(SCORE_MESSAGE[1]), t.text("answer"))
    second = min(TEMPERATURE + HOTTER, HOTTEST)
    asked = items.withColumn("message", message).select("pos", "message", F.explode(F.array(F.lit(TEMPERATURE), F.lit(second))).alias("temperature"))
    read = judging.call(asked, judge, table="scored").select("pos", "temperature", _evaluation("reply", threshold).alias("e"))
    two = read.groupBy("pos").agg(F.max(F.when(F.col("temperature") == TEMPERATURE, F.struct("e"))).alias("x"), F.max(F.when(F.col("temperature") != TEMPERATURE, F.struct("e"))).alias("y"))
    both = items.join(two.select("pos", F.coalesce("x.e", "y.e").alias("_a"), F.coalesce("y.e", "x.e").alias("_b")), "pos")
    apart = both.where(F.abs(F.col("_a.total_score") - F.col("_b.total_score")) > 2.0)
    parts = ARBITER_MESSAGE
    third = F.concat(F.lit(parts[0]), t.text("question"), F.lit(parts[1]), t.text("answer"), F.lit(parts[2]), t.one_decimal(F.col("_a.total_score")), F.lit(parts[3]), t.one_decimal(F.col("_b.total_score")), F.lit(parts[4]))
    settled = judging.call(apart.select("pos", third.alias("message"), F.lit(TEMPERATURE).alias("temperature")), judge, table="arbitrated").select("pos", _evaluation("reply", threshold).alias("_c"))
    merged = votes.double_score(both.join(settled, "pos", "left"), "_a", "_b", "_c")
    value = F.struct(F.col("merged_total").alias("total_score"), F.col("merged_passed").alias("passed"), F.col("merged_dimensions").alias("dimensions"), F.col("merged_suggestion").alias("suggestion"))
    return merged.withColumn("evaluation", F.when(F.col("_a").isNotNull(), value)).drop("_a", "_b", "_c", *[c for c in merged.columns if c.startswith("merged_")])
