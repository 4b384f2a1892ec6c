"""The three programs: corpus pipeline with a judge-and-rework loop, answer evaluation, format-quality batch.

Every round of the corpus pipeline is one job over the pending rows, stored before the next round
starts, so a lost executor repeats tasks, never finished calls.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as t
from siftloom.functions.idfilter import without
from siftloom.operators import align, anomaly, dedup, parse, profile, stats, summary, votes
from siftloom.plans import judging
from siftloom.session import work_table


@dataclasses.dataclass
class PipelineConfig:
    """Settings of the corpus pipeline; max_rework counts judging rounds, so there are at most max_rework - 1 reworks."""

    deduplicate: bool = True
    similarity: float = 0.85
    grade: bool = True
    pass_threshold: float = 7.0
    max_rework: int = 2
    temperature: float = 0.7


def prepare(corpus: DataFrame, config: PipelineConfig) -> DataFrame:
    """Deduplicated and graded items (pos, id, question, answer, difficulty_score, difficulty_level)."""
    items = corpus
    if config.deduplicate:
        dropped = work_table(dedup.dedup_status(items, "pos", "question", config.similarity).where("status <> 'keep'").select("pos"), "dropped")
        items = without(items, "pos", dropped)
    return profile.difficulty(items, "question") if config.grade else items


def rule_evaluation(items: DataFrame, threshold: float) -> DataFrame:
    """Adds evaluation (total_score, passed, suggestion) by the rule judge, on a scale to 10; blank answers get none."""
    scored = profile.rule_score(items, "answer")
    total = F.round(F.col("rule_score") * 2, 2)
    value = F.struct(total.alias("total_score"), (total >= threshold).alias("passed"), F.when(total >= threshold, "无").otherwise("请补充细节并避免重复").alias("suggestion"))
    return scored.withColumn("evaluation", F.when(t.text("answer") != "", value)).drop("length", "sentence_count", "rule_score")


def run(corpus: DataFrame, generator: judging.Model, config: PipelineConfig | None = None, evaluate=rule_evaluation) -> DataFrame:
    """Items with answer, evaluation and rework_count after all rounds.

    All answers are judged in each round; those that fail are generated again with the suggestion, until none fails or
    the rounds are used up. An item whose call fails keeps its answer. What is stored of a call is the new answer only, not
    the message and the old answer besides; rows that pass are not moved.
    """
    config = config or PipelineConfig()

    def asked(items: DataFrame, message: Column, name: str) -> DataFrame:
        """items, of which those with a reply have it as their answer, and replied."""
        calls = judging.answered(items.withColumn("message", message).withColumn("temperature", F.lit(config.temperature)), generator)
        return work_table(calls.withColumn("answer", F.coalesce("reply", t.text("answer"))).withColumn("replied", F.col("reply").isNotNull()).drop("message", "temperature", *judging.ADDED), name)

    columns = ["pos", "id", "question", "answer"]
    items = prepare(corpus, config).select(*columns, *(["difficulty_level"] if config.grade else []))
    state = asked(items, F.col("question"), "generated").drop("replied").withColumn("rework_count", F.lit(0))
    for number in range(1, config.max_rework + 1):
        before = state.columns
        state = work_table(evaluate(state, config.pass_threshold), f"judged-{number}")
        fails = F.coalesce(F.expr("evaluation is not null and not evaluation.passed"), F.lit(False))
        failed = state.where(fails)
        if number == config.max_rework or failed.limit(1).count() == 0:
            break
        again = asked(failed.select(*before, "evaluation"), F.concat("question", F.lit("\n\n"), "evaluation.suggestion"), f"rework-{number}")
        state = state.where(~fails).select(*before).unionByName(again.withColumn("rework_count", F.col("rework_count") + F.col("replied").cast("int")).select(*before))
    return state


def evaluate_outputs(outputs: DataFrame, prompts: DataFrame) -> dict[str, DataFrame]:
    """Single-mode evaluation with the offline judge: results, summary, anomalies, long-answer classes, lengths."""
    joined = align.single_join(outputs, prompts).drop("text", "category")
    judged = judging.rule_judgements(joined, "response")
    results = votes.single_rounds(judged, ["prompt_id", "model_version"], "scores")
    profiled = profile.full_profile(outputs, "response")
    return {
        "results": results,
        "summary": summary.single_summary(results, ["model_version"]),
        "versions": summary.version_table(results),
        "anomalies": anomaly.output_anomalies(outputs, ["model_version"], "response"),
        "long_answers": summary.class_distribution(profile.long_answer_classes(profiled)),
        "lengths": stats.basic(outputs.withColumn("length", F.char_length("response").cast("double")), ["model_version"], "length"),
    }


def format_quality(rows: DataFrame, judge: judging.Model, candidates: int = 8) -> DataFrame:
    """(id, subset, best, ranking, verdict_summary, error, one column for each candidate's dimension) from k-way merged rows."""
    from siftloom.functions.constants import FORMAT_SHEET

    asked = rows.withColumn("message", parse.user_message(F.col("instruction"), F.col("predictions"))).withColumn("temperature", F.lit(0.0))
    reply = judging.call(asked, judge, table="format-quality").withColumn("_j", parse.lenient_json("reply"))
    kinds = ",".join(f"{d}:string" for d in FORMAT_SHEET)
    parsed = reply.withColumn("_e", F.from_json(F.get_json_object("_j", "$.evaluations"), f"array<struct<label:string,{kinds}>>"))
    entry = lambda i: F.coalesce(F.get(F.filter("_e", lambda x: x["label"] == f"C{i}"), F.lit(0)), F.get("_e", F.lit(i - 1)))
    cells = [entry(i)[d].alias(f"C{i}_{name}") for i in range(1, candidates + 1) for d, name in FORMAT_SHEET.items()]
    return parsed.select("id", "subset", F.substring("instruction", 1, 500).alias("instruction_preview"), F.get_json_object("_j", "$.best").alias("best"), F.get_json_object("_j", "$.ranking").alias("ranking"), F.get_json_object("_j", "$.verdict_summary").alias("verdict_summary"), F.coalesce("error", F.when(F.col("_j").isNull(), "reply is no JSON")).alias("error"), *cells)
