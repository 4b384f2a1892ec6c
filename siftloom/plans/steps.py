"""Step-by-step answers: generation, verification, rework, and self-consistency by sampling; and the planner's call."""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as t
from siftloom.operators import parse, votes
from siftloom.plans import judging
from siftloom.session import work_table

STEPS = "thinking string, steps array<struct<step_number:int,step_type:string,content:string,formula:string>>, final_answer string"
CHECKS = "step_verifications array<struct<step_number:int,is_correct:boolean,error_type:string,explanation:string,suggested_fix:string>>, chain_coherence double, final_answer_correct boolean, overall_score double, suggestion string"

#: The kinds of task and domains that a plan may name.
TASKS, DOMAINS = ("generate", "evaluate"), ("math", "physics", "chemistry", "biology", "code", "general")


@dataclasses.dataclass
class Plan:
    """What the planner decides: task, domain, constraints, prompts by role."""

    task_type: str = "generate"
    domain: str = "general"
    constraints: list[dict[str, str]] = dataclasses.field(default_factory=list)
    prompts: dict[str, str] = dataclasses.field(default_factory=dict)


def first_samples(items: DataFrame, pos: str = "pos", count: int = 5) -> DataFrame:
    """The first items by position, shown to the planner (C11, H5)."""
    return items.orderBy(pos).limit(count)


def plan(model: judging.Model, instruction: str, samples: list[str], mode: str | None = None) -> Plan:
    """One call on the driver (L2): the reply's JSON, with unknown tasks and domains replaced; a given mode is authoritative."""
    reply = model.ask(instruction + "\n\n" + "\n".join(samples), 0.0)
    found = re.search(r"\{.*\}", reply, re.S)
    try:
        got = json.loads(found.group()) if found else {}
    except ValueError:
        got = {}
    task, domain = got.get("task_type"), got.get("domain")
    return Plan(mode or (task if task in TASKS else "generate"), domain if domain in DOMAINS else "general", got.get("constraints") or [], {k: v for k, v in got.items() if k.endswith("_prompt") and isinstance(v, str)})


def generate_steps(items: DataFrame, generator: judging.Model, temperature: float = 0.7, table: str = "steps") -> DataFrame:
    """Adds cot_steps, final_answer and the rendered answer (L5); an item whose reply is no JSON gets none."""
    asked = (items if "message" in items.columns else items.withColumn("message", F.col("question"))).withColumn("temperature", F.lit(temperature))
    got = judging.call(asked, generator, table=table).withColumn("_r", F.from_json(parse.lenient_json("reply"), STEPS))
    out = got.withColumn("cot_steps", F.col("_r.steps")).withColumn("final_answer", F.coalesce("_r.final_answer", F.lit("")))
    rendered = parse.render_steps(F.col("_r.thinking"), F.col("cot_steps"), F.col("final_answer"))
    return out.withColumn("answer", F.when(F.col("cot_steps").isNotNull(), rendered).otherwise(F.lit(""))).drop("_r", "message", "temperature", *judging.ADDED)


def verify_steps(items: DataFrame, judge: judging.Model, threshold: float = 7.0, table: str = "verified") -> DataFrame:
    """Adds cot_evaluation for items with steps (F4), from the judge's reply; reference is the expected answer, if there is one."""
    reference = F.when(t.text("reference") != "", F.concat(F.lit("\n参考答案: "), "reference")).otherwise("") if "reference" in items.columns else F.lit("")
    asked = items.where("cot_steps is not null").withColumn("message", F.concat("question", F.lit("\n\n"), "answer", reference)).withColumn("temperature", F.lit(0.3))
    got = judging.call(asked, judge, table=table).withColumn("_r", F.from_json(parse.lenient_json("reply"), CHECKS))
    flat = got.withColumns({"_checks": F.coalesce("_r.step_verifications", F.array().cast(CHECKS.split(" ", 1)[1].split(", chain_coherence")[0])), "overall_score": F.col("_r.overall_score"), "final_answer_correct": F.col("_r.final_answer_correct")})
    scored = votes.step_stats(flat, "cot_steps", "_checks", threshold)
    value = F.struct(
        F.size("cot_steps").alias("total_steps"), "correct_steps", "first_error_step", "step_accuracy", F.coalesce("overall_score", F.col("step_accuracy") * 10).alias("overall_score"), F.col("step_passed").alias("passed"),
        F.coalesce("_r.chain_coherence", F.lit(0.0)).alias("chain_coherence"), F.coalesce("final_answer_correct", F.lit(False)).alias("final_answer_correct"), t.text("_r.suggestion").alias("suggestion"), F.col("_checks").alias("step_verifications"),
    )
    judged = scored.select("pos", F.when(F.col("_r").isNotNull(), value).alias("cot_evaluation"))
    return items.drop("cot_evaluation").join(judged, "pos", "left")


def run(items: DataFrame, generator: judging.Model, judge: judging.Model, max_rework: int = 2, threshold: float = 7.0) -> DataFrame:
    """Items (pos, id, question) with steps, answer, cot_evaluation and rework_count after all rounds; only items with steps are reworked."""
    state = generate_steps(items, generator).withColumn("rework_count", F.lit(0))
    for number in range(1, max_rework + 1):
        state = work_table(verify_steps(state, judge, threshold, f"verified-{number}"), f"steps-{number}")
        failed = state.where("cot_evaluation is not null and not cot_evaluation.passed and cot_steps is not null")
        if number == max_rework or failed.limit(1).count() == 0:
            break
        again = generate_steps(failed.withColumn("message", F.concat("question", F.lit("\n\n"), parse.render_feedback("cot_evaluation", "cot_evaluation.step_verifications"))), generator, table=f"steps-rework-{number}").where("cot_steps is not null")
        new = again.select("pos", F.struct("answer", "cot_steps", "final_answer").alias("_n"))
        pick = lambda c: F.coalesce(f"_n.{c}", c).alias(c)
        kept = [c for c in state.columns if c not in ("answer", "cot_steps", "final_answer", "rework_count", "cot_evaluation")]
        state = state.join(new, "pos", "left").select(*kept, pick("answer"), pick("cot_steps"), pick("final_answer"), (F.col("rework_count") + F.col("_n").isNotNull().cast("int")).alias("rework_count"))
    return state


def self_consistency(items: DataFrame, generator: judging.Model, paths: int = 5) -> DataFrame:
    """(pos, best_answer, confidence, is_consistent, paths): the most frequent of several sampled answers."""
    temperatures = F.array(*[F.lit(x) for x in votes.temperatures(paths)])
    asked = items.select("pos", F.col("question").alias("message"), F.posexplode(temperatures).alias("path", "temperature"))
    got = judging.call(asked, generator, table="paths").where("reply is not null")
    answers = got.select("pos", "path", t.normalize_answer(t.extract_answer("reply")).alias("answer"))
    return votes.self_consistency(answers, ["pos"], "answer", "path")
