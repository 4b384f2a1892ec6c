"""Queries over sources, sinks and JSON replies, each a round trip or a parse of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.operators import align, anomaly, mathcheck, parse, votes
from siftloom.plans import evaluation, judging, pipeline, text_queries
from siftloom.session import scratch_path, table
from siftloom.sources import readers, writers

SQL: dict[str, str] = {}


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as JSON lines and read back."""
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "corpus").select("id", "question", "answer", "metadata").where("question is not null"), path)
    return readers.read_corpus(spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("question") + F.char_length("answer")).alias("chars"))


SQL["jsonl_roundtrip"] = "SELECT id, count(*) AS n, sum(length(question) + length(coalesce(answer, '')))::BIGINT AS chars FROM corpus WHERE question IS NOT NULL GROUP BY id"


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs written as CSV with line breaks in cells and read back."""
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, d, "model_outputs").select("row_id", F.coalesce("response", F.lit("")).alias("response")), path)
    return readers.read_csv(spark, path).select(F.col("row_id").cast("bigint").alias("row_id"), F.md5(F.coalesce("response", F.lit(""))).alias("digest"))


SQL["csv_roundtrip"] = "SELECT row_id, md5(coalesce(response, '')) AS digest FROM model_outputs"


def load_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = readers.load_prompts(table(spark, d, "prompts").drop("metadata"))
    return p.select("prompt_id", "text", "category", F.coalesce(F.col("metadata")["subset"], F.lit("")).alias("subset"))


SQL["load_prompts"] = "SELECT prompt_id, coalesce(text, '') AS text, coalesce(category, '') AS category, coalesce(subset, '') AS subset FROM prompts"


def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """Scores read back from replies that wrap their JSON in prose."""
    reply = F.concat(F.lit("结果如下：\n"), F.to_json(F.struct(F.struct("scores_a.*").alias("scores"))), F.lit("\n谢谢"))
    df = table(spark, d, "pairwise_results").where("scores_a is not null").select("row_id", reply.alias("reply"))
    return judging.parsed_scores(df).select("row_id", F.col("scores.format").alias("format"), F.col("scores.naturalness").alias("naturalness"))


SQL["lenient_json"] = "SELECT row_id, coalesce(scores_a.format, 0) AS format, coalesce(scores_a.naturalness, 0) AS naturalness FROM pairwise_results WHERE scores_a IS NOT NULL"


def extracted_qa(spark: SparkSession, d: str) -> DataFrame:
    """Pairs read back from replies that hold a JSON array in prose."""
    array = F.to_json(F.array(F.struct(F.col("id").alias("id"), F.col("question").alias("question"), F.col("answer").alias("answer"))))
    df = table(spark, d, "corpus").where("question is not null").select("row_id", F.concat(F.lit("提取到：\n"), array, F.lit("\n完")).alias("reply"))
    return parse.extracted_pairs(df, "row_id", "reply").select("row_id", "id", F.md5("question").alias("digest"), F.char_length("answer").cast("bigint").alias("answer_chars"))


SQL["extracted_qa"] = "SELECT row_id, id, md5(question) AS digest, length(coalesce(answer, '')) AS answer_chars FROM corpus WHERE question IS NOT NULL"


def rendered_items(spark: SparkSession, d: str) -> DataFrame:
    return writers.rendered(table(spark, d, "output_items").select("id", "question", "answer", "evaluation", "rework_count")).select(F.md5("value").alias("digest"))


_N = "chr(10)"
SQL["rendered_items"] = f"""SELECT md5(repeat('=', 60) || {_N} || '[' || coalesce(id, '') || ']' || {_N} || {_N} || '【问题】' || {_N} || coalesce(question, '') || {_N} || {_N} || '【回答】' || {_N} || coalesce(answer, '') || {_N}
 || CASE WHEN evaluation IS NOT NULL THEN {_N} || '【评分】' || printf('%.1f', coalesce(evaluation.total_score, 0.0::DOUBLE)) || '/10 (' || CASE WHEN evaluation.passed THEN '通过' ELSE '未通过' END || ')' || {_N}
   || coalesce(array_to_string(list_transform(evaluation.dimensions, lambda x: '  - ' || coalesce(x.dimension, '') || ': ' || printf('%.1f', coalesce(x.score, 0.0::DOUBLE)) || ' — ' || coalesce(x.reason, '') || {_N}), ''), '')
   || CASE WHEN coalesce(evaluation.suggestion, '') NOT IN ('', '无') THEN '【建议】' || evaluation.suggestion || {_N} ELSE '' END ELSE '' END
 || CASE WHEN coalesce(rework_count, 0) > 0 THEN '【重写次数】' || rework_count || {_N} ELSE '' END) AS digest FROM output_items"""


def rendered_steps(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "output_items").where("cot_steps is not null")
    return df.select("row_id", F.md5(parse.render_steps(F.col("question"), F.col("cot_steps"), F.col("answer"))).alias("digest"))


SQL["rendered_steps"] = f"""SELECT row_id, md5('<think>' || {_N} || coalesce(question, '') || {_N} || '</think>' || {_N} || {_N}
 || coalesce(array_to_string(list_transform(cot_steps, lambda s: '**Step ' || s.step_number || CASE WHEN coalesce(s.step_type, '') <> '' THEN ' [' || s.step_type || ']' ELSE '' END || '**' || {_N} || coalesce(s.content, '') || {_N}
   || CASE WHEN coalesce(s.formula, '') <> '' THEN '$$' || {_N} || s.formula || {_N} || '$$' || {_N} ELSE '' END || {_N}), ''), '') || '**最终答案：** ' || coalesce(answer, '')) AS digest FROM output_items WHERE cot_steps IS NOT NULL"""


def rework_feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_items").where("cot_evaluation is not null").select("row_id", parse.render_feedback("cot_evaluation").alias("feedback"))


SQL["rework_feedback"] = f"""SELECT row_id, concat_ws({_N}, CASE WHEN NOT coalesce(cot_evaluation.final_answer_correct, false) THEN '最终答案不正确，需要修正。' END, '推理链连贯性评分: ' || coalesce(cot_evaluation.chain_coherence, 0.0::DOUBLE)::VARCHAR || '/10',
 CASE WHEN coalesce(cot_evaluation.suggestion, '') <> '' THEN '总体建议: ' || cot_evaluation.suggestion END) AS feedback FROM output_items WHERE cot_evaluation IS NOT NULL"""


def judge_message(spark: SparkSession, d: str) -> DataFrame:
    """The message of a format-quality judge, with question and answer as two candidates."""
    df = table(spark, d, "corpus")
    return df.select("row_id", F.md5(parse.user_message(F.col("question"), F.array(F.col("answer"), F.col("question")), 240)).alias("digest"))


_CUT = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN '（空回答）' WHEN length({c}) <= 240 THEN {c} ELSE left({c}, 156) || {_N} || {_N} || '[…中间省略…]' || {_N} || {_N} || right({c}, 4) END"
SQL["judge_message"] = f"SELECT row_id, md5('## 题目（Instruction）' || {_N} || coalesce(question, '') || {_N} || {_N} || '## 候选回答' || {_N} || '### C1' || {_N} || {_CUT('answer')} || {_N} || {_N} || '### C2' || {_N} || {_CUT('question')} || {_N}) AS digest FROM corpus"


def regex_pairs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs read back from texts that label question and answer, one pair a text."""
    df = table(spark, d, "corpus").where("question is not null and answer is not null").select("row_id", F.concat(F.lit("问题："), F.md5("question"), F.lit("\n答案："), F.md5("answer"), F.lit("\n")).alias("text"))
    return parse.regex_pairs(df, "row_id", "text").select("row_id", "id", "question", "answer")


SQL["regex_pairs_roundtrip"] = "SELECT row_id, '1' AS id, md5(question) AS question, md5(answer) AS answer FROM corpus WHERE question IS NOT NULL AND answer IS NOT NULL"


def loaded_outputs(spark: SparkSession, d: str) -> DataFrame:
    """One version's answers as its file would give them; the other fields go to metadata."""
    rows = table(spark, d, "model_outputs").where("model_version = 'harrow-1'").select("prompt_id", "response", F.col("row_id").alias("serial"))
    got = readers.load_outputs(rows, "harrow-1")
    return got.select("prompt_id", "model_version", F.md5("response").alias("digest"), F.col("metadata")["serial"].cast("bigint").alias("serial"))


SQL["loaded_outputs"] = "SELECT prompt_id, model_version, md5(coalesce(response, '')) AS digest, row_id AS serial FROM model_outputs WHERE model_version = 'harrow-1'"


def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with alternative field names brought to one form."""
    got = align.coalesce_rows(table(spark, d, "corpus").select("id", "question", "answer"))
    return got.select("id", F.md5("instruction").alias("instruction"), F.md5(F.get("predictions", F.lit(0))).alias("prediction"), "subset")


_FILLED = lambda c: f"coalesce(nullif({text_queries.s.strip(text_queries.s.text(c))}, ''), '')"
SQL["candidate_rows"] = f"SELECT {_FILLED('id')} AS id, md5({_FILLED('question')}) AS instruction, md5({_FILLED('answer')}) AS prediction, '' AS subset FROM corpus"


def flat_scores(spark: SparkSession, d: str) -> DataFrame:
    """Nested scores as columns of their own."""
    flat = parse.flatten(table(spark, d, "pairwise_results").select("row_id", "scores_a", "scores_b"))
    return flat.select("row_id", *[F.col(f"`scores_{s}.{x}`").alias(f"{s}_{x}") for s in "ab" for x in k.DIMENSIONS])


SQL["flat_scores"] = "SELECT row_id, " + ", ".join(f"scores_{s}.{x} AS {s}_{x}" for s in "ab" for x in k.DIMENSIONS) + " FROM pairwise_results"


def anomaly_sheet(spark: SparkSession, d: str) -> DataFrame:
    flags = anomaly.output_anomalies(table(spark, d, "model_outputs").select("prompt_id", "model_version", "response"), ["model_version"], "response").select("prompt_id", "anomaly_types", "length")
    return writers.anomaly_sheet(flags)


SQL["anomaly_sheet"] = text_queries.SQL["output_anomalies"].split(" SELECT row_id, length")[0] + " SELECT o.prompt_id, array_to_string(types, '; ') AS anomaly_types, '{\"length\":' || length || '}' AS details FROM a JOIN model_outputs o USING (row_id) WHERE len(types) > 0"


def augmented_items(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows with two variants each, as an augmenting call would give them."""
    items = table(spark, d, "corpus").where("id is not null").select("id", "question", "answer")
    variants = items.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), F.concat(F.lit("变体 "), t.text("question")).alias("question"), F.lit("rewrite").alias("strategy"))
    return judging.augmented(items, variants).groupBy("id", "source_id", "strategy").agg(F.count(F.lit(1)).alias("n"))


SQL["augmented_items"] = "WITH i AS (SELECT id FROM corpus WHERE id IS NOT NULL), a AS (SELECT id, NULL AS source_id, NULL AS strategy FROM i UNION ALL SELECT id || '_aug_' || p, id, 'rewrite' FROM i, (VALUES (1), (2)) v(p)) SELECT id, source_id::VARCHAR AS source_id, strategy::VARCHAR AS strategy, count(*) AS n FROM a GROUP BY ALL"


def step_checks(spark: SparkSession, d: str) -> DataFrame:
    """Step statistics where every second step is taken as wrong."""
    df = table(spark, d, "output_items").where("cot_steps is not null").select("row_id", "cot_steps", F.transform("cot_steps", lambda x: F.struct(x["step_number"].alias("step_number"), (x["step_number"] % 2 == 1).alias("is_correct"))).alias("checks"), F.lit(True).alias("final_answer_correct"))
    return votes.step_stats(df, "cot_steps", "checks").select("row_id", "correct_steps", "first_error_step", "step_accuracy", "step_passed")


SQL["step_checks"] = """WITH s AS (SELECT row_id, len(cot_steps) AS n, len(list_filter(cot_steps, lambda x: x.step_number % 2 = 1)) AS c, list_extract(list_transform(list_filter(cot_steps, lambda x: x.step_number % 2 <> 1), lambda x: x.step_number), 1) AS f FROM output_items WHERE cot_steps IS NOT NULL)
SELECT row_id, c AS correct_steps, f AS first_error_step, round(CASE WHEN n = 0 THEN 0 ELSE c::DOUBLE / n END, 4) AS step_accuracy, CASE WHEN n = 0 THEN 0 ELSE c::DOUBLE / n END * 10 >= 7 AS step_passed FROM s"""


def equation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of steps by whether they are true, false, or no numeric equation."""
    df = table(spark, d, "output_items").where("cot_steps is not null").select(F.explode("cot_steps.formula").alias("f"))
    return df.select(mathcheck.holds(F.col("f")).alias("holds")).groupBy("holds").agg(F.count(F.lit(1)).alias("n"))


def pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    """The corpus pipeline with the offline generator and judge, by level and result."""
    corpus = table(spark, d, "corpus").where("question is not null").select(F.col("row_id").alias("pos"), "id", "question", "answer")
    items = pipeline.run(corpus, judging.EchoGenerator())
    return items.groupBy("difficulty_level", F.col("evaluation.passed").alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum("rework_count").alias("reworks"))


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Single-mode evaluation of all outputs by the offline judge."""
    return pipeline.evaluate_outputs(table(spark, d, "model_outputs"), table(spark, d, "prompts"))["summary"]


def pairwise_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise evaluation of two versions over three rounds by the offline judge."""
    got = evaluation.judge_pairs(table(spark, d, "model_outputs"), table(spark, d, "prompts"), "harrow-1", "harrow-2", judging.LengthJudge())["results"]
    return got.select("prompt_id", "winner", "agreement", "num_rounds", "a_format", "b_naturalness", "position_swaps")


SQL["pairwise_evaluation"] = """WITH last AS (SELECT prompt_id, model_version, length(coalesce(arg_max_null(response, row_id), '')) AS n FROM model_outputs WHERE prompt_id IS NOT NULL AND model_version IS NOT NULL GROUP BY ALL)
SELECT x.prompt_id, CASE WHEN x.n > y.n THEN 'A' WHEN y.n > x.n THEN 'B' ELSE 'tie' END AS winner, 1.0::DOUBLE AS agreement, 3 AS num_rounds, (1 + x.n % 5)::DOUBLE AS a_format, (1 + y.n % 5)::DOUBLE AS b_naturalness, 1 AS position_swaps
FROM last x JOIN last y USING (prompt_id) WHERE x.model_version = 'harrow-1' AND y.model_version = 'harrow-2'"""


def answer_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Single evaluation of all answers over three rounds by the offline judge."""
    got = evaluation.judge_answers(table(spark, d, "model_outputs"), table(spark, d, "prompts"), judging.LengthJudge())["results"]
    return got.select("prompt_id", "model_version", "format", "num_rounds", "uncertain")


SQL["answer_evaluation"] = """WITH pr AS (SELECT DISTINCT prompt_id FROM prompts), j AS (SELECT prompt_id, model_version, (1 + length(coalesce(response, '')) % 5)::DOUBLE AS x FROM model_outputs JOIN pr USING (prompt_id))
SELECT prompt_id, model_version, round(median(x) + 1e-9, 1) AS format, 3 * count(*) AS num_rounds, round(stddev_pop(x), 9) > 1.5 AS uncertain FROM j GROUP BY ALL"""


def scored_twice(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows scored by two calls of the offline judge, an arbiter where they differ too much."""
    items = table(spark, d, "corpus").select(F.col("row_id").alias("pos"), "question", "answer")
    e = F.col("evaluation")
    return evaluation.score_twice(items, judging.LengthJudge()).select(F.col("pos").alias("row_id"), e["total_score"].alias("total_score"), e["passed"].alias("passed"), e["suggestion"].alias("suggestion"))


SQL["scored_twice"] = """WITH c AS (SELECT row_id, (length(coalesce(answer, '')) % 10)::DOUBLE AS a, (length(coalesce(question, '')) % 4)::DOUBLE AS x FROM corpus)
SELECT row_id, CASE WHEN x > 2 THEN 5.0::DOUBLE ELSE round(a + x / 2, 2) END AS total_score, CASE WHEN x > 2 THEN false ELSE a >= 7 END AS passed, CASE WHEN x > 2 THEN '仲裁' ELSE '无' END AS suggestion FROM c"""


_AVG = "round(avg(m) + 1e-9, 3)"
SQL["evaluation_report"] = text_queries.RULED + f""", pr AS (SELECT DISTINCT prompt_id FROM prompts), j AS (SELECT prompt_id, model_version, rule_score FROM ruled JOIN pr USING (prompt_id)),
agg AS (SELECT prompt_id, model_version, round(median(rule_score) + 1e-9, 1) AS m, round(stddev_pop(rule_score) + 1e-9, 3) AS s, round(stddev_pop(rule_score), 9) > 1.5 AS u FROM j GROUP BY ALL)
SELECT model_version, count(*) AS total, {_AVG} AS mean_score, {', '.join(f'{_AVG} AS {d}' for d in k.DIMENSIONS)}, count_if(m < 2.5) AS low, count_if(m >= 2.5 AND m < 3.5) AS mid, count_if(m >= 3.5) AS high, count_if(u) AS uncertain_count, round(avg(u::INT) + 1e-9, 3) AS uncertain_rate, round(avg(s) + 1e-9, 3) AS avg_max_std FROM agg GROUP BY ALL"""


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
