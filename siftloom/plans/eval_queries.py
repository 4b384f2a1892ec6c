"""Queries over alignments, votes, statistics and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.operators import align, anomaly, profile, stats, summary, votes
from siftloom.plans import report
from siftloom.plans import sql as s
from siftloom.session import table

SQL: dict[str, str] = {}
KEYS = ["prompt_id", "model_a", "model_b"]
BASE, CAND = "harrow-1", "harrow-2"
_LAST = "last AS (SELECT prompt_id, model_version, coalesce(arg_max_null(response, row_id), '') AS response FROM model_outputs WHERE prompt_id IS NOT NULL AND model_version IS NOT NULL GROUP BY ALL)"
_PROMPTS = "pr AS (SELECT prompt_id, max(text) AS text, arg_max_null(category, text) AS category FROM prompts GROUP BY ALL)"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_outputs")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return align.judged(table(spark, d, "pairwise_results"))


def align_pair(spark: SparkSession, d: str) -> DataFrame:
    return align.align_pair(_outputs(spark, d), table(spark, d, "prompts"), BASE, CAND)


SQL["align_pair"] = f"WITH {_LAST}, {_PROMPTS} SELECT b.prompt_id, coalesce(text, '') AS prompt_text, coalesce(category, '') AS category, b.response AS baseline_response, c.response AS candidate_response FROM last b JOIN last c ON b.prompt_id = c.prompt_id LEFT JOIN pr ON b.prompt_id = pr.prompt_id WHERE b.model_version = '{BASE}' AND c.model_version = '{CAND}'"


def align_skipped(spark: SparkSession, d: str) -> DataFrame:
    return align.skipped_counts(_outputs(spark, d), BASE, CAND)


SQL["align_skipped"] = f"WITH h AS (SELECT prompt_id, coalesce(bool_or(model_version = '{BASE}'), false) AS b, coalesce(bool_or(model_version = '{CAND}'), false) AS c FROM model_outputs WHERE prompt_id IS NOT NULL GROUP BY ALL) SELECT count_if(b AND NOT c) AS only_baseline, count_if(c AND NOT b) AS only_candidate FROM h"


def align_multi_version(spark: SparkSession, d: str) -> DataFrame:
    wide = align.align_versions(_outputs(spark, d), [BASE, CAND, "tindra-m"])
    return wide.select("prompt_id", *[F.char_length(F.col(f"`{v}`")).cast("bigint").alias(c) for v, c in ((BASE, "len_1"), (CAND, "len_2"), ("tindra-m", "len_3"))])


SQL["align_multi_version"] = f"WITH {_LAST} SELECT x.prompt_id, length(x.response) AS len_1, length(y.response) AS len_2, length(z.response) AS len_3 FROM last x JOIN last y ON x.prompt_id = y.prompt_id JOIN last z ON x.prompt_id = z.prompt_id WHERE x.model_version = '{BASE}' AND y.model_version = '{CAND}' AND z.model_version = 'tindra-m'"


def single_join(spark: SparkSession, d: str) -> DataFrame:
    return align.single_join(_outputs(spark, d), table(spark, d, "prompts")).select("row_id", "prompt_id", F.coalesce("category", F.lit("")).alias("category"), F.char_length("text").cast("bigint").alias("prompt_chars"))


SQL["single_join"] = f"WITH {_PROMPTS} SELECT row_id, o.prompt_id, coalesce(pr.category, '') AS category, length(text) AS prompt_chars FROM model_outputs o JOIN pr ON o.prompt_id = pr.prompt_id"


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return align.coverage(_outputs(spark, d), table(spark, d, "prompts"))


SQL["coverage_report"] = """WITH ids AS (SELECT DISTINCT prompt_id FROM prompts WHERE prompt_id IS NOT NULL), have AS (SELECT DISTINCT model_version, prompt_id FROM model_outputs WHERE model_version IS NOT NULL AND prompt_id IS NOT NULL),
v AS (SELECT DISTINCT model_version FROM have), m AS (SELECT v.model_version, i.prompt_id FROM v CROSS JOIN ids i WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.model_version = v.model_version AND h.prompt_id = i.prompt_id)),
ms AS (SELECT model_version, count(*) AS missing, array_to_string(list_slice(list_sort(list(prompt_id)), 1, 10), ',') AS first_missing FROM m GROUP BY ALL),
kn AS (SELECT h.model_version, count_if(i.prompt_id IS NOT NULL) AS covered, count_if(i.prompt_id IS NULL) AS extra FROM have h LEFT JOIN ids i USING (prompt_id) GROUP BY ALL)
SELECT model_version, covered, coalesce(missing, 0) AS missing, extra, printf('%.1f%%', covered * 100.0::DOUBLE / (SELECT count(*) FROM ids) + 1e-9) AS rate, coalesce(first_missing, '') AS first_missing FROM kn LEFT JOIN ms USING (model_version)"""


def missing_extra_ids(spark: SparkSession, d: str) -> DataFrame:
    return align.missing_ids(_outputs(spark, d), table(spark, d, "prompts"))


SQL["missing_extra_ids"] = "SELECT DISTINCT prompt_id, 'missing' AS side FROM prompts WHERE prompt_id NOT IN (SELECT prompt_id FROM model_outputs WHERE prompt_id IS NOT NULL) UNION ALL SELECT DISTINCT prompt_id, 'extra' FROM model_outputs WHERE prompt_id IS NOT NULL AND prompt_id NOT IN (SELECT prompt_id FROM prompts WHERE prompt_id IS NOT NULL)"


def duplicate_prompts(spark: SparkSession, d: str) -> DataFrame:
    return align.duplicate_ids(table(spark, d, "prompts"), "prompt_id")


SQL["duplicate_prompts"] = "SELECT prompt_id, count(*) AS n FROM prompts GROUP BY ALL HAVING count(*) > 1 ORDER BY prompt_id LIMIT 10"


def blank_counts(spark: SparkSession, d: str) -> DataFrame:
    return align.blank_counts(_outputs(spark, d), "model_version", "response")


SQL["blank_counts"] = f"SELECT model_version, count(*) AS n, count_if({s.compact('response')} = '') AS blank FROM model_outputs GROUP BY ALL"


def output_issues(spark: SparkSession, d: str) -> DataFrame:
    return align.output_issues(table(spark, d, "output_items")).select("row_id", F.array_join("issues", "|").alias("issues"))


SQL["output_issues"] = f"SELECT row_id, array_to_string(list_filter([CASE WHEN {s.compact('question')} = '' THEN 'question_blank' END, CASE WHEN {s.compact('answer')} = '' THEN 'answer_blank' END, CASE WHEN length({s.text('answer')}) < 10 THEN 'answer_short' END], lambda x: x IS NOT NULL), '|') AS issues FROM output_items"


def failed_items(spark: SparkSession, d: str) -> DataFrame:
    return summary.failed_items(table(spark, d, "output_items")).select("row_id", "id")


SQL["failed_items"] = "SELECT row_id, id FROM output_items WHERE evaluation IS NOT NULL AND NOT evaluation.passed"


def pending_items(spark: SparkSession, d: str) -> DataFrame:
    return summary.pending_items(table(spark, d, "output_items")).select("row_id")


SQL["pending_items"] = "SELECT row_id FROM output_items WHERE coalesce(answer, '') <> ''"


def eval_join(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows with the last evaluation of their id."""
    last = align.keep_last(table(spark, d, "output_items").where("id is not null"), ["id"], "row_id", "answer", "evaluation")
    return table(spark, d, "corpus").select("row_id", "id").join(last, "id", "left").select("row_id", t.text("answer").alias("generated"), F.col("evaluation.total_score").alias("total_score"), F.col("evaluation.passed").alias("passed"))


SQL["eval_join"] = "WITH l AS (SELECT * FROM output_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1) SELECT c.row_id, coalesce(l.answer, '') AS generated, l.evaluation.total_score AS total_score, l.evaluation.passed AS passed FROM corpus c LEFT JOIN l ON c.id = l.id"


def reference_answers(spark: SparkSession, d: str) -> DataFrame:
    """Output items with the first corpus answer of their id."""
    first = align.keep_first(table(spark, d, "corpus").where("id is not null"), ["id"], "row_id", "answer")
    return table(spark, d, "output_items").select("row_id", "id").join(first, "id", "left").select("row_id", t.text("answer").alias("reference"))


SQL["reference_answers"] = "WITH f AS (SELECT id, answer FROM corpus WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1) SELECT o.row_id, coalesce(f.answer, '') AS reference FROM output_items o LEFT JOIN f ON o.id = f.id"


def kway_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three versions as three candidate files."""
    versions = [BASE, CAND, "osprey-rl"]
    files = _outputs(spark, d).where(F.col("model_version").isin(*versions)).select((F.array_position(F.array(*[F.lit(v) for v in versions]), F.col("model_version")) - 1).cast("int").alias("file"), F.col("row_id").alias("pos"), F.col("prompt_id").alias("id"), F.lit("").alias("subset"), F.col("prompt_id").alias("instruction"), t.text("response").alias("prediction"))
    merged = align.k_way(files, 3).orderBy(*align.numeric_first("id"))
    return merged.select("id", F.md5(F.array_join("predictions", "|")).alias("predictions"), "mismatch")


SQL["kway_merge"] = f"WITH {_LAST} SELECT x.prompt_id AS id, md5(x.response || '|' || y.response || '|' || z.response) AS predictions, false AS mismatch FROM last x JOIN last y ON x.prompt_id = y.prompt_id JOIN last z ON x.prompt_id = z.prompt_id WHERE x.model_version = '{BASE}' AND y.model_version = '{CAND}' AND z.model_version = 'osprey-rl'"


def numeric_first_sort(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "corpus").select(F.when(F.col("row_id") % 3 == 0, F.col("row_id").cast("string")).otherwise(F.col("id")).alias("id")).where("id is not null").distinct()
    return ids.orderBy(*align.numeric_first("id"))


SQL["numeric_first_sort"] = "WITH i AS (SELECT DISTINCT CASE WHEN row_id % 3 = 0 THEN row_id::VARCHAR ELSE id END AS id FROM corpus) SELECT id FROM i WHERE id IS NOT NULL"


def ab_decode(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("row_id", "winner", F.col("scores_a.format").alias("a_format"), F.col("scores_b.format").alias("b_format"))


SQL["ab_decode"] = s.JUDGED + " SELECT row_id, winner, sa.format AS a_format, sb.format AS b_format FROM judged"


def single_rounds_median(spark: SparkSession, d: str) -> DataFrame:
    return _singles(spark, d)


def _singles(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    both = j.select("prompt_id", F.col("model_a").alias("model_version"), F.col("scores_a").alias("s")).unionAll(j.select("prompt_id", "model_b", "scores_b"))
    return votes.single_rounds(both, ["prompt_id", "model_version"], "s")


_DIMS = ", ".join(k.DIMENSIONS)
SQL["single_rounds_median"] = s.JUDGED + f", {s.SINGLES} SELECT prompt_id, model_version, {_DIMS}, num_rounds, max_std, uncertain FROM single_rounds"


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    return votes.pairwise_rounds(_judged(spark, d), KEYS)


_SIDES = ", ".join(f"{x}_{dim}" for x in "ab" for dim in k.DIMENSIONS)


def pairwise_rounds_vote(spark: SparkSession, d: str) -> DataFrame:
    return _rounds(spark, d).select(*KEYS, "winner", "agreement", "num_rounds", *[f"{x}_{dim}" for x in "ab" for dim in k.DIMENSIONS], "position_swaps")


SQL["pairwise_rounds_vote"] = s.JUDGED + f", {s.PLURALITY}, {s.MEDIANS} SELECT {s.KEYS}, winner, agreement, num_rounds, {_SIDES}, position_swaps FROM plural JOIN medians USING ({s.KEYS})"


def multi_round_majority(spark: SparkSession, d: str) -> DataFrame:
    return votes.majority(_judged(spark, d), KEYS)


SQL["multi_round_majority"] = s.JUDGED + f", c AS (SELECT {s.KEYS}, count_if(winner = 'A') AS a, count_if(winner = 'B') AS b, count_if(winner = 'tie') AS t FROM judged GROUP BY ALL) SELECT {s.KEYS}, CASE WHEN a > b AND a > t THEN 'A' WHEN b > a AND b > t THEN 'B' ELSE 'tie' END AS winner FROM c"


def multi_round_average(spark: SparkSession, d: str) -> DataFrame:
    return votes.average_rounds(_judged(spark, d), KEYS)


SQL["multi_round_average"] = s.JUDGED + f", m AS (SELECT {s.KEYS}, avg({s.mean_side('a')}) AS ma, avg({s.mean_side('b')}) AS mb FROM judged GROUP BY ALL) SELECT {s.KEYS}, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN round(ma - mb, 9) > 0.1::DOUBLE THEN 'A' WHEN round(ma - mb, 9) < -0.1::DOUBLE THEN 'B' ELSE 'tie' END AS winner FROM m"


def judge_majority(spark: SparkSession, d: str) -> DataFrame:
    return votes.judge_majority(_judged(spark, d), KEYS)


SQL["judge_majority"] = s.JUDGED + f", {s.PLURALITY} SELECT {s.KEYS}, CASE WHEN n = 1 AND total > 2 THEN 'tie' ELSE winner END AS winner, total::BIGINT AS judges FROM ranked WHERE rn = 1"


def judge_weighted(spark: SparkSession, d: str) -> DataFrame:
    return votes.judge_weighted(_judged(spark, d), KEYS, "panel_human")


SQL["judge_weighted"] = s.JUDGED + f", w AS (SELECT {s.KEYS}, unnest(['A', 'B', 'tie']) AS v, unnest([0, 1, 2]) AS i, unnest([coalesce(sum(CASE WHEN judge_id = 'panel_human' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (winner = 'A'), 0), coalesce(sum(CASE WHEN judge_id = 'panel_human' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (winner = 'B'), 0), coalesce(sum(CASE WHEN judge_id = 'panel_human' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (winner = 'tie'), 0)]) AS x FROM judged GROUP BY {s.KEYS}), r AS (SELECT *, lead(x) OVER (PARTITION BY {s.KEYS} ORDER BY x DESC, i) AS second, row_number() OVER (PARTITION BY {s.KEYS} ORDER BY x DESC, i) AS rn FROM w) SELECT {s.KEYS}, CASE WHEN x - second < 0.5::DOUBLE THEN 'tie' ELSE v END AS winner FROM r WHERE rn = 1"


def judge_conservative(spark: SparkSession, d: str) -> DataFrame:
    return votes.judge_conservative(_judged(spark, d), KEYS)


SQL["judge_conservative"] = s.JUDGED + f" SELECT {s.KEYS}, CASE WHEN count(DISTINCT winner) = 1 THEN min(winner) ELSE 'tie' END AS winner, count(DISTINCT winner) = 1 AS unanimous FROM judged GROUP BY ALL"


def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of judges over shared prompts and model families."""
    return votes.judge_agreement(_judged(spark, d), ["prompt_id", "model_a", "model_b"])


SQL["judge_agreement"] = s.JUDGED + f", o AS (SELECT {s.KEYS}, judge_id, arg_min(winner, row_id) AS w FROM judged GROUP BY ALL) SELECT x.judge_id AS judge_1, y.judge_id AS judge_2, count(*) AS shared, round(avg((x.w = y.w)::INT), 6) AS agreement FROM o x JOIN o y USING ({s.KEYS}) WHERE x.judge_id < y.judge_id GROUP BY ALL"


def unanimous_rate(spark: SparkSession, d: str) -> DataFrame:
    return votes.unanimous_rate(_judged(spark, d), KEYS)


SQL["unanimous_rate"] = s.JUDGED + f", c AS (SELECT count(DISTINCT winner) = 1 AS u FROM judged GROUP BY {s.KEYS}) SELECT count(*) AS comparisons, count_if(u) AS unanimous, round(avg(u::INT), 6) AS rate FROM c"


def self_consistency_vote(spark: SparkSession, d: str) -> DataFrame:
    """The versions' extracted, normalised answers as sampled answers to one prompt."""
    paths = _outputs(spark, d).where("prompt_id is not null").select("prompt_id", "row_id", t.normalize_answer(t.extract_answer("response")).alias("answer"))
    return votes.self_consistency(paths, ["prompt_id"], "answer", "row_id")


def _extracted(c: str) -> str:
    """The answer that a text gives, by the twin of extract_answer."""
    own = lambda p: s.strip(f"regexp_extract({s.text(c)}, '(?s){p}', 1)")
    found = ", ".join(f"CASE WHEN regexp_matches({s.text(c)}, '(?s){p}') THEN {own(p)} END" for p in (p.replace(k.WS_JAVA, s.WS) for p in t.ANSWER_PATTERNS))
    return f"coalesce({found}, {s.strip(f'list_extract(string_split({s.strip(s.text(c))}, chr(10)), -1)')})"


SQL["self_consistency_vote"] = f"WITH p AS (SELECT prompt_id, row_id, lower(regexp_replace({_extracted('response')}, '[。，、；：！？]|{s.WS}', '', 'g')) AS answer FROM model_outputs WHERE prompt_id IS NOT NULL), v AS (SELECT prompt_id, answer, count(*) AS n, min(row_id) AS first FROM p GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY prompt_id) AS total, row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, first) AS rn FROM v) SELECT prompt_id, answer AS best_answer, round(n::DOUBLE / total + 1e-9, 2) AS confidence, n::DOUBLE / total >= 0.6::DOUBLE AS is_consistent, total::BIGINT AS paths FROM r WHERE rn = 1"


def double_score_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first and last evaluation of an id as its two scores, the highest scored one as the arbiter's."""
    items = table(spark, d, "output_items").where("id is not null and evaluation is not null")
    three = items.groupBy("id").agg(F.min_by("evaluation", "row_id").alias("a"), F.max_by("evaluation", "row_id").alias("b"), F.max_by("evaluation", F.struct(F.coalesce("evaluation.total_score", F.lit(-1.0)), "row_id")).alias("c"))
    dims = F.array_join(F.transform("merged_dimensions", lambda x: F.concat(F.coalesce(x["dimension"], F.lit("")), F.lit("="), F.format_string("%.1f", x["score"]))), ";")
    return votes.double_score(three, "a", "b", "c").select("id", "merged_total", "merged_passed", "merged_suggestion", dims.alias("merged_dimensions"))


_APART = "abs(a.total_score - b.total_score) > 2.0::DOUBLE"
SQL["double_score_merge"] = f"""WITH i AS (SELECT id, arg_min(evaluation, row_id) AS a, arg_max(evaluation, row_id) AS b, arg_max(evaluation, [coalesce(evaluation.total_score, -1.0::DOUBLE), row_id::DOUBLE]) AS c FROM output_items WHERE id IS NOT NULL AND evaluation IS NOT NULL GROUP BY id),
z AS (SELECT *, least(len(coalesce(a.dimensions, [])), len(coalesce(b.dimensions, []))) AS n FROM i)
SELECT id, CASE WHEN {_APART} THEN c.total_score ELSE round((a.total_score + b.total_score) / 2, 2) END AS merged_total, CASE WHEN {_APART} THEN c.passed ELSE a.passed AND b.passed END AS merged_passed,
 CASE WHEN {_APART} THEN c.suggestion WHEN coalesce(a.suggestion, '') IN ('', '无') THEN b.suggestion ELSE a.suggestion END AS merged_suggestion,
 CASE WHEN {_APART} THEN array_to_string(list_transform(c.dimensions, lambda x: coalesce(x.dimension, '') || '=' || printf('%.1f', x.score)), ';') WHEN n = 0 THEN array_to_string(list_transform(a.dimensions, lambda x: coalesce(x.dimension, '') || '=' || printf('%.1f', x.score)), ';')
 ELSE array_to_string(list_transform(range(1, n + 1), lambda j: coalesce(a.dimensions[j].dimension, '') || '=' || printf('%.1f', round((coalesce(a.dimensions[j].score, 0) + coalesce(b.dimensions[j].score, 0)) / 2 + 1e-9, 1))), ';') END AS merged_dimensions FROM z"""


def blind_ab(spark: SparkSession, d: str) -> DataFrame:
    """The first and last judgement of a pair as the two calls of a blind comparison, where it has several."""
    from siftloom.plans import judging

    calls = table(spark, d, "pairwise_results").where("winner in ('A', 'B', 'tie') and prompt_id is not null and model_a is not null and model_b is not null").groupBy(*KEYS)
    call = F.struct("winner", "scores_a", "scores_b")
    two = calls.agg(F.min_by(call, "row_id").alias("x"), F.max_by(call, "row_id").alias("y"), (F.count(F.lit(1)) > 1).alias("swapped"))
    both = two.select(*KEYS, "swapped", "x.*", F.col("y.winner").alias("winner_2"), F.col("y.scores_a").alias("scores_a_2"), F.col("y.scores_b").alias("scores_b_2"))
    return judging.blind_results(both).select(*KEYS, "winner", "consistency", F.col("scores_a.format").alias("a_format"), F.col("scores_b.naturalness").alias("b_naturalness"))


SQL["blind_ab"] = """WITH g AS (SELECT prompt_id, model_a, model_b, arg_min(struct_pack(w := winner, a := scores_a, b := scores_b), row_id) AS x, arg_max(struct_pack(w := winner, a := scores_a, b := scores_b), row_id) AS y, count(*) > 1 AS two
  FROM pairwise_results WHERE winner IN ('A', 'B', 'tie') AND prompt_id IS NOT NULL AND model_a IS NOT NULL AND model_b IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE y.w WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'tie' END AS back FROM g)
SELECT prompt_id, model_a, model_b, CASE WHEN two AND x.w <> back THEN 'tie' ELSE x.w END AS winner, CASE WHEN NOT two THEN NULL WHEN x.w = back THEN 'consistent' ELSE 'position_bias_detected' END AS consistency,
 CASE WHEN two AND x.w <> back THEN round((coalesce(x.a.format, 0) + coalesce(y.b.format, 0)) / 2 + 1e-9, 1) ELSE x.a.format END AS a_format,
 CASE WHEN two AND x.w <> back THEN round((coalesce(x.b.naturalness, 0) + coalesce(y.a.naturalness, 0)) / 2 + 1e-9, 1) ELSE x.b.naturalness END AS b_naturalness FROM s"""


def weighted_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_items").where("evaluation is not null").select("row_id", F.round(votes.weighted_total(F.coalesce(F.col("evaluation.dimensions"), F.array().cast("array<struct<dimension:string,score:double,reason:string>>"))), 4).alias("weighted"))


SQL["weighted_totals"] = "SELECT row_id, round(coalesce(list_sum(list_transform(evaluation.dimensions, lambda x: coalesce(x.score, 0) * CASE x.dimension WHEN '准确性' THEN 0.35::DOUBLE WHEN '格式依从性' THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END)), 0), 4) AS weighted FROM output_items WHERE evaluation IS NOT NULL"


def cot_stats(spark: SparkSession, d: str) -> DataFrame:
    return summary.step_report(table(spark, d, "output_items"))


SQL["cot_stats"] = "SELECT count(*) AS items, sum(cot_evaluation.total_steps)::BIGINT AS total_steps, sum(cot_evaluation.correct_steps)::BIGINT AS correct_steps, round(avg(cot_evaluation.chain_coherence), 4) AS avg_coherence, round(avg(coalesce(cot_evaluation.final_answer_correct, false)::INT), 4) AS final_answer_rate, count_if(rework_count > 0) AS reworked, round(sum(cot_evaluation.correct_steps) / sum(cot_evaluation.total_steps), 4) AS step_accuracy FROM output_items WHERE cot_evaluation IS NOT NULL"


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return summary.run_report(table(spark, d, "output_items"))


SQL["run_report"] = f"SELECT count(*) AS total_items, count_if({s.compact('question')} = '' OR length({s.text('answer')}) < 10 OR {s.compact('answer')} = '') AS items_with_errors, count(evaluation.total_score) AS scored_items, round(avg(evaluation.total_score), 2) AS avg_score, max(evaluation.total_score) AS max_score, min(evaluation.total_score) AS min_score, count_if(evaluation.total_score IS NOT NULL AND evaluation.passed) AS pass_count, coalesce(sum(rework_count), 0)::BIGINT AS total_reworks, count_if(rework_count > 0) AS items_reworked, printf('%.1f%%', count_if(evaluation.total_score IS NOT NULL AND evaluation.passed) * 100.0::DOUBLE / count(evaluation.total_score)) AS pass_rate FROM output_items"


def single_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.single_summary(_singles(spark, d), ["model_version"])


_M6 = "(" + " + ".join(k.DIMENSIONS) + ") / 6"
SQL["single_summary"] = s.JUDGED + f", {s.SINGLES}, m AS (SELECT *, {_M6} AS mm FROM single_rounds) SELECT model_version, count(*) AS total, round(avg(mm) + 1e-9, 3) AS mean_score, {', '.join(f'round(avg({x}) + 1e-9, 3) AS {x}' for x in k.DIMENSIONS)}, count_if(round(mm, 9) < 2.5) AS low, count_if(round(mm, 9) >= 2.5 AND round(mm, 9) < 3.5) AS mid, count_if(round(mm, 9) >= 3.5) AS high, count_if(uncertain) AS uncertain_count, round(avg(uncertain::INT) + 1e-9, 3) AS uncertain_rate, round(avg(max_std) + 1e-9, 3) AS avg_max_std FROM m GROUP BY model_version"


def pairwise_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.pairwise_summary(_rounds(spark, d), ["model_a", "model_b"])


SQL["pairwise_summary"] = s.JUDGED + f", {s.PLURALITY} SELECT model_a, model_b, count(*) AS total, round(count_if(winner = 'A')::DOUBLE / count(*), 6) AS win_rate_a, round(count_if(winner = 'B')::DOUBLE / count(*), 6) AS win_rate_b, round(count_if(winner = 'tie')::DOUBLE / count(*), 6) AS tie_rate, round(avg(agreement) + 1e-9, 3) AS avg_agreement FROM plural GROUP BY ALL"


def pairwise_by_category(spark: SparkSession, d: str) -> DataFrame:
    return summary.by_category(_rounds(spark, d), table(spark, d, "prompts"))


SQL["pairwise_by_category"] = s.JUDGED + f", {s.PLURALITY}, {_PROMPTS} SELECT coalesce(category, 'unknown') AS category, count(*) AS total, count_if(winner = 'A') AS a, count_if(winner = 'B') AS b, count_if(winner = 'tie') AS tie FROM plural LEFT JOIN pr USING (prompt_id) GROUP BY 1"


def version_table(spark: SparkSession, d: str) -> DataFrame:
    return summary.version_table(_singles(spark, d))


SQL["version_table"] = s.JUDGED + f", {s.SINGLES} SELECT model_version, count(*) AS total, round(avg({_M6}) + 1e-9, 3) AS mean, {', '.join(f'round(avg({x}) + 1e-9, 3) AS {x}' for x in k.DIMENSIONS)} FROM single_rounds GROUP BY model_version"


def win_rate_bars(spark: SparkSession, d: str) -> DataFrame:
    return report.win_rates(_rounds(spark, d), ["model_a", "model_b"])


SQL["win_rate_bars"] = s.JUDGED + f", {s.PLURALITY}, w AS (SELECT model_a, model_b, count_if(winner = 'A')::DOUBLE / count(*) AS a, count_if(winner = 'B')::DOUBLE / count(*) AS b, count_if(winner = 'tie')::DOUBLE / count(*) AS t FROM plural GROUP BY ALL) SELECT model_a, model_b, unnest(['Baseline 胜', 'Candidate 胜', '平局']) AS outcome, unnest([round(a, 6), round(b, 6), round(t, 6)]) AS rate FROM w"


def radar_data(spark: SparkSession, d: str) -> DataFrame:
    return report.radar(_singles(spark, d))


SQL["radar_data"] = s.JUDGED + f", {s.SINGLES}, v AS (SELECT model_version, {', '.join(f'round(avg({x}) + 1e-9, 3) AS {x}' for x in k.DIMENSIONS)} FROM single_rounds GROUP BY model_version) " + " UNION ALL ".join(f"SELECT model_version, '{x}' AS dimension, '{label}' AS label, {x} AS value FROM v" for x, label in k.DIMENSION_LABELS.items())


def quality_pie(spark: SparkSession, d: str) -> DataFrame:
    return report.quality_pie(_singles(spark, d))


SQL["quality_pie"] = s.JUDGED + f", {s.SINGLES}, m AS (SELECT model_version, round(({' + '.join(k.DIMENSIONS)}) / 6, 9) AS mm FROM single_rounds), g AS (SELECT model_version, count_if(mm < 2.5) AS lo, count_if(mm >= 2.5 AND mm < 3.5) AS mi, count_if(mm >= 3.5) AS hi FROM m GROUP BY ALL) SELECT model_version, unnest(['low', 'mid', 'high']) AS bucket, unnest([lo, mi, hi]) AS n FROM g"


def dimension_diff(spark: SparkSession, d: str) -> DataFrame:
    return summary.dimension_diff(_rounds(spark, d), ["model_a", "model_b"])


_LONG = " UNION ALL ".join(f"SELECT model_a, model_b, '{x}' AS dim, a_{x} AS a, b_{x} AS b FROM medians" for x in k.DIMENSIONS)
SQL["dimension_diff"] = s.JUDGED + f", {s.MEDIANS}, l AS ({_LONG}), g AS (SELECT model_a, model_b, dim, avg(a) AS a, avg(b) AS b FROM l GROUP BY ALL) SELECT model_a, model_b, dim, round(a + 1e-9, 3) AS mean_a, round(b + 1e-9, 3) AS mean_b, round(a - b + 1e-9, 3) AS diff, CASE WHEN round(a - b, 9) > 0.1::DOUBLE THEN '↑' WHEN round(a - b, 9) < -0.1::DOUBLE THEN '↓' ELSE '≈' END AS arrow FROM g"


def pairwise_sheet(spark: SparkSession, d: str) -> DataFrame:
    first = align.keep_first(_judged(spark, d), KEYS, "row_id", "judge_id", "reasoning")
    return summary.pairwise_sheet(_rounds(spark, d).join(first, KEYS))


_MEAN = lambda x: f"round(({' + '.join(f'{x}_{dim}' for dim in k.DIMENSIONS)}) / 6 + 1e-9, 3) AS {x}_mean"
SQL["pairwise_sheet"] = s.JUDGED + f", {s.PLURALITY}, {s.MEDIANS}, f AS (SELECT {s.KEYS}, judge_id, reasoning FROM judged QUALIFY row_number() OVER (PARTITION BY {s.KEYS} ORDER BY row_id) = 1) SELECT {s.KEYS}, winner, {_SIDES}, {_MEAN('a')}, {_MEAN('b')}, agreement AS winner_agreement, judge_id, left(coalesce(reasoning, ''), 200) AS reasoning FROM plural JOIN medians USING ({s.KEYS}) JOIN f USING ({s.KEYS})"


def single_sheet(spark: SparkSession, d: str) -> DataFrame:
    last = align.keep_last(_outputs(spark, d).where("prompt_id is not null and model_version is not null"), ["prompt_id", "model_version"], "row_id", "response")
    return summary.single_sheet(_singles(spark, d).join(profile.full_profile(last, "response"), ["prompt_id", "model_version"]))


SQL["single_sheet"] = s.profile("(SELECT prompt_id, model_version, arg_max_null(response, row_id) AS response FROM model_outputs WHERE prompt_id IS NOT NULL AND model_version IS NOT NULL GROUP BY ALL)", "response", "prompt_id, model_version") + s.JUDGED.replace("\nWITH usable", ", usable") + f", {s.SINGLES} SELECT prompt_id, model_version, {_DIMS}, round({_M6} + 1e-9, 3) AS mean, uncertain, max_std, round(worst, 4) AS repetition_worst, template_ending_count AS template_count, assistant_phrase_count AS assistant_count, paragraph_count, sentence_count FROM single_rounds JOIN full_profile USING (prompt_id, model_version)"


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The format and naturalness of three candidates in one wide row."""
    versions = [BASE, CAND, "osprey-rl"]
    long = _singles(spark, d).where(F.col("model_version").isin(*versions)).withColumn("label", F.concat(F.lit("C"), F.array_position(F.array(*[F.lit(v) for v in versions]), F.col("model_version"))))
    return summary.wide_scores(long, "prompt_id", "label", 3, {"format": "format", "naturalness": "naturalness"})


SQL["score_pivot"] = s.JUDGED + f", {s.SINGLES} SELECT prompt_id, " + ", ".join(f"max({c}) FILTER (model_version = '{v}') AS C{i}_{c}" for i, v in enumerate((BASE, CAND, "osprey-rl"), 1) for c in ("format", "naturalness")) + f" FROM single_rounds WHERE model_version IN ('{BASE}', '{CAND}', 'osprey-rl') GROUP BY prompt_id"


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Characters of prompt and answer in the place of tokens, by version."""
    calls = align.single_join(_outputs(spark, d), table(spark, d, "prompts")).select("model_version", F.char_length("text").alias("prompt_tokens"), F.char_length(t.text("response")).alias("completion_tokens"))
    return summary.token_usage(calls, ["model_version"])


SQL["token_usage"] = f"WITH {_PROMPTS}, c AS (SELECT model_version, length(text) AS p, length(coalesce(response, '')) AS q FROM model_outputs JOIN pr USING (prompt_id)) SELECT model_version, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(q)::BIGINT AS completion_tokens, sum(p + q)::BIGINT AS total_tokens, round(sum(p + q)::DOUBLE / count(*), 2) AS per_call FROM c GROUP BY ALL"


def basic_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.basic(_outputs(spark, d).withColumn("v", F.char_length("response").cast("double")), ["model_version"], "v")


SQL["basic_stats"] = "WITH q AS (SELECT model_version, length(response)::DOUBLE AS v FROM model_outputs WHERE response IS NOT NULL) SELECT model_version, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95 FROM q GROUP BY ALL"


def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return stats.trimmed_mean(_outputs(spark, d).where("model_version is not null").withColumn("v", F.char_length("response").cast("double")), ["model_version"], "v")


SQL["trimmed_mean"] = "WITH q AS (SELECT model_version, length(response)::DOUBLE AS v, row_number() OVER (PARTITION BY model_version ORDER BY length(response)) AS r, count(*) OVER (PARTITION BY model_version) AS n FROM model_outputs WHERE response IS NOT NULL AND model_version IS NOT NULL), c AS (SELECT *, greatest(0, least(floor(n * 0.1::DOUBLE), floor(n / 2) - 1)) AS k FROM q) SELECT model_version, round(avg(v), 4) AS trimmed_mean FROM c WHERE r > k AND r <= n - k GROUP BY ALL"


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_ci(_outputs(spark, d).where("model_version is not null").withColumn("v", F.char_length("response").cast("double")), ["model_version"], "v")


def _pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """(model_a, model_b, dim, x, y) of the medians of both sides."""
    rounds = _rounds(spark, d)
    return rounds.select("model_a", "model_b", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(f"a_{x}").alias("x"), F.col(f"b_{x}").alias("y")) for x in k.DIMENSIONS])).alias("_s")).select("model_a", "model_b", "_s.*")


_PAIRS = s.JUDGED + f", {s.MEDIANS}, ps AS ({_LONG})"
_CDF = "CASE WHEN zz < -8 THEN 0.0 WHEN zz > 8 THEN 1.0 ELSE 0.5 * (1 + CASE WHEN zz < 0 THEN -erf ELSE erf END) END"


def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(_pair_scores(spark, d), ["model_a", "model_b", "dim"], "x", "y")


SQL["wilcoxon"] = _PAIRS + f""", df AS (SELECT model_a, model_b, dim, round(a - b, 9) AS d FROM ps), nz AS (SELECT *, abs(d) AS ad FROM df WHERE d <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b, dim ORDER BY ad) + (count(*) OVER (PARTITION BY model_a, model_b, dim, ad) - 1) / 2 AS r FROM nz),
w AS (SELECT model_a, model_b, dim, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM rk GROUP BY ALL),
e AS (SELECT DISTINCT model_a, model_b, dim FROM df), j AS (SELECT model_a, model_b, dim, coalesce(n, 0) AS n, coalesce(least(up, down), 0.0)::DOUBLE AS statistic FROM e LEFT JOIN w USING (model_a, model_b, dim)),
z AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE (statistic - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) END AS z FROM j),
c AS (SELECT *, -abs(z) AS zz, abs(z) / sqrt(2.0::DOUBLE) AS xx, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS tt FROM z),
f AS (SELECT *, 1 - ((((1.061405429::DOUBLE * tt - 1.453152027::DOUBLE) * tt + 1.421413741::DOUBLE) * tt - 0.284496736::DOUBLE) * tt + 0.254829592::DOUBLE) * tt * exp(-xx * xx) AS erf FROM c),
p AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * ({_CDF})) END AS p FROM f)
SELECT model_a, model_b, dim, n, statistic, round(z + 1e-9, 4) AS z, round(p, 6) AS p_value, p < 0.05 AS significant_005 FROM p"""


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.sign_test(_pair_scores(spark, d), ["model_a", "dim"], "x", "y")


SQL["sign_test"] = _PAIRS + """, g AS (SELECT model_a, dim, count_if(round(a - b, 9) > 0) AS plus, count_if(round(a - b, 9) < 0) AS minus FROM ps GROUP BY ALL), n AS (SELECT *, plus + minus AS n, least(plus, minus) AS lo FROM g)
SELECT model_a, dim, plus, minus, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, (lo + 1)::BIGINT), lambda i: exp(lgamma((n + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n - i + 1)::DOUBLE) - n * ln(2.0::DOUBLE))))) END, 6) AS p_value FROM n"""


def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return stats.cohens_d(_pair_scores(spark, d), ["model_a", "model_b", "dim"], "x", "y")


SQL["cohens_d"] = _PAIRS + ", g AS (SELECT model_a, model_b, dim, avg(a) AS mx, avg(b) AS my, coalesce(var_samp(a), 0) AS vx, coalesce(var_samp(b), 0) AS vy FROM ps GROUP BY ALL) SELECT model_a, model_b, dim, round(mx + 1e-9, 4) AS mean_x, round(my + 1e-9, 4) AS mean_y, round(mx - my + 1e-9, 4) AS diff, round(CASE WHEN sqrt((vx + vy) / 2) < 1e-12 THEN 0.0 ELSE (mx - my) / sqrt((vx + vy) / 2) END + 1e-9, 4) AS cohens_d FROM g"


def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two versions paired by prompt, by dimension."""
    long = _singles(spark, d).where(F.col("model_version").isin("tindra-l", "cassin-x")).select("prompt_id", "model_version", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).alias("score")) for x in k.DIMENSIONS])).alias("_s")).select("prompt_id", "model_version", "_s.*")
    a, b = (long.where(F.col("model_version") == v).select("prompt_id", "dim", F.col("score").alias(c)) for v, c in (("tindra-l", "x"), ("cassin-x", "y")))
    return stats.cohens_d(a.join(b, ["prompt_id", "dim"]), ["dim"], "x", "y")


_LS = " UNION ALL ".join(f"SELECT prompt_id, model_version, '{x}' AS dim, {x} AS v FROM single_rounds" for x in k.DIMENSIONS)
SQL["version_compare"] = s.JUDGED + f", {s.SINGLES}, l AS ({_LS}), g AS (SELECT a.dim, avg(a.v) AS mx, avg(b.v) AS my, coalesce(var_samp(a.v), 0) AS vx, coalesce(var_samp(b.v), 0) AS vy FROM l a JOIN l b ON a.prompt_id = b.prompt_id AND a.dim = b.dim WHERE a.model_version = 'tindra-l' AND b.model_version = 'cassin-x' GROUP BY ALL) SELECT dim, round(mx + 1e-9, 4) AS mean_x, round(my + 1e-9, 4) AS mean_y, round(mx - my + 1e-9, 4) AS diff, round(CASE WHEN sqrt((vx + vy) / 2) < 1e-12 THEN 0.0 ELSE (mx - my) / sqrt((vx + vy) / 2) END + 1e-9, 4) AS cohens_d FROM g"


def length_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank_bounds(_outputs(spark, d).where("model_version is not null").withColumn("v", t.count_chars("response")), ["model_version"], "v")


SQL["length_bounds"] = f"WITH q AS (SELECT model_version, length({s.compact('response')}) AS v FROM model_outputs WHERE model_version IS NOT NULL), o AS (SELECT model_version, v, row_number() OVER (PARTITION BY model_version ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY model_version) AS n FROM q) SELECT model_version, min(v) FILTER (i = floor(n * 5 / 100)) AS low_value, min(v) FILTER (i = floor(least(n * 95 / 100, n - 1))) AS high_value FROM o GROUP BY ALL"


def score_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Results beyond two deviations of their version's mean, or uncertain ones."""
    singles = _singles(spark, d).withColumn("score", F.round(summary.mean_of(*k.DIMENSIONS), 9)).withColumn("worst", F.lit(0.0)).withColumn("phrases", F.lit(0))
    return anomaly.result_anomalies(singles, ["model_version"], "score", "worst", "phrases", "uncertain").select("prompt_id", "model_version", F.array_join("anomaly_types", "|").alias("anomaly_types"), "z_score")


SQL["score_outliers"] = s.JUDGED + f", {s.SINGLES}, m AS (SELECT *, round({_M6}, 9) AS score FROM single_rounds), st AS (SELECT model_version, avg(score) AS mu, stddev_pop(score) AS sd FROM m GROUP BY ALL), z AS (SELECT m.*, CASE WHEN sd > 0 THEN (score - mu) / sd END AS z FROM m JOIN st USING (model_version)), a AS (SELECT *, list_filter([CASE WHEN round(abs(z), 9) > 2 THEN 'extreme_score' END, CASE WHEN uncertain THEN 'judge_disagreement' END], lambda x: x IS NOT NULL) AS ty FROM z) SELECT prompt_id, model_version, array_to_string(ty, '|') AS anomaly_types, round(z, 3) AS z_score FROM a WHERE len(ty) > 0"


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_singles(spark, d).withColumn("score", F.round(summary.mean_of(*k.DIMENSIONS), 9)), ["model_version"], "score", 1.0, 5.0)


SQL["score_histogram"] = s.JUDGED + f", {s.SINGLES}, m AS (SELECT model_version, round({_M6}, 9) AS score FROM single_rounds) SELECT model_version, least(floor((score - 1.0::DOUBLE) / ((5.0::DOUBLE - 1.0::DOUBLE) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM m WHERE score BETWEEN 1 AND 5 GROUP BY ALL"


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
