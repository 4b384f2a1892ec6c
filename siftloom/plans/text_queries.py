"""Queries over texts: profiles, rules, difficulty, deduplication, parsing; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.operators import anomaly, dedup, parse, profile, summary
from siftloom.plans import sql as s
from siftloom.session import table

SQL: dict[str, str] = {}


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_outputs").select("row_id", "prompt_id", "model_version", "response")


P = s.profile("model_outputs", "response", "row_id, prompt_id, model_version")


def text_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: quality of all answers by version and difficulty of the answer's text."""
    df = profile.difficulty(profile.structure_profile(profile.repetition_profile(_responses(spark, d), "response"), "response"), "response")
    return df.groupBy("model_version", "difficulty_level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("char_4") + 1e-9, 4).alias("avg_char_4"), F.sum("sentence_count").alias("sentences"), F.sum("paragraph_count").alias("paragraphs"))


def char_ngram_repetition(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("row_id", F.round(t.char_repetition("response", 4), 6).alias("rate"), t.count_chars("response").alias("chars"))


SQL["char_ngram_repetition"] = f"WITH b AS (SELECT row_id, {s.compact('response')} AS c FROM model_outputs), q AS (SELECT row_id, string_split(c, '') AS ch, length(c) AS cn FROM b) SELECT row_id, round({s.rate(4)}, 6) AS rate, cn AS chars FROM q"


def repetition_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.repetition_profile(_responses(spark, d), "response").select("row_id", "char_3", "char_4", "char_5", "word_3", "word_4", "word_5", "half_split_repeat", "total_chars")


SQL["repetition_profile"] = P + " SELECT row_id, char_3, char_4, char_5, word_3, word_4, word_5, half_split_repeat, total_chars FROM full_profile"


def structure_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.structure_profile(_responses(spark, d), "response").select("row_id", "paragraph_count", "sentence_count", "avg_paragraph_length", "paragraph_length_std", "heading_count", "list_item_count", "chars_per_sentence")


SQL["structure_profile"] = P + " SELECT row_id, paragraph_count, sentence_count, avg_paragraph_length, paragraph_length_std, heading_count, list_item_count, chars_per_sentence FROM full_profile"


def style_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.style_profile(_responses(spark, d), "response").select("row_id", F.array_join("template_endings", "|").alias("template_endings"), "template_ending_count", F.array_join("assistant_phrases", "|").alias("assistant_phrases"), "assistant_phrase_count")


SQL["style_profile"] = P + " SELECT row_id, array_to_string(te, '|') AS template_endings, template_ending_count, array_to_string(ap, '|') AS assistant_phrases, assistant_phrase_count FROM full_profile"


def analysis_text(spark: SparkSession, d: str) -> DataFrame:
    return profile.analysis_text(profile.full_profile(_responses(spark, d), "response"), "response", label="A", most=400).select("row_id", "analysis")


_QUOTE = "''"
_LISTED = lambda c: f"'[{_QUOTE}' || array_to_string({c}, '{_QUOTE}, {_QUOTE}') || '{_QUOTE}]'"
SQL["analysis_text"] = P + f""" SELECT row_id, concat_ws(chr(10), '## 规则预分析报告（回答 A）',
  CASE WHEN length(t) > 400 THEN '- [注意] 原文较长(' || total_chars || '字)，已截断展示，以下统计数据基于全文' END, '- 总字数: ' || total_chars,
  '- 最高 n-gram 重复率: ' || CASE WHEN char_3 = worst THEN 'char_3gram' WHEN char_4 = worst THEN 'char_4gram' ELSE 'char_5gram' END || ' = ' || printf('%.2f%%', worst * 100),
  '- 前后半段重复率: ' || printf('%.2f%%', half_split_repeat * 100),
  '- 段落数 ' || paragraph_count || ', 句子数 ' || sentence_count || ', 平均段落长度 ' || printf('%.1f', avg_paragraph_length) || ' 字',
  CASE WHEN heading_count > 0 THEN '- Markdown 标题 ' || heading_count || ' 个' END, CASE WHEN list_item_count > 0 THEN '- 列表项 ' || list_item_count || ' 个' END,
  CASE WHEN len(te) > 0 THEN '- [警告] 模板化结尾: ' || {_LISTED('te')} END, CASE WHEN len(ap) > 0 THEN '- [警告] 助手化用语: ' || {_LISTED('ap')} END) AS analysis FROM full_profile"""


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("row_id", F.posexplode(t.sentences("response")).alias("at", "sentence")).select("row_id", F.col("at").cast("bigint").alias("at"), "sentence")


_D = k.SENTENCE_MARKS
SQL["sentence_split"] = f"WITH q AS (SELECT row_id, list_filter(list_transform(regexp_extract_all({s.text('response')}, '[^{_D}]*[{_D}]|[^{_D}]+$'), lambda x: {s.strip('x')}), lambda x: x <> '') AS l FROM model_outputs) SELECT row_id, unnest(range(0, len(l))) AS at, unnest(l) AS sentence FROM q"


def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("row_id", F.posexplode(t.paragraphs("response")).alias("at", "paragraph")).select("row_id", F.col("at").cast("bigint").alias("at"), "paragraph")


SQL["paragraph_split"] = f"WITH q AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array({s.text('response')}, '\\n+'), lambda x: {s.strip('x')}), lambda x: x <> '') AS l FROM model_outputs) SELECT row_id, unnest(range(0, len(l))) AS at, unnest(l) AS paragraph FROM q"


def smart_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("row_id", t.smart_truncate("response", 200).alias("cut"), t.hard_truncate("response", 240).alias("hard_cut"))


SQL["smart_truncate"] = f"""SELECT row_id, CASE WHEN length({s.text('response')}) <= 200 THEN {s.text('response')} ELSE left(response, 120) || chr(10) || chr(10) || '[...此处省略约 ' || (length(response) - 180) || ' 字，预分析报告包含全文统计数据...]' || chr(10) || chr(10) || right(response, 60) END AS cut,
 CASE WHEN length({s.text('response')}) <= 240 THEN {s.text('response')} ELSE left(response, 156) || chr(10) || chr(10) || '[…中间省略…]' || chr(10) || chr(10) || right(response, 4) END AS hard_cut FROM model_outputs"""


def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_items").select("row_id", t.normalize_answer("answer").alias("normal"), t.final_answer("answer").alias("final_answer"))


SQL["normalize_answer"] = f"SELECT row_id, lower(regexp_replace({s.text('answer')}, '[。，、；：！？]|{s.WS}', '', 'g')) AS normal, CASE WHEN contains({s.text('answer')}, '{k.FINAL_ANSWER_MARK}') THEN {s.strip(f'''list_extract(string_split(answer, '{k.FINAL_ANSWER_MARK}'), -1)''')} ELSE '' END AS final_answer FROM output_items"


def extract_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_items").select("row_id", t.extract_answer("answer").alias("extracted"))


_PATTERNS = [p.replace(k.WS_JAVA, s.WS) for p in t.ANSWER_PATTERNS]
SQL["extract_answer"] = "SELECT row_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches({s.text('answer')}, '(?s){p}') THEN {s.strip(f'''regexp_extract({s.text('answer')}, '(?s){p}', 1)''')} END" for p in _PATTERNS) + f", {s.strip(f'''list_extract(string_split({s.strip(s.text('answer'))}, chr(10)), -1)''')}) AS extracted FROM output_items"


def _difficulty_sql(c: str) -> str:
    low, raw = f"lower({s.text(c)})", s.text(c)
    words = lambda w, n: " + ".join(f"{n} * contains({low}, lower('{x}'))::INT" for x in w)
    formulas = f"(len(regexp_extract_all({raw}, '\\$[^$]+\\$')) + len(regexp_extract_all({raw}, '\\\\\\(.*?\\\\\\)')))"
    marks = f"len(regexp_extract_all({raw}, '[？?]'))"
    return f"({words(k.HARD_WORDS, 3)} + {words(k.MEDIUM_WORDS, 1)} + {words(k.EASY_WORDS, -1)} + CASE WHEN {formulas} >= 3 THEN 2 WHEN {formulas} >= 1 THEN 1 ELSE 0 END + CASE WHEN length({raw}) > 300 THEN 2 WHEN length({raw}) > 100 THEN 1 ELSE 0 END + CASE WHEN {marks} >= 3 THEN 2 ELSE 0 END)::BIGINT"


_LEVEL = "CASE WHEN difficulty_score >= 5 THEN 'hard' WHEN difficulty_score >= 2 THEN 'medium' ELSE 'easy' END"


SQL["text_quality_summary"] = P + f", g AS (SELECT *, {_difficulty_sql('t')} AS difficulty_score FROM full_profile) SELECT model_version, {_LEVEL} AS difficulty_level, count(*) AS n, round(avg(char_4) + 1e-9, 4) AS avg_char_4, sum(sentence_count)::BIGINT AS sentences, sum(paragraph_count)::BIGINT AS paragraphs FROM g GROUP BY ALL"


def difficulty_levels(spark: SparkSession, d: str) -> DataFrame:
    return profile.difficulty(table(spark, d, "corpus").select("row_id", "question"), "question").select("row_id", "difficulty_score", "difficulty_level")


SQL["difficulty_levels"] = f"WITH q AS (SELECT row_id, {_difficulty_sql('question')} AS difficulty_score FROM corpus) SELECT row_id, difficulty_score, {_LEVEL} AS difficulty_level FROM q"


def difficulty_histogram(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty_level string")
    counts = difficulty_levels(spark, d).groupBy("difficulty_level").agg(F.count(F.lit(1)).alias("c"))
    return levels.join(counts, "difficulty_level", "left").select("difficulty_level", F.coalesce("c", F.lit(0)).alias("n"))


SQL["difficulty_histogram"] = f"WITH q AS (SELECT {_difficulty_sql('question')} AS difficulty_score FROM corpus), l AS (SELECT {_LEVEL} AS difficulty_level FROM q) SELECT v.difficulty_level, count(l.difficulty_level) AS n FROM (VALUES ('easy'), ('medium'), ('hard')) v(difficulty_level) LEFT JOIN l USING (difficulty_level) GROUP BY ALL"

RULED = f"""
WITH b AS (SELECT row_id, prompt_id, model_version, {s.text('response')} AS t, {s.compact('response')} AS c FROM model_outputs),
q AS (SELECT *, string_split(c, '') AS ch, length(c) AS cn, {s.sentence_count('t')} AS sc FROM b),
r AS (SELECT *, {s.rate(4)} AS rate, len({s.present('right(t, 200)', k.TEMPLATE_ENDINGS)}) AS tpl, len({s.present('t', k.ASSISTANT_PHRASES)}) AS ast FROM q),
ruled AS (SELECT row_id, prompt_id, model_version, cn AS length, sc AS sentence_count, round(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 5.0::DOUBLE - CASE WHEN cn BETWEEN 50 AND 50000 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END - CASE WHEN rate >= 0.3::DOUBLE THEN least(2.0::DOUBLE, (rate - 0.3::DOUBLE) * 5) ELSE 0.0::DOUBLE END - 0.5::DOUBLE * tpl - 0.3::DOUBLE * least(ast, 3) - CASE WHEN sc < 3 AND cn > 100 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)), 2) AS rule_score FROM r)"""


def rule_judge_single(spark: SparkSession, d: str) -> DataFrame:
    return profile.rule_score(_responses(spark, d), "response").select("row_id", "length", "sentence_count", "rule_score")


SQL["rule_judge_single"] = RULED + " SELECT row_id, length, sentence_count, rule_score FROM ruled"


def rule_judge_pairwise(spark: SparkSession, d: str) -> DataFrame:
    from siftloom.operators import align

    scored = profile.rule_score(_responses(spark, d), "response")
    last = align.keep_last(scored.where("model_version is not null and prompt_id is not null"), ["prompt_id", "model_version"], "row_id", "rule_score")
    a, b = (last.where(F.col("model_version") == v).select("prompt_id", F.col("rule_score").alias(c)) for v, c in (("harrow-1", "a"), ("harrow-2", "b")))
    return a.join(b, "prompt_id").select("prompt_id", "a", "b", profile.rule_winner(F.col("a"), F.col("b")).alias("winner"))


SQL["rule_judge_pairwise"] = RULED + """, last AS (SELECT prompt_id, model_version, arg_max(rule_score, row_id) AS rs FROM ruled WHERE model_version IS NOT NULL AND prompt_id IS NOT NULL GROUP BY ALL)
SELECT prompt_id, x.rs AS a, y.rs AS b, CASE WHEN x.rs > y.rs + 0.2::DOUBLE THEN 'A' WHEN y.rs > x.rs + 0.2::DOUBLE THEN 'B' ELSE 'tie' END AS winner FROM last x JOIN last y USING (prompt_id) WHERE x.model_version = 'harrow-1' AND y.model_version = 'harrow-2'"""


def rule_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The rules applied to a flat score of 3 on every answer."""
    df = profile.full_profile(_responses(spark, d), "response").withColumn("repetition", F.lit(3.0)).withColumn("naturalness", F.lit(3.0))
    return profile.rule_corrections(df).select("row_id", F.round("repetition_corrected", 6).alias("repetition"), F.round("naturalness_corrected", 6).alias("naturalness"))


SQL["rule_corrections"] = P + """, n1 AS (SELECT *, CASE WHEN template_ending_count > 0 THEN greatest(1.0::DOUBLE, 3.0::DOUBLE - 0.5::DOUBLE * template_ending_count) ELSE 3.0::DOUBLE END AS nat FROM full_profile)
SELECT row_id, round(CASE WHEN worst > 0.3::DOUBLE THEN greatest(1.0::DOUBLE, 3.0::DOUBLE - least(2.0::DOUBLE, (worst - 0.3::DOUBLE) * 5)) ELSE 3.0::DOUBLE END, 6) AS repetition, round(CASE WHEN assistant_phrase_count > 2 THEN greatest(1.0::DOUBLE, nat - 0.3::DOUBLE * least(assistant_phrase_count, 5)) ELSE nat END, 6) AS naturalness FROM n1"""

_CLASSES = f""", cls AS (SELECT *, CASE WHEN worst > 0.5::DOUBLE THEN 'critical' WHEN worst > 0.3::DOUBLE THEN 'high' WHEN worst > 0.15::DOUBLE THEN 'moderate' ELSE 'normal' END AS severity,
  CASE WHEN avg_paragraph_length = 0 THEN 'unknown' WHEN paragraph_length_std / avg_paragraph_length > 1.5::DOUBLE THEN 'unbalanced' WHEN paragraph_length_std / avg_paragraph_length > 0.8::DOUBLE THEN 'moderate' ELSE 'balanced' END AS balance,
  CASE WHEN paragraph_count <= 1 AND sentence_count > 5 THEN 'poor' WHEN paragraph_count >= 3 AND sentence_count >= 5 THEN 'good' ELSE 'acceptable' END AS quality,
  CASE WHEN template_ending_count > 2 AND assistant_phrase_count > 3 THEN '{k.DIAGNOSES['both']}' WHEN template_ending_count > 1 THEN '{k.DIAGNOSES['template']}' WHEN assistant_phrase_count > 2 THEN '{k.DIAGNOSES['assistant']}' ELSE '{k.DIAGNOSES['normal']}' END AS diagnosis FROM full_profile),
iss AS (SELECT *, list_filter([CASE WHEN severity IN ('high', 'critical') THEN '{k.ISSUES['repetition']}' END, CASE WHEN template_ending_count > 1 THEN '{k.ISSUES['template']}' END, CASE WHEN assistant_phrase_count > 2 THEN '{k.ISSUES['assistant']}' END, CASE WHEN quality = 'poor' THEN '{k.ISSUES['structure']}' END], lambda x: x IS NOT NULL) AS issues FROM cls)"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return profile.long_answer_classes(profile.full_profile(_responses(spark, d), "response"))


def long_answer_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("row_id", "severity", "balance", "quality", "diagnosis", F.array_join("issues", "|").alias("issues"))


SQL["long_answer_classes"] = P + _CLASSES + " SELECT row_id, severity, balance, quality, diagnosis, array_to_string(issues, '|') AS issues FROM iss"


def long_answer_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.long_answer_summary(_classes(spark, d).withColumn("score", F.col("sentence_count").cast("double")), "score")


SQL["long_answer_summary"] = P + _CLASSES + " SELECT count(*) AS n, round(avg(sentence_count), 3) AS score_mean, round(stddev_pop(sentence_count), 3) AS score_std, round(avg((len(issues) > 0)::INT), 3) AS issue_rate FROM iss"


def long_answer_distribution(spark: SparkSession, d: str) -> DataFrame:
    return summary.class_distribution(_classes(spark, d))


SQL["long_answer_distribution"] = P + _CLASSES + ", p AS (SELECT 'issue' AS kind, unnest(issues) AS value FROM iss UNION ALL SELECT 'severity', severity FROM iss UNION ALL SELECT 'structure', quality FROM iss UNION ALL SELECT 'style', diagnosis FROM iss) SELECT kind, value, count(*) AS n FROM p GROUP BY ALL"


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, d, "corpus").select("row_id", "question"), "row_id", "question").select("row_id")


_KEY = f"md5(lower({s.compact('question')}))"
SQL["exact_dedup"] = f"SELECT row_id FROM corpus QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY row_id) = 1"

_SETS = f"""
WITH RECURSIVE firsts AS (SELECT row_id, lower({s.compact('question')}) AS c FROM corpus QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY row_id) = 1),
chars AS (SELECT row_id, c, string_split(c, '') AS ch, length(c) AS cn FROM firsts),
sets AS (SELECT row_id, CASE WHEN cn < 3 THEN [c] ELSE list_distinct(list_transform(range(1, cn - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2])) END AS g FROM chars),
grams AS (SELECT row_id, len(g) AS n, unnest(g) AS gram FROM sets),
common AS (SELECT x.row_id AS a, y.row_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM grams x JOIN grams y ON x.gram = y.gram AND x.row_id < y.row_id AND least(x.n, y.n) >= 0.85::DOUBLE * greatest(x.n, y.n) GROUP BY ALL),
pairs AS (SELECT a, b, k::DOUBLE / (na + nb - k) AS similarity FROM common WHERE k::DOUBLE / (na + nb - k) >= 0.85::DOUBLE)"""


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    firsts = dedup.exact_dedup(table(spark, d, "corpus").select("row_id", "question"), "row_id", "question")
    return dedup.similar_pairs(firsts, "row_id", "question").select("a", "b", F.round("similarity", 6).alias("similarity"))


SQL["similar_pairs"] = _SETS + " SELECT a, b, round(similarity, 6) AS similarity FROM pairs"

_GREEDY = """,
nodes AS (SELECT b AS node, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS removed UNION ALL SELECT w.i + 1, CASE WHEN len(list_filter(n.earlier, lambda e: NOT list_contains(w.removed, e))) > 0 THEN list_append(w.removed, n.node) ELSE w.removed END FROM walk w JOIN nodes n ON n.i = w.i + 1),
gone AS (SELECT unnest(removed) AS row_id FROM walk WHERE i = (SELECT max(i) FROM walk))"""


def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_status(table(spark, d, "corpus").select("row_id", "question"), "row_id", "question").where("status = 'keep'").select(F.col("pos").alias("row_id"))


SQL["near_dedup"] = _SETS + _GREEDY + " SELECT row_id FROM firsts WHERE row_id NOT IN (SELECT row_id FROM gone)"


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_status(table(spark, d, "corpus").select("row_id", "question"), "row_id", "question").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


SQL["dedup_report"] = _SETS + _GREEDY + ", st AS (SELECT CASE WHEN f.row_id IS NULL THEN 'exact_dup' WHEN g.row_id IS NOT NULL THEN 'near_dup' ELSE 'keep' END AS status FROM corpus c LEFT JOIN firsts f ON c.row_id = f.row_id LEFT JOIN gone g ON c.row_id = g.row_id) SELECT status, count(*) AS n FROM st GROUP BY ALL"


def output_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.output_anomalies(_responses(spark, d), ["model_version"], "response").select("row_id", "length", F.array_join("anomaly_types", "|").alias("anomaly_types"), "repeat_rate")


_ANOMALY = f"""
WITH b AS (SELECT row_id, model_version, {s.compact('response')} AS c FROM model_outputs), q AS (SELECT row_id, model_version, string_split(c, '') AS ch, length(c) AS cn FROM b),
r AS (SELECT row_id, model_version, cn, {s.rate(4)} AS rate FROM q), o AS (SELECT model_version, cn, row_number() OVER (PARTITION BY model_version ORDER BY cn) - 1 AS i, count(*) OVER (PARTITION BY model_version) AS n FROM r),
lim AS (SELECT model_version, min(cn) FILTER (i = floor(n * 5 / 100)) AS lo, min(cn) FILTER (i = floor(least(n * 95 / 100, n - 1))) AS hi FROM o GROUP BY model_version),
a AS (SELECT row_id, cn AS length, rate, list_filter([CASE WHEN cn = 0 THEN 'empty_response' END, CASE WHEN cn < lo OR cn > hi THEN 'length_outlier' END, CASE WHEN rate > 0.3::DOUBLE THEN 'high_repetition' END], lambda x: x IS NOT NULL) AS types FROM r JOIN lim ON r.model_version IS NOT DISTINCT FROM lim.model_version)"""
SQL["output_anomalies"] = _ANOMALY + " SELECT row_id, length, array_to_string(types, '|') AS anomaly_types, round(rate, 4) AS repeat_rate FROM a WHERE len(types) > 0"


def anomaly_distribution(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.type_distribution(anomaly.output_anomalies(_responses(spark, d), ["model_version"], "response"))


SQL["anomaly_distribution"] = _ANOMALY + ", u AS (SELECT unnest(types) AS type FROM a) SELECT type, count(*) AS n FROM u GROUP BY ALL"


def regex_qa(spark: SparkSession, d: str) -> DataFrame:
    return parse.regex_pairs(table(spark, d, "documents"), "doc_id", "text")


def extraction_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(parse.extraction_prompt("text")).alias("digest"))


SQL["extraction_prompt"] = f"SELECT doc_id, md5('{parse.EXTRACTION[0]}' || CASE WHEN length({s.text('text')}) > 15000 THEN left(text, 15000) || chr(10) || '... (文本已截断)' ELSE {s.text('text')} END || chr(10)) AS digest FROM documents"


def queries() -> dict:
    mine = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
    return mine
