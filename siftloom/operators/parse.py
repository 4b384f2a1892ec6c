"""Parsing of model replies and of question-answer texts: lenient JSON, labelled and numbered pairs, rendered answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t

_WS = k.WS_JAVA
#: Labelled pairs, and numbered ones.
PAIR = rf"(?sid)(?:问题?|Q|Question){_WS}*[:：]{_WS}*(.+?)(?:\n|$){_WS}*(?:答案?|A|Answer){_WS}*[:：]{_WS}*(.+?)(?:\n\n|\n(?=问题?|Q|Question)|$)"
NUMBERED = rf"(?sid)(\p{{Nd}}+){_WS}*[.、)]{_WS}*(.+?)(?:\n|$){_WS}*(?:答案?|A|Answer){_WS}*[:：]{_WS}*(.+?)(?:\n\n|\n(?=\p{{Nd}}+{_WS}*[.、)])|$)"


def regex_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, id, question, answer) of labelled pairs, else of numbered ones."""
    c = t.text(column)
    hit = lambda p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    labelled = F.zip_with(hit(PAIR, 1), hit(PAIR, 2), lambda q, a: F.struct(t.strip(q).alias("question"), t.strip(a).alias("answer")))
    labelled = F.transform(labelled, lambda x, i: F.struct((i + 1).cast("string").alias("id"), x["question"].alias("question"), x["answer"].alias("answer")))
    numbered = F.zip_with(F.arrays_zip(hit(NUMBERED, 1).alias("n"), hit(NUMBERED, 2).alias("q")), hit(NUMBERED, 3), lambda x, a: F.struct(x["n"].alias("id"), t.strip(x["q"]).alias("question"), t.strip(a).alias("answer")))
    found = df.select(key, F.when(F.size(labelled) > 0, labelled).otherwise(numbered).alias("_p"))
    return found.select(key, F.explode("_p").alias("_p")).select(key, "_p.*")


def extracted_pairs(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, id, question, answer) from a reply that holds a JSON array of pairs somewhere (A8); entries without a question drop out."""
    whole = F.regexp_extract(t.text(reply), r"(?s)\[.*\]", 0)
    fenced = F.regexp_replace(t.text(reply), "```(?:json)?", "")
    parsed = F.coalesce(F.from_json(F.when(whole != "", whole), "array<struct<id:string,question:string,answer:string>>"), F.from_json(fenced, "array<struct<id:string,question:string,answer:string>>"))
    rows = df.select(key, F.posexplode(parsed).alias("_i", "_s")).where(F.col("_s.question").isNotNull() & (t.compact("_s.question") != ""))
    return rows.select(key, F.coalesce("_s.id", (F.col("_i") + 1).cast("string")).alias("id"), F.col("_s.question").alias("question"), t.text("_s.answer").alias("answer"))


def qa_json(df: DataFrame, column: str) -> Column:
    """A reply as VARIANT: the whole text, else its widest braces (J1, J2); null if neither parses."""
    c = t.text(column)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def lenient_json(column: str) -> Column:
    """The JSON object of a reply as text: the whole, else the widest braces, else a fenced block."""
    c = t.strip(t.text(column))
    braces = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    fence = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(c), ok(braces), ok(fence))


def score_of(reply: str, dim: str, *sections: str) -> Column:
    """A dimension's score of a reply, from the first section that has it or from the top; 0 if missing or no number."""
    paths = [f"$.{s}.{dim}" for s in sections] + [f"$.{dim}"]
    return F.coalesce(*[F.get_json_object(reply, p).try_cast("double") for p in paths], F.lit(0.0))


#: The prompt that asks for the pairs of a document, before and after its text, and the note on a cut text.
EXTRACTION = (
    """请从以下原始文本中识别并提取所有的「问题-答案」对。

# 提取规则
1. 识别文本中所有明确或隐含的问答对
2. 如果文本有明显的 Q/A、问/答、题目/解答等标记，按标记拆分
3. 如果是表格形式（问题列 + 答案列），逐行提取
4. 如果没有明显标记，根据语义判断哪些是问题、哪些是对应的答案
5. 为每条提取结果分配一个递增 ID（从 1 开始）

# 输出格式
严格输出 JSON 数组（不要包含 ```json 标记）：
[
  {"id": "1", "question": "提取到的问题", "answer": "提取到的答案"},
  {"id": "2", "question": "...", "answer": "..."}
]

如果某条只有问题没有答案，answer 填空字符串 ""。

# 原始文本
""",
    "\n",
)
CUT_NOTE = "\n... (文本已截断)"


def extraction_prompt(column: str, most: int = 15_000) -> Column:
    """The prompt that asks a model for the pairs of a document, with its first characters and a note if there are more."""
    c = t.text(column)
    cut = F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(CUT_NOTE))).otherwise(c)
    return F.concat(F.lit(EXTRACTION[0]), cut, F.lit(EXTRACTION[1]))


def render_steps(thinking: Column, steps: Column, final: Column) -> Column:
    """Thinking block, numbered steps with their formulas, final answer line (I20); nulls count as empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    label = lambda s: F.concat(F.lit("**Step "), s["step_number"].cast("string"), F.when(empty(s["step_type"]) != "", F.concat(F.lit(" ["), s["step_type"], F.lit("]"))).otherwise(""), F.lit("**\n"))
    formula = lambda s: F.when(empty(s["formula"]) != "", F.concat(F.lit("$$\n"), s["formula"], F.lit("\n$$\n"))).otherwise("")
    step = lambda s: F.concat(label(s), empty(s["content"]), F.lit("\n"), formula(s), F.lit("\n"))
    return F.concat(F.lit("<think>\n"), empty(thinking), F.lit("\n</think>\n\n"), F.array_join(F.coalesce(F.transform(steps, step), F.array().cast("array<string>")), ""), F.lit(k.FINAL_ANSWER_MARK + " "), empty(final))


def render_feedback(evaluation: str, checks: str | None = None) -> Column:
    """Feedback for a rework (I21): each wrong step with its explanation and fix, a wrong final answer, coherence, suggestion.

    checks is the path of the step verifications (step_number, is_correct, error_type, explanation, suggested_fix); without
    one there are no lines of steps. Nulls count as empty, a null verdict on the final answer as wrong.
    """
    e, empty = F.col(evaluation), lambda c: F.coalesce(c, F.lit(""))
    wrong = lambda v: F.concat(F.lit("Step "), v["step_number"].cast("string"), F.lit(" 错误 ["), empty(v["error_type"]), F.lit("]: "), empty(v["explanation"]), F.when(empty(v["suggested_fix"]) != "", F.concat(F.lit("\n  建议修正: "), v["suggested_fix"])).otherwise(""))
    steps = F.nullif(F.array_join(F.transform(F.filter(F.col(checks), lambda v: ~v["is_correct"]), wrong), "\n"), F.lit("")) if checks else F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        steps,
        F.when(~F.coalesce(e["final_answer_correct"], F.lit(False)), "最终答案不正确，需要修正。"),
        F.concat(F.lit("推理链连贯性评分: "), F.coalesce(e["chain_coherence"], F.lit(0.0)).cast("string"), F.lit("/10")),
        F.when(empty(e["suggestion"]) != "", F.concat(F.lit("总体建议: "), e["suggestion"])),
    )


def user_message(instruction: Column, predictions: Column, most: int = 6000) -> Column:
    """Instruction and labelled candidates, each cut to a length, as one message (I22); a blank candidate has a mark of its own."""
    body = lambda p: F.coalesce(F.nullif(t.hard_truncate(p, most), F.lit("")), F.lit("（空回答）"))
    one = lambda p, i: F.concat(F.lit("### C"), (i + 1).cast("string"), F.lit("\n"), body(p), F.lit("\n"))
    return F.concat(F.lit("## 题目（Instruction）\n"), t.text(instruction), F.lit("\n\n## 候选回答\n"), F.array_join(F.transform(predictions, one), "\n"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested struct columns as top-level columns with dotted names."""

    def leaves(schema, path: list[str]) -> list[list[str]]:
        out = []
        for f in schema.fields:
            out += leaves(f.dataType, [*path, f.name]) if hasattr(f.dataType, "fields") else [[*path, f.name]]
        return out

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p)) for p in leaves(df.schema, [])])
