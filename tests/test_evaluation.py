"""Evaluation programs with failing judges and empty tables; the bounded id filter."""

from pyspark.sql import functions as F

from siftloom.functions.idfilter import bits_for, maybe_in, without
from siftloom.plans import evaluation, judging


def fickle():
    """A judge that fails on some messages and answers others in prose without JSON."""

    class Fickle:
        def ask(self, message, temperature):
            if "坏" in message:
                raise ValueError("no")
            return "no json here" if "空" in message else judging.LengthJudge().ask(message, temperature)

    return Fickle()


def test_failed_calls_leave_their_round_out(spark):
    prompts = spark.createDataFrame([("p", "t", "c"), ("q", "坏", "c")], "prompt_id string, text string, category string")
    outputs = spark.createDataFrame([(1, "p", "a", "12345"), (2, "p", "b", "空"), (3, "q", "a", "x"), (4, "p", "a", None), (5, None, "a", "x")], "row_id bigint, prompt_id string, model_version string, response string")
    got = {(r.prompt_id, r.model_version): (r.format, r.num_rounds) for r in evaluation.judge_answers(outputs, prompts, fickle(), rounds=2)["results"].collect()}
    assert got == {("p", "a"): (1.0, 4)}
    pairs = evaluation.judge_pairs(outputs, prompts, "a", "b", judging.LengthJudge())
    r = pairs["results"].first()
    assert (r.prompt_id, r.winner, r.num_rounds, r.position_swaps) == ("p", "B", 3, 1)
    assert pairs["summary"].first().total == 1 and {x.calls for x in pairs["usage"].collect()} == {1}
    assert evaluation.judge_pairs(outputs.limit(0), prompts, "a", "b", judging.LengthJudge())["results"].count() == 0


def test_score_twice_survives_failures(spark):
    items = spark.createDataFrame([(1, "qq", "12345678"), (2, "qqq", "1"), (3, "坏", "x"), (4, None, None), (5, "空", "x")], "pos bigint, question string, answer string")
    got = {r.pos: r.evaluation for r in evaluation.score_twice(items, fickle()).collect()}
    assert got[1].total_score == 9.0 and got[1].passed and got[1].suggestion == "无"
    assert got[2].total_score == 5.0 and got[2].suggestion == "仲裁" and not got[2].passed
    assert got[3] is None and got[5] is None and got[4].total_score == 0.0
    assert evaluation.score_twice(items.limit(0), fickle()).count() == 0


def test_id_filter_keeps_all_that_match(spark):
    df = spark.range(20_000).select((F.col("id") * 7).alias("id"), F.lit("x").alias("_w2")).unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit("null").alias("_w2")))
    ids = spark.range(0, 20_000, 40).select((F.col("id") * 7).alias("id"))
    kept = {r.id for r in maybe_in(df, "id", ids).collect()}
    want = {r.id for r in ids.collect()}
    assert want <= kept and len(kept) < 3 * len(want)
    rest = [r.id for r in without(df, "id", ids).collect()]
    assert len(rest) == 20_001 - len(want) and not want & set(rest) and None in rest
    assert maybe_in(df, "id", ids.limit(0)).count() == 0 and without(df, "id", ids.limit(0)).count() == 20_001
    assert bits_for(0) == 16 and bits_for(10**12) == 26


def test_report_sections(spark):
    from siftloom.functions import constants as k
    from siftloom.plans import report

    sides = ", ".join(f"{v}D as {s}_{d}" for s, v in (("a", 3.0), ("b", 3.5)) for d in k.DIMENSIONS)
    pairs = spark.sql(f"select 'p' as prompt_id, 'x' as model_a, 'y' as model_b, 'A' as winner, 1.0D as agreement, 3L as num_rounds, {sides}")
    prompts = spark.createDataFrame([("p", "t", "c|d")], "prompt_id string, text string, category string")
    single = spark.sql("select 'p' as prompt_id, 'x' as model_version, " + ", ".join(f"4.0D as {d}" for d in k.DIMENSIONS) + ", 2L as num_rounds, 0.5D as max_std, false as uncertain")
    text = report.markdown({"mode": "both"}, report.pairwise_sections(pairs, prompts, ["model_a", "model_b"]), report.single_sections(single))
    for line in ("## 评测配置", "| x | y | Baseline 胜 | 100.0% |", "| x | y | 总计 | 1 条 |", "| x | y | 格式排版 | 3.000 | 3.500 | +0.500 ↑ |", "| c\\|d | 1 | 1 | 0 | 0 |", "| x | 1 | 4.000 | 0.0% | 0.500 |", "| x | 语言自然度 | 4.000 |", "| x | 0 | 0 | 1 |"):
        assert line in text, (line, text)
