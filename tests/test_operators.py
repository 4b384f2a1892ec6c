"""Deduplication, alignment, votes, statistics and parsing on small tables with nulls, ties and extra columns."""

import math
import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftloom import session
from siftloom.operators import align, anomaly, dedup, parse, stats, summary, votes
from siftloom.plans import eval_queries


def grams(s):
    s = "".join((s or "").lower().split())
    return {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}


def greedy(rows, threshold):
    seen, kept, status = set(), [], {}
    for pos, s in rows:
        key = "".join((s or "").lower().split())
        if key in seen:
            status[pos] = "exact_dup"
            continue
        seen.add(key)
        g = grams(s)
        if any(len(g & h) / len(g | h) >= threshold for h in kept):
            status[pos] = "near_dup"
        else:
            kept.append(g)
            status[pos] = "keep"
    return status


def test_dedup_is_the_greedy_rule(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    texts = [None, "", " ", "ab", "AB", *base]
    for s in base:
        for _ in range(4):
            x = list(s)
            x[rng.randrange(40)] = "z"
            texts.append("".join(x))
            s = texts[-1]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "pos bigint, q string").withColumn("extra", F.lit(1))
    got = {r.pos: r.status for r in dedup.dedup_status(df, "pos", "q", 0.8).collect()}
    assert got == greedy(rows, 0.8)
    assert {"keep", "exact_dup", "near_dup"} <= set(got.values())
    assert dedup.dedup_status(df.limit(0), "pos", "q").count() == 0


def test_similar_pairs_are_exact(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, q string")
    got = {(r.a, r.b) for r in dedup.similar_pairs(df, "pos", "q", 0.5).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.5}
    assert got == want


@pytest.fixture
def stored(monkeypatch):
    """(columns, rows) of every table that deduplication stores."""
    seen = []

    def noting(keep):
        def run(df, *name):
            out = keep(df, *name)
            seen.append((out.columns, out.count()))
            return out

        return run

    for name, keep in (("cut", session.cut), ("work_table", session.work_table)):
        monkeypatch.setattr(dedup, name, noting(keep), raising=False)
    return seen


def templated(rng, count=300):
    """Texts of one length that share a rare phrase and nothing else, two near copies among them."""
    letter = lambda: chr(0x4E00 + rng.randrange(20000))
    phrase = "".join(chr(0xAC00 + i) for i in range(6))
    texts = ["".join(letter() for _ in range(54)) + phrase for _ in range(count)]
    return [*texts, texts[3][:-8] + "zz" + phrase, texts[5][:-7] + "z" + phrase]


def test_dedup_stores_no_candidates_and_texts_once(spark, stored):
    texts = templated(random.Random(3))
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "pos bigint, q string")
    got = {r.pos: r.status for r in dedup.dedup_status(df, "pos", "q").collect()}
    assert {p: s for p, s in got.items() if s != "keep"} == {300: "near_dup", 301: "near_dup", 302: "exact_dup"}
    assert max(n for _, n in stored) <= len(texts)
    assert sum(bool({"text", "plain", "pieces"} & set(c)) for c, _ in stored) == 1


def test_similar_pairs_of_a_shared_phrase_stay_in_the_join(spark, stored):
    texts = templated(random.Random(4))
    got = {(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "pos bigint, q string"), "pos", "q").collect()}
    assert got == {(3, 300), (5, 301)}
    assert sum(n for c, n in stored if {"a", "b"} <= set(c)) <= 10


def test_pieces_of_odd_texts():
    texts = ["", "a", "ab", "aba", "ababab", "\U0001f600b\U0001f600b\U0001f600", None, "\uffff\uffff\uffff\uffff", "a\0\0"]
    own, g, n = dedup.pieces(pa.array(texts))
    assert list(n) == [len(grams(t)) for t in texts] and len(own) == len(g) == sum(n)
    name = {}
    for k, t in enumerate(texts):
        name.setdefault(frozenset(g[own == k].tolist()), set()).add(frozenset(grams(t)))
    assert all(len(v) == 1 for v in name.values()) and len(name) == len({frozenset(grams(t)) for t in texts})
    assert len(dedup.pieces(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_greedy_rule_of_many_pairs(spark, few):
    rng = random.Random(few)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    want = set()
    for b in range(60):
        if any(y == b and x not in want for x, y in pairs):
            want.add(b)
    got = [r.pos for r in dedup.greedy_removed(spark.createDataFrame(sorted(pairs), "a int, b int"), few).collect()]
    assert sorted(got) == sorted(want)


def test_greedy_rule_of_a_long_chain(spark):
    chain = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.pos for r in dedup.greedy_removed(chain).collect()) == list(range(1, 2001, 2))


@pytest.fixture(scope="module")
def outputs(spark):
    return spark.createDataFrame([(1, "p1", "a", "old"), (2, "p1", "a", "new"), (3, "p1", "b", "cand"), (4, "p2", "a", None), (5, "p2", "b", ""), (6, "p3", "a", "x"), (7, None, "a", "y"), (8, "p9", None, "z")], "row_id int, prompt_id string, model_version string, response string")


def test_alignment(spark, outputs):
    prompts = spark.createDataFrame([("p1", "text", None), ("p1", "text ", "c"), ("p4", "t", "c")], "prompt_id string, text string, category string")
    got = {r.prompt_id: tuple(r)[1:] for r in align.align_pair(outputs, prompts, "a", "b").collect()}
    assert got == {"p1": ("text ", "c", "new", "cand"), "p2": ("", "", "", "")}
    assert tuple(align.skipped_counts(outputs, "a", "b").first()) == (1, 0)
    assert {r.prompt_id for r in align.in_all_versions(outputs, ["a", "b"]).collect()} == {"p1", "p2"}
    cover = {r.model_version: r for r in align.coverage(outputs, prompts).collect()}
    assert (cover["a"].covered, cover["a"].missing, cover["a"].extra, cover["a"].rate, cover["a"].first_missing) == (1, 1, 2, "50.0%", "p4")
    assert align.coverage(outputs, prompts.limit(0)).where("model_version = 'a'").first().rate == "0.0%"
    assert {(r.prompt_id, r.side) for r in align.missing_ids(outputs, prompts).collect()} == {("p4", "missing"), ("p2", "extra"), ("p3", "extra"), ("p9", "extra")}


def test_k_way_and_order(spark):
    files = spark.createDataFrame([(0, 1, "1", "s", "i", "p0"), (0, 2, "1", "s", "i", "p1"), (1, 1, "1", "t", "j", "q"), (1, 2, "2", "t", "j", "r")], "file int, pos int, id string, subset string, instruction string, prediction string")
    r = align.k_way(files, 2).collect()
    assert len(r) == 1 and r[0].predictions == ["p1", "q"] and r[0].subset == "s" and r[0].mismatch
    ids = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "id string")
    assert [x.id for x in ids.orderBy(*align.numeric_first("id")).collect()] == ["9", "10", "a", "b"]


def test_votes(spark):
    rows = [("k1", 1, "A", "j1"), ("k1", 2, "B", "j2"), ("k1", 3, "A", "j3"), ("k2", 4, "B", "j1"), ("k2", 5, "A", "j2"), ("k3", 6, "A", "j1"), ("k3", 7, "B", "j2"), ("k3", 8, "tie", "j3"), ("k4", 9, "tie", "j1")]
    df = spark.createDataFrame(rows, "key string, row_id int, winner string, judge_id string")
    win = lambda x: {r.key: r.winner for r in x.collect()}
    assert win(votes.plurality(df, ["key"], "winner", "row_id")) == {"k1": "A", "k2": "tie", "k3": "tie", "k4": "tie"}
    assert win(votes.majority(df, ["key"])) == {"k1": "A", "k2": "tie", "k3": "tie", "k4": "tie"}
    assert win(votes.judge_majority(df, ["key"])) == {"k1": "A", "k2": "B", "k3": "tie", "k4": "tie"}
    assert win(votes.judge_weighted(df, ["key"], "j1")) == {"k1": "A", "k2": "B", "k3": "A", "k4": "tie"}
    assert win(votes.judge_conservative(df, ["key"])) == {"k1": "tie", "k2": "tie", "k3": "tie", "k4": "tie"}
    agree = {(r.judge_1, r.judge_2): r.agreement for r in votes.judge_agreement(df, ["key"]).collect()}
    assert agree == {("j1", "j2"): 0.0, ("j1", "j3"): 0.5, ("j2", "j3"): 0.0}
    best = {r.key: (r.best_answer, r.confidence, r.is_consistent) for r in votes.self_consistency(df, ["key"], "winner", "row_id").collect()}
    assert best["k1"] == ("A", 0.67, True) and best["k2"] == ("B", 0.5, False)
    assert votes.temperatures(5) == [0.58, 0.64, 0.7, 0.76, 0.82]


def test_statistics(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0), ("g", 3.0, 1.0), ("g", 10.0, 4.0), ("h", 5.0, 5.0), ("g", None, 1.0)], "k string, x double, y double")
    b = {r.k: r for r in stats.basic(df, ["k"], "x").collect()}
    assert (b["g"].n, b["g"].mean, b["g"].median, b["g"].p25) == (4, 4.0, 2.5, 1.75) and b["h"].std == 0
    w = {r.k: r for r in stats.wilcoxon(df.where("x is not null"), ["k"], "x", "y").collect()}
    assert (w["g"].n, w["g"].statistic) == (3, 1.0) and (w["h"].n, w["h"].p_value, w["h"].significant_005) == (0, 1.0, False)
    s = {r.k: r for r in stats.sign_test(df, ["k"], "x", "y").collect()}
    assert (s["g"].plus, s["g"].minus, s["g"].p_value) == (2, 1, 1.0) and s["h"].p_value == 1.0
    assert {r.k: r.cohens_d for r in stats.cohens_d(df, ["k"], "x", "y").collect()}["h"] == 0
    lo = stats.nearest_rank_bounds(spark.range(100).withColumn("k", F.lit(1)), ["k"], "id").first()
    assert (lo.low_value, lo.high_value) == (5, 95)
    z = stats.z_outliers(spark.createDataFrame([("a", 1.0)] * 9 + [("a", 50.0)], "k string, x double"), ["k"], "x").where("extreme").collect()
    assert len(z) == 1 and z[0].x == 50.0
    ci = stats.bootstrap_ci(spark.range(200).withColumn("k", F.lit(1)).withColumn("x", F.col("id") % 10), ["k"], "x").first()
    low, high = stats.bootstrap_reference([float(i % 10) for i in range(200)])
    assert abs(ci.lower - low) < 0.2 and abs(ci.upper - high) < 0.2 and ci.lower < ci.mean < ci.upper


def test_parsing(spark):
    df = spark.createDataFrame([(1, "问题：一加一？\n答案：二\n\nQ: two\nA: 2"), (2, "1. 甲\n答：乙\n2. 丙\n答：丁"), (3, None), (4, "")], "i int, s string")
    got = [(r.i, r.id, r.question, r.answer) for r in parse.regex_pairs(df, "i", "s").orderBy("i", "id").collect()]
    assert got == [(1, "1", "一加一？", "二"), (1, "2", "two", "2"), (2, "1", "甲", "乙"), (2, "2", "丙", "丁")]
    js = spark.createDataFrame([("x {\"scores\": {\"format\": \"4.5\", \"structure\": \"bad\"}} y",), ("nothing",), (None,)], "reply string")
    r = js.select(parse.lenient_json("reply").alias("j")).select(parse.score_of("j", "format", "scores").alias("f"), parse.score_of("j", "structure", "scores").alias("s")).collect()
    assert [tuple(x) for x in r] == [(4.5, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_anomalies_and_report(spark):
    df = spark.createDataFrame([(i, "一段普通的回答文字" + str(i) * 3) for i in range(40)] + [(98, ""), (99, "重复" * 300)], "row_id int, response string")
    got = {r.row_id: r.anomaly_types for r in anomaly.output_anomalies(df, [], "response").collect()}
    assert got[98] == ["empty_response", "length_outlier"] and got[99] == ["length_outlier", "high_repetition"]
    empty = spark.createDataFrame([], "question string, answer string, rework_count int, evaluation struct<total_score:double,passed:boolean>")
    r = summary.run_report(empty).first()
    assert r.total_items == 0 and r.pass_rate is None


def test_sign_test_is_exact_at_every_size(spark):
    rows = [(g, float(i < plus), float(i >= plus)) for g, plus, n in (("small", 6, 20), ("large", 980, 2001), ("one sign", 1200, 1200)) for i in range(n)]
    got = {r.k: r.p_value for r in stats.sign_test(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    exact = lambda n, low: min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(low + 1)), 2**n)))
    assert got == {"small": round(exact(20, 6), 6), "large": round(exact(2001, 980), 6), "one sign": 0.0}
    assert all(abs(2 * stats.binomial_tail(n, low) / exact(n, low) - 1) < 1e-9 for n, low in ((1001, 0), (1001, 450), (3126, 1500), (9001, 4400)))


def test_self_consistency_votes_on_whole_answers(spark, tmp_path):
    rows = [(1, "p", "答案是甲乙。"), (2, "p", "答案是甲丙。"), (3, "p", "So we count.\nFinal answer: 42"), (4, "p", "Some steps.\nfinal answer: 42"), (5, "p", None)]
    spark.createDataFrame(rows, "row_id bigint, prompt_id string, response string").write.parquet(str(tmp_path / "model_outputs.parquet"))
    r = eval_queries.self_consistency_vote(spark, str(tmp_path)).first()
    assert (r.best_answer, r.confidence, r.is_consistent, r.paths) == ("42", 0.4, False, 5)


def test_numeric_first_sort_keeps_every_id(spark, tmp_path):
    rows = [(i, f"t{i:03}") for i in range(300)] + [(301, None), (302, "t001")]
    spark.createDataFrame(rows, "row_id bigint, id string").repartition(4).write.parquet(str(tmp_path / "corpus.parquet"))
    got = [r.id for r in eval_queries.numeric_first_sort(spark, str(tmp_path)).collect()]
    assert got == [str(i) for i in range(0, 300, 3)] + [f"t{i:03}" for i in range(300) if i % 3]


def test_rendered_steps_feedback_and_message(spark):
    from siftloom.operators import parse

    df = spark.sql("select array(named_struct('step_number', 1, 'step_type', '计算', 'content', 'c1', 'formula', 'x=1'), named_struct('step_number', 2, 'step_type', cast(null as string), 'content', 'c2', 'formula', '')) as s, named_struct('final_answer_correct', false, 'chain_coherence', 7.5D, 'suggestion', '再查') as e, array(named_struct('step_number', 2, 'is_correct', false, 'error_type', '算术', 'explanation', '错了', 'suggested_fix', '改成 3'), named_struct('step_number', 3, 'is_correct', true, 'error_type', '', 'explanation', '', 'suggested_fix', '')) as v")
    r = df.select(parse.render_steps(F.lit("想"), F.col("s"), F.lit("1")).alias("a"), parse.render_feedback("e", "v").alias("f"), parse.user_message(F.lit("题"), F.array(F.lit("答"), F.lit(None).cast("string"))).alias("m")).first()
    assert r.a == "<think>\n想\n</think>\n\n**Step 1 [计算]**\nc1\n$$\nx=1\n$$\n\n**Step 2**\nc2\n\n**最终答案：** 1"
    assert r.f == "Step 2 错误 [算术]: 错了\n  建议修正: 改成 3\n最终答案不正确，需要修正。\n推理链连贯性评分: 7.5/10\n总体建议: 再查"
    assert r.m == "## 题目（Instruction）\n题\n\n## 候选回答\n### C1\n答\n\n### C2\n（空回答）\n"


def test_blind_results_swap_back(spark):
    from siftloom.functions import constants as k
    from siftloom.plans import judging

    score = lambda x: "named_struct(" + ", ".join(f"'{d}', {x}D" for d in k.DIMENSIONS) + ")"
    rows = " union all ".join(f"select {i} as i, '{w}' as winner, {score(4.0)} as scores_a, {score(2.0)} as scores_b, {s} as swapped, '{w2}' as winner_2, {score(3.0)} as scores_a_2, {score(1.0)} as scores_b_2" for i, w, s, w2 in ((1, "A", "true", "B"), (2, "A", "true", "A"), (3, "B", "false", "B"), (4, "tie", "true", "odd")))
    got = {r.i: (r.winner, r.consistency, r.scores_a.format, r.scores_b.format, r.position_swapped) for r in judging.blind_results(spark.sql(rows)).collect()}
    assert got == {1: ("A", "consistent", 4.0, 2.0, False), 2: ("tie", "position_bias_detected", 2.5, 2.5, True), 3: ("B", None, 4.0, 2.0, False), 4: ("tie", "consistent", 4.0, 2.0, False)}


def test_line_numbers_over_several_files(spark, tmp_path):
    from siftloom.sources import readers

    for name, n in (("b", 3), ("a", 5000), ("c", 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"question": "{name}{i}"}}' if i != 1 else " " for i in range(n)) + "\n", encoding="utf-8")
    got = {r.question: r.pos for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert got["a0"] == 0 and got["a4999"] == 4999 and got["b0"] == 5000 and got["b2"] == 5002 and got["c0"] == 5003 and len(got) == 5002
    mapped = tmp_path / "m"
    mapped.mkdir()
    (mapped / "x.jsonl").write_text('{"q": "ask", "a": "say", "key": 7}\nbroken\n', encoding="utf-8")
    fields = {"id": "key", "question": "q", "answer": "a"}
    assert [(r.id, r.question, r.answer) for r in readers.read_corpus(spark, str(mapped), strict=False, fields=fields).collect()] == [("7", "ask", "say")]
