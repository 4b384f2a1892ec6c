"""Problems 1, 3 and 4 against brute force and hand-made cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftloom.functions.textbatch import TextBatch
from siftloom.llm import format_copies, ranking, repetition


def brute_share(text: str | None) -> float:
    s = "".join(c for c in (text or "").lower() if c.isalnum())
    cjk = sum("㐀" <= c <= "鿿" for c in s)
    size = 12 if cjk >= 0.3 * max(len(s), 1) else 30
    hit = [False] * len(s)
    seen = set()
    for i in range(len(s) - size + 1):
        w = s[i : i + size]
        if w in seen:
            hit[i : i + size] = [True] * size
        seen.add(w)
    return sum(hit) / max(len(s), 1)


def test_share_equals_brute_force():
    rng = random.Random(1)
    texts = [None, "", "…", "短", "这是一个足够长的句子用来测试。" * 3, "The same clause stands here again and again. " * 4, "ab " * 40]
    for _ in range(60):
        parts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randrange(5, 20))) for _ in range(6)]
        texts.append("，".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))))
    got = repetition.stats_of(pa.array(texts, pa.large_string()))[:, 0]
    assert np.allclose(got, [brute_share(t) for t in texts])


def test_forest_keeps_all_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(300)] + [(1000 + i, " ".join([word() for _ in range(12)] * 3)) for i in range(12)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "row_id int, response string").withColumn("score", F.lit(0))
    got = repetition.repetition(df, "row_id", "response").where("is_case").collect()
    assert {r.row_id for r in got} == set(range(1000, 1012))
    assert repetition.repetition(df.limit(0), "row_id", "response").count() == 0


SAME = [
    ["What is 3.5 + x?", "what  is\t3.5 + X", "**What is 3.5 + x？**", "What is 3.5 +​ x!"],
    ["主题：甲\n难度：中等3\n要求：乙", "难度：中等3；要求：乙；主题：甲", '{"要求": "乙", "主题": "甲", "难度": "中等3"}', "{'主题' :  '甲', '难度': '中等3', '要求': '乙'}", " {“主题“: “甲“, “难度“: “中等3“, “要求“: “乙“}**"],
    ["判断对错：甲，只取决于乙。", "判断对错:甲、只取决于乙"],
    ["$\\frac{1}{2x} = 3$ 的值", "$\\Frac{1}{2X}  = 3$ 的值。"],
    ["", "  ", "？！"],
]
DIFFERENT = ["(8.4z * 4 = 0)", "(8.4z - 4 = 0)", "(84z - 4 = 0)", "(8.4z + 4 = 0)", "$\\frac{12}{x}$", "$\\frac{1}{2x}$", "甲：1\n乙：2", "甲：2\n乙：1"]


def test_copies_by_hash_and_by_comparison(spark):
    groups = [*SAME, *[[x] for x in DIFFERENT]]
    rows = [(10 * g + i, t) for g, ts in enumerate(groups) for i, t in enumerate(ts)] + [(9999, None), (10000, None)]
    df = spark.createDataFrame(rows, "row_id int, question string").withColumn("text", F.lit("x"))
    got = {(r.first_key, r.row_id) for r in format_copies.format_copies(df, "row_id", "question").collect()}
    assert got == {(10 * g, 10 * g + i) for g, ts in enumerate(groups) for i in range(1, len(ts))}
    copies = {r.first_key: r.copies for r in format_copies.format_groups(df, "row_id", "question").collect()}
    assert copies == {10 * g: len(ts) for g, ts in enumerate(groups)}
    flat = [t for ts in groups for t in ts]
    home = [g for g, ts in enumerate(groups) for _ in ts]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert format_copies.same_text(a, b) == (home[i] == home[j]), (a, b)


def test_hash_collisions_lose_nothing(spark):
    texts = ["Alpha one", "alpha  ONE!", "Beta two", "beta two.", "gamma", "BETA, two", "delta: 1\nepsilon: 2", "Epsilon：2；Delta：1", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, question string")
    got = {(r.first, r.id) for r in format_copies.verified_copies(df, "row_id", "question", bits=1).collect()}
    assert got == {(0, 1), (2, 3), (2, 5), (6, 7)}


def test_hashes_skip_without_a_canonical_array():
    cps, keep = format_copies.kept_symbols(TextBatch.of(["a ; b", "A,b", "ab"]))
    (one, _), down, run = format_copies.skipping_hashes(cps, keep)
    assert len(one) == len(cps) + 1 and run[-1] == 6
    h1, h2 = format_copies.canonical_hash(pa.array(["a . b", "A,b", "ab", "ba"], pa.large_string()))
    assert h1[0] == h1[1] == h1[2] != h1[3] and h2[0] == h2[2] != h2[3]


def test_ranking_solves_the_system(spark):
    rng = random.Random(8)
    names = [f"m{i}" for i in range(7)]
    games = []
    for _ in range(400):
        i, j = rng.sample(range(7), 2)
        games.append((names[i], names[j], 1 if rng.random() < 1 / (1 + np.exp(i - j)) else -1 if rng.random() < 0.8 else 0))
    got = {r.item: r for r in ranking.ranking(spark.createDataFrame(games, "a string, b string, y int"), spark.createDataFrame([(n,) for n in [*names, "idle", None]], "item string")).collect()}
    lap, rhs = np.eye(7) * 1e-6, np.zeros(7)
    for a, b, y in games:
        i, j = names.index(a), names.index(b)
        lap[i, i] += 1
        lap[j, j] += 1
        lap[i, j] -= 1
        lap[j, i] -= 1
        rhs[i] += y
        rhs[j] -= y
    want = np.linalg.solve(lap, rhs)
    assert np.allclose([got[n].strength for n in names], want - want.mean(), atol=1e-6)
    assert got["idle"].strength == 0 and got["idle"].games == 0 and len(got) == 8
    assert [got[n].rank_no for n in names] == sorted(got[n].rank_no for n in names)


def test_comparisons_are_cleaned(spark):
    rows = [("p", "x", "y", "j", 1, " A.", False), ("p", "x", "y", "j", 1, "A", False), ("p", "x", "y", "j", 2, "model_b", True), ("p", "x", "x", "j", 3, "A", False), ("p", "x", "y", "j", 4, "error", False), ("p", "x", "y", "j", 5, None, None), ("p", "x", "y", "j", 6, "平局", None), ("p", None, "y", "j", 7, "A", False)]
    df = spark.createDataFrame(rows, "prompt_id string, model_a string, model_b string, judge_id string, judged_at int, winner string, position_swapped boolean")
    assert sorted(r.y for r in ranking.comparisons(df).collect()) == [0, 1, 1]
    assert ranking.ranking(ranking.comparisons(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["a: b\n" * 3000, "字" * 200_000])
def test_long_texts(text):
    a = pa.array([text, text + "！"], pa.large_string())
    h1, h2 = format_copies.canonical_hash(a)
    assert h1[0] == h1[1] and h2[0] == h2[1] and format_copies.same_texts(a, a).all()
