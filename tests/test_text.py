"""Text measures against plain Python definitions, on random and hand-made texts."""

import random
import re

from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import ngrams
from siftloom.functions import text as t
from siftloom.operators import profile

TEXTS = [None, "", " ", "　\n", "你好。", "a", "ab", "总之，这是结论。", "x" * 120, "第一段。第二句！\n\n# 标题\n- 项\n1. 一\n", "no mark at end", "……", "a;b;c", "\x1c\x85 x", "您好，请注意：值得一提的是", "问：什么是NP？\n答：$x$"]


def some_texts() -> list:
    rng = random.Random(4)
    letters = "ab 。！？\n\t;…x#-1.、　你好\x85"
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(150)]


def ws(s: str) -> str:
    return re.sub(r"\s+", "", s)


def sentences(s: str) -> list:
    out, now = [], ""
    for c in s:
        now += c
        if c in k.SENTENCE_MARKS:
            out.append(now)
            now = ""
    return [x.strip() for x in [*out, now] if x.strip()]


def rate(s: str, n: int) -> float:
    s = ws(s)
    g = [s[i : i + n] for i in range(len(s) - n + 1)]
    return 1 - len(set(g)) / len(g) if g else 0.0


def test_measures_match_python(spark):
    rows = list(enumerate(some_texts()))
    df = spark.createDataFrame(rows, "i int, s string")
    got = df.select("i", t.count_chars("s").alias("n"), t.sentences("s").alias("sent"), t.sentence_count("s").alias("sc"), t.paragraphs("s").alias("par"), t.headings("s").alias("h"), t.list_items("s").alias("li"), *[t.char_repetition("s", n).alias(f"r{n}") for n in (2, 3, 4, 5)]).collect()
    assert len(got) == len(rows)
    for r in got:
        s = rows[r.i][1] or ""
        assert r.n == len(ws(s))
        assert r.sent == sentences(s), repr(s)
        assert r.sc == len(sentences(s)), repr(s)
        assert r.par == [p.strip() for p in re.split(r"\n+", s) if p.strip()], repr(s)
        assert r.h == len(re.findall(r"^#{1,6}\s", s, re.M))
        assert r.li == len(re.findall(r"^\s*[-*]\s", s, re.M)) + len(re.findall(r"^\s*\d+[.、]\s", s, re.M)), repr(s)
        for n in (2, 3, 4, 5):
            assert abs(r[f"r{n}"] - rate(s, n)) < 1e-9, (n, s)


def test_rates_of_long_and_no_texts():
    import pyarrow as pa

    assert ngrams.rates(pa.array([], pa.large_string())).shape == (0, 3)
    long = "abc" * 400_000
    assert abs(ngrams.rates(pa.array([long, None], pa.large_string()))[0, 0] - (1 - 3 / (len(long) - 2))) < 1e-9


def test_phrases_and_truncation(spark):
    df = spark.createDataFrame([("总之，您好。" + "x" * 300,), ("x" * 300 + "总之",), (None,)], "s string")
    r = df.select(t.template_endings("s").alias("e"), t.assistant_phrases("s").alias("a"), F.length(t.smart_truncate("s", 100)).alias("n"), F.length(t.hard_truncate("s", 100)).alias("m")).collect()
    assert r[0].e == [] and r[1].e == ["总之"] and r[2].e == []
    assert r[0].a == ["您好"] and r[0].n == 60 + len("\n\n[...此处省略约 216 字，预分析报告包含全文统计数据...]\n\n") + 30 and r[0].m == 100 and r[2].n == 0


def test_answers(spark):
    df = spark.createDataFrame([("思考\n因此，x=3\n完",), ("最终答案：42\n",), ("只有一行",), ("",), (None,), ("步骤\n**最终答案：** 7",)], "s string")
    r = df.select(t.extract_answer("s").alias("x"), t.final_answer("s").alias("f")).collect()
    assert [x.x for x in r[:5]] == ["x=3", "42", "只有一行", "", ""]
    assert r[5].f == "7" and r[0].f == ""


def test_difficulty(spark):
    df = spark.createDataFrame([("证明并推导：$a$ $b$ $c$",), ("什么是力",), ("计算",), (None,)], "q string")
    r = profile.difficulty(df, "q").collect()
    assert [(x.difficulty_score, x.difficulty_level) for x in r] == [(8, "hard"), (-1, "easy"), (1, "easy"), (0, "easy")]
    assert r[0].signals == ["证明", "推导", "formulas"]


def test_rule_judge_floor_and_empty_table(spark):
    df = spark.createDataFrame([("重复" * 400,), ("",)], "s string")
    r = profile.rule_score(df, "s").collect()
    assert r[0].rule_score == 2.5 and r[1].rule_score == 3.5
    assert profile.long_answer_classes(profile.full_profile(df.limit(0), "s")).count() == 0


def test_cuts_say_what_they_leave_out(spark):
    df = spark.createDataFrame([("a" * 100 + "b" * 100,), ("short",), (None,)], "s string").withColumn("w", F.concat("s", "s"))
    r = df.select(t.smart_truncate("s", 100).alias("x"), t.hard_truncate("s", 240 - 60).alias("y"), t.hard_truncate("w", 240).alias("v"), t.hard_truncate("s", 60).alias("z")).collect()
    assert r[0].x == "a" * 60 + "\n\n[...此处省略约 110 字，预分析报告包含全文统计数据...]\n\n" + "b" * 30
    assert r[0].y == "a" * 100 + "b" * 80  # no room for a tail
    assert r[0].v == "a" * 100 + "b" * 56 + "\n\n[…中间省略…]\n\n" + "b" * 4
    assert r[0].z == "a" * 60 and r[1].x == r[1].y == "short" and r[2].x == r[2].y == ""


def test_one_decimal_prints_the_binary_value(spark):
    values = [8.25, 8.35, 8.75, 0.05, 0.15, 2.675, 9.95, 10.0, 0.0, 7.449999, 99.949999999, -1.25, 8.45]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert [r.s for r in df.select(t.one_decimal(F.col("x")).alias("s")).collect()] == [f"{v:.1f}" for v in values] + ["0.0"]
