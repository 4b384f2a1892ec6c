"""The model boundary: generators and judges behind one small interface, with offline ones included.

A generator or judge is any picklable object with ask(messages, temperature) -> str. Calls run inside
mapInPandas, a bounded pool in each task, with retries; a failed call becomes an error column, never a
failed job. Replies are written to a table at once, since a call must never be repeated by a retried task
of a later stage.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.functions import constants as k
from siftloom.operators import parse, profile, votes
from siftloom.session import work_table


#: Columns that a call adds.
ADDED = ("reply", "error", "prompt_chars", "completion_chars", "seconds")


class Model(Protocol):
    def ask(self, message: str, temperature: float) -> str: ...


class EchoGenerator:
    """Offline generator: a deterministic answer that names its question (no model is called)."""

    def ask(self, message: str, temperature: float) -> str:
        return f"解答：{message.strip()[:200]}\n{k.FINAL_ANSWER_MARK} {len(message)}"


class LengthJudge:
    """Offline judge of pairs and of single items: longer answers win, scores follow lengths (no model is called)."""

    def ask(self, message: str, temperature: float) -> str:
        if "## 评审 A 评分" in message:
            return json.dumps({"total_score": 5.0, "suggestion": "仲裁"}, ensure_ascii=False)
        if "\n\n## 回答 B\n" in message:
            a, b = (len(x) for x in message.split("\n\n## 回答 A\n", 1)[1].split("\n\n## 回答 B\n", 1))
            return "结论：" + json.dumps({"winner": "A" if a > b else "B" if b > a else "tie", "scores_a": dict.fromkeys(k.DIMENSIONS, float(1 + a % 5)), "scores_b": dict.fromkeys(k.DIMENSIONS, float(1 + b % 5))})
        question, answer = (len(x) for x in message.split("## 问题\n", 1)[1].split("\n\n## 回答\n", 1))
        extra = question % 4 if temperature > 0.3 else 0
        return json.dumps({"total_score": float(answer % 10 + extra), "suggestion": "无" if temperature > 0.3 else "", "scores": dict.fromkeys(k.DIMENSIONS, float(1 + answer % 5))}, ensure_ascii=False)


class TableModel:
    """Replies looked up by message, for recorded runs and tests."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def ask(self, message: str, temperature: float) -> str:
        return self.replies[message]


def _ask(model: Model, message: str, temperature: float, attempts: int, pause: float) -> tuple[str | None, str | None, float]:
    start = time.monotonic()
    for attempt in range(attempts):
        try:
            return model.ask(message, temperature), None, time.monotonic() - start
        except Exception as e:  # noqa: BLE001  the error becomes a column
            if attempt == attempts - 1:
                return None, f"{type(e).__name__}: {e}"[:300], time.monotonic() - start
            time.sleep(pause * 2**attempt)
    return None, "no attempt", 0.0


def answered(df: DataFrame, model: Model, message: str = "message", temperature: str = "temperature", pool: int = 4, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """Adds reply, error, prompt_chars, completion_chars and seconds (L1, L11, L12, F20); to be stored before anything else; pool: calls at once in each task."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("prompt_chars", T.LongType()), T.StructField("completion_chars", T.LongType()), T.StructField("seconds", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(pool) as workers:
            for f in frames:
                got = list(workers.map(lambda x: _ask(model, x[0], x[1], attempts, pause), zip(f[message], f[temperature], strict=True)))
                yield f.assign(reply=[g[0] for g in got], error=[g[1] for g in got], prompt_chars=[len(m or "") for m in f[message]], completion_chars=[len(g[0] or "") for g in got], seconds=[g[2] for g in got])

    return df.mapInPandas(run, schema)


def call(df: DataFrame, model: Model, message: str = "message", temperature: str = "temperature", pool: int = 4, attempts: int = 3, pause: float = 2.0, table: str = "replies") -> DataFrame:
    """The same, stored with all columns."""
    return work_table(answered(df, model, message, temperature, pool, attempts, pause), table)


def rounds(df: DataFrame, count: int, base: float = 0.3, step: float = 0.05) -> DataFrame:
    """Each row once for each round, with the round's temperature."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("temperature", F.round(F.lit(base) + F.col("round") * step, 4))


def pairwise_messages(pairs: DataFrame, count: int) -> DataFrame:
    """Messages of each round of a comparison; odd rounds show the candidate first."""
    r = rounds(pairs, count).withColumn("position_swapped", F.col("round") % 2 == 1)
    first = F.when(F.col("position_swapped"), F.col("candidate_response")).otherwise(F.col("baseline_response"))
    second = F.when(F.col("position_swapped"), F.col("baseline_response")).otherwise(F.col("candidate_response"))
    return r.withColumn("message", F.concat(F.lit("## 问题\n"), "prompt_text", F.lit("\n\n## 回答 A\n"), first, F.lit("\n\n## 回答 B\n"), second))


def rule_judgements(df: DataFrame, column: str) -> DataFrame:
    """The offline judge: the rule score stands for every dimension; no model is called."""
    scored = profile.rule_score(df, column)
    return scored.withColumn("scores", F.struct(*[F.col("rule_score").alias(d) for d in k.DIMENSIONS]))


def parsed_scores(df: DataFrame, reply: str = "reply", *sections: str) -> DataFrame:
    """Adds scores, a struct of the six dimensions read from the reply, 0 where one is missing."""
    text = df.withColumn("_json", parse.lenient_json(reply))
    return text.withColumn("scores", F.struct(*[parse.score_of("_json", d, *(sections or ("scores",))).alias(d) for d in k.DIMENSIONS])).drop("_json")


def blind_pairs(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds swapped: half of the second calls show the answers exchanged, chosen by a hash of the key."""
    return df.withColumn("swapped", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(2)) == 1)


def swapped_back(winner: str) -> Column:
    """The real winner of a call that saw the answers exchanged: anything but A or B is a tie."""
    return F.when(F.col(winner) == "A", "B").when(F.col(winner) == "B", "A").otherwise("tie")


def blind_results(df: DataFrame) -> DataFrame:
    """Settles two calls on one pair (L10): winner, scores_a, scores_b of the first, winner_2, scores_a_2, scores_b_2 of the second.

    swapped rows had a second call that saw the answers exchanged. If both name the same winner after swapping back, the
    first result stays (consistency consistent); else it is a tie with the mean scores of both calls, rounded to one
    decimal (position_bias_detected). Rows without a second call pass through; their consistency is null.
    """
    real = swapped_back("winner_2")
    asked = F.coalesce("swapped", F.lit(False))
    same = F.coalesce("winner", F.lit("tie")) == real
    bias = asked & ~same
    score = lambda s, d: F.coalesce(F.col(f"{s}.{d}"), F.lit(0.0))
    mean = lambda own, other: F.struct(*[F.round((score(own, d) + score(other, d)) / 2 + votes.NUDGE, 1).alias(d) for d in k.DIMENSIONS])
    return df.withColumns(
        {
            "consistency": F.when(asked & same, "consistent").when(bias, "position_bias_detected"),
            "winner": F.when(bias, "tie").otherwise(F.col("winner")),
            "scores_a": F.when(bias, mean("scores_a", "scores_b_2")).otherwise(F.col("scores_a")),
            "scores_b": F.when(bias, mean("scores_b", "scores_a_2")).otherwise(F.col("scores_b")),
            "position_swapped": bias,
        }
    ).drop("winner_2", "scores_a_2", "scores_b_2")


def augmented(items: DataFrame, variants: DataFrame) -> DataFrame:
    """Items and their variants (id, position, question, strategy), ids {id}_aug_{k} from 1."""
    more = variants.select(F.concat("id", F.lit("_aug_"), F.col("position").cast("string")).alias("id"), "question", F.lit("").alias("answer"), F.col("id").alias("source_id"), "strategy")
    return items.select("id", "question", "answer", F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("strategy")).unionByName(more)
