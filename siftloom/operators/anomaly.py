"""Anomaly flags from answers and from evaluation results, and summaries of long answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as t
from siftloom.operators import stats


def output_anomalies(df: DataFrame, keys: list[str], column: str, threshold: float = 0.3, low: float = 5, high: float = 95) -> DataFrame:
    """Rows with anomaly_types empty_response, length_outlier, high_repetition (I24); bounds by group of keys, where a null key is a group, too."""
    sized = df.withColumn("length", t.count_chars(column)).withColumn("_rate", t.char_repetition(column, 4))
    bounds = stats.nearest_rank_bounds(sized, keys, "length", low, high)
    # one row for each group of keys, a single one without keys
    if keys:
        theirs = bounds.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "low_value", "high_value")
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
        joined = sized.join(theirs, reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        joined = sized.join(F.broadcast(bounds))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("length") == 0, "empty_response"),
            F.when((F.col("length") < F.col("low_value")) | (F.col("length") > F.col("high_value")), "length_outlier"),
            F.when(F.col("_rate") > threshold, "high_repetition"),
        )
    )
    return joined.withColumn("anomaly_types", kinds).withColumn("repeat_rate", F.round("_rate", 4)).drop("_rate").where(F.size("anomaly_types") > 0)


def result_anomalies(df: DataFrame, keys: list[str], score: str, worst: str, phrases: str, uncertain: str, threshold: float = 0.3, times: float = 2.0) -> DataFrame:
    """Rows with anomaly_types extreme_score, high_repetition, over_assistant_style, judge_disagreement."""
    z = stats.z_outliers(df, keys, score, times)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("extreme"), "extreme_score"),
            F.when(F.col(worst) > threshold, "high_repetition"),
            F.when(F.col(phrases) > 3, "over_assistant_style"),
            F.when(F.col(uncertain), "judge_disagreement"),
        )
    )
    return z.withColumn("anomaly_types", kinds).where(F.size("anomaly_types") > 0)


def type_distribution(df: DataFrame, column: str = "anomaly_types") -> DataFrame:
    """(type, n) over all flags."""
    return df.select(F.explode(column).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
