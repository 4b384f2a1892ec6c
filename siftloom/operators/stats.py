"""Statistics over scores and lengths, by group: percentiles, rank tests, effect sizes, outliers.

Everything is an aggregation or a window over the group's keys; the only exact order statistics that
need a whole group are percentiles, which Spark computes from (value, count) pairs.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basic(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population std, min, max, median, percentiles by linear interpolation, to 4 places (G1); nulls do not count."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), p.alias("_p"))
    return g.select(*keys, "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", *[F.round(F.col("_p")[i], 4).alias(x) for i, x in enumerate(("p5", "p25", "median", "p75", "p95"))])


def trimmed_mean(df: DataFrame, keys: list[str], value: str, ratio: float = 0.1) -> DataFrame:
    """Mean without int(n * ratio) values at each end, at least one kept."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    placed = counts.withColumn("_to", upto).withColumn("_n", F.sum("c").over(Window.partitionBy(*keys)))
    cut = F.greatest(F.lit(0), F.least(F.floor(F.col("_n") * ratio), F.floor(F.col("_n") / 2) - 1))
    kept = F.greatest(F.lit(0), F.least(F.col("_to"), F.col("_n") - cut) - F.greatest(F.col("_to") - F.col("c"), cut))
    g = placed.withColumn("_k", kept).groupBy(*keys).agg(F.sum(F.col("v") * F.col("_k")).alias("_s"), F.sum("_k").alias("_k"))
    return g.select(*keys, F.round(F.col("_s") / F.col("_k"), 4).alias("trimmed_mean"))


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, draws: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, mean, lower, upper): percentile interval of the mean over resamples.

    A resample of n values is drawn as counts of each distinct value, from a generator seeded by seed, so a group is one
    short table of (value, count) however many rows it has.
    """
    table = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("v")
        n, p = int(group["c"].sum()), (group["c"] / group["c"].sum()).to_numpy()
        rng = np.random.default_rng(seed)
        means = np.sort([float((rng.multinomial(n, p) * group["v"]).sum()) / n for _ in range(draws)])
        alpha = (1 - confidence) / 2
        row = {c: group[c].iloc[0] for c in keys} | {"mean": float((group["c"] * group["v"]).sum() / n), "lower": float(means[int(draws * alpha)]), "upper": float(means[min(int(draws * (1 - alpha)), draws - 1)])}
        return pd.DataFrame([row])

    return table.groupBy(*keys).applyInPandas(run, f"{kinds}, mean double, lower double, upper double")


def bootstrap_reference(values: list[float], draws: int = 1000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """The same interval by drawing rows one by one with the standard generator; for small lists and tests."""
    rng = random.Random(seed)
    n = len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
    alpha = (1 - confidence) / 2
    return means[int(draws * alpha)], means[min(int(draws * (1 - alpha)), draws - 1)]


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the Abramowitz-Stegun polynomial, 0 and 1 beyond 8."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(0.5 * (1 + F.when(z < 0, -erf).otherwise(erf)))


def wilcoxon(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, statistic, z, p_value, significant_005): signed-rank test by normal approximation.

    Zero differences do not count, ties share their mean rank; groups without any difference have statistic 0 and p 1.
    """
    d = df.withColumn("_d", F.round(F.col(x) - F.col(y), 9))
    some = d.where("_d != 0").withColumn("_abs", F.abs("_d"))
    # rows of equal size share their rank, so ranks are running sums over the distinct sizes
    sizes = some.groupBy(*keys, "_abs").agg(F.count_if(F.col("_d") > 0).alias("_u"), F.count_if(F.col("_d") < 0).alias("_v"))
    both = F.col("_u") + F.col("_v")
    ranked = sizes.withColumn("_rank", F.sum(both).over(Window.partitionBy(*keys).orderBy("_abs")) - (both - 1) / 2)
    w = ranked.groupBy(*keys).agg(F.sum(both).alias("n"), F.sum(F.col("_rank") * F.col("_u")).alias("_up"), F.sum(F.col("_rank") * F.col("_v")).alias("_down"))
    everyone = d.select(*keys).distinct()
    n = F.coalesce("n", F.lit(0))
    stat = F.coalesce(F.least("_up", "_down"), F.lit(0.0))
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = F.when(n == 0, 0.0).otherwise((stat - n * (n + 1) / 4.0) / F.nullif(sigma, F.lit(0.0)))
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(z))))
    out = everyone.join(w, keys, "left").select(*keys, n.alias("n"), stat.alias("statistic"), z.alias("z"), p.alias("p"))
    return out.select(*keys, "n", "statistic", F.round(F.col("z") + 1e-9, 4).alias("z"), F.round("p", 6).alias("p_value"), (F.col("p") < 0.05).alias("significant_005"))


def binomial_tail(n: int, low: int, block: int = 1 << 16) -> float:
    """Share of the outcomes of n fair throws with at most low heads, low <= n / 2, to double precision."""
    if n == 0:
        return 1.0
    largest = math.exp(math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2))
    total, term = largest, largest
    for top in range(low, 0, -block):
        i = np.arange(top, max(0, top - block), -1, dtype=np.float64)
        terms = term * np.cumprod(i / (n - i + 1))  # from one outcome to the next smaller one
        total, term = total + float(terms.sum()), float(terms[-1])
        if term == 0:
            break
    return total


def sign_test(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, plus, minus, p_value): exact two-sided binomial test of the signs (G5), at every number of differences."""
    d = F.round(F.col(x) - F.col(y), 9)
    g = df.groupBy(*keys).agg(F.count_if(d > 0).alias("plus"), F.count_if(d < 0).alias("minus"))

    @F.pandas_udf("double")
    def p_value(plus: pd.Series, minus: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * binomial_tail(int(a + b), int(min(a, b)))) for a, b in zip(plus, minus, strict=True)], dtype="float64")

    return g.select(*keys, "plus", "minus", F.round(p_value("plus", "minus"), 6).alias("p_value"))


def cohens_d(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, mean_x, mean_y, diff, cohens_d): pooled by the mean of both sample variances, 0 without any spread."""
    g = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("vx"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("vy"))
    pooled = F.sqrt((F.col("vx") + F.col("vy")) / 2)
    return g.select(*keys, F.round(F.col("mx") + 1e-9, 4).alias("mean_x"), F.round(F.col("my") + 1e-9, 4).alias("mean_y"), F.round(F.col("mx") - F.col("my") + 1e-9, 4).alias("diff"), F.round(F.when(pooled < 1e-12, 0.0).otherwise((F.col("mx") - F.col("my")) / F.nullif(pooled, F.lit(0.0))) + 1e-9, 4).alias("cohens_d"))


def nearest_rank_bounds(df: DataFrame, keys: list[str], value: str, low: float = 5, high: float = 95) -> DataFrame:
    """(keys, low_value, high_value): values at the 0-based ranks int(n low / 100) and int(min(n high / 100, n - 1)).

    Values are counted first; ranks are running sums over the distinct values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    n = F.sum("c").over(Window.partitionBy(*keys))
    r = counts.withColumn("_to", upto).withColumn("_n", n)
    lo, hi = F.floor(F.col("_n") * low / 100), F.floor(F.least(F.col("_n") * high / 100, F.col("_n") - 1))
    return r.groupBy(*keys).agg(F.min(F.when(F.col("_to") > lo, F.col("v"))).alias("low_value"), F.min(F.when(F.col("_to") > hi, F.col("v"))).alias("high_value"))


def z_outliers(df: DataFrame, keys: list[str], value: str, times: float = 2.0) -> DataFrame:
    """Adds z_score and extreme: more than times the population std from the group's mean."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    joined = df.join(stats, keys)
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
    return joined.withColumn("z_score", F.round(z, 3)).withColumn("extreme", F.coalesce(F.round(F.abs(z), 9) > times, F.lit(False))).drop("_mean", "_std")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(keys, bin, n): rows in equal bins, the last one closed; data for a chart."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(value).between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


