"""Report sections and chart data of the evaluation, each a small DataFrame; a Markdown document of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.operators import summary
from siftloom.sources import writers

#: Titles of the report and of its sections, outcomes of a comparison.
TITLE, PAIRWISE, SINGLE = "中文长回答 SFT 评测报告", "配对对比评测 (Pairwise)", "单模型评测 (Single)"
WINS, BY_DIMENSION, BY_CATEGORY, MODEL, QUALITY = "胜率统计", "维度平均分对比", "分类统计", "模型", "质量分布"
OUTCOMES = {"win_rate_a": "Baseline 胜", "win_rate_b": "Candidate 胜", "tie_rate": "平局"}


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def _label(dim: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in k.DIMENSION_LABELS.items() for x in kv]), F.col(dim))


def win_rates(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome, rate): data of the bar chart of a comparison (B11), one row for each outcome."""
    s = summary.pairwise_summary(results, keys)
    return s.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("outcome"), F.col(c).alias("rate")) for c, name in OUTCOMES.items()])).alias("_s")).select(*keys, "_s.*")


def radar(results: DataFrame) -> DataFrame:
    """(model_version, dimension, label, value): data of the radar chart (B11), from single_rounds."""
    s = summary.version_table(results)
    long = s.select("model_version", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in k.DIMENSIONS])).alias("_s"))
    return long.select("model_version", "_s.dimension", _label("_s.dimension").alias("label"), "_s.value")


def quality_pie(results: DataFrame) -> DataFrame:
    """(model_version, bucket, n): data of the pie chart of quality bins (B11), from single_rounds."""
    s = summary.single_summary(results, ["model_version"])
    return s.select("model_version", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in ("low", "mid", "high")])).alias("_s")).select("model_version", "_s.*")


def pairwise_sections(results: DataFrame, prompts: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Win rates, dimensions of both sides and categories of a comparison (B10), from pairwise_rounds."""
    s = summary.pairwise_summary(results, keys)
    rows = [F.struct(F.lit(name).alias("结果"), _percent(F.col(c)).alias("比例")) for c, name in OUTCOMES.items()] + [F.struct(F.lit("总计").alias("结果"), F.format_string("%d 条", "total").alias("比例")), F.struct(F.lit("平均胜者一致率").alias("结果"), _percent(F.col("avg_agreement")).alias("比例"))]
    diff = summary.dimension_diff(results, keys)
    gap = F.col("mean_b") - F.col("mean_a")
    arrow = F.when(F.round(gap, 9) > 0.1, "↑").when(F.round(gap, 9) < -0.1, "↓").otherwise("≈")
    return {
        WINS: s.select(*keys, F.explode(F.array(*rows)).alias("_s")).select(*keys, "_s.*"),
        BY_DIMENSION: diff.select(*keys, _label("dim").alias("维度"), F.format_string("%.3f", "mean_a").alias("Baseline"), F.format_string("%.3f", "mean_b").alias("Candidate"), F.concat(F.format_string("%+.3f ", gap), arrow).alias("差值")),
        BY_CATEGORY: summary.by_category(results, prompts).select(F.col("category").alias("分类"), F.col("total").alias("总数"), F.col("a").alias("A 胜"), F.col("b").alias("B 胜"), F.col("tie").alias("平局")),
    }


def single_sections(results: DataFrame) -> dict[str, DataFrame]:
    """Means, consistency, dimensions and quality bins of every version (B10), from single_rounds."""
    s = summary.single_summary(results, ["model_version"])
    values = radar(results)
    return {
        MODEL: s.select(F.col("model_version").alias("模型"), F.col("total").alias("总数"), F.format_string("%.3f", "mean_score").alias("平均分"), _percent(F.col("uncertain_rate")).alias("不确定率"), F.format_string("%.3f", "avg_max_std").alias("平均最大标准差")),
        BY_DIMENSION: values.select(F.col("model_version").alias("模型"), F.col("label").alias("维度"), F.format_string("%.3f", "value").alias("平均分")),
        QUALITY: s.select(F.col("model_version").alias("模型"), "low", "mid", "high"),
    }


def markdown(settings: dict[str, str], pairwise: dict[str, DataFrame] | None = None, single: dict[str, DataFrame] | None = None) -> str:
    """The report as one Markdown document; tables are gathered, their size is checked."""
    lines = [f"# {TITLE}", ""]
    if settings:
        lines += ["## 评测配置", "", "| 参数 | 值 |", "| --- | --- |", *[f"| {n} | {v} |" for n, v in settings.items()], ""]
    for title, sections in ((PAIRWISE, pairwise), (SINGLE, single)):
        if sections:
            lines += [f"## {title}", ""]
            for name, df in sections.items():
                lines += [f"### {name}", "", writers.markdown_table(df), ""]
    return "\n".join(lines)
