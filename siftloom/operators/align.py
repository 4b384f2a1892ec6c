"""Alignment of answers by prompt, checks of inputs, and decoding of blind comparisons.

Where a prompt has several rows, the last by position wins (align) or the first (answers looked up);
keep_last and keep_first use one aggregation with max_by / min_by, so a hot prompt is pre-aggregated
on the map side. Null ids never align.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t

#: Versions that one coverage report may have: their number is checked.
MOST_VERSIONS = 10_000


def keep_last(df: DataFrame, keys: list[str], pos: str, *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), pos).alias("_s")).select(*keys, "_s.*")


def keep_first(df: DataFrame, keys: list[str], pos: str, *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), pos).alias("_s")).select(*keys, "_s.*")


def align_pair(outputs: DataFrame, prompts: DataFrame, baseline: str, candidate: str, pos: str = "row_id") -> DataFrame:
    """(prompt_id, prompt_text, category, baseline_response, candidate_response): prompts with both answers.

    A prompt that is not listed gives an empty text and category.
    """
    last = keep_last(outputs.where(F.col("prompt_id").isNotNull() & F.col("model_version").isin(baseline, candidate)), ["prompt_id", "model_version"], pos, "response")
    one = last.where(F.col("model_version") == baseline).select("prompt_id", t.text("response").alias("baseline_response"))
    two = last.where(F.col("model_version") == candidate).select("prompt_id", t.text("response").alias("candidate_response"))
    known = keep_last(prompts, ["prompt_id"], "text", "text", "category")
    return one.join(two, "prompt_id").join(known, "prompt_id", "left").select("prompt_id", t.text("text").alias("prompt_text"), t.text("category").alias("category"), "baseline_response", "candidate_response")


def skipped_counts(outputs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(only_baseline, only_candidate): prompts that one side alone answers."""
    has = outputs.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id").agg(F.bool_or(F.col("model_version") == baseline).alias("b"), F.bool_or(F.col("model_version") == candidate).alias("c"))
    return has.agg(F.count_if(F.coalesce("b", F.lit(False)) & ~F.coalesce("c", F.lit(False))).alias("only_baseline"), F.count_if(F.coalesce("c", F.lit(False)) & ~F.coalesce("b", F.lit(False))).alias("only_candidate"))


def in_all_versions(outputs: DataFrame, versions: list[str]) -> DataFrame:
    """(prompt_id) of the prompts that every version answers."""
    return outputs.where(F.col("model_version").isin(*versions) & F.col("prompt_id").isNotNull()).groupBy("prompt_id").agg(F.count_distinct("model_version").alias("n")).where(F.col("n") == len(set(versions))).select("prompt_id")


def align_versions(outputs: DataFrame, versions: list[str], pos: str = "row_id") -> DataFrame:
    """(prompt_id, one column of answers for each version) over the prompts that all answer."""
    last = keep_last(outputs.where(F.col("model_version").isin(*versions) & F.col("prompt_id").isNotNull()), ["prompt_id", "model_version"], pos, "response")
    wide = last.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("model_version") == v, t.text("response"))).alias(v) for v in versions])
    return wide.where(F.col("_n") == len(set(versions))).drop("_n")


def single_join(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Answers with their prompt; answers without a listed prompt drop out (D3)."""
    return outputs.join(keep_last(prompts, ["prompt_id"], "text", "text", "category"), "prompt_id")


def coverage(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(model_version, covered, missing, extra, rate, first_missing) against the listed prompts (C7, C8); no prompts give rate 0."""
    ids = prompts.select("prompt_id").where("prompt_id is not null").distinct()
    have = outputs.where(F.col("model_version").isNotNull() & F.col("prompt_id").isNotNull()).select("model_version", "prompt_id").distinct()
    n = ids.count()
    versions = [r[0] for r in have.select("model_version").distinct().limit(MOST_VERSIONS + 1).collect()]
    if len(versions) > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions")
    by_prompt = have.groupBy("prompt_id").agg(F.collect_set("model_version").alias("have"))
    every = F.array(*[F.lit(v) for v in versions]).cast("array<string>")
    gone = ids.join(by_prompt, "prompt_id", "left").select("prompt_id", F.explode(F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))).alias("model_version"))
    first = gone
    for part in (["model_version", F.pmod(F.xxhash64("prompt_id"), F.lit(64))], ["model_version"]):  # the first ten of 64 parts, then of all
        first = first.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy("prompt_id"))).where("_i <= 10").drop("_i")
    lists = first.groupBy("model_version").agg(F.array_join(F.sort_array(F.collect_list("prompt_id")), ",").alias("first_missing"))
    known = have.join(ids.withColumn("known", F.lit(True)), "prompt_id", "left").groupBy("model_version").agg(F.count_if("known").alias("covered"), F.count_if(F.col("known").isNull()).alias("extra"))
    rate = F.lit("0.0%") if n == 0 else F.format_string("%.1f%%", F.col("covered") * 100.0 / n + 1e-9)
    return known.join(lists, "model_version", "left").select("model_version", "covered", (F.lit(n) - F.col("covered")).alias("missing"), "extra", rate.alias("rate"), F.coalesce("first_missing", F.lit("")).alias("first_missing"))


def missing_ids(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt_id, side): prompts nobody answers and answers to unknown prompts."""
    a, b = prompts.select("prompt_id").where("prompt_id is not null").distinct(), outputs.select("prompt_id").where("prompt_id is not null").distinct()
    return a.join(b, "prompt_id", "left_anti").withColumn("side", F.lit("missing")).unionAll(b.join(a, "prompt_id", "left_anti").withColumn("side", F.lit("extra")))


def duplicate_ids(df: DataFrame, key: str, first: int = 10) -> DataFrame:
    """(key, n) of the first ids that stand in several rows (C4): a report of fixed length."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(key).limit(first)


def blank_counts(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, blank): blank texts in each group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(t.compact(column) == "").alias("blank"))


def output_issues(df: DataFrame) -> DataFrame:
    """Adds issues: blank question, blank answer, answer shorter than ten characters (C1); no row is dropped."""
    return df.withColumn("issues", F.array_compact(F.array(F.when(t.compact("question") == "", "question_blank"), F.when(t.compact("answer") == "", "answer_blank"), F.when(F.char_length(t.text("answer")) < 10, "answer_short"))))


def k_way(files: DataFrame, count: int) -> DataFrame:
    """(id, subset, instruction, predictions, mismatch) of the ids in all count files, from (file, pos, id, subset, instruction, prediction).

    In each file the last row of an id wins; subset and instruction come from the first file; one file alone keeps all its rows.
    """
    if count == 1:
        return files.select("id", "subset", "instruction", F.array("prediction").alias("predictions"), F.lit(False).alias("mismatch"))
    last = keep_last(files.where("id is not null"), ["id", "file"], "pos", "subset", "instruction", "prediction")
    merged = last.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("subset", "file").alias("subset"), F.min_by("instruction", "file").alias("instruction"), F.transform(F.array_sort(F.collect_list(F.struct("file", "prediction"))), lambda x: x["prediction"]).alias("predictions"), (F.count_distinct("instruction") > 1).alias("mismatch"))
    return merged.where(F.col("_n") == count).drop("_n")


def numeric_first(column: str) -> list[Column]:
    """Order by number where an id is one, then the others by text (H4)."""
    number = F.regexp_like(F.col(column), F.lit("^[0-9]+$"))
    return [F.when(number, 0).otherwise(1), F.when(number, F.col(column).try_cast("bigint")), F.col(column)]


def decode_blind(results: DataFrame) -> DataFrame:
    """Winner and scores as the models' own, not as shown: swapped rows exchange A with B."""
    swapped = F.coalesce("position_swapped", F.lit(False))
    return results.withColumns(
        {
            "winner": F.when(swapped & (F.col("winner") == "A"), "B").when(swapped & (F.col("winner") == "B"), "A").otherwise(F.col("winner")),
            "scores_a": F.when(swapped, F.col("scores_b")).otherwise(F.col("scores_a")),
            "scores_b": F.when(swapped, F.col("scores_a")).otherwise(F.col("scores_b")),
        }
    )


def clean_winner(column: str = "winner") -> Column:
    """A, B or tie from the spellings that judges use; null for anything else."""
    w = F.lower(F.regexp_replace(F.col(column), f"^({k.WS_JAVA}|\\.)+|({k.WS_JAVA}|\\.)+$", ""))
    return F.when(w.isin("a", "model_a"), "A").when(w.isin("b", "model_b"), "B").when(w.isin("tie", "draw", "平局", "c"), "tie")


def judged(results: DataFrame) -> DataFrame:
    """Usable comparisons, decoded, each delivered once: the smallest row_id of a comparison stays."""
    keys = ["prompt_id", "model_a", "model_b", "judge_id", "judged_at"]
    usable = results.withColumn("winner", clean_winner()).where("winner is not null")
    once = usable.groupBy(*keys).agg(F.min_by(F.struct("row_id", "winner", "scores_a", "scores_b", "position_swapped", "reasoning"), "row_id").alias("_s")).select(*keys, "_s.*")
    return decode_blind(once)


def coalesce_rows(df: DataFrame) -> DataFrame:
    """(id, instruction, predictions, subset) from rows with alternative field names; blanks count as missing."""
    pick = lambda *names: F.coalesce(*[F.nullif(t.strip(t.text(n)), F.lit("")) for n in names if n in df.columns], F.lit(""))
    single = F.array(pick("prediction", "response", "answer"))
    many = [F.col(n) for n in ("predictions", "candidates") if n in df.columns]
    return df.select(pick("id", "prompt_id").alias("id"), pick("instruction", "text", "question").alias("instruction"), F.coalesce(*many, single).alias("predictions"), (t.text("subset") if "subset" in df.columns else F.lit("")).alias("subset"))
