"""Queries of the training-data problems: name -> (spark, data folder) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm import defects, format_copies, leaks, near_duplicates, packing, personal, ranking, repetition
from siftloom.session import shared_dir, ship_package, table

#: Tables with generated texts and the column that holds them.
TEXTS = (("model_outputs", "response"), ("output_items", "answer"))


def _start(spark: SparkSession) -> None:
    ship_package(spark)
    shared_dir(spark)


def _p1(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    parts = [repetition.repetition(table(spark, d, t), "row_id", c).select(F.lit(t).alias("table_name"), "row_id", "share", "longest", "score", "is_case") for t, c in TEXTS]
    return parts[0].unionAll(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).where("is_case").select("table_name", "row_id")


def p1_repetition_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content, for every text."""
    return _p1(spark, d).select("table_name", "row_id", F.round("share", 6).alias("share"), F.round("longest", 6).alias("longest"), "is_case")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    return near_duplicates.similar_rows(table(spark, d, "corpus"), "row_id", ["question", "answer"]).toDF("row_id_a", "row_id_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each row of the corpus: its class of equal texts, and the number of other classes that are similar."""
    _start(spark)
    df = table(spark, d, "corpus")
    classes, several, pairs = near_duplicates.similar_classes(df, "row_id", ["question", "answer"])
    links = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    who = near_duplicates.members(classes, several)
    return who.join(links, "rep", "left").select(F.col("id").alias("row_id"), F.col("rep").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    return format_copies.format_copies(table(spark, d, "corpus"), "row_id", "question").select(F.col("first_key").alias("first_row_id"), "row_id")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each question, with its number of copies."""
    _start(spark)
    return format_copies.format_groups(table(spark, d, "corpus"), "row_id", "question").select(F.col("first_key").alias("first_row_id"), "copies", F.col("text").alias("question"))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    items = table(spark, d, "model_versions").select(F.col("model_version").alias("item"))
    return ranking.ranking(ranking.comparisons(table(spark, d, "pairwise_results")), items)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("rank_no", F.col("item").alias("model_version"))


def p4_strengths(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("rank_no", F.col("item").alias("model_version"), "games", F.round("strength", 6).alias("strength"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """One text for each prompt_id."""
    return table(spark, d, "prompts").groupBy("prompt_id").agg(F.min("text").alias("question"))


def _pairs(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(row_id, question, answer, source) of one table; a response whose prompt is unknown has no question."""
    if name == "model_outputs":
        return table(spark, d, name).join(_prompts(spark, d), "prompt_id", "left").select("row_id", "question", F.col("response").alias("answer"), "source")
    return table(spark, d, name).select("row_id", "question", "answer", "source")


def _p5(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, source, truncated) of every text."""
    _start(spark)
    known = [(table(spark, d, t), c) for t, c in TEXTS]
    parts = [(t, _pairs(spark, d, t), defects.limits_by_source(table(spark, d, t), c, "source")) for t, c in TEXTS]
    return defects.judge_tables(parts, "row_id", known, None).select("table_name", "row_id", F.array_contains("defects", "truncated").alias("truncated"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("truncated").select("table_name", "row_id")


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    sources = [table(spark, d, t).select(F.lit(t).alias("table_name"), "row_id", "source") for t, _ in TEXTS]
    rows = _p5(spark, d).join(sources[0].unionAll(sources[1]), ["table_name", "row_id"])
    return rows.groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"))


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hidden storage limits found, by source and encoding."""
    from siftloom.llm import truncation

    _start(spark)
    parts = [truncation.hidden_limits(truncation.length_table(table(spark, d, t), c, "source")).withColumn("table_name", F.lit(t)) for t, c in TEXTS]
    names = F.array(*[F.lit(e) for e in truncation.ENCODINGS])
    return parts[0].unionAll(parts[1]).select("table_name", "source", F.element_at(names, F.col("encoding") + 1).alias("encoding"), "length", "n", F.round("usual", 4).alias("usual"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    texts = (("corpus", "answer"), ("model_outputs", "response"))
    known = [(table(spark, d, t), c) for t, c in texts]
    languages = defects.broadcast(spark, defects.language_model(table(spark, d, "documents"), "text", "lang"))
    parts = [(t, _pairs(spark, d, t), defects.limits_by_source(table(spark, d, t), c, "source")) for t, c in texts]
    return defects.judge_tables(parts, "row_id", known, languages).select("table_name", "row_id", F.explode("defects").alias("defect"))


def p6_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs by table and type."""
    return p6_found(spark, d).groupBy("table_name", "defect").agg(F.count(F.lit(1)).alias("n"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers, for each specification."""
    _start(spark)
    items = table(spark, d, "documents").select("doc_id", packing.byte_size("text").alias("size"))
    return packing.pack(items, "doc_id", table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each specification are."""
    return packing.fill(p7_packing(spark, d), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "question").select("doc_id", "item_id")


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a long enough passage of an item with some edits, at most a tenth of its letters, and their least number."""
    _start(spark)
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "question", edits=leaks.EDITS)


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _start(spark)
    return personal.personal(table(spark, d, "documents"), "doc_id", "text")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in place of what was found."""
    _start(spark)
    return personal.redacted(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit() and callable(f)}


_LETTERS = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

#: The plain definition where SQL can say it over whole tables: documents that hold a passage of an item.
SQL = {
    "p8_found": f"""WITH d AS (SELECT doc_id, {_LETTERS('text')} AS t FROM documents), i AS (SELECT item_id, {_LETTERS('question')} AS q FROM eval_items),
p AS (SELECT item_id, q, greatest(1, ceil(0.4::DOUBLE * length(q) - 1e-9))::INT AS need FROM i WHERE q <> ''),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(q) - need + 2), lambda a: q[a : a + need - 1])) AS passage FROM p)
SELECT DISTINCT doc_id, item_id FROM d JOIN s ON contains(d.t, s.passage)""",
}
SQL["p8_leaked_items"] = f"WITH f AS ({SQL['p8_found']}) SELECT item_id, count(*) AS documents FROM f GROUP BY item_id"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
