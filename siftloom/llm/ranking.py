"""Problem 4: one global ranking from pairwise comparisons, by spring energy.

Each comparison is a spring that wants its winner one unit above its loser; a tie wants both level.
Minimising the springs' energy gives a sparse linear system (L + alpha I) s = d, where L is the
Laplacian of the comparison counts and d the surplus of wins. It is solved by conjugate gradients
with a Jacobi preconditioner: every product is a join and an aggregation over DataFrames, and both scalars of a step come from one aggregation.

Comparisons are first pre-aggregated to one edge for each ordered pair, so the system has as many
rows as there are different pairs, however many comparisons there are. Items without comparisons
get strength 0. Null items, unusable winners and an item against itself do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import cut

#: Spellings of a usable winner, after trimming white space and points and lowering.
FIRST_WINS, SECOND_WINS, TIES = ("a", "model_a"), ("b", "model_b"), ("tie", "draw", "平局", "c")


def outcome(winner: str, swapped: str) -> Column:
    """1 if model_a won, -1 if model_b won, 0 for a tie, null if unusable; winner is what the judge saw."""
    w = F.lower(F.regexp_replace(F.col(winner), r"(?U)^[\s.]+|[\s.]+$", ""))
    seen = F.when(w.isin(*FIRST_WINS), 1).when(w.isin(*SECOND_WINS), -1).when(w.isin(*TIES), 0)
    return F.when(F.coalesce(F.col(swapped), F.lit(False)), -seen).otherwise(seen)


def comparisons(df: DataFrame) -> DataFrame:
    """(a, b, y) of each usable comparison of PairwiseResult rows; a redelivered comparison counts once."""
    return (
        df.select("prompt_id", "model_a", "model_b", "judge_id", "judged_at", outcome("winner", "position_swapped").alias("y"))
        .where(F.col("y").isNotNull() & F.col("model_a").isNotNull() & F.col("model_b").isNotNull() & (F.col("model_a") != F.col("model_b")))
        .groupBy("prompt_id", "model_a", "model_b", "judge_id", "judged_at")
        .agg(F.min("y").alias("y"))
        .select(F.col("model_a").alias("a"), F.col("model_b").alias("b"), "y")
    )


def spring_rank(games: DataFrame, items: DataFrame | None = None, alpha: float = 1e-6, tolerance: float = 1e-9, max_steps: int = 300) -> DataFrame:
    """(item, games, strength) from (a, b, y); items (item) adds those without any game.

    Items stay a DataFrame, so their number is not bounded by the driver; only two scalars of each step reach it, gathered
    by one aggregation. The lineage is cut in every step with a checkpoint in the shared folder. RuntimeError if the residual has not fallen to the tolerance after max_steps.
    """
    way = games.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("d"))
    both = way.unionAll(way.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", (-F.col("d")).alias("d")))
    edges = cut(both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    nodes = edges.groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("games"), F.sum("d").alias("rhs"))
    if items is not None:
        nodes = items.select("item").where(F.col("item").isNotNull()).distinct().join(nodes, "item", "full").fillna(0.0, ["games", "rhs"])
    state = nodes.select("item", "games", (F.col("games") + alpha).alias("diag"), F.lit(0.0).alias("s"), F.col("rhs").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    goal = gamma = step_length = None
    for _ in range(max_steps + 1):
        # u is the preconditioned residual, w = L u; gamma = r u and delta = w u give both scalars of the step
        state = state.withColumn("u", F.col("r") / F.col("diag"))
        pull = edges.join(state.select(F.col("item").alias("b"), "u"), "b").groupBy(F.col("a").alias("item")).agg(F.sum(F.col("n") * F.col("u")).alias("_nu"))
        state = cut(state.join(pull, "item", "left").withColumn("w", F.col("diag") * F.col("u") - F.coalesce("_nu", F.lit(0.0))).drop("_nu"))
        sums = state.agg(F.coalesce(F.sum(F.col("r") * F.col("u")), F.lit(0.0)).alias("gamma"), F.coalesce(F.sum(F.col("w") * F.col("u")), F.lit(0.0)).alias("delta")).first()
        goal = tolerance * tolerance * sums.gamma if goal is None else goal
        if sums.gamma <= goal:
            break
        turn = sums.gamma / gamma if gamma else 0.0
        step_length = sums.gamma / (sums.delta - (turn * sums.gamma / step_length if gamma else 0.0))
        gamma = sums.gamma
        state = state.withColumn("p", F.col("u") + turn * F.col("p")).withColumn("q", F.col("w") + turn * F.col("q"))
        state = state.withColumn("s", F.col("s") + step_length * F.col("p")).withColumn("r", F.col("r") - step_length * F.col("q")).drop("u", "w")
    else:
        raise RuntimeError(f"strengths have not converged after {max_steps} steps")
    # the system leaves the common level almost free: strengths are told from their mean over the items that played
    level = state.where("games > 0").agg(F.avg("s")).first()[0] or 0.0
    return state.select("item", F.col("games").cast("bigint").alias("games"), F.when(F.col("games") > 0, F.col("s") - level).otherwise(0.0).alias("strength"))


def ranking(games: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(rank_no, item, games, strength); the strongest has rank 1, equal strengths are ordered by name.

    Rows are sorted by ranges; a rank is the row's place in its range and the number of rows in the ranges before it.
    """
    ranked = spring_rank(games, items).withColumn("_o", F.round("strength", 9))
    # sorted once and stored, so that the ranges stay what they are when they are counted and read again
    placed = cut(ranked.orderBy(F.desc("_o"), "item").select("item", "games", "strength", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select((F.col("_before") + within + 1).cast("int").alias("rank_no"), "item", "games", "strength")
