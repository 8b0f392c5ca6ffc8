"""Disagreement pairs of two similarities, and their matched controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("easy_positive", "hard_negative", "hard_positive", "easy_negative")


def thresholds(scores: DataFrame, close: float = 0.95, distant: float = 0.5) -> DataFrame:
    """(close_min, distant_max): exact, interpolated quantiles of the pair scores."""
    return scores.agg(F.percentile("score", F.lit(close)).alias("close_min"), F.percentile("score", F.lit(distant)).alias("distant_max"))


def pair_class(visual: Column | str, semantic: Column | str, close_min: float, distant_max: float, semantic_close: float = 0.5, semantic_distant: float = 0.2) -> Column:
    """One of CLASSES by inclusive bounds, or null between them."""
    if close_min <= distant_max or semantic_close <= semantic_distant:
        raise ValueError("close must lie above distant")
    v, s = (F.col(x) if isinstance(x, str) else x for x in (visual, semantic))
    near, far, same, other = v >= close_min, v <= distant_max, s >= semantic_close, s <= semantic_distant
    return F.when(near & same, CLASSES[0]).when(near & other, CLASSES[1]).when(far & same, CLASSES[2]).when(far & other, CLASSES[3])


def select_pairs(pairs: DataFrame, per_class: int = 250) -> DataFrame:
    """Of (query_id, candidate_id, class, visual, semantic) each unordered pair once, as its least query has it, and the best of each class."""
    once = F.row_number().over(Window.partitionBy("class", F.least("query_id", "candidate_id"), F.greatest("query_id", "candidate_id")).orderBy("query_id", "candidate_id"))
    single = pairs.withColumn("_once", once).where("_once = 1").drop("_once")
    v, s = F.round("visual", 6), F.round("semantic", 6)
    first = F.when(F.col("class").isin(*CLASSES[:2]), -v).when(F.col("class") == CLASSES[2], -s).otherwise(v)
    second = F.when(F.col("class") == CLASSES[0], -s).when(F.col("class") == CLASSES[2], v).otherwise(s)
    best = F.row_number().over(Window.partitionBy("class").orderBy(first, second, "query_id", "candidate_id"))
    return single.withColumn("place", best).where(F.col("place") <= per_class)


def eligible_controls(pairs: DataFrame, scores: DataFrame, strata: DataFrame, labels: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(query_id, positive_id, control_id, target, score): of the query's stratum, within the tolerance of the positive's score, without a label in common."""
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    target = scores.select("query_id", F.col("candidate_id").alias("positive_id"), F.col("score").alias("target"))
    own = pairs.select("query_id", F.col("candidate_id").alias("positive_id")).join(target, ["query_id", "positive_id"])
    found = own.join(scores.select("query_id", F.col("candidate_id").alias("control_id"), "score"), "query_id").where((F.abs(F.round(F.col("score") - F.col("target"), 6)) <= tolerance) & (F.col("control_id") != F.col("positive_id")))
    q, c = strata.select(F.col("id").alias("query_id"), F.col("stratum").alias("_q")), strata.select(F.col("id").alias("control_id"), F.col("stratum").alias("_c"))
    found = found.join(q, "query_id").join(c, "control_id").where(F.col("_q").eqNullSafe(F.col("_c")))
    sets = labels.groupBy("id").agg(F.collect_set("label").alias("ls"))
    found = found.join(sets.select(F.col("id").alias("query_id"), F.col("ls").alias("_ql")), "query_id", "left").join(sets.select(F.col("id").alias("control_id"), F.col("ls").alias("_cl")), "control_id", "left")
    return found.where(~F.coalesce(F.arrays_overlap("_ql", "_cl"), F.lit(False))).select("query_id", "positive_id", "control_id", "target", "score")


def draw_controls(eligible: DataFrame, seed: int = 42) -> DataFrame:
    """One control for each pair, the side of the target drawn less often so far preferred: a sequential draw, in the order of the pairs.

    The choice depends on all before it, so it runs in one group; it gets one row a pair, its candidates as two short lists (the LEAST hashes of each side).
    """
    order = F.xxhash64("query_id", "positive_id", "control_id", F.lit(seed))
    side = F.when(F.round(F.col("score"), 6) <= F.round("target", 6), "below").otherwise("above")
    one = F.row_number().over(Window.partitionBy("query_id", "positive_id", "side").orderBy(order, "control_id"))
    picks = eligible.withColumn("side", side).withColumn("_n", one).where("_n = 1").drop("_n").withColumn("all", F.lit(1))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        drawn, out = {"below": 0, "above": 0}, []
        for _, own in frame.sort_values(["query_id", "positive_id"]).groupby(["query_id", "positive_id"]):
            sides = {r.side: r for r in own.itertuples()}
            name = ("below" if drawn["below"] <= drawn["above"] else "above") if len(sides) == 2 else next(iter(sides))
            drawn[name] += 1
            r = sides[name]
            out.append((r.query_id, r.positive_id, r.control_id, r.target, r.score))
        return pd.DataFrame(out, columns=["query_id", "positive_id", "control_id", "target", "score"])

    kind = dict(eligible.dtypes)["query_id"]
    return picks.groupBy("all").applyInPandas(draw, f"query_id {kind}, positive_id {kind}, control_id {kind}, target double, score double")


def bootstrap_auc(positive: np.ndarray, control: np.ndarray, resamples: int = 2000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    wins = np.where(positive > control, 1.0, np.where(positive == control, 0.5, 0.0))
    draws = np.random.default_rng(seed).integers(0, len(wins), (resamples, len(wins)))
    low, high = np.quantile(wins[draws].mean(axis=1), [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(wins.mean()), float(low), float(high)
