"""Score fusion of two modalities, its calibration, and the choice of its weight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = ("linear", "rank_linear", "rrf", "max", "product")


def bounds(scores: DataFrame) -> DataFrame:
    """(low, high, mean, std) of similarities; equal bounds are an error where they are used."""
    return scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def scaled(score: Column | str, low: float, high: float) -> Column:
    """Min-max scaling by outside bounds, not clipped."""
    if not high > low:
        raise ValueError("the upper bound must exceed the lower")
    return (F.col(score) if isinstance(score, str) else score) - F.lit(low) if high - low == 1 else ((F.col(score) if isinstance(score, str) else score) - F.lit(low)) / F.lit(high - low)


def fuse(scores: DataFrame, rule: str, alpha: float | Column, by: tuple[str, ...] = ("query_id",), rrf_k: float = 60.0) -> DataFrame:
    """Adds `score` from columns v and g under a rule; `alpha` weighs v and may be a column, so that a grid of weights is one pass."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known are {', '.join(RULES)}")
    if rrf_k <= 0 or isinstance(alpha, int | float) and not 0 <= alpha <= 1:
        raise ValueError("rrf_k must be positive and alpha between 0 and 1")
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    group = Window.partitionBy(*by)
    if rule == "linear":
        return scores.withColumn("score", a * F.col("v") + (1 - a) * F.col("g"))
    if rule == "max":
        return scores.withColumn("score", F.greatest(a * F.col("v"), (1 - a) * F.col("g")))
    if rule == "product":
        low_high = scores.select("*", *[f(c).over(group).alias(f"_{n}{c}") for c in ("v", "g") for n, f in (("low", F.min), ("high", F.max))])
        unit = lambda c: F.greatest(F.when(F.col(f"_high{c}") > F.col(f"_low{c}"), (F.col(c) - F.col(f"_low{c}")) / (F.col(f"_high{c}") - F.col(f"_low{c}"))).otherwise(F.col(c) - F.col(f"_low{c}")), F.lit(1e-9))
        return low_high.withColumn("score", F.exp(a * F.log(unit("v")) + (1 - a) * F.log(unit("g")))).drop("_lowv", "_highv", "_lowg", "_highg")
    both = scores.select("*", *[F.row_number().over(group.orderBy(F.desc(c), "candidate_id")).alias(f"_r{c}") for c in ("v", "g")], F.count("*").over(group).alias("_n"))
    if rule == "rrf":
        out = both.withColumn("score", a / (rrf_k + F.col("_rv")) + (1 - a) / (rrf_k + F.col("_rg")))
    else:
        unit = lambda c: F.when(F.col("_n") < 2, 1.0).otherwise(1 - (F.col(f"_r{c}") - 1) / (F.col("_n") - 1))
        out = both.withColumn("score", a * unit("v") + (1 - a) * unit("g"))
    return out.drop("_rv", "_rg", "_n")


def rerank(scores: DataFrame, candidates: int, alpha: float) -> DataFrame:
    """The best `candidates` by v, put in order by the linear fusion of v and g."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "candidate_id"))
    kept = fuse(scores.withColumn("first", first).where(F.col("first") <= candidates), "linear", alpha)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "candidate_id")))


def record_scores(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Cosine of weighted, concatenated unit vectors from the parts' own cosines: their weights count squared."""
    total = sum(w * w for _, w in parts.values())
    out = None
    for name, (scores, w) in parts.items():
        own = scores.select("query_id", "candidate_id", (F.col("score") * (w * w / total)).alias(name))
        out = own if out is None else out.join(own, ["query_id", "candidate_id"])
    return out.select("query_id", "candidate_id", sum((F.col(n) for n in parts), F.lit(0.0)).alias("score"))


def late_fusion_vector(v: Column, g: Column, alpha: float, v_width: float, g_width: float) -> Column:
    """One vector whose dot products order pairs as linear fusion of the scaled cosines does."""
    a, b = math.sqrt(alpha / v_width), math.sqrt((1 - alpha) / g_width)
    return F.concat(F.transform(v, lambda x: x * a), F.transform(g, lambda x: x * b))


def choose_weight(grid: DataFrame) -> DataFrame:
    """Of (alpha, metric) the weight with the best metric, the larger one of equals."""
    return grid.agg(F.max_by("alpha", F.struct(F.round("metric", 9), "alpha")).alias("alpha"), F.max("metric").alias("metric"))
