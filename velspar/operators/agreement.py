"""Agreement of raters and namers, lifts, and paired statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """One row (alpha, observed, expected, n_units, n_skipped) of ordinal agreement from (unit, rater, rating).

    Coincidences come from counts of each rating in a unit; categories, not units, meet in pairs. Null where there is no variation.
    """
    counts = ratings.groupBy("unit", F.col("rating").cast("double").alias("rating")).agg(F.count("*").alias("n"))
    units = counts.groupBy("unit").agg(F.sum("n").alias("m"))
    used = counts.join(units.where("m >= 2"), "unit")
    left, right = used.select("unit", F.col("rating").alias("c"), F.col("n").alias("nc"), "m"), used.select("unit", F.col("rating").alias("k"), F.col("n").alias("nk"))
    same = F.when(F.col("c") == F.col("k"), F.col("nc") * (F.col("nk") - 1)).otherwise(F.col("nc") * F.col("nk"))
    coincidence = left.join(right, "unit").groupBy("c", "k").agg(F.sum(same / (F.col("m") - 1)).alias("o"))
    marginal = coincidence.groupBy("c").agg(F.sum("o").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("c")))
    a, b = marginal.select("c", F.col("n").alias("n1"), F.col("upto").alias("u1")), marginal.select(F.col("c").alias("k"), F.col("n").alias("n2"), F.col("upto").alias("u2"))
    grid = a.crossJoin(b)  # of categories
    between = F.when(F.col("c") <= F.col("k"), F.col("u2") - F.col("u1") + F.col("n1")).otherwise(F.col("u1") - F.col("u2") + F.col("n2"))
    delta = F.pow(between - (F.col("n1") + F.col("n2")) / 2, 2)
    grid = grid.withColumn("delta", delta).join(coincidence, ["c", "k"], "left")
    expected = F.when(F.col("c") == F.col("k"), F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2"))
    total = marginal.agg(F.sum("n").alias("total"), F.count("*").alias("categories"))
    sums = grid.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")).alias("so"), F.sum(expected * F.col("delta")).alias("se")).crossJoin(total)
    observed, chance = F.try_divide("so", "total"), F.try_divide(F.col("se"), F.col("total") * (F.col("total") - 1))
    out = sums.select(F.when(F.col("categories") > 1, 1 - F.try_divide(observed, F.nullif(chance, F.lit(0.0)))).alias("alpha"), observed.alias("observed"), chance.alias("expected"))
    return out.crossJoin(units.agg(F.count_if(F.col("m") >= 2).alias("n_units"), F.count_if(F.col("m") < 2).alias("n_skipped")))  # one row each


def kendall_tau_b(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(tau): rank correlation with ties, from counts of distinct value pairs; null under two rows or without variation."""
    cells = pairs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a, b = cells.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1")), cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    signs = a.join(b, F.col("x1") < F.col("x2")).agg(F.sum(F.col("n1") * F.col("n2") * F.signum(F.col("y2") - F.col("y1"))).alias("s"))
    tied = lambda c: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    size = cells.agg(F.sum("n").alias("n"))
    row = signs.crossJoin(tied("x")).crossJoin(tied("y")).crossJoin(size)  # one row each
    every = F.col("n") * (F.col("n") - 1) / 2
    return row.select(F.try_divide(F.coalesce("s", F.lit(0.0)), F.nullif(F.sqrt((every - F.col("tx")) * (every - F.col("ty"))), F.lit(0.0))).alias("tau"))


def disagreements(ratings: DataFrame, threshold: float = 2.0, limit: int = 25) -> DataFrame:
    spread = ratings.groupBy("unit").agg((F.max("rating") - F.min("rating")).alias("spread"), F.count("*").alias("n")).where("n >= 2")
    return spread.where(F.col("spread") >= threshold).orderBy(F.desc("spread"), "unit").limit(limit)


def name_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, jaccard, shared) of two namers' words for the pictures that both named; two empty sets have 0."""
    a, b = (t.groupBy("id").agg(F.collect_set("word").alias(n)) for t, n in ((left, "a"), (right, "b")))
    both = a.join(b, "id")
    return both.select("id", F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(0.0)).alias("jaccard"), F.size(F.array_intersect("a", "b")).alias("shared"))


def name_lift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, n, confirmed, base, lift): how much oftener the other namer gives a word where the first does, over the pictures both named."""
    ids = left.select("id").distinct().join(right.select("id").distinct(), "id")
    a, b = (t.select("id", "word").distinct().join(ids, "id") for t in (left, right))
    size = ids.agg(F.count("*").alias("pictures"))
    own = a.groupBy("word").agg(F.count("*").alias("n"))
    base = b.groupBy("word").agg(F.count("*").alias("m"))
    both = a.join(b, ["id", "word"]).groupBy("word").agg(F.count("*").alias("k"))
    row = own.join(base, "word", "left").join(both, "word", "left").crossJoin(size)  # a single row
    share, rate = F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("m") / F.col("pictures"), F.lit(0.0))
    return row.select("word", "n", share.alias("confirmed"), rate.alias("base"), F.try_divide(share, F.nullif(rate, F.lit(0.0))).alias("lift"))


def prune_vocabulary(left: DataFrame, right: DataFrame, least_lift: float = 2.0, least: int = 20) -> DataFrame:
    """(word, lift_ab, lift_ba, support, verdict): a word stays if both namers' lifts and its support suffice."""
    ab, ba = name_lift(left, right), name_lift(right, left)
    row = ab.select("word", F.col("n").alias("na"), F.col("lift").alias("lift_ab")).join(ba.select("word", F.col("n").alias("nb"), F.col("lift").alias("lift_ba")), "word", "full")
    support = F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))
    verdict = F.when(support < least, "rare").when((F.coalesce("lift_ab", F.lit(0.0)) < least_lift) | (F.coalesce("lift_ba", F.lit(0.0)) < least_lift), "unconfirmed").otherwise("kept")
    return row.select("word", "lift_ab", "lift_ba", support.alias("support"), verdict.alias("verdict"))


def cohens_d(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean over sample deviation of the paired differences; 0 if they are constant."""
    d = F.col(a) - F.col(b)
    return pairs.agg(F.when(F.count(d) >= 2, F.coalesce(F.try_divide(F.avg(d), F.nullif(F.stddev_samp(d), F.lit(0.0))), F.lit(0.0))).alias("d"))


def cliffs_delta(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean sign over all pairs of a value of `a` and one of `b`, from cumulated counts of distinct values; `pairs` is computed once."""
    each = F.array(F.struct(F.col(a).alias("v"), F.lit(1).alias("p"), F.lit(0).alias("q")), F.struct(F.col(b).alias("v"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    values = pairs.select(F.explode(each).alias("r")).select("r.*").where("v is not null").groupBy("v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    order = Window.orderBy("v")
    below = F.coalesce(F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("w", F.col("p") * (below - above)).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("delta"))


def bootstrap_ci(rows: DataFrame, group: str, value: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(group, mean, low, high, n): percentile intervals of each group's mean; a group's values are one per query, in order of (value)."""
    if not 0 < confidence < 1:
        raise ValueError("the confidence must lie between 0 and 1")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame[value].to_numpy(float))
        rng = np.random.default_rng(seed)
        means = np.concatenate([x[rng.integers(0, len(x), (100, len(x)))].mean(axis=1) for _ in range(-(-resamples // 100))])[:resamples]
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({group: [frame[group].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high], "n": [len(x)]})

    return rows.where(F.col(value).isNotNull()).groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, mean double, low double, high double, n bigint")


def permutation_test(rows: DataFrame, group: str, a: str, b: str, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """(group, difference, p, n): sign flips of paired differences, two-sided, with one added to both counts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        d = np.sort((frame[a] - frame[b]).to_numpy(float))
        rng, least, n = np.random.default_rng(seed), 0, 0
        while n < permutations:
            flips = rng.integers(0, 2, (min(100, permutations - n), len(d))) * 2 - 1
            least += int((np.abs((flips * d).mean(axis=1)) >= abs(d.mean()) - 1e-12).sum())
            n += len(flips)
        return pd.DataFrame({group: [frame[group].iloc[0]], "difference": [d.mean()], "p": [(least + 1) / (permutations + 1)], "n": [len(d)]})

    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, difference double, p double, n bigint")


def paired_difference(rows: DataFrame, group: str, a: str, b: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(group, mean_first, mean_second, mean_difference, low, high, excludes_zero, n): queries are resampled jointly, as differences."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = known.groupBy(group).agg(F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"))
    interval = bootstrap_ci(known.select(group, (F.col(a) - F.col(b)).alias("difference")), group, "difference", resamples, confidence, seed).withColumnRenamed("mean", "mean_difference")
    return means.join(interval, group).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def compare_methods(rows: DataFrame, group: str, a: str, b: str, resamples: int = 10_000, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """The paired difference of two methods with its interval, the permutation test and both effect sizes, for each group, of which there are few."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = paired_difference(known, group, a, b, resamples, seed=seed).join(permutation_test(known, group, a, b, permutations, seed).select(group, "p"), group)
    d = F.col(a) - F.col(b)
    size = known.groupBy(group).agg(F.when(F.count(d) >= 2, F.coalesce(F.try_divide(F.avg(d), F.nullif(F.stddev_samp(d), F.lit(0.0))), F.lit(0.0))).alias("cohens_d"))
    values = known.select(group, F.col(a).alias("v"), F.lit(1).alias("p"), F.lit(0).alias("q")).union(known.select(group, b, F.lit(0), F.lit(1))).groupBy(group, "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    order = Window.partitionBy(group).orderBy("v")
    below = F.coalesce(F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("q").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    delta = values.withColumn("w", F.col("p") * (below - above)).groupBy(group).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("cliffs_delta"))
    return out.join(size, group).join(delta, group)


def compare_with_metric(human: DataFrame, metric: DataFrame) -> DataFrame:
    """Kendall's tau-b of two tables (key, value) over the keys that both hold."""
    return kendall_tau_b(human.select("key", F.col("value").alias("x")).join(metric.select("key", F.col("value").alias("y")), "key"), "x", "y")
