"""Pooled vectors, bands and shares of ranked rows, set matching, region descriptors, colour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mean_pool(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector, covered): the unit mean of the vectors (label, vector) of an item's labels; labels without a vector are left out.

    Sums go by dimension, with partial sums before the shuffle; an item's dimensions meet again as one short array.
    """
    cells = labels.join(vectors, "label").select("id", F.posexplode("vector").alias("k", "x"))
    means = cells.groupBy("id", "k").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda c: c["m"]).alias("vector"), F.max("n").alias("covered"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("_n"))
    return packed.where("_n > 0").select("id", F.transform("vector", lambda x: x / F.col("_n")).alias("vector"), "covered")




def terciles(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Adds `band` 0 to 2 by (value, key): the first two bands have max(n div 3, 1) rows, the rest lie in the last."""
    place = ordered(rows, value, key)
    size = rows.agg(F.greatest(F.floor(F.count("*") / 3), F.lit(1)).alias("_s"))
    return place.crossJoin(F.broadcast(size)).withColumn("band", F.least(F.floor((F.col("place") - 1) / F.col("_s")), F.lit(2)).cast("int")).drop("_s")  # one row


def ordered(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds `place` 1 to n in order of (value, key), from counts of distinct values, so that only equal values meet in one task."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_m"))
    before = counts.select(value, F.coalesce(F.sum("_m").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(value).orderBy(key))
    return rows.join(before, value).withColumn("place", F.col("_before") + own).drop("_before")


def top_decile_share(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(n, share): the share of all positive gain that the max(1, n div 10) largest gains hold."""
    n = rows.agg(F.greatest(F.floor(F.count("*") / 10), F.lit(1)).alias("_k"), F.count("*").alias("n"), F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("_all"))
    best = ordered(rows.withColumn("_v", -F.col(value)), "_v", key).crossJoin(F.broadcast(n)).where(F.col("place") <= F.col("_k"))  # one row
    return best.agg(F.max("n").alias("n"), F.try_divide(F.sum(F.greatest(F.col(value), F.lit(0.0))), F.nullif(F.max("_all"), F.lit(0.0))).alias("share"))


def relative_scale(regions: DataFrame) -> DataFrame:
    """(id, region_index, to_median, to_largest) of areas; the upper median, at place n div 2 counted from 0."""
    per = regions.groupBy("id").agg(F.array_sort(F.collect_list("area")).alias("_a"))
    median, largest = F.element_at("_a", (F.floor(F.size("_a") / 2) + 1).cast("int")), F.element_at("_a", -1)
    return regions.join(per, "id").select("id", "region_index", F.try_divide("area", F.nullif(median, F.lit(0.0))).alias("to_median"), F.try_divide("area", F.nullif(largest, F.lit(0.0))).alias("to_largest"))


def descriptor(area: Column, elongation: Column, holes: Column, tone: Column, hu: Column) -> Column:
    """A region as numbers: logarithm of its area, elongation, holes up to 8, tone as a sign, signed logarithms of its moments."""
    signed = F.transform(hu, lambda x: F.signum(x) * F.log1p(F.abs(x)))
    return F.concat(F.array(F.log1p(area), F.log1p(elongation), F.least(holes, F.lit(8)).cast("double"), F.when(tone == "dark", 1.0).otherwise(-1.0)), signed)


def grid_cell(x: Column, y: Column, side: int = 3) -> Column:
    """The cell of a side x side grid, row by row."""
    at = lambda c: F.least(F.floor(c * side), F.lit(side - 1))
    return (at(y) * side + at(x)).cast("bigint")


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab of sRGB values from 0 to 1 under D65 (fixed values: the sRGB matrix and white point)."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    r, g, b = linear(r), linear(g), linear(b)
    x, y, z = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    return F.array(116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z)))


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least cost, rows <= columns: shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if not match[j]:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


@F.pandas_udf(DoubleType())
def soft_match(left: pd.Series, right: pd.Series) -> pd.Series:
    """Mean similarity of two lists of vectors under their best assignment, over the shorter list; 0 for an empty one."""

    def one(a: list, b: list) -> float:
        if not len(a) or not len(b):
            return 0.0
        x, y = (np.stack([np.asarray(v, float) / (np.linalg.norm(v) or 1) for v in s]) for s in (a, b))
        similarity = x @ y.T if len(x) <= len(y) else y @ x.T
        return float(np.mean([similarity[i, j] for i, j in enumerate(assign(-similarity))]))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def expected_best_rank(partners: DataFrame, size: int) -> DataFrame:
    """(median): the median over queries (n targets each) of the best rank expected by chance, (size + 1) / (n + 1)."""
    return partners.select((F.lit(size + 1.0) / (F.col("n") + 1)).alias("e")).agg(F.median("e").alias("median"))


def entity_means(rows: DataFrame, method: str, rating: str) -> DataFrame:
    """(method, n, mean): a rating counts once for each method that retrieved its pair."""
    return rows.select(F.explode(method).alias("method"), rating).groupBy("method").agg(F.count(rating).alias("n"), F.avg(rating).alias("mean"))
