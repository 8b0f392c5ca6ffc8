"""Symbolic channels of pictures from their regions: histograms, repetition, relations, groups, context, named nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.operators.components import connected


def histogram(rows: DataFrame, feature: str, weight: str, by: str = "id") -> DataFrame:
    """(id, feature, weight): summed weights, L2-normalised in each picture; sparse, so a cosine is a join on the feature."""
    sums = rows.groupBy(by, F.col(feature).alias("feature")).agg(F.sum(weight).alias("w"))
    norms = sums.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return sums.join(norms, by).select(by, "feature", F.when(F.col("_n") > 0, F.col("w") / F.col("_n")).otherwise(0.0).alias("weight"))


def sparse_cosine(histograms: DataFrame) -> DataFrame:
    """(query_id, candidate_id, score) of pictures that share a feature."""
    q = histograms.select(F.col("id").alias("query_id"), "feature", F.col("weight").alias("w1"))
    c = histograms.select(F.col("id").alias("candidate_id"), "feature", F.col("weight").alias("w2"))
    return q.join(c, "feature").where("query_id <> candidate_id").groupBy("query_id", "candidate_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("score"))


def repetition(rows: DataFrame) -> DataFrame:
    """(id, bucket, share): how many of a picture's signs occur 1, 2, 3 to 4 and 5 or more times."""
    counts = rows.groupBy("id", "sign").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 4, "3-4").otherwise("5+")
    buckets = counts.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("m"))
    totals = counts.groupBy("id").agg(F.count("*").alias("t"))
    return buckets.join(totals, "id").select("id", "bucket", (F.col("m") / F.col("t")).alias("share"))


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    c = lambda n: F.col(f"{prefix}.{n}")
    return c("centroid_x") - c("extent_x") / 2, c("centroid_y") - c("extent_y") / 2, c("centroid_x") + c("extent_x") / 2, c("centroid_y") + c("extent_y") / 2


def relation(a: str = "a", b: str = "b") -> Column:
    """The coarse spatial relation from one region to another; y grows downward, touching edges overlap, equal boxes contain each other."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    dx, dy = F.col(f"{b}.centroid_x") - F.col(f"{a}.centroid_x"), F.col(f"{b}.centroid_y") - F.col(f"{a}.centroid_y")
    overlap = ~((ax1 < bx0) | (bx1 < ax0) | (ay1 < by0) | (by1 < ay0))
    return (
        F.when((ax0 <= bx0) & (ay0 <= by0) & (ax1 >= bx1) & (ay1 >= by1), "contains")
        .when((bx0 <= ax0) & (by0 <= ay0) & (bx1 >= ax1) & (by1 >= ay1), "inside").when(overlap, "touches")
        .when(F.abs(dy) >= F.abs(dx), F.when(dy > 0, "above").otherwise("below")).otherwise(F.when(dx > 0, "right").otherwise("left"))
    )


def region_pairs(regions: DataFrame) -> DataFrame:
    """Ordered pairs of regions of one picture, as structs a and b."""
    own = [F.struct(*regions.columns).alias(n) for n in ("a", "b")]
    left, right = regions.select("id", own[0]), regions.select("id", own[1])
    return left.join(right, "id").where("a.region_index <> b.region_index")


def relation_counts(regions: DataFrame, min_support: int = 30) -> DataFrame:
    """(id, sign_a, relation, sign_b, n), without features of fewer than `min_support` pairs over all pictures."""
    counts = region_pairs(regions).groupBy("id", F.col("a.sign").alias("sign_a"), relation().alias("relation"), F.col("b.sign").alias("sign_b")).agg(F.count("*").alias("n"))
    common = counts.groupBy("sign_a", "relation", "sign_b").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support).drop("support")
    return counts.join(common, ["sign_a", "relation", "sign_b"], "left_semi").select("id", "sign_a", "relation", "sign_b", "n")


def region_context(regions: DataFrame) -> DataFrame:
    """(id, region_index, one count for each relation) of each region to the others of its picture."""
    pairs = region_pairs(regions).select("id", F.col("a.region_index").alias("region_index"), relation().alias("r"))
    kinds = ("above", "below", "left", "right", "contains", "inside", "touches")
    counts = pairs.groupBy("id", "region_index").agg(*[F.count_if(F.col("r") == k).alias(k) for k in kinds])
    return regions.select("id", "region_index").join(counts, ["id", "region_index"], "left").na.fill(0, list(kinds))


def touching(margin: float, ratio: float) -> Column:
    """Near enough by the parts' own size, and of comparable area."""
    ax0, ay0, ax1, ay1 = box("a")
    bx0, by0, bx1, by1 = box("b")
    gap_x, gap_y = F.greatest(F.lit(0.0), bx0 - ax1, ax0 - bx1), F.greatest(F.lit(0.0), by0 - ay1, ay0 - by1)
    diagonal = F.least(*[F.sqrt(F.pow(F.col(f"{p}.extent_x"), 2) + F.pow(F.col(f"{p}.extent_y"), 2)) for p in "ab"])
    sizes = F.greatest("a.area", "b.area") / F.greatest(F.least(F.col("a.area"), F.col("b.area")), F.lit(1e-9))
    return (sizes <= ratio) & (F.sqrt(gap_x * gap_x + gap_y * gap_y) <= margin * F.greatest(diagonal, F.lit(1e-6)))


def region_groups(spark: SparkSession, regions: DataFrame, margin: float = 0.15, ratio: float = 3.0) -> DataFrame:
    """(id, region_index, group_index): touching parts, transitively; a group is named by its least region."""
    name = lambda p: F.concat_ws(":", F.lpad(F.col(f"{p}.id").cast("string"), 20, "0"), F.lpad(F.col(f"{p}.region_index").cast("string"), 10, "0"))
    edges = region_pairs(regions).where(touching(margin, ratio)).select(name("a").alias("a"), name("b").alias("b")).where("a < b")
    groups = connected(spark, edges)
    own = regions.select("id", "region_index", F.concat_ws(":", F.lpad(F.col("id").cast("string"), 20, "0"), F.lpad(F.col("region_index").cast("string"), 10, "0")).alias("node"))
    return own.join(groups, "node", "left").select("id", "region_index", F.element_at(F.split(F.coalesce("component", "node"), ":"), 2).cast("bigint").alias("group_index"))


def node_record(nodes: DataFrame, by_place: bool = True) -> DataFrame:
    """Histogram of a picture's named nodes (id, word, cell, area), by word and cell or by word alone."""
    feature = F.concat_ws("@", "word", "cell") if by_place else F.col("word")
    return histogram(nodes.withColumn("feature", feature).withColumn("w", F.col("area") + 1e-3), "feature", "w")


def corpus_skew(rows: DataFrame, least: int = 50) -> DataFrame:
    """(sign, skew): the largest share that one corpus has of a sign's uses, for signs with enough of them."""
    counts = rows.groupBy("sign", "corpus").agg(F.count("*").alias("n"))
    return counts.groupBy("sign").agg(F.sum("n").alias("total"), (F.max("n") / F.sum("n")).alias("skew")).where(F.col("total") >= least)


def composition(rows: DataFrame) -> DataFrame:
    """(id, entropy, spread_x, spread_y, balance) of a picture's mass (id, x, y, mass), normalised to 1."""
    total = rows.groupBy("id").agg(F.sum("mass").alias("m")).where("m > 0")
    p = rows.join(total, "id").withColumn("p", F.col("mass") / F.col("m"))
    centre = p.groupBy("id").agg(F.sum(F.col("p") * F.col("x")).alias("cx"), F.sum(F.col("p") * F.col("y")).alias("cy"))
    q = p.join(centre, "id")
    return q.groupBy("id").agg(
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("entropy"), F.sum(F.col("p") * F.pow(F.col("x") - F.col("cx"), 2)).alias("spread_x"),
        F.sum(F.col("p") * F.pow(F.col("y") - F.col("cy"), 2)).alias("spread_y"), F.sum(F.when(F.col("x") < 0.5, F.col("p")).otherwise(-F.col("p"))).alias("balance"),
    )
