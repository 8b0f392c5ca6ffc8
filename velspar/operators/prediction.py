"""Label prediction from neighbours and priors, ranks within admitted fields, chance floors, associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency_prior(labels: DataFrame) -> DataFrame:
    """(label, n, rank): labels by the number of items that hold them, ties by name. Only the counts of labels are ranked."""
    n = labels.groupBy("label").agg(F.count_distinct("id").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def vote(neighbours: DataFrame, labels: DataFrame, visible: DataFrame) -> DataFrame:
    """(query_id, label, weight, rank): neighbours (query_id, candidate_id, score) vote for their labels with their scores, negative ones with 0;
    labels that a query shows (visible: query_id, label) are no predictions. Ties go by label."""
    tally = neighbours.join(labels.select(F.col("id").alias("candidate_id"), "label"), "candidate_id").groupBy("query_id", "label").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("weight"))
    hidden = tally.join(visible.select("query_id", "label"), ["query_id", "label"], "left_anti").withColumn("weight", F.round("weight", 9))
    return hidden.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "label")))


def prediction_metrics(predicted: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """n_queries, hits at each k, and mean reciprocal rank, over the queries of truth (query_id, label); queries without a right prediction count 0."""
    first = truth.join(predicted.select("query_id", "label", "rank"), ["query_id", "label"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    hits = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"hits_at_{k}") for k in ks]
    return first.agg(F.count("*").alias("n_queries"), *hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def admitted_ranks(scores: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, field, rank): the size of each query's admitted field and the best rank in it of a relevant candidate; queries without one are left out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    placed = scores.withColumn("rank", F.row_number().over(order)).withColumn("field", F.count("*").over(Window.partitionBy("query_id")))
    return placed.join(relevant, ["query_id", "candidate_id"], "left_semi").groupBy("query_id").agg(F.max("field").alias("field"), F.min("rank").alias("rank"))


def other_kind_floor(items: DataFrame, partnered: DataFrame, kind: str) -> DataFrame:
    """(n, floor): the mean chance that a random neighbour of a partnered item is of another kind, (N - n of its kind) / (N - 1)."""
    sizes, total = items.groupBy(kind).agg(F.count("*").alias("own")), items.agg(F.count("*").alias("total"))
    rows = partnered.select("id").distinct().join(items.select("id", kind), "id").join(sizes, kind).crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("total") - F.col("own")) / (F.col("total") - 1)).alias("floor"))


def largest(regions: DataFrame, n: int) -> DataFrame:
    """Each picture's n largest regions; ties by region_index."""
    order = Window.partitionBy("id").orderBy(F.desc("area"), "region_index")
    return regions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def associations(signs: DataFrame, labels: DataFrame, least_lift: float = 1.5, least: int = 5, top: int = 5) -> DataFrame:
    """(sign, label, n, share, base, lift): labels that pictures with a sign (id, sign) hold more often than all labelled pictures, the best `top` of a sign."""
    signs = signs.select("id", "sign").distinct().join(labels.select("id").distinct(), "id", "left_semi")
    with_sign = signs.groupBy("sign").agg(F.count("*").alias("items"))
    size = labels.agg(F.count_distinct("id").alias("size"))
    base = labels.groupBy("label").agg(F.count("*").alias("held")).crossJoin(F.broadcast(size)).select("label", (F.col("held") / F.col("size")).alias("base"))  # one row
    both = signs.join(labels, "id").groupBy("sign", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = both.join(F.broadcast(with_sign), "sign").join(base, "label").withColumn("share", F.col("n") / F.col("items"))
    rows = rows.withColumn("lift", F.round(F.col("share") / F.col("base"), 9)).where(F.col("lift") >= least_lift)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sign").orderBy(F.desc("lift"), "label"))).where(F.col("place") <= top).select("sign", "label", "n", "share", "base", "lift")


def ancestor_jaccard(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, jaccard): likeness of the ancestor sets of all pairs of the given nodes with an ancestor in common; paths are (node, ancestor)."""
    own = paths.select("node", "ancestor").distinct().join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    size = own.groupBy("node").agg(F.count("*").alias("n"))
    both = own.select(F.col("node").alias("a"), "ancestor").join(own.select(F.col("node").alias("b"), "ancestor"), "ancestor").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    sized = both.join(size.select(F.col("node").alias("a"), F.col("n").alias("x")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("y")), "b")
    return sized.select("a", "b", (F.col("k") / (F.col("x") + F.col("y") - F.col("k"))).alias("jaccard"))


def class_composition(pairs: DataFrame, items: DataFrame, labels: DataFrame, attribute: str = "book") -> DataFrame:
    """(class, n, cross, shared): of each class of pairs the share that crosses the attribute and the share with a label in common."""
    a, b = items.select(F.col("id").alias("query_id"), F.col(attribute).alias("x")), items.select(F.col("id").alias("candidate_id"), F.col(attribute).alias("y"))
    common = pairs.select("query_id", "candidate_id").join(labels.select(F.col("id").alias("query_id"), "label"), "query_id").join(labels.select(F.col("id").alias("candidate_id"), "label"), ["candidate_id", "label"])
    rows = pairs.join(a, "query_id").join(b, "candidate_id").join(common.select("query_id", "candidate_id", F.lit(1).alias("hit")).distinct(), ["query_id", "candidate_id"], "left")
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.avg((F.col("x") != F.col("y")).cast("double")).alias("cross"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("shared"))
