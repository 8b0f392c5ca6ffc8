"""A label taxonomy with several parents per node: closure, depth, distances, resolution, graded relevance and its ideal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.functions.text import strip_all_keys, strip_structural_keys
from velspar.session import materialise


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def closure(spark: SparkSession, edges: DataFrame, limit: int = 64) -> DataFrame:
    """(node, ancestor, distance): least number of edges up, 0 to itself. Grows level by level without duplicates, so diamonds do not multiply; `limit` guards against cycles."""
    level = nodes(edges).select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    known = materialise(spark, level, "closure")
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")).distinct()
    frontier = known
    for _ in range(limit):
        new = frontier.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        frontier = materialise(spark, new.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "closure")
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise ValueError(f"the taxonomy has a path of over {limit} edges, or a cycle")


def depth(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): least number of edges to a root."""
    roots = nodes(edges).join(edges.select(F.col("child").alias("node")), "node", "left_anti").withColumnRenamed("node", "ancestor")
    return paths.join(roots, "ancestor").groupBy("node").agg(F.min("distance").alias("depth"))


def distances(paths: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, distance) of nodes in `left` (a) and `right` (b) with a common ancestor: the least sum of the ways up."""
    a = paths.join(left.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), "ancestor", F.col("distance").alias("d1"))
    b = paths.join(right.select(F.col("b").alias("node")).distinct(), "node").select(F.col("node").alias("b"), "ancestor", F.col("distance").alias("d2"))
    return a.join(b, "ancestor").groupBy("a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))


def resolve(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `resolved` to (label): itself, else without structural keys, else without any key, else null."""
    table = known.select(F.col("node").alias("_n")).distinct()
    out = labels
    for k, form in enumerate((F.col("label"), strip_structural_keys(F.col("label")), strip_all_keys(F.col("label")))):
        out = out.join(table.withColumnRenamed("_n", f"_n{k}"), form == F.col(f"_n{k}"), "left")
    return out.withColumn("resolved", F.coalesce("_n0", "_n1", "_n2")).drop("_n0", "_n1", "_n2")


def with_keyed_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges, and each label with a text key, where it is no node yet, as a child of its base, where that is one."""
    known = nodes(edges)
    keyed = labels.select("label").distinct().where(F.col("label").rlike(r"\([^()+][^()]*\)")).join(known, F.col("label") == F.col("node"), "left_anti")
    based = keyed.withColumn("parent", strip_all_keys(F.col("label"))).join(known.withColumnRenamed("node", "parent"), "parent")
    return edges.select("parent", "child").union(based.select("parent", F.col("label").alias("child"))).distinct()


def graded(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, candidate_id, gain): the largest 1 / (1 + distance) over pairs of labels (id, label); pairs without a common ancestor have none.

    Items meet in the ancestors of their labels, each with its least distance up, so pairs arise per ancestor and not per pair of labels.
    """
    ups = labels.withColumnRenamed("label", "node").join(paths, "node").groupBy("id", "ancestor").agg(F.min("distance").alias("d"))
    q, c = ups.select(F.col("id").alias("query_id"), "ancestor", F.col("d").alias("d1")), ups.select(F.col("id").alias("candidate_id"), "ancestor", F.col("d").alias("d2"))
    near = q.join(c, "ancestor").where("query_id <> candidate_id").groupBy("query_id", "candidate_id").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))
    return near.select("query_id", "candidate_id", (1 / (1 + F.col("distance"))).alias("gain"))


def undirected_distances(spark: SparkSession, edges: DataFrame, limit: int) -> DataFrame:
    """(a, b, distance) by at most `limit` edges taken either way: what the ideal ranking of a taxonomy with several parents goes by."""
    steps = edges.select(F.col("parent").alias("b"), F.col("child").alias("next")).union(edges.select("child", "parent")).distinct()
    known = materialise(spark, nodes(edges).select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("distance")), "distances")
    frontier = known
    for k in range(limit):
        new = frontier.join(steps, "b").select("a", F.col("next").alias("b"), F.lit(k + 1).alias("distance")).distinct()
        frontier = materialise(spark, new.join(known.select("a", "b"), ["a", "b"], "left_anti"), "distances")
        known = known.union(frontier)
    return known


def exact(labels: DataFrame, hub: int | None = None) -> DataFrame:
    """(query_id, candidate_id): pairs of items (id, label) with a label in common; labels of more than `hub` items may be left out."""
    own = labels.select("id", "label").distinct()
    if hub is not None:
        own = own.join(own.groupBy("label").count().where(F.col("count") <= hub).select("label"), "label")
    other = own.select(F.col("id").alias("candidate_id"), "label")
    return own.withColumnRenamed("id", "query_id").join(other, "label").where("query_id <> candidate_id").select("query_id", "candidate_id").distinct()
