"""Search regimes: what a result must share with the query and in what it must differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velspar.operators import rows
from velspar.session import materialise

ATTRIBUTES = ("book", "stratum", "status", "y")


def attribute(name: str) -> str:
    return {"book": "book", "place": "stratum", "medium": "status", "year": "y"}[name.split("_")[1]]


def predicate(name: str) -> Column:
    """Clauses over a pair row with columns a_<attribute> and b_<attribute>; an unknown value neither matches nor differs."""
    column = attribute(name)
    a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
    return a == b if name.startswith("same_") else a != b


def pairs_of(scores: DataFrame, items: DataFrame) -> DataFrame:
    for side, key in (("a", "query_id"), ("b", "candidate_id")):
        scores = scores.join(items.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in ATTRIBUTES]), key)
    return scores


def search(scores: DataFrame, items: DataFrame, labels: DataFrame, match: list[str], differ: list[str], k: int) -> DataFrame:
    """(query_id, candidate_id, score, rank): the k best of the pairs that satisfy every clause; `subject` is a label in common."""
    if "subject" in match:
        from velspar.operators.taxonomy import exact

        scores = scores.join(exact(labels), ["query_id", "candidate_id"], "left_semi")
    found = pairs_of(scores, items)
    for clause in [*match, *differ]:
        if clause != "subject":
            found = found.where(predicate(clause))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "candidate_id", "score", "rank")


def search_all(pool: DataFrame, items: DataFrame, match: list[str], differ: list[str], k: int) -> DataFrame:
    """search() of every item of the pool (id, vector, keys) against all: clauses are tested beside the scores, so only the k best pairs leave a task."""
    clauses = [c for c in [*match, *differ] if c != "subject"]
    same, other = (tuple(attribute(c) for c in clauses if c.startswith(x)) for x in ("same_", "other_"))
    known = materialise(pool.sparkSession, pool.join(items.select("id", *dict.fromkeys([*same, *other])), "id"), "pool")
    return rows.search(known, known, k, "subject" in match, same, other)


def rare_labels(labels: DataFrame, size: int, share: float) -> DataFrame:
    """Labels of at most max(floor(share * size), 1) items."""
    most = max(int(share * size), 1)
    return labels.groupBy("label").agg(F.countDistinct("id").alias("n")).where(F.col("n") <= most).select("label")
