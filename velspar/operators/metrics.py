"""Retrieval metrics over ranked lists: reciprocal rank, recall, average precision, DCG and nDCG, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Metrics of each query from (query_id, candidate_id, rank, relevant): null where the pool has nothing relevant."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranks.withColumn("hit", F.col("relevant").cast("int")).withColumn("hits", F.sum("hit").over(order))
    total = F.sum("hit")
    some = lambda c: F.when(total > 0, c)
    return hits.groupBy("query_id").agg(
        F.count("*").alias("n_candidates"), total.alias("n_relevant"), some(1 / F.min(F.when(F.col("hit") == 1, F.col("rank")))).alias("reciprocal_rank"),
        some(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / total).alias("average_precision"),
        *[some(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / total).alias(f"recall_at_{k}") for k in ks],
    )


def dcg(ranks: DataFrame, gain: str = "gain", k: int = 10, name: str = "dcg") -> DataFrame:
    return ranks.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col(gain) / F.log2(F.col("rank") + 1)).alias(name))


def ideal_dcg(gains: DataFrame, k: int = 10) -> DataFrame:
    """The DCG of each query's k largest gains of the pool."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))
    return dcg(gains.withColumn("rank", place), "gain", k, "ideal")


def ndcg(ranks: DataFrame, ideal: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): null where the ideal is 0."""
    return dcg(ranks, "gain", k).join(ideal, "query_id", "full").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Means over the queries that have the metric."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def stratified(metrics: DataFrame, strata: DataFrame, metric: str) -> DataFrame:
    """(stratum, n, mean) of a metric by (query_id, stratum)."""
    return metrics.join(strata, "query_id").groupBy("stratum").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))


def paired_auc(pairs: DataFrame, positive: str, control: str) -> DataFrame:
    """P(positive > control) + P(tie) / 2 over matched pairs."""
    return pairs.agg(F.avg(F.when(F.col(positive) > F.col(control), 1.0).when(F.col(positive) == F.col(control), 0.5).otherwise(0.0)).alias("auc"))


def unpaired_auc(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """The same over all pairs of a positive and a negative row, from counts by distinct score."""
    counts = scores.groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("wins", F.col("p") * (below + F.col("n") / 2)).agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))
