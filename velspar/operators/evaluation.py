"""Splits, alignment of identifiers, coverage, and one evaluation of a scores table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import metrics, ranking


def check_alignment(table: DataFrame, manifest: DataFrame) -> None:
    """Every id of the table is in the manifest, and the manifest's ids are distinct; an error names up to five."""
    twice = manifest.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
    if twice:
        raise ValueError("ids occur more than once: " + ", ".join(str(r["id"]) for r in twice))
    missing = table.select("id").join(manifest.select("id"), "id", "left_anti").orderBy("id").limit(5).collect()
    if missing:
        raise ValueError("ids without a record: " + ", ".join(str(r["id"]) for r in missing))


def select_ids(table: DataFrame, manifest: DataFrame, split: str | None) -> DataFrame:
    """The rows of the table in a split, all for None."""
    chosen = manifest if split is None else manifest.where(F.col("split") == split)
    return table.join(chosen.select("id"), "id", "left_semi")


def covered(tables: list[DataFrame]) -> DataFrame:
    """(id) of what every table holds."""
    return reduce(lambda a, b: a.join(b.select("id").distinct(), "id", "left_semi"), tables[1:], tables[0].select("id").distinct())


def evaluate(queries: DataFrame, candidates: DataFrame, relevant: DataFrame, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per query, kept): exact cosine ranks of the candidates for each query, metrics by `relevant` (query_id, candidate_id), and the `keep` best of each.

    A query without a relevant candidate has null metrics and counts in the coverage only.
    """
    ranks = ranking.ranked(ranking.pair_scores(queries, candidates))
    marked = ranks.join(relevant.select("query_id", "candidate_id", F.lit(True).alias("relevant")), ["query_id", "candidate_id"], "left").na.fill(False, ["relevant"])
    return metrics.per_query(marked), ranks.where(F.col("rank") <= keep)


def coverage(per_query: DataFrame) -> DataFrame:
    """n_queries, n_evaluated, coverage and the means of the metrics over evaluated queries."""
    n = F.count("average_precision")
    return per_query.agg(F.count("*").alias("n_queries"), n.alias("n_evaluated"), (n / F.count("*")).alias("coverage"), F.avg("average_precision").alias("mean_average_precision"), F.avg("reciprocal_rank").alias("mean_reciprocal_rank"), F.avg("recall_at_10").alias("mean_recall_at_10"))


def by_frequency(per_query: DataFrame, labels: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """(bin, n, mean): mean average precision by the median frequency of the queries' labels; bin k holds medians up to bounds[k], the last one the rest."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    middle = labels.join(n, "label").groupBy(F.col("id").alias("query_id")).agg(F.median("n").alias("m"))
    place = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col("m")))
    rows = per_query.join(middle, "query_id").withColumn("bin", place)
    return rows.groupBy("bin").agg(F.count("average_precision").alias("n"), F.avg("average_precision").alias("mean"))
