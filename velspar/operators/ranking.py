"""Exact cosine scores, ranks, top-k, neighbour overlap and hubness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def blocks(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, ids, vectors): about `block` rows each, by a hash of the id. The number of blocks grows with the table, their size does not."""
    n = max(1, -(-table.count() // block))
    packed = table.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.struct("id", F.col("vector").cast("array<double>").alias("vector")).alias("row"))
    return packed.groupBy("block").agg(F.collect_list("row").alias("rows")).select("block", F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors"))


def unit_rows(vectors: object) -> np.ndarray:
    matrix = vectors.astype(float, copy=False) if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.stack([np.asarray(v, float) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    if (length == 0).any():
        raise ValueError("a zero vector has no cosine")
    return matrix / length


def pair_scores(queries: DataFrame, candidates: DataFrame, digits: int | None = 6, best: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, candidate_id, score): cosines of a stated query set with all candidates, in blocks, without pairs of equal ids.

    Each pair of blocks is one matrix product. With `best`, a block pair passes on each query's best ones only, by (-score, candidate_id).
    """
    kind = dict(candidates.dtypes)["id"]

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, vectors, other_ids, others in zip(frame["ids"], frame["vectors"], frame["other_ids"], frame["others"], strict=True):
                order = np.argsort(other_ids, kind="stable")
                scores = unit_rows(vectors) @ unit_rows(others)[order].T
                other_ids, ids = np.asarray(other_ids)[order], np.asarray(ids)
                scores = np.round(scores, digits) + 0.0 if digits is not None else scores
                keep = np.arange(scores.shape[1])[None, :].repeat(len(ids), 0)
                if best is not None and best + 1 < scores.shape[1]:
                    keep = np.argsort(-scores, axis=1, kind="stable")[:, : best + 1]
                out = pd.DataFrame({"query_id": ids.repeat(keep.shape[1]), "candidate_id": other_ids[keep.ravel()], "score": np.take_along_axis(scores, keep, 1).ravel()})
                yield out[out["query_id"] != out["candidate_id"]]

    right = blocks(candidates, block).select(F.col("ids").alias("other_ids"), F.col("vectors").alias("others"))
    pairs = blocks(queries, block).select("ids", "vectors").crossJoin(right)  # of blocks
    return pairs.mapInPandas(product, f"query_id {kind}, candidate_id {kind}, score double")


def score_pairs(pairs: DataFrame, vectors: DataFrame, digits: int | None = 6) -> DataFrame:
    """(query_id, candidate_id, score): cosines of the given pairs alone, for fields that were admitted before."""
    from velspar.functions.vectors import dot, normalise

    unit = normalise(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")))
    both = pairs.join(unit.select(F.col("id").alias("query_id"), F.col("vector").alias("u")), "query_id").join(unit.select(F.col("id").alias("candidate_id"), F.col("vector").alias("w")), "candidate_id")
    score = dot("u", "w")
    return both.select("query_id", "candidate_id", (F.round(score, digits) + 0.0 if digits is not None else score).alias("score"))


def ranked(scores: DataFrame, by: tuple[str, ...] = ("query_id",), score: Column | str = "score") -> DataFrame:
    """Adds `rank`, 1 for the best; ties go by candidate_id, never averaged."""
    score = F.col(score) if isinstance(score, str) else score
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), F.col("candidate_id"))))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, digits: int | None = 6) -> DataFrame:
    """Each query's k best candidates, itself excluded; the limit is applied in each block pair and before the shuffle."""
    return ranked(pair_scores(queries, candidates, digits, best=k)).where(F.col("rank") <= k)


def top_k_sql(queries: DataFrame, candidates: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The same in expressions alone, for tables where a join of all pairs is small."""
    from velspar.functions.vectors import dot, normalise

    q, c = (normalise(t.select("id", F.col("vector").cast("array<double>").alias("vector"))) for t in (queries, candidates))
    pairs = q.select(F.col("id").alias("query_id"), F.col("vector").alias("u")).join(c.select(F.col("id").alias("candidate_id"), F.col("vector").alias("v")), F.expr("query_id <> candidate_id"))
    return ranked(pairs.select("query_id", "candidate_id", F.round(dot("u", "v"), digits).alias("score"))).where(F.col("rank") <= k)


def neighbour_overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): the share of k neighbours that two top-k tables have in common."""
    both = left.select("query_id", "candidate_id").join(right.select("query_id", "candidate_id"), ["query_id", "candidate_id"]).groupBy("query_id").count()
    return left.select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("count", F.lit(0)) / F.lit(k)).alias("overlap"))


def occurrences(top: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n): in how many top-k lists an item stands; 0 for those in none."""
    counts = top.groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("n"))
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged: from counts of each distinct value, so that no task holds all rows."""
    values = df.groupBy(column).agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    table = values.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("_m") + 1) / 2).drop("_m")
    return df.join(table, column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): null for under three rows or a constant column."""
    both = average_ranks(average_ranks(df, a, "_ra"), b, "_rb")
    known = (F.count("*") >= 3) & (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return both.agg(F.count("*").alias("n"), F.when(known, F.corr("_ra", "_rb")).alias("rho"))


def best_partner_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, rank): the best rank of any of a query's targets (query_id, candidate_id) among the scored candidates."""
    return ranked(scores).join(targets.select("query_id", "candidate_id").distinct(), ["query_id", "candidate_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))


def label_votes(top: DataFrame, labels: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(query_id, label, vote, rank): neighbours vote for their labels with their score, if positive; visible labels are left out."""
    votes = top.join(labels.withColumnRenamed("id", "candidate_id"), "candidate_id").groupBy("query_id", "label").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("vote"))
    if visible is not None:
        votes = votes.join(visible.withColumnRenamed("id", "query_id"), ["query_id", "label"], "left_anti")
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("vote", 6)), "label")))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, entered, left, stayed): what two top-k tables do not share."""
    a, b = (t.select("query_id", "candidate_id", F.lit(True).alias(n)) for t, n in ((before, "old"), (after, "new")))
    both = a.join(b, ["query_id", "candidate_id"], "full")
    return both.groupBy("query_id").agg(F.count_if(F.col("old").isNull()).alias("entered"), F.count_if(F.col("new").isNull()).alias("left"), F.count_if(F.col("old") & F.col("new")).alias("stayed"))


def neighbourhood_composition(top: DataFrame, attributes: DataFrame) -> DataFrame:
    """(query_id, share): the share of neighbours with the query's attribute; null equals nothing."""
    own = attributes.select(F.col("id").alias("query_id"), F.col("value").alias("own"))
    other = attributes.select(F.col("id").alias("candidate_id"), F.col("value").alias("other"))
    return top.join(own, "query_id").join(other, "candidate_id").groupBy("query_id").agg(F.avg(F.coalesce((F.col("own") == F.col("other")).cast("double"), F.lit(0.0))).alias("share"))
