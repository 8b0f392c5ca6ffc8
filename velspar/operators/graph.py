"""Triples: projections of records, masking, audits, degrees, co-occurrence, walks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velspar.session import materialise

def normalise(triples: DataFrame) -> DataFrame:
    """Trimmed and distinct; an empty part is an error."""
    parts = [F.trim(c).alias(c) for c in ("head", "relation", "tail")]
    bad = F.raise_error(F.lit("a triple has an empty part")).cast("string")
    return triples.select(*parts).select(*[F.when(F.length(c) > 0, F.col(c)).otherwise(bad).alias(c) for c in ("head", "relation", "tail")]).distinct()


def context_triples(records: DataFrame, window: int = 1) -> DataFrame:
    """(id, book, position): part_of each known book, adjacent_to the next `window` items by position (unknown last), then id."""
    if window < 0:
        raise ValueError("the window must not be negative")
    known = records.where("book is not null").select(F.col("id").cast("string").alias("id"), F.col("book").cast("string").alias("book"), "position")
    out = known.select(F.col("id").alias("head"), F.lit("part_of").alias("relation"), F.col("book").alias("tail"))
    if window:
        order = Window.partitionBy("book").orderBy(F.col("position").asc_nulls_last(), "id")
        leads = known.select("id", *[F.lead("id", k).over(order).alias(f"n{k}") for k in range(1, window + 1)])
        nexts = leads.select("id", F.explode(F.array(*[f"n{k}" for k in range(1, window + 1)])).alias("tail"))
        out = out.union(nexts.where("tail is not null").select("id", F.lit("adjacent_to"), "tail"))
    return out.distinct()


def attribute_triples(records: DataFrame, relations: dict[str, str]) -> DataFrame:
    """One triple for each known, non-empty attribute: {column: relation}."""
    pairs = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(c).cast("string").alias("tail")) for c, r in relations.items()])
    return records.select(F.col("id").cast("string").alias("head"), F.explode(pairs).alias("p")).select("head", "p.relation", "p.tail").where("tail is not null and tail <> ''").distinct()


def mask(triples: DataFrame, targets: DataFrame, relations: list[str], match_tail: bool = False) -> DataFrame:
    """Adds `removed`: a blocked relation at a target entity, as head or, if asked, as tail."""
    t = targets.select(F.col("id").cast("string").alias("_t"), F.lit(True).alias("_hit")).distinct()
    out = triples.join(t.withColumnRenamed("_t", "head").withColumnRenamed("_hit", "_h"), "head", "left")
    out = out.join(t.withColumnRenamed("_t", "tail").withColumnRenamed("_hit", "_u"), "tail", "left")
    hit = F.col("_h").isNotNull() | (F.col("_u").isNotNull() if match_tail else F.lit(False))
    return out.select("head", "relation", "tail", (F.col("relation").isin(relations) & hit).alias("removed"))


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("head").alias("entity")).union(triples.select("tail"))


def audit(triples: DataFrame) -> DataFrame:
    """One row: triples, entities, relations."""
    a = triples.agg(F.count("*").alias("n_triples"), F.countDistinct("relation").alias("n_relations"))
    return a.crossJoin(entities(triples).agg(F.countDistinct("entity").alias("n_entities")))  # one row each


def digest(table: DataFrame, columns: list[str]) -> str:
    """SHA-256 of the rows in canonical order, tab-separated, a row a line: read in order, hashed as a stream."""
    h = hashlib.sha256()
    for r in table.select(F.concat_ws("\t", *columns).alias("row")).orderBy("row").toLocalIterator():
        h.update(f"{r['row']}\n".encode())
    return h.hexdigest()


def degrees(triples: DataFrame) -> DataFrame:
    """(entity, degree): incident edges, a loop counted twice."""
    return entities(triples).groupBy("entity").agg(F.count("*").alias("degree"))


def shared_tails(triples: DataFrame) -> DataFrame:
    """(tail, heads): tails of one relation that several heads share."""
    return triples.groupBy("relation", "tail").agg(F.countDistinct("head").alias("heads")).where("heads > 1")


def ppmi(sequences: DataFrame, window: int) -> DataFrame:
    """(a, b, n, ppmi) of tokens (seq, position, token) within `window` positions, both orders; only positive values."""
    far = sequences.select("seq", F.col("position").alias("p"), F.col("token").alias("a"), F.explode(F.expr(f"filter(sequence(-{window}, {window}), d -> d <> 0)")).alias("d")).withColumn("position", F.col("p") + F.col("d"))
    counts = far.join(sequences.withColumnRenamed("token", "b"), ["seq", "position"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = counts.groupBy("a").agg(F.sum("n").alias("na"))
    columns = counts.groupBy("b").agg(F.sum("n").alias("nb"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(rows, "a").join(columns, "b").crossJoin(total)  # a single row
    return out.withColumn("ppmi", F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).where("ppmi > 0").select("a", "b", "n", "ppmi")


#: Proposals of a biased step; the chance that none is accepted is under (1 - least / greatest weight) ** PROPOSALS, then the last one is taken.
PROPOSALS = 6


def walks(spark: SparkSession, triples: DataFrame, per_node: int = 10, length: int = 20, seed: int = 42, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(seq, position, token): second-order walks over the undirected graph, a step at a time, each choice by a hash of walk and step.

    Neighbours are numbered, so a step joins each walk with the neighbours it draws and not with all of a hub's. Returning weighs 1 / p, a neighbour of the
    last node 1, others 1 / q: proposals are drawn evenly and accepted by weight. Every step is a written table.
    """
    edges = triples.select(F.col("head").alias("a"), F.col("tail").alias("b")).union(triples.select("tail", "head")).where("a <> b").distinct()
    edges = materialise(spark, edges.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("b")).cast("long")), "walk-edges")
    degree = edges.groupBy(F.col("a").alias("now")).agg(F.count("*").alias("degree"))
    biased, most = p != 1 or q != 1, max(1 / p, 1.0, 1 / q)
    at = edges.select(F.col("a").alias("now")).distinct().select("now", F.lit(None).cast("string").alias("last"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k"))
    at = materialise(spark, at.select("now", "last", F.concat_ws("#", "now", "k").alias("seq")), "walk-step")
    out = at.select("seq", F.lit(0).alias("position"), F.col("now").alias("token"))
    draw = lambda step, salt: F.xxhash64("seq", F.lit(step), "turn", F.lit(seed), F.lit(salt))
    for step in range(1, length):
        asked = at.join(degree, "now").withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(PROPOSALS if biased else 1))))
        asked = asked.withColumn("place", F.pmod(draw(step, 0), F.col("degree")) + 1).join(edges.select(F.col("a").alias("now"), F.col("b").alias("next"), "place"), ["now", "place"])
        if biased:
            known = edges.select(F.col("a").alias("last"), F.col("b").alias("next"), F.lit(True).alias("near"))
            weight = F.when(F.col("last").isNull(), most).when(F.col("next") == F.col("last"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
            refused = F.pmod(draw(step, 1), F.lit(1 << 30)) / F.lit(1 << 30) * most >= weight
            asked = asked.join(known, ["last", "next"], "left").withColumn("order", F.when(refused, 2 * PROPOSALS - F.col("turn")).otherwise(F.col("turn") - PROPOSALS - 1))
            asked = asked.groupBy("seq", "now").agg(F.min_by("next", "order").alias("next"))
        at = materialise(spark, asked.select(F.col("next").alias("now"), F.col("now").alias("last"), "seq"), "walk-step")
        out = out.union(at.select("seq", F.lit(step).alias("position"), F.col("now").alias("token")))
    return out


#: Nodes in a row of a partial product.
STRIP = 4096


def spectral(spark: SparkSession, pairs: DataFrame, dimension: int, weight: str = "ppmi", rounds: int = 30, seed: int = 0) -> DataFrame:
    """(id, vector): leading eigenvectors of a symmetric sparse matrix (a, b, weight) by block power iteration.

    Edges are numbered and written once as packed arrays; every round multiplies them in tasks. The driver holds 8 x `dimension` bytes a node, a few times over, to
    make the columns orthogonal, and neither edges nor names.
    """
    import numpy as np
    import pyarrow as pa

    names = materialise(spark, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "nodes")
    n = names.count()
    if not n:
        return spark.createDataFrame([], "id string, vector array<double>")
    placed = names.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(-(-n // (1 << 16))))).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    placed = materialise(spark, placed, "nodes")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # one row for 65536 nodes
    starts = spark.createDataFrame([(part, sum(c for _, c in sizes[:k])) for k, (part, _) in enumerate(sizes)], "part bigint, start bigint")
    number = placed.join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("place")).cast("int").alias("at"))
    edges = pairs.select("a", "b", F.col(weight).cast("double").alias("w")).join(number.select(F.col("id").alias("a"), F.col("at").alias("i")), "a").join(number.select(F.col("id").alias("b"), F.col("at").alias("j")), "b").select("i", "j", "w")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], ["i", "j", "w"])

    edges = materialise(spark, edges.mapInArrow(pack, "i binary, j binary, w binary"), "edges")

    def product(x):
        def multiply(frames):
            y = np.zeros_like(x)
            for frame in frames:
                for r in frame.itertuples(index=False):
                    i, own = np.frombuffer(r.i, np.int32), np.frombuffer(r.w)[:, None] * x[np.frombuffer(r.j, np.int32)]
                    for k in range(x.shape[1]):
                        np.add.at(y[:, k], i, own[:, k])
            yield pd.DataFrame([(k, y[k : k + STRIP].tobytes()) for k in range(0, n, STRIP)], columns=["strip", "y"])

        def total(frame):
            return pd.DataFrame({"strip": frame["strip"].iloc[:1], "y": [sum(np.frombuffer(b) for b in frame["y"]).tobytes()]})

        rows = edges.mapInPandas(multiply, "strip bigint, y binary").groupBy("strip").applyInPandas(total, "strip bigint, y binary").collect()
        return np.concatenate([np.frombuffer(r["y"]) for r in sorted(rows, key=lambda r: r["strip"])]).reshape(x.shape)

    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(dimension, max(1, n - 1)))))[0]
    for _ in range(rounds):
        x = np.linalg.qr(product(np.ascontiguousarray(x)))[0]

    def named(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "vector": list(x[frame["at"].to_numpy()])})

    return number.mapInPandas(named, "id string, vector array<double>")


