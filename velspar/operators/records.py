"""Records: leakage-safe splits, merged groups, near-duplicates by perceptual hashes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velspar.functions.text import split_of
from velspar.operators.components import connected
from velspar.operators.hamming import pairs_within


def split_records(records: DataFrame, seed: str, group: str | None = None, item: str = "id", shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Adds `split` by a hash of the group; a record without a group is a group of its own."""
    key = F.coalesce(F.col(group).cast("string"), F.col(item).cast("string")) if group else F.col(item)
    return records.withColumn("split", split_of(key, seed, shares))


def leakage(records: DataFrame, key: str) -> DataFrame:
    """(key, splits) of known keys in several splits."""
    found = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return found.where(F.size("splits") > 1)


def combine_groups(spark: SparkSession, records: DataFrame, keys: list[str], item: str = "id") -> DataFrame:
    """(id, group_id): records that share a known value of any key are one group, transitively, named by its least id.

    Every value links its records to its least id, so edges are as many as values, not as pairs.
    """
    edges = None
    for k in keys:
        known = records.where(F.col(k).isNotNull()).select(F.col(item).alias("a"), F.col(k).cast("string").alias("value"))
        star = known.join(known.groupBy("value").agg(F.min("a").alias("b")), "value").select("a", "b")
        edges = star if edges is None else edges.union(star)
    groups = connected(spark, edges.where("a <> b"))
    return records.select(F.col(item).alias("id")).join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b, of all hashes (id, hash) within the threshold, equal hashes included: each pair of ids once.

    Distinct hashes are compared once, copies only named: near_values() has the links without the pairs of copies.
    """
    return pairs_within(hashes, threshold, bits)


def near_values(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b: pairs within the threshold of the least ids of distinct hashes, and each least id with its copies; as connected as near_pairs()."""
    values = hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"))
    equal = hashes.where("hash is not null").join(values.withColumnRenamed("id", "a"), "hash").where("a <> id").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return pairs_within(values, threshold, bits, hashes.count()).union(equal)


def near_groups(spark: SparkSession, hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """(id, group_id) for every row; those without near-duplicates or without a hash stand alone."""
    groups = connected(spark, near_values(hashes, threshold, bits).select("a", "b"))
    return hashes.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def group_size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1").groupBy("size").agg(F.count("*").alias("groups"))


def merge_first(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of several sources, of one id the first source's."""
    every = None
    for k, s in enumerate(sources):
        own = s.withColumn("_source", F.lit(k))
        every = own if every is None else every.unionByName(own)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_source"))
    return every.withColumn("_place", first).where("_place = 1").drop("_source", "_place")


def annotation_audit(labels: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items, assignments, unlabelled items, distinct and single labels, mean, median and largest number of labels."""
    per_item = items.select("id").join(labels.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    per_label = labels.groupBy("label").agg(F.count("*").alias("m"))
    a = per_item.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_assignments"), F.count_if(F.col("n") == 0).alias("n_unlabelled"), F.avg("n").alias("mean_labels"), F.median("n").alias("median_labels"), F.max("n").alias("max_labels"))
    b = per_label.agg(F.count("*").alias("n_labels"), F.count_if(F.col("m") == 1).alias("n_single"))
    return a.crossJoin(b)  # one row each


def cooccurrence(labels: DataFrame, top: int = 20) -> DataFrame:
    """The `top` pairs of labels that items carry together."""
    pairs = labels.alias("x").join(labels.alias("y"), F.expr("x.id = y.id and x.label < y.label")).groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "a", "b").limit(top)


def filled_report(records: DataFrame, columns: list[str]) -> DataFrame:
    """Share of filled and number of distinct values of each column."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return records.agg(F.count("*").alias("n"), *[F.avg(filled(c).isNotNull().cast("double")).alias(f"{c}_filled") for c in columns], *[F.countDistinct(filled(c)).alias(f"{c}_distinct") for c in columns])
