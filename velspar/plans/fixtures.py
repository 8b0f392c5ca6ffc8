"""The relational tables as pictures, labels, volumes, triples, regions and judgements; SQL with the same meaning for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velspar.session import table

#: Ids that are sent to every executor; those of a larger pool are shuffled.
POOL_IDS = 1 << 19

#: DuckDB common table expressions by name; with_() puts those that a query needs before it.
CTE = {
    "u": "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings",
    "uv": "SELECT vec_id AS id, label, list_transform(embedding[1:32], lambda x: x::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]))) AS v, list_transform(embedding[33:64], lambda x: x::DOUBLE / sqrt(list_dot_product(embedding[33:64]::DOUBLE[], embedding[33:64]::DOUBLE[]))) AS g FROM embeddings",
    "s": "SELECT a.id AS q, b.id AS c, round(list_dot_product(a.v, b.v), 6) + 0 AS score, a.label = b.label AS rel FROM u a JOIN u b ON a.id <> b.id",
    "r": "SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s",
    "vg": "SELECT a.id AS q, b.id AS c, round(list_dot_product(a.v, b.v), 6) + 0 AS v, round(list_dot_product(a.g, b.g), 6) + 0 AS g, a.label = b.label AS rel FROM uv a JOIN uv b ON a.id <> b.id",
    "vr": "SELECT q, c, v, rel, row_number() OVER (PARTITION BY q ORDER BY v DESC, c) AS rank FROM vg",
    "gr": "SELECT q, c, g, rel, row_number() OVER (PARTITION BY q ORDER BY g DESC, c) AS rank FROM vg",
    "item": "SELECT o_orderkey AS id, o_custkey AS book, o_orderpriority AS stratum, o_orderstatus AS status, year(o_orderdate) AS y FROM orders",
    "lab": "SELECT DISTINCT l_orderkey AS id, 'S' || l_suppkey AS label FROM lineitem",
    "tree": "SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier",
    "dag": "SELECT * FROM tree UNION SELECT 'X' || (s_suppkey % 3), 'S' || s_suppkey FROM supplier",
    "few": "SELECT id, label FROM lab SEMI JOIN embeddings ON vec_id = id",
    "plab": "SELECT DISTINCT l_orderkey AS id, 'P' || l_partkey AS label FROM lineitem",
    "region_rows": "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) AS region_index, l_partkey % 16 AS sign, l_quantity / 50 AS area, l_discount * 10 AS centroid_x, l_tax * 12.5 AS centroid_y, l_quantity / 100 AS extent_x, l_quantity / 125 AS extent_y, l_returnflag AS corpus FROM lineitem",
    "box": "SELECT *, centroid_x - extent_x / 2 AS x0, centroid_y - extent_y / 2 AS y0, centroid_x + extent_x / 2 AS x1, centroid_y + extent_y / 2 AS y1 FROM region_rows",
    "rel": """SELECT a.id, a.region_index, b.region_index AS other, a.sign AS sign_a, b.sign AS sign_b,
      CASE WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 THEN 'contains'
           WHEN b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 THEN 'inside'
           WHEN NOT (a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0) THEN 'touches'
           WHEN abs(b.centroid_y - a.centroid_y) >= abs(b.centroid_x - a.centroid_x) THEN CASE WHEN b.centroid_y - a.centroid_y > 0 THEN 'above' ELSE 'below' END
           ELSE CASE WHEN b.centroid_x - a.centroid_x > 0 THEN 'right' ELSE 'left' END END AS relation
      FROM box a JOIN box b ON a.id = b.id AND a.region_index <> b.region_index""",
    "named": "SELECT user_id AS id, event_type || '-' || (CAST(json_extract(props, '$.k') AS BIGINT) % 8) AS word, CAST(json_extract(props, '$.k') AS BIGINT) % 9 AS cell, value / 100 AS area, event_id % 2 AS namer FROM events",
    "triple": "SELECT CAST(o_orderkey AS VARCHAR) AS head, 'part_of' AS relation, 'C' || o_custkey AS tail FROM orders UNION SELECT 'C' || c_custkey, 'published_at', 'N' || c_nationkey FROM customer UNION SELECT CAST(id AS VARCHAR), 'has_label', label FROM lab",
    "rating": "SELECT doc_id AS unit, 'quality' AS rater, CAST(quality AS DOUBLE) AS rating FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels",
    "apv": "SELECT q, sum(CASE WHEN rel THEN hits / rank ELSE 0 END) / sum(rel::INT) AS ap FROM (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM vr) GROUP BY q",
    "apg": "SELECT q, sum(CASE WHEN rel THEN hits / rank ELSE 0 END) / sum(rel::INT) AS ap FROM (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM gr) GROUP BY q",
}


def with_(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({CTE[n]})" for n in names.split()) + f" {body}"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def half(spark: SparkSession, d: str, name: str) -> DataFrame:
    e = vectors(spark, d)
    return e.withColumn("vector", F.slice("vector", 1 if name == "v" else 33, 32))


def items(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("label")).distinct()


def of_pool(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The rows whose id has a vector: what can be ranked. Up to POOL_IDS ids go to where the rows are, so rows of other ids are not shuffled."""
    ids = vectors(spark, d).select("id")
    return rows.join(F.broadcast(ids) if ids.count() <= POOL_IDS else ids, "id", "left_semi")


def pool_items(spark: SparkSession, d: str) -> DataFrame:
    return of_pool(spark, d, items(spark, d))


def pool_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of all pictures that have a vector."""
    held = of_pool(spark, d, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id"))  # before the repeats are dropped
    return held.select("id", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("label")).distinct()


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all pictures of which each is held by few, whatever the number of pictures."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("label")).distinct()


def taxonomy(spark: SparkSession, d: str, several: bool = False) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    out = n.select(name("R", F.col("n_regionkey")).alias("parent"), name("N", F.col("n_nationkey")).alias("child")).union(s.select(name("N", F.col("s_nationkey")), name("S", F.col("s_suppkey"))))
    return (out.union(s.select(name("X", F.col("s_suppkey") % 3), name("S", F.col("s_suppkey")))) if several else out).distinct()


def regions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    c = F.col
    # Line numbers repeat within an order, so a region is named by its place.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    return li.select(c("l_orderkey").alias("id"), F.row_number().over(order).alias("region_index"), (c("l_partkey") % 16).alias("sign"), (c("l_quantity") / 50).alias("area"), (c("l_discount") * 10).alias("centroid_x"), (c("l_tax") * 12.5).alias("centroid_y"), (c("l_quantity") / 100).alias("extent_x"), (c("l_quantity") / 125).alias("extent_y"), c("l_returnflag").alias("corpus"))


def named(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").alias("id"), F.concat_ws("-", "event_type", (k % 8).cast("string")).alias("word"), (k % 9).alias("cell"), (F.col("value") / 100).alias("area"), (F.col("event_id") % 2).alias("namer"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    out = o.select(F.col("o_orderkey").cast("string").alias("head"), F.lit("part_of").alias("relation"), name("C", "o_custkey").alias("tail"))
    out = out.union(c.select(name("C", "c_custkey"), F.lit("published_at"), name("N", "c_nationkey")))
    return out.union(labels(spark, d).select(F.col("id").cast("string"), F.lit("has_label"), "label")).distinct()


def ratings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels")
    rows = F.array(*[F.struct(F.lit(n).alias("rater"), F.col(n).cast("double").alias("rating")) for n in ("quality", "toxic")])
    return t.select(F.col("doc_id").alias("unit"), F.explode(rows).alias("r")).select("unit", "r.rater", "r.rating")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})
