"""Further queries: pooling, bands, shares, descriptors, reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from velspar.functions.vectors import dot, weighted_concat
from velspar.operators import graph, metrics, pooling, ranking, regimes
from velspar.plans import fixtures as X
from velspar.plans.fixtures import items, labels, named, part_labels, ratings, regions, rounded, triples, with_
from velspar.session import materialise, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(with_("lab", """, c AS (SELECT 'S' || vec_id AS label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT lab.id, k, avg(v[k]) AS m, count(*) AS n FROM lab JOIN c USING (label), range(1, 65) r(k) GROUP BY lab.id, k)
  SELECT id, CAST(max(n) AS BIGINT) AS covered, round(max(CASE WHEN k = 1 THEN m END) / sqrt(sum(m * m)), 6) + 0 AS first FROM p GROUP BY id"""))
def concept_mean_pool(spark, d):
    concepts = X.vectors(spark, d).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("label"), "vector")
    return rounded(pooling.mean_pool(labels(spark, d), concepts).select("id", "covered", F.col("vector")[0].alias("first")), "first")


@query("""WITH o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place, greatest(count(*) OVER () // 3, 1) AS s FROM orders) SELECT id, place, CAST(least((place - 1) // s, 2) AS INT) AS band FROM o""")
def union_ratio_terciles(spark, d):
    return pooling.terciles(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "o_totalprice").select("id", "place", "band")


@query("""WITH g AS (SELECT s_suppkey AS id, round(s_acctbal, 2) AS v FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, id) AS place, greatest(count(*) OVER () // 10, 1) AS k, sum(greatest(v, 0)) OVER () AS a, count(*) OVER () AS n FROM g)
  SELECT max(n) AS n, round(sum(greatest(v, 0)) / max(a), 6) AS share FROM k WHERE place <= k""")
def top_decile_gain(spark, d):
    return rounded(pooling.top_decile_share(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", 2).alias("v")), "v"), "share")


@query(with_("region_rows", "SELECT id, region_index, round(area / nullif(list_extract(list_sort(list(area) OVER (PARTITION BY id)), count(*) OVER (PARTITION BY id) // 2 + 1), 0), 6) AS to_median, round(area / nullif(max(area) OVER (PARTITION BY id), 0), 6) AS to_largest FROM region_rows"))
def region_scale(spark, d):
    return rounded(pooling.relative_scale(regions(spark, d)), "to_median", "to_largest")


@query(with_("region_rows", "SELECT id, CAST(least(floor(centroid_y * 3), 2) * 3 + least(floor(centroid_x * 3), 2) AS BIGINT) AS cell, count(*) AS n, round(sum(area), 6) AS area FROM region_rows GROUP BY ALL"))
def region_grid(spark, d):
    return rounded(regions(spark, d).groupBy("id", pooling.grid_cell(F.col("centroid_x"), F.col("centroid_y")).alias("cell")).agg(F.count("*").alias("n"), F.sum("area").alias("area")), "area")


@query("SELECT l_orderkey AS id, l_linenumber AS k, l_partkey AS part, round(ln(1 + l_quantity), 6) AS d0, round(ln(1 + l_discount), 6) AS d1, CAST(least(l_linenumber, 8) AS DOUBLE) AS d2, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS DOUBLE) AS d3, round(sign(l_tax - 0.04) * ln(1 + abs(l_tax - 0.04)), 6) + 0 AS d4 FROM lineitem")
def region_descriptor(spark, d):
    li = table(spark, d, "lineitem")
    tone = F.when(F.col("l_linestatus") == "O", "dark").otherwise("light")
    v = pooling.descriptor(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"), tone, F.array(F.col("l_tax") - 0.04))
    return rounded(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("part"), *[v[k].alias(f"d{k}") for k in range(5)]), "d0", "d1", "d4")


@query("""WITH c AS (SELECT p_partkey AS id, (p_size % 10) / 10.0 AS r, (p_size % 7) / 7.0 AS g, (p_size % 3) / 3.0 AS b FROM part), l AS (SELECT id, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM c),
  x AS (SELECT id, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM l),
  f AS (SELECT id, CASE WHEN x > 216 / 24389 THEN cbrt(x) ELSE (24389 / 27 * x + 16) / 116 END AS x, CASE WHEN y > 216 / 24389 THEN cbrt(y) ELSE (24389 / 27 * y + 16) / 116 END AS y, CASE WHEN z > 216 / 24389 THEN cbrt(z) ELSE (24389 / 27 * z + 16) / 116 END AS z FROM x)
  SELECT id, round(116 * y - 16, 4) + 0 AS l, round(500 * (x - y), 4) + 0 AS a, round(200 * (y - z), 4) + 0 AS b FROM f""")
def lab_colour(spark, d):
    p = table(spark, d, "part")
    v = pooling.lab((F.col("p_size") % 10) / 10, (F.col("p_size") % 7) / 7, (F.col("p_size") % 3) / 3)
    return rounded(p.select(F.col("p_partkey").alias("id"), v[0].alias("l"), v[1].alias("a"), v[2].alias("b")), "l", "a", "b", digits=4)


@query(with_("rating", "SELECT rater AS dimension, count(*) AS n, round(avg(rating), 6) AS mean, count(*) FILTER (rating >= 1) AS high FROM rating GROUP BY rater"))
def summarise_dimensions(spark, d):
    return rounded(ratings(spark, d).groupBy(F.col("rater").alias("dimension")).agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.count_if(F.col("rating") >= 1).alias("high")), "mean")


@query("SELECT m AS method, count(quality) AS n, round(avg(quality), 6) AS mean FROM (SELECT quality, unnest(CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END) AS m FROM labels) GROUP BY m")
def method_means(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("methods"), "quality")
    return rounded(pooling.entity_means(rows, "methods", "quality"), "mean")


@query("SELECT count(*) AS n, count(o_custkey) AS with_book, count(DISTINCT o_custkey) AS books, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS several, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)) AS largest FROM orders")
def book_coverage(spark, d):
    books = items(spark, d).where("book is not null").groupBy("book").agg(F.count("*").alias("m"))
    total = items(spark, d).agg(F.count("*").alias("n"), F.count("book").alias("with_book"))
    return total.crossJoin(books.agg(F.count("*").alias("books"), F.count_if(F.col("m") > 1).alias("several"), F.max("m").alias("largest")))  # one row each


@query(with_("lab triple", "SELECT relation, count(*) AS n, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM triple GROUP BY relation"))
def context_graph_report(spark, d):
    return triples(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"), F.countDistinct("tail").alias("tails"))


@query(with_("lab", "SELECT id, median(m) AS median_frequency FROM (SELECT lab.id, count(*) OVER (PARTITION BY label) AS m FROM lab) GROUP BY id"))
def label_frequencies(spark, d):
    own = labels(spark, d)
    return own.join(own.groupBy("label").agg(F.count("*").alias("m")), "label").groupBy("id").agg(F.median("m").alias("median_frequency"))


@query(with_("lab", ", n AS (SELECT count(DISTINCT id) AS n FROM lab) SELECT label, count(DISTINCT id) AS n FROM lab GROUP BY label HAVING count(DISTINCT id) <= (SELECT greatest(CAST(floor(0.0375 * n) AS BIGINT), 1) FROM n)"))
def rare_labels(spark, d):
    own = labels(spark, d)
    size = own.select("id").distinct().count()
    return own.join(regimes.rare_labels(own, size, 0.0375), "label").groupBy("label").agg(F.countDistinct("id").alias("n"))


@query(with_("plab", ", p AS (SELECT x.id, count(DISTINCT y.id) AS n FROM plab x JOIN plab y ON x.label = y.label AND x.id <> y.id GROUP BY x.id) SELECT round(median(501.0 / (n + 1)), 6) AS median FROM p"))
def expected_best_rank(spark, d):
    from velspar.operators.taxonomy import exact

    partners = exact(part_labels(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"))
    return rounded(pooling.expected_best_rank(partners, 500), "median")


@query(with_("uv vg", ", k AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY v DESC, c) AS rank FROM vg), p AS (SELECT q, avg(rel::INT) AS share FROM k WHERE rank <= 15 GROUP BY q) SELECT round(avg((share > 0.1)::INT), 6) AS over_chance, round(avg(share), 6) AS mean_share FROM p"))
def knn_probe(spark, d):
    own = X.half(spark, d, "v")
    top = ranking.top_k(own, own, 15)
    share = ranking.neighbourhood_composition(top, own.select("id", F.col("label").alias("value")))
    return rounded(share.agg(F.avg((F.col("share") > 0.1).cast("double")).alias("over_chance"), F.avg("share").alias("mean_share")), "over_chance", "mean_share")


@query(with_("uv", "SELECT a.id AS query_id, b.id AS candidate_id, round((list_dot_product(a.v, b.v) + 0.25 * list_dot_product(a.g, b.g)) / 1.25, 6) + 0 AS score FROM uv a JOIN uv b ON a.id <> b.id WHERE a.id % 20 = 0"))
def concatenated_record(spark, d):
    """Weighted unit vectors as one: the cosine weighs the parts by the squares of their weights."""
    from velspar.functions.vectors import normalise

    parts = [normalise(X.half(spark, d, n)).select("id", F.col("vector").alias(n)) for n in "vg"]
    rows = normalise(parts[0].join(parts[1], "id").select("id", weighted_concat([("v", 1.0), ("g", 0.5)]).alias("vector")))
    return rounded(ranking.pair_scores(rows.where("id % 20 = 0"), rows), "score")  # stated queries against all rows


@query(with_("named", """, a AS (SELECT DISTINCT id, word FROM named WHERE namer = 0), r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM (SELECT id, list(word) AS w FROM a GROUP BY id)), n AS (SELECT count(*) AS n FROM r)
  SELECT round(avg(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))), 6) AS floor FROM r x JOIN r y ON y.k = x.k % (SELECT n FROM n) + 1 WHERE x.id <> y.id"""))
def agreement_floor(spark, d):
    """Agreement of each picture's words with the next picture's: what chance gives."""
    own = named(spark, d).where("namer = 0").groupBy("id").agg(F.collect_set("word").alias("w"))
    places = pooling.ordered(own.withColumn("_one", F.col("id")), "_one", "id").select("place", "id", "w")
    n = places.count()
    other = places.select((F.when(F.col("place") == 1, n).otherwise(F.col("place") - 1)).alias("place"), F.col("id").alias("other"), F.col("w").alias("v"))
    both = places.join(other, "place").where("id <> other")
    return rounded(both.agg(F.avg(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v"))).alias("floor")), "floor")


@query()
def soft_set_match(spark, d):
    """Best assignment of the label vectors of two items of a book."""
    concepts = X.vectors(spark, d).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("label"), "vector")
    sets = labels(spark, d).join(concepts, "label").groupBy("id").agg(F.collect_list("vector").alias("vs")).join(items(spark, d).select("id", "book"), "id")
    pairs = sets.alias("a").join(sets.alias("b"), F.expr("a.book = b.book and a.id < b.id"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), pooling.soft_match(F.col("a.vs"), F.col("b.vs")).alias("score"))


@query()
def adjacency_svd(spark, d):
    """Leading directions of the co-occurrence graph of labels."""
    own = labels(spark, d)
    pairs = own.alias("x").join(own.alias("y"), F.expr("x.id = y.id and x.label <> y.label")).groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.count("*").cast("double").alias("ppmi"))
    return graph.spectral(spark, materialise(spark, pairs, "pairs"), 8)


@query("SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS good FROM labels JOIN documents USING (doc_id) GROUP BY lang HAVING count(*) >= 15")
def stratify_transfer(spark, d):
    """A metric by stratum, strata of under 15 rows left out."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    m = metrics.stratified(rows.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).cast("double").alias("good")), rows.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("stratum")), "good")
    return rounded(m.where("n >= 15").select(F.col("stratum").alias("lang"), "n", F.col("mean").alias("good")), "good")


@query("SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, ''), 'unknown') AS collection, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def lookup_with_fallback(spark, d):
    from velspar.functions.text import truthy

    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce(truthy(F.col("c_mktsegment")), F.lit("unknown")).alias("collection"), F.coalesce("n", F.lit(0)).alias("n"))


@query(with_("named", ", a AS (SELECT id, list_sort(list(DISTINCT word)) AS w FROM named WHERE namer = 0 GROUP BY id), b AS (SELECT id, list_sort(list(DISTINCT word)) AS w FROM named WHERE namer = 1 GROUP BY id) SELECT id, CAST(len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS INT) AS only_first, CAST(len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS INT) AS only_second FROM a JOIN b USING (id)"))
def symmetric_difference(spark, d):
    n = named(spark, d)
    a, b = (n.where(F.col("namer") == k).groupBy("id").agg(F.collect_set("word").alias(c)) for k, c in ((0, "a"), (1, "b")))
    return a.join(b, "id").select("id", F.size(F.array_except("a", "b")).alias("only_first"), F.size(F.array_except("b", "a")).alias("only_second"))
