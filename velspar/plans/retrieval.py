"""Queries over vectors: ranking, metrics, fusion, pairs, search; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.operators import agreement, fusion, metrics, pairs, ranking, records, rows
from velspar.plans.fixtures import half, items, labels, named, pool_items, pool_labels, rounded, vectors, with_
from velspar.session import materialise

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def both_scores(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, candidate_id, v, g): cosines of both halves."""
    v, g = (ranking.pair_scores(half(spark, d, n), half(spark, d, n)).withColumnRenamed("score", n) for n in "vg")
    return v.join(g, ["query_id", "candidate_id"])


def both_halves(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", F.slice("vector", 1, 32).alias("v"), F.slice("vector", 33, 32).alias("g"))


def relevant(spark: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    own = vectors(spark, d).select("id", "label")
    a, b = own.select(F.col("id").alias("query_id"), F.col("label").alias("_a")), own.select(F.col("id").alias("candidate_id"), F.col("label").alias("_b"))
    return scores.join(a, "query_id").join(b, "candidate_id").withColumn("relevant", F.col("_a") == F.col("_b")).drop("_a", "_b")


def by_label(items: DataFrame) -> DataFrame:
    """Items whose label is their key: relevant are those of the same label."""
    return items.select("id", "vector", F.when(F.col("label").isNotNull(), F.array(F.col("label").cast("string"))).alias("keys"))


METRIC_SQL = """SELECT q AS query_id, count(*) AS n_candidates, CAST(sum(rel::INT) AS BIGINT) AS n_relevant,
  CASE WHEN sum(rel::INT) > 0 THEN round(1 / min(CASE WHEN rel THEN rank END), 6) END AS reciprocal_rank,
  CASE WHEN sum(rel::INT) > 0 THEN round(sum(CASE WHEN rel THEN hits / rank ELSE 0 END) / sum(rel::INT), 6) END AS average_precision,
  CASE WHEN sum(rel::INT) > 0 THEN round(sum((rel AND rank <= 1)::INT) / sum(rel::INT), 6) END AS recall_at_1,
  CASE WHEN sum(rel::INT) > 0 THEN round(sum((rel AND rank <= 5)::INT) / sum(rel::INT), 6) END AS recall_at_5,
  CASE WHEN sum(rel::INT) > 0 THEN round(sum((rel AND rank <= 10)::INT) / sum(rel::INT), 6) END AS recall_at_10
  FROM (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM {}) GROUP BY q"""
METRICS = ("reciprocal_rank", "average_precision", "recall_at_1", "recall_at_5", "recall_at_10")


@query(with_("u s r", "SELECT q AS query_id, c AS candidate_id, score, rank FROM r WHERE rank <= 10"))
def topk_cosine(spark, d):
    return ranking.top_k(vectors(spark, d), vectors(spark, d), 10)


@query(with_("u s r", "SELECT q AS query_id, c AS candidate_id, score, rank FROM r WHERE rank <= 3"))
def topk_cosine_expressions(spark, d):
    return ranking.top_k_sql(vectors(spark, d), vectors(spark, d), 3)


def exact_metrics(spark, d):
    own = by_label(vectors(spark, d))
    return rows.label_metrics(own, own)


@query(with_("u s r", METRIC_SQL.format("r")))
def retrieval_metrics_exact(spark, d):
    return rounded(exact_metrics(spark, d), *METRICS)


@query(with_("u s r", f"SELECT count(*) AS n_queries, round(avg(average_precision), 6) AS mean_average_precision, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank FROM ({METRIC_SQL.format('r').replace('round(', '(').replace(', 6)', ')')})"))
def retrieval_summary(spark, d):
    return rounded(metrics.summary(exact_metrics(spark, d), ["average_precision", "reciprocal_rank"]), "mean_average_precision", "mean_reciprocal_rank")


@query(with_("u s r", f"SELECT label AS stratum, count(ap) AS n, round(avg(ap), 6) AS mean FROM (SELECT query_id, average_precision AS ap FROM ({METRIC_SQL.format('r').replace('round(', '(').replace(', 6)', ')')})) JOIN u ON u.id = query_id GROUP BY label"))
def stratified_metrics(spark, d):
    strata = vectors(spark, d).select(F.col("id").alias("query_id"), F.col("label").alias("stratum"))
    return rounded(metrics.stratified(exact_metrics(spark, d), strata, "average_precision"), "mean")


@query(with_("u s r", """, gain AS (SELECT q, c, rank, 1.0 / (1 + abs(a.label - b.label)) AS g FROM r JOIN u a ON a.id = q JOIN u b ON b.id = c),
  best AS (SELECT q, sum(g / log2(place + 1)) AS ideal FROM (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY g DESC) AS place FROM gain) WHERE place <= 10 GROUP BY q)
  SELECT query_id, round(dcg / ideal, 6) AS ndcg FROM (SELECT q AS query_id, sum(g / log2(rank + 1)) AS dcg FROM gain WHERE rank <= 10 GROUP BY q) JOIN best ON q = query_id"""))
def ndcg_graded_labels(spark, d):
    own = vectors(spark, d).select("id", "label")
    a, b = own.select(F.col("id").alias("query_id"), F.col("label").alias("_a")), own.select(F.col("id").alias("candidate_id"), F.col("label").alias("_b"))
    ranks = ranking.ranked(ranking.pair_scores(vectors(spark, d), vectors(spark, d))).join(a, "query_id").join(b, "candidate_id").withColumn("gain", 1 / (1 + F.abs(F.col("_a") - F.col("_b"))))
    return rounded(metrics.ndcg(ranks, metrics.ideal_dcg(ranks.select("query_id", "candidate_id", "gain"))), "ndcg")


@query(with_("uv vg vr gr", "SELECT a.q AS query_id, round(count(b.c) / 10, 6) AS overlap FROM (SELECT * FROM vr WHERE rank <= 10) a LEFT JOIN (SELECT * FROM gr WHERE rank <= 10) b ON a.q = b.q AND a.c = b.c GROUP BY a.q"))
def neighbor_overlap(spark, d):
    v, g = (ranking.top_k(half(spark, d, n), half(spark, d, n)) for n in "vg")
    return rounded(ranking.neighbour_overlap(v, g, 10), "overlap")


@query(with_("u s r", "SELECT u.id, count(r.q) AS n FROM u LEFT JOIN r ON r.c = u.id AND rank <= 10 GROUP BY u.id"))
def hubness_counts(spark, d):
    return ranking.occurrences(ranking.top_k(vectors(spark, d), vectors(spark, d)), vectors(spark, d))


@query(with_("u s r lab", """, deg AS (SELECT u.id, count(lab.label) AS x FROM u LEFT JOIN lab ON lab.id = u.id GROUP BY u.id), hub AS (SELECT u.id, count(r.q) AS y FROM u LEFT JOIN r ON r.c = u.id AND rank <= 10 GROUP BY u.id),
  k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM deg JOIN hub USING (id))
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k"""))
def degree_hubness_spearman(spark, d):
    ids = vectors(spark, d).select("id")
    degree = ids.join(labels(spark, d).groupBy("id").agg(F.count("*").alias("x")), "id", "left").na.fill(0)
    hub = ranking.occurrences(ranking.top_k(vectors(spark, d), vectors(spark, d)), ids).withColumnRenamed("n", "y")
    return rounded(ranking.spearman(degree.join(hub, "id"), "x", "y"), "rho")


RULE_SQL = {
    "linear": "0.25 * v + 0.75 * g",
    "max": "greatest(0.25 * v, 0.75 * g)",
    "rrf": "0.25 / (60 + rv) + 0.75 / (60 + rg)",
    "rank_linear": "0.25 * (1 - (rv - 1) / (n - 1)) + 0.75 * (1 - (rg - 1) / (n - 1))",
    "product": "exp(0.25 * ln(greatest((v - lv) / (hv - lv), 1e-9)) + 0.75 * ln(greatest((g - lg) / (hg - lg), 1e-9)))",
}


def _rule(rule: str):
    sql = with_("uv vg", f""", w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, c) AS rv, row_number() OVER (PARTITION BY q ORDER BY g DESC, c) AS rg, count(*) OVER (PARTITION BY q) AS n,
      min(v) OVER (PARTITION BY q) AS lv, max(v) OVER (PARTITION BY q) AS hv, min(g) OVER (PARTITION BY q) AS lg, max(g) OVER (PARTITION BY q) AS hg FROM vg),
      f AS (SELECT q, c, round({RULE_SQL[rule]}, 9) + 0 AS score FROM w)
      SELECT query_id, candidate_id, score, rank FROM (SELECT q AS query_id, c AS candidate_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM f) WHERE rank <= 10""")

    def run(spark, d):
        if rule in ("linear", "max"):  # ranked beside the cosines
            return rounded(fusion.fuse(rows.top_fused(both_halves(spark, d), rule, 0.25, 10), rule, 0.25), "score", digits=9).select("query_id", "candidate_id", "score", "rank")
        fused = fusion.fuse(both_scores(spark, d), rule, 0.25).select("query_id", "candidate_id", (F.round("score", 9) + 0.0).alias("score"))
        return ranking.ranked(fused).where("rank <= 10")

    run.__name__ = {"linear": "late_fusion", "max": "max_rule", "product": "product_rule"}.get(rule, rule)
    query(sql)(run)


for _name in fusion.RULES:
    _rule(_name)


@query(with_("uv vg", """, grid AS (SELECT q, c, rel, alpha, round(alpha * v + (1 - alpha) * g, 9) + 0 AS score FROM vg, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS alpha)),
  k AS (SELECT *, row_number() OVER (PARTITION BY alpha, q ORDER BY score DESC, c) AS rank FROM grid), h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY alpha, q ORDER BY rank) AS hits FROM k),
  m AS (SELECT alpha, avg(ap) AS metric FROM (SELECT alpha, q, sum(CASE WHEN rel THEN hits / rank ELSE 0 END) / sum(rel::INT) AS ap FROM h GROUP BY alpha, q) GROUP BY alpha)
  SELECT CAST(alpha AS DOUBLE) AS alpha, round(metric, 6) AS metric FROM m ORDER BY round(metric, 9) DESC, alpha DESC LIMIT 1"""))
def alpha_selection(spark, d):
    """All weights in one pass: the weight is a column, every (weight, query) its own ranking."""
    grid = relevant(spark, d, both_scores(spark, d)).withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    fused = fusion.fuse(grid, "linear", F.col("alpha"))
    ranks = ranking.ranked(fused, ("alpha", "query_id"), F.round("score", 9) + 0.0)
    own = metrics.per_query(ranks.withColumn("query_id", F.struct("alpha", "query_id"))).select("query_id.alpha", "average_precision")
    return rounded(fusion.choose_weight(own.groupBy("alpha").agg(F.avg("average_precision").alias("metric"))), "metric")


@query(with_("uv vg vr", ", f AS (SELECT vr.q, vr.c, round(0.5 * vg.v + 0.5 * vg.g, 9) + 0 AS score FROM vr JOIN vg USING (q, c) WHERE rank <= 50) SELECT * FROM (SELECT q AS query_id, c AS candidate_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM f) WHERE rank <= 10"))
def rerank_candidates(spark, d):
    return rounded(fusion.rerank(both_scores(spark, d), 50, 0.5).where("rank <= 10").select("query_id", "candidate_id", "score", "rank"), "score", digits=9)


@query(with_("uv vg", ", f AS (SELECT q, c, round((v * 1.0 + g * 0.25) / 1.25, 9) + 0 AS score FROM vg) SELECT * FROM (SELECT q AS query_id, c AS candidate_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM f) WHERE rank <= 10"))
def record_mix_search(spark, d):
    v, g = (ranking.pair_scores(half(spark, d, n), half(spark, d, n)) for n in "vg")
    return ranking.ranked(rounded(fusion.record_scores({"v": (v, 1.0), "g": (g, 0.5)}), "score", digits=9)).where("rank <= 10")


@query(with_("uv vg", "SELECT min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM vg WHERE q < c"))
def similarity_bounds(spark, d):
    return rounded(fusion.bounds(ranking.pair_scores(half(spark, d, "v"), half(spark, d, "v")).where("query_id < candidate_id")), "mean", "std")


@query(with_("uv vg", "SELECT round(quantile_cont(v, 0.95), 6) + 0 AS close_min, round(quantile_cont(v, 0.5), 6) + 0 AS distant_max FROM vg WHERE q < c"))
def visual_thresholds(spark, d):
    return rounded(pairs.thresholds(ranking.pair_scores(half(spark, d, "v"), half(spark, d, "v")).where("query_id < candidate_id")), "close_min", "distant_max")


PAIR_SQL = """, p AS (SELECT q, c, vg.v AS v, CASE WHEN abs(a.label - b.label) = 0 THEN 1.0 ELSE round(1.0 / (1 + abs(a.label - b.label)), 6) END AS s FROM vg JOIN uv a ON a.id = q JOIN uv b ON b.id = c),
  k AS (SELECT *, CASE WHEN v >= 0.3 AND s >= 0.5 THEN 'easy_positive' WHEN v >= 0.3 AND s <= 0.2 THEN 'hard_negative' WHEN v <= 0.0 AND s >= 0.5 THEN 'hard_positive' WHEN v <= 0.0 AND s <= 0.2 THEN 'easy_negative' END AS class FROM p),
  once AS (SELECT * FROM k WHERE class IS NOT NULL AND q < c),
  best AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN class IN ('easy_positive', 'hard_negative') THEN -v WHEN class = 'hard_positive' THEN -s ELSE v END,
    CASE WHEN class = 'easy_positive' THEN -s WHEN class = 'hard_positive' THEN v ELSE s END, q, c) AS place FROM once)"""


def chosen_pairs(spark, d):
    """The 250 best pairs of each class, written once."""
    own = half(spark, d, "v").select("id", "vector", F.col("label").alias("value"))
    return materialise(spark, pairs.select_pairs(rows.class_pairs(own, 250, 0.3, 0.0), 250), "pairs")


@query(with_("uv vg", PAIR_SQL + " SELECT q AS query_id, c AS candidate_id, class, v AS visual, s AS semantic, place FROM best WHERE place <= 250"))
def hard_pairs(spark, d):
    return chosen_pairs(spark, d)


CONTROL_SQL = PAIR_SQL + """, e AS (SELECT b.q, b.c AS p, x.c AS ctl, b.v AS target, x.v AS score FROM best b JOIN vg x ON x.q = b.q AND x.c <> b.c JOIN item i ON i.id = b.q JOIN item j ON j.id = x.c
  WHERE b.class = 'hard_positive' AND b.place <= 250 AND i.stratum = j.stratum AND abs(round(x.v - b.v, 6)) <= 0.02
  AND NOT EXISTS (SELECT 1 FROM lab l JOIN lab m ON l.label = m.label WHERE l.id = b.q AND m.id = x.c))"""


def controls(spark, d):
    hard = chosen_pairs(spark, d).where("class = 'hard_positive'")
    held = pool_labels(spark, d).groupBy("id").agg(F.collect_list("label").alias("keys"))
    pool = half(spark, d, "v").select("id", "vector").join(pool_items(spark, d).select("id", "stratum"), "id").join(held, "id", "left")
    return rows.controls(hard, materialise(spark, pool, "pool"))


@query(with_("uv vg item lab", CONTROL_SQL + " SELECT q AS query_id, p AS positive_id, ctl AS control_id, target, score FROM e"))
def matched_control_candidates(spark, d):
    return controls(spark, d)


@query()
def matched_controls(spark, d):
    return pairs.draw_controls(controls(spark, d))


@query(with_("uv vg item lab", CONTROL_SQL + " SELECT round(avg(CASE WHEN target > score THEN 1.0 WHEN target = score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM e"))
def paired_auc(spark, d):
    return rounded(metrics.paired_auc(controls(spark, d), "target", "score"), "auc")


@query(with_("uv vg", "SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT v, p, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT v, sum(rel::INT) AS p, sum((NOT rel)::INT) AS n FROM vg WHERE q < c GROUP BY v))"))
def unpaired_auc(spark, d):
    return rounded(metrics.unpaired_auc(relevant(spark, d, both_scores(spark, d)).where("query_id < candidate_id"), "v", "relevant"), "auc")


@query(with_("u s r", """, t AS (SELECT q, u.label, sum(greatest(score, 0)) AS vote FROM r JOIN u ON u.id = c WHERE rank <= 10 GROUP BY q, u.label)
  SELECT query_id, label, round(vote, 6) AS vote, rank FROM (SELECT q AS query_id, label, vote, row_number() OVER (PARTITION BY q ORDER BY round(vote, 6) DESC, label) AS rank FROM t)"""))
def masked_label_vote(spark, d):
    return rounded(ranking.label_votes(ranking.top_k(vectors(spark, d), vectors(spark, d)), vectors(spark, d).select("id", "label")), "vote")


@query(with_("uv vg vr gr", "SELECT coalesce(a.q, b.q) AS query_id, count(*) FILTER (a.q IS NULL) AS entered, count(*) FILTER (b.q IS NULL) AS \"left\", count(*) FILTER (a.q IS NOT NULL AND b.q IS NOT NULL) AS stayed FROM (SELECT * FROM vr WHERE rank <= 10) a FULL JOIN (SELECT * FROM gr WHERE rank <= 10) b ON a.q = b.q AND a.c = b.c GROUP BY 1"))
def rank_changes(spark, d):
    v, g = (ranking.top_k(half(spark, d, n), half(spark, d, n)) for n in "vg")
    return ranking.rank_changes(v, g)


@query(with_("u s r item", "SELECT q AS query_id, round(avg(CASE WHEN a.stratum = b.stratum THEN 1.0 ELSE 0.0 END), 6) AS share FROM r JOIN item a ON a.id = q JOIN item b ON b.id = c WHERE rank <= 10 GROUP BY q"))
def neighbourhood_composition(spark, d):
    top = ranking.top_k(vectors(spark, d), vectors(spark, d))
    return rounded(ranking.neighbourhood_composition(top, items(spark, d).select("id", F.col("stratum").alias("value"))), "share")


@query(with_("u s r item", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.book = b.book THEN 'same book' WHEN a.stratum = b.stratum AND a.y = b.y THEN 'same place and year' WHEN a.stratum = b.stratum OR a.y = b.y THEN 'near' ELSE 'unexplained' END AS kind
  FROM r JOIN item a ON a.id = q JOIN item b ON b.id = c WHERE rank <= 10) GROUP BY kind"""))
def cross_book_class(spark, d):
    own = items(spark, d)
    a, b = (own.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("book", "stratum", "y")]) for k, p in (("query_id", "a"), ("candidate_id", "b")))
    top = ranking.top_k(vectors(spark, d), vectors(spark, d)).join(a, "query_id").join(b, "candidate_id")
    same = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    kind = F.when(same("book"), "same book").when(same("stratum") & same("y"), "same place and year").when(same("stratum") | same("y"), "near").otherwise("unexplained")
    return top.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(with_("uv vg vr gr apv apg", "SELECT round(avg(a.ap - b.ap) / stddev_samp(a.ap - b.ap), 6) AS d FROM apv a JOIN apg b ON a.q = b.q"))
def cohens_d(spark, d):
    return rounded(agreement.cohens_d(_paired(spark, d), "v", "g"), "d")


@query(with_("uv vg vr gr apv apg", "SELECT round(avg(sign(round(a.ap, 9) - round(b.ap, 9))), 6) + 0 AS delta FROM apv a, apg b"))
def cliffs_delta(spark, d):
    return rounded(agreement.cliffs_delta(_paired(spark, d).select(F.round("v", 9).alias("v"), F.round("g", 9).alias("g")), "v", "g"), "delta")


def _paired(spark, d):
    """(query_id, v, g): average precision by each half."""
    keys = F.when(F.col("label").isNotNull(), F.array(F.col("label").cast("string"))).alias("keys")
    own = vectors(spark, d).select("id", F.slice("vector", 1, 32).alias("v"), F.slice("vector", 33, 32).alias("g"), keys)
    return rows.average_precisions(own, ("v", "g"))


@query()
def bootstrap_ci(spark, d):
    both = _paired(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("value")) for n in "vg"])).alias("r")).select("r.*")
    return agreement.bootstrap_ci(both, "method", "value")


@query()
def permutation_test(spark, d):
    return agreement.permutation_test(_paired(spark, d).withColumn("test", F.lit("v against g")), "test", "v", "g")


HASH_SQL = "SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i < 64 THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE 0 END)) AS BIGINT) + CASE WHEN embedding[64] > 0 THEN -9223372036854775808 ELSE 0 END AS h FROM embeddings"


def sign_hashes(spark, d):
    bits = F.aggregate(F.transform("vector", lambda x, i: F.when(x > 0, F.expr("shiftleft(1L, 0)")).otherwise(F.lit(0).cast("bigint"))), F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("i")), lambda s, x: F.struct((s["h"].bitwiseOR(F.call_function("shiftleft", x, s["i"]))).alias("h"), (s["i"] + 1).alias("i")))
    return vectors(spark, d).select("id", bits["h"].alias("hash"))


@query(f"WITH h AS ({HASH_SQL}) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.h, y.h)) AS INT) AS distance FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 17")
def near_dup_pairs(spark, d):
    return records.near_pairs(sign_hashes(spark, d), 17)


@query(f"""WITH RECURSIVE h AS ({HASH_SQL}), e AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id AND bit_count(xor(x.h, y.h)) <= 17),
  reach AS (SELECT id AS a, id AS b FROM h UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a""")
def near_dup_groups(spark, d):
    return records.near_groups(spark, sign_hashes(spark, d), 17)


@query(with_("u s r named", """, n AS (SELECT DISTINCT id, word FROM named), df AS (SELECT word, ln((SELECT count(DISTINCT id) FROM n) / (1 + count(*))) AS idf FROM n GROUP BY word), pool AS (SELECT n.* FROM n SEMI JOIN u ON u.id = n.id),
  f AS (SELECT x.id AS q, y.id AS c, round(sum(idf), 9) AS w FROM pool x JOIN pool y ON x.word = y.word AND x.id <> y.id JOIN df ON df.word = x.word WHERE x.id % 20 = 0 GROUP BY 1, 2),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, c) AS place FROM f) WHERE place <= 100)
  SELECT * FROM (SELECT k.q AS query_id, k.c AS candidate_id, s.score, row_number() OVER (PARTITION BY k.q ORDER BY s.score DESC, k.c) AS rank FROM k JOIN s ON s.q = k.q AND s.c = k.c) WHERE rank <= 10"""))
def filter_then_rank(spark, d):
    """The field of best shared names, weighted by rarity, then cosine within it."""
    n = named(spark, d).select("id", "word").distinct()
    size = n.agg(F.countDistinct("id").alias("size"))
    idf = n.groupBy("word").agg(F.count("*").alias("m")).crossJoin(size).select("word", F.log(F.col("size") / (1 + F.col("m"))).alias("idf"))  # one row
    ids = vectors(spark, d).select("id")
    pool = n.join(ids, "id")  # names of what can be ranked; queries as stated
    q, c = pool.where("id % 20 = 0").withColumnRenamed("id", "query_id"), pool.withColumnRenamed("id", "candidate_id")
    field = q.join(c, "word").where("query_id <> candidate_id").join(idf, "word").groupBy("query_id", "candidate_id").agg(F.round(F.sum("idf"), 9).alias("score"))
    field = ranking.ranked(field).where("rank <= 100").select("query_id", "candidate_id")
    return ranking.ranked(ranking.score_pairs(field, vectors(spark, d))).where("rank <= 10")


@query(with_("u", ", c AS (SELECT i, j, avg(v[i] * v[j]) AS m FROM u, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j) SELECT round(sum(CASE WHEN i = j THEN m ELSE 0 END) ** 2 / sum(m * m), 4) AS effective_rank FROM c"))
def embedding_collapse(spark, d):
    """Effective rank (tr C)^2 / |C|^2 of the second-moment matrix: sums of products by pairs of dimensions, without a decomposition."""
    from velspar.functions.vectors import normalise

    cells = normalise(vectors(spark, d)).select(F.posexplode("vector").alias("i", "x"), "vector").select("i", "x", F.posexplode("vector").alias("j", "y"))
    c = cells.groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("m"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("m")).otherwise(0.0))
    return c.agg(F.round(F.pow(trace, 2) / F.sum(F.col("m") * F.col("m")), 4).alias("effective_rank"))


@query()
def kmeans_vocabulary(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from velspar.functions.vectors import normalise

    points = normalise(vectors(spark, d)).select("id", array_to_vector("vector").alias("features"))
    model = KMeans(k=10, seed=7, maxIter=15).fit(points)
    return model.transform(points).select("id", F.col("prediction").alias("sign"))


@query()
def linear_probe(spark, d):
    """Accuracy of a linear probe for the label in four folds by hash, against the most frequent label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from velspar.functions.vectors import normalise

    points = normalise(vectors(spark, d)).select("id", F.col("label").cast("double").alias("label"), array_to_vector("vector").alias("features"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("fold"))
    out = None
    for k in range(4):
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(points.where(F.col("fold") != k))
        own = model.transform(points.where(F.col("fold") == k)).select(F.lit(k).alias("fold"), (F.col("prediction") == F.col("label")).cast("double").alias("right"))
        out = own if out is None else out.union(own)
    return out.groupBy("fold").agg(F.avg("right").alias("accuracy"), F.count("*").alias("n"))
