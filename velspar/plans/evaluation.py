"""Queries over splits, evaluation, label prediction, associations and catalogue reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from velspar.operators import agreement, catalogue, evaluation, prediction, ranking, rows, taxonomy
from velspar.plans import fixtures as X
from velspar.plans.fixtures import items, labels, pool_labels, regions, rounded, triples, vectors, with_
from velspar.plans.retrieval import METRIC_SQL, PAIR_SQL, chosen_pairs
from velspar.plans.structure import keyed, tax
from velspar.session import materialise, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def manifest(spark, d):
    return items(spark, d).withColumnRenamed("status", "split")


@query("SELECT vec_id AS id FROM embeddings JOIN orders ON o_orderkey = vec_id WHERE o_orderstatus = 'F'")
def select_split(spark, d):
    own = vectors(spark, d).join(manifest(spark, d).select("id"), "id", "left_semi")
    evaluation.check_alignment(own, manifest(spark, d))
    return evaluation.select_ids(own, manifest(spark, d), "F").select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders) AND vec_id IN (SELECT l_orderkey FROM lineitem) AND vec_id IN (SELECT doc_id FROM documents)")
def coverage_restriction(spark, d):
    return evaluation.covered([vectors(spark, d), items(spark, d), labels(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id"))])


SPLIT_SQL = """, t AS (SELECT u.* FROM u JOIN item USING (id) WHERE status = 'F'), lap AS (SELECT DISTINCT x.id AS q, y.id AS c FROM few x JOIN few y ON x.label = y.label AND x.id <> y.id),
  sc AS (SELECT a.id AS q, b.id AS c, round(list_dot_product(a.v, b.v), 6) + 0 AS score FROM t a JOIN t b ON a.id <> b.id),
  ev AS (SELECT sc.q, sc.c, lap.q IS NOT NULL AS rel, row_number() OVER (PARTITION BY sc.q ORDER BY score DESC, sc.c) AS rank FROM sc LEFT JOIN lap ON lap.q = sc.q AND lap.c = sc.c)"""


def evaluated(spark, d):
    known = materialise(spark, evaluation.select_ids(keyed(spark, d), manifest(spark, d), "F"), "keyed")
    own = known.select("id", "vector")
    return rows.label_metrics(known, known), ranking.top_k(own, own)


@query(with_("u item lab few", SPLIT_SQL + " " + METRIC_SQL.format("ev")))
def evaluate_split(spark, d):
    return rounded(evaluated(spark, d)[0], "reciprocal_rank", "average_precision", "recall_at_1", "recall_at_5", "recall_at_10")


@query(with_("u item lab few", SPLIT_SQL + f", pq AS ({METRIC_SQL.format('ev').replace('round(', '(').replace(', 6)', ')')}) SELECT count(*) AS n_queries, count(average_precision) AS n_evaluated, round(count(average_precision) / count(*), 6) AS coverage, round(avg(average_precision), 6) AS mean_average_precision, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg(recall_at_10), 6) AS mean_recall_at_10 FROM pq"))
def evaluation_coverage(spark, d):
    return rounded(evaluation.coverage(evaluated(spark, d)[0]), "coverage", "mean_average_precision", "mean_reciprocal_rank", "mean_recall_at_10")


@query(with_("u item lab few", SPLIT_SQL + " SELECT q AS query_id, c AS candidate_id, rank FROM ev WHERE rank <= 10"))
def evaluation_kept(spark, d):
    return evaluated(spark, d)[1].select("query_id", "candidate_id", "rank")


@query(with_("u item lab few", SPLIT_SQL + f", pq AS ({METRIC_SQL.format('ev').replace('round(', '(').replace(', 6)', ')')}), fr AS (SELECT id, median(n) AS m FROM (SELECT id, count(*) OVER (PARTITION BY label) AS n FROM few) GROUP BY id) SELECT CAST((m > 8)::INT + (m > 15)::INT + (m > 20)::INT AS INT) AS bin, count(average_precision) AS n, round(avg(average_precision), 6) AS mean FROM pq JOIN fr ON fr.id = pq.query_id GROUP BY 1"))
def evaluation_by_frequency(spark, d):
    return rounded(evaluation.by_frequency(evaluated(spark, d)[0], pool_labels(spark, d), (8, 15, 20)), "mean")


# Label prediction


@query(with_("lab", "SELECT label, count(DISTINCT id) AS n, row_number() OVER (ORDER BY count(DISTINCT id) DESC, label) AS rank FROM lab GROUP BY label"))
def frequency_prior(spark, d):
    return prediction.frequency_prior(labels(spark, d))


MASKED_SQL = """, least AS (SELECT id, min(label) AS label FROM few GROUP BY id HAVING count(*) >= 2),
  near AS (SELECT q, c, score FROM (SELECT s.q, s.c, score, row_number() OVER (PARTITION BY s.q ORDER BY score DESC, s.c) AS place FROM s JOIN item a ON a.id = s.q JOIN item b ON b.id = s.c WHERE a.book <> b.book) WHERE place <= 10),
  tally AS (SELECT near.q, few.label, round(sum(greatest(score, 0)), 9) AS w FROM near JOIN few ON few.id = near.c GROUP BY ALL),
  open AS (SELECT t.*, row_number() OVER (PARTITION BY t.q ORDER BY w DESC, t.label) AS rank FROM tally t WHERE NOT EXISTS (SELECT 1 FROM few JOIN least USING (id) WHERE few.id = t.q AND few.label = t.label AND few.label <> least.label))"""


def masked(spark, d):
    own = pool_labels(spark, d)
    least = own.groupBy("id").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n >= 2")
    truth = least.select(F.col("id").alias("query_id"), "label")
    visible = own.join(least.select("id", F.col("label").alias("hidden")), "id").where("label <> hidden").select(F.col("id").alias("query_id"), "label")
    pool = vectors(spark, d).select("id", "vector").join(items(spark, d).select("id", "book"), "id")
    return prediction.vote(rows.search(pool, pool, 10, differ=("book",)), own, visible), truth, visible


@query(with_("u s item lab few", MASKED_SQL + " SELECT q AS query_id, label, round(w, 6) AS weight, rank FROM open WHERE rank <= 10"))
def masked_votes(spark, d):
    return rounded(masked(spark, d)[0].where("rank <= 10"), "weight")


@query(with_("u s item lab few", MASKED_SQL + """, first AS (SELECT least.id, min(rank) AS rank FROM least LEFT JOIN open ON open.q = least.id AND open.label = least.label GROUP BY least.id)
  SELECT count(*) AS n_queries, round(avg(coalesce(rank <= 1, false)::INT), 6) AS hits_at_1, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hits_at_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS hits_at_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM first"""))
def masked_recovery(spark, d):
    votes, truth, _ = masked(spark, d)
    return rounded(prediction.prediction_metrics(votes, truth), "hits_at_1", "hits_at_5", "hits_at_10", "mrr")


@query(with_("u s item lab few", """, f AS (SELECT s.q, s.c, score FROM s JOIN item a ON a.id = s.q JOIN item b ON b.id = s.c WHERE a.book <> b.book AND a.stratum = b.stratum),
  k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank, count(*) OVER (PARTITION BY q) AS field FROM f), lap AS (SELECT DISTINCT x.id AS q, y.id AS c FROM few x JOIN few y ON x.label = y.label AND x.id <> y.id)
  SELECT k.q AS query_id, max(field) AS field, min(rank) AS rank FROM k JOIN lap ON lap.q = k.q AND lap.c = k.c GROUP BY k.q"""))
def admitted_rank(spark, d):
    """The field is admitted first and only its pairs are scored."""
    own = items(spark, d).join(vectors(spark, d).select("id"), "id", "left_semi").select("id", "book", "stratum")
    a, b = own.toDF("query_id", "x", "stratum"), own.toDF("candidate_id", "y", "stratum")
    field = a.join(b, "stratum").where("x <> y").select("query_id", "candidate_id")
    return prediction.admitted_ranks(ranking.score_pairs(field, vectors(spark, d)), taxonomy.exact(pool_labels(spark, d)))


@query("SELECT count(*) AS n, round(avg((total - own) / (total - 1)), 6) AS floor FROM (SELECT o_orderkey AS id, count(*) OVER (PARTITION BY o_orderstatus) AS own, count(*) OVER () AS total FROM orders) WHERE id IN (SELECT l_orderkey FROM lineitem)")
def other_kind_floor(spark, d):
    return rounded(prediction.other_kind_floor(items(spark, d), labels(spark, d), "status"), "floor")


@query(with_("region_rows", "SELECT id, region_index, place FROM (SELECT id, region_index, row_number() OVER (PARTITION BY id ORDER BY area DESC, region_index) AS place FROM region_rows) WHERE place <= 2"))
def largest_regions(spark, d):
    return prediction.largest(regions(spark, d), 2).select("id", "region_index", "place")


@query(with_("region_rows lab", """, sg AS (SELECT DISTINCT id, sign FROM region_rows), w AS (SELECT sign, count(*) AS m FROM sg GROUP BY sign), n AS (SELECT count(DISTINCT id) AS n FROM lab), b AS (SELECT label, count(*) / (SELECT n FROM n) AS base FROM lab GROUP BY label),
  t AS (SELECT sign, label, count(*) AS n FROM sg JOIN lab USING (id) GROUP BY ALL HAVING count(*) >= 5), l AS (SELECT t.sign, t.label, t.n, t.n / m AS share, base, round(t.n / m / base, 9) AS lift FROM t JOIN w USING (sign) JOIN b USING (label))
  SELECT sign, label, n, round(share, 6) AS share, round(base, 6) AS base, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY lift DESC, label) AS place FROM l WHERE lift >= 1.05) WHERE place <= 5"""))
def sign_associations(spark, d):
    return rounded(prediction.associations(regions(spark, d), labels(spark, d), 1.05), "share", "base", "lift")


@query(tax("tree dag", """, own AS (SELECT DISTINCT node, ancestor FROM cl WHERE node[1] = 'S'), size AS (SELECT node, count(*) AS n FROM own GROUP BY node), k AS (SELECT x.node AS a, y.node AS b, count(*) AS k FROM own x JOIN own y ON x.ancestor = y.ancestor AND x.node < y.node GROUP BY ALL)
  SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM k JOIN size x ON x.node = a JOIN size y ON y.node = b"""))
def ancestor_jaccard(spark, d):
    paths = taxonomy.closure(spark, X.taxonomy(spark, d, True))
    return rounded(prediction.ancestor_jaccard(paths, paths.where("node LIKE 'S%'").select(F.col("node").alias("id"))), "jaccard")


@query(with_("uv vg item lab", PAIR_SQL + """, b2 AS (SELECT * FROM best WHERE place <= 250), sh AS (SELECT DISTINCT b2.q, b2.c FROM b2 JOIN lab l ON l.id = b2.q JOIN lab m ON m.id = b2.c AND m.label = l.label)
  SELECT class, count(*) AS n, round(avg((a.book <> b.book)::INT), 6) AS cross, round(avg((sh.q IS NOT NULL)::INT), 6) AS shared FROM b2 JOIN item a ON a.id = b2.q JOIN item b ON b.id = b2.c LEFT JOIN sh ON sh.q = b2.q AND sh.c = b2.c GROUP BY class""".replace(" AS cross,", ' AS "cross",')))
def pair_class_composition(spark, d):
    chosen = chosen_pairs(spark, d).select("query_id", "candidate_id", "class")
    return rounded(prediction.class_composition(chosen, items(spark, d), pool_labels(spark, d)), "cross", "shared")


# Catalogue


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS collection, count(*) AS total, count(n) AS labelled, CAST(coalesce(sum(n), 0) AS BIGINT) AS assignments, round(coalesce(sum(n) / nullif(count(n), 0), 0), 6) AS mean_labels FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1")
def label_coverage(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"))
    return rounded(catalogue.label_coverage(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id"))), "mean_labels")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 4 = 1 AND contains(lower(p_name || ' ' || p_type), 'ring') AND list_contains(string_split(p_type, ' '), 'ECONOMY')")
def facet_search(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("size"), "p_name", "p_type", F.split("p_type", " ").alias("types"))
    return catalogue.facets(p, {"size": 1}, {"types": "ECONOMY"}, "RING", ("p_name", "p_type")).select("id")


@query(with_("u s r item lab", """, hub AS (SELECT label FROM lab GROUP BY label HAVING count(*) <= 610), rare AS (SELECT lab.* FROM lab SEMI JOIN hub USING (label)), top AS (SELECT q, c, rank FROM r WHERE rank <= 10)
  SELECT q AS query_id, c AS candidate_id, rank, EXISTS (SELECT 1 FROM rare l JOIN rare m USING (label) WHERE l.id = q AND m.id = c) AS subject, coalesce(a.book = b.book, false) AS same_book, coalesce(a.stratum = b.stratum, false) AS same_stratum, coalesce(a.y = b.y, false) AS same_y,
  coalesce(a.book <> b.book, false) AS other_book, coalesce(a.stratum <> b.stratum, false) AS other_stratum, coalesce(a.y <> b.y, false) AS other_y FROM top LEFT JOIN item a ON a.id = q LEFT JOIN item b ON b.id = c"""))
def neighbour_chips(spark, d):
    top = ranking.top_k(vectors(spark, d), vectors(spark, d))
    return catalogue.chips(top, items(spark, d), labels(spark, d), ("book", "stratum", "y"), 610)


PLAIN_SQL = "trim(regexp_replace(regexp_replace(n, '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g'))"
KEYED_SQL = "p_brand || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '(+' || p_size || ')' WHEN 2 THEN '(+' || p_size || ')(' || p_type || ')' ELSE '(a(' || p_size || '))' END"


@query(f"""WITH no AS (SELECT DISTINCT {KEYED_SQL} AS n FROM part), ma AS (SELECT p_brand || CASE WHEN p_size = 1 THEN '(+1)' ELSE '' END AS n, min('Q' || p_partkey) AS t FROM part WHERE p_brand < 'Brand#4' GROUP BY 1)
  SELECT no.n AS notation, coalesce(a.t, b.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'exact' WHEN b.t IS NOT NULL THEN 'normalised' END AS how FROM no LEFT JOIN ma a ON a.n = no.n LEFT JOIN ma b ON b.n = {PLAIN_SQL.replace('(n,', '(no.n,')}""")
def vocabulary_join(spark, d):
    p = table(spark, d, "part")
    keyed = F.expr("concat(p_brand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat('(+', p_size, ')') WHEN 2 THEN concat('(+', p_size, ')(', p_type, ')') ELSE concat('(a(', p_size, '))') END)")
    mapping = p.where("p_brand < 'Brand#4'").select(F.concat("p_brand", F.when(F.col("p_size") == 1, "(+1)").otherwise("")).alias("notation"), F.concat(F.lit("Q"), "p_partkey").alias("target"))
    return catalogue.vocabulary_join(p.select(keyed.alias("notation")), mapping)


@query(with_("lab", "SELECT label, count(DISTINCT id) AS n FROM lab GROUP BY label HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) <= 0.04 * (SELECT count(DISTINCT id) FROM lab)"))
def support_filter(spark, d):
    return catalogue.support_filter(labels(spark, d), 5, 0.04)


FAMILIES = {"cheap": ["ECONOMY", "STANDARD"], "little": ["SMALL", "ECONOMY"], "offered": ["PROMO"]}


@query("SELECT p_partkey AS id, CASE WHEN list_has_any(string_split(p_type, ' '), ['ECONOMY', 'STANDARD']) THEN 'cheap' WHEN list_has_any(string_split(p_type, ' '), ['SMALL', 'ECONOMY']) THEN 'little' WHEN list_has_any(string_split(p_type, ' '), ['PROMO']) THEN 'offered' END AS family FROM part")
def object_families(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), catalogue.family_of(F.split("p_type", " "), FAMILIES).alias("family"))


@query(with_("lab triple", "SELECT DISTINCT id FROM (SELECT head AS id FROM triple UNION SELECT tail FROM triple) WHERE regexp_matches(id, '^[CN][0-9]+$') AND id NOT IN (SELECT 'C' || c_custkey FROM customer)"))
def wanted_ids(spark, d):
    known = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return catalogue.wanted(triples(spark, d), ["head", "tail"], known, "^[CN][0-9]+$")


@query("SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS id FROM embeddings)")
def ids_digest(spark, d):
    return spark.createDataFrame([(catalogue.ids_digest(vectors(spark, d)),)], "digest string")


@query("SELECT doc_id AS id, concat_ws(' ', nullif(trim(lang), ''), nullif(trim(source), ''), nullif(trim(text[1:40]), '')) AS text FROM documents WHERE concat_ws(' ', nullif(trim(lang), ''), nullif(trim(source), ''), nullif(trim(text[1:40]), '')) <> ''")
def text_selection(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.substring("text", 1, 40).alias("opening"))
    return catalogue.text_of(docs, ["lang", "source", "opening"])


@query("SELECT id, round(ln(1 + f), 6) AS log_f, round(ln(1 + o), 6) AS log_o, round(f / (f + o), 6) AS share_f FROM (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F') AS o FROM orders GROUP BY 1)")
def context_features(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "F").alias("o"))
    x = n.select("id", catalogue.with_context(["f", "o"]).alias("x"))
    return rounded(x.select("id", F.col("x")[0].alias("log_f"), F.col("x")[1].alias("log_o"), F.col("x")[2].alias("share_f")), "log_f", "log_o", "share_f")


@query(with_("region_rows", """, m AS (SELECT sign, median(area / 10) AS area, median(extent_x * 4 + 1) AS elongation, median(extent_y * 2) AS solidity, median(centroid_y) AS y, avg((corpus = 'N')::INT) AS dark FROM region_rows GROUP BY sign)
  SELECT sign, 'tache ' || CASE WHEN area < 0.01 THEN 'minuscule' WHEN area < 0.03 THEN 'petite' WHEN area < 0.10 THEN 'moyenne' ELSE 'grande' END || ', ' || CASE WHEN elongation > 2.2 THEN 'très allongée' WHEN elongation > 1.4 THEN 'allongée' ELSE 'compacte' END || ', '
  || CASE WHEN solidity > 0.6 THEN 'pleine' WHEN solidity > 0.35 THEN 'découpée' ELSE 'très découpée' END || ', ' || CASE WHEN dark > 0.6 THEN 'sombre' WHEN dark < 0.4 THEN 'claire' ELSE 'de ton variable' END || ', plutôt ' || CASE WHEN y < 0.38 THEN 'en haut' WHEN y > 0.62 THEN 'en bas' ELSE 'au centre' END AS words FROM m"""))
def shape_phrases(spark, d):
    r = regions(spark, d).select("sign", (F.col("area") / 10).alias("area"), (F.col("extent_x") * 4 + 1).alias("elongation"), (F.col("extent_y") * 2).alias("solidity"), "centroid_y", (F.col("corpus") == "N").alias("dark"))
    return catalogue.shape_words(r)


SLUG_SQL = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')[1:60], '')"


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS volume_id, p_name AS title, array_to_string(string_split(p_name, ' ')[1:3], ' ') AS work_title, {SLUG_SQL.format('p_brand')} AS place, 1400 + p_size * 7 AS year,
  {SLUG_SQL.format('p_type')} AS creator, CASE WHEN {SLUG_SQL.format('p_type')} = {SLUG_SQL.format('p_brand')} THEN 1 ELSE 2 END AS creators FROM part""")
def catalogue_volumes(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.array(F.concat("p_type", F.lit(", first")), F.col("p_brand"), F.col("p_type")).alias("authors"), F.col("p_brand").alias("place"), F.concat(F.lit("in "), (1400 + F.col("p_size") * 7).cast("string")).alias("date"))
    names = F.col("creator_names")
    return catalogue.catalogue_volumes(rows).select("volume_id", "title", "work_title", "place", "year", names[0].alias("creator"), F.size(names).alias("creators"))


# Comparisons


def _two_methods(spark, d):
    rows = []
    for name in "vg":
        half = X.half(spark, d, name)
        own = half.select("id", "label")
        a, b = own.select(F.col("id").alias("query_id"), F.col("label").alias("_a")), own.select(F.col("id").alias("candidate_id"), F.col("label").alias("_b"))
        top = ranking.top_k(half, half).join(a, "query_id").join(b, "candidate_id")
        rows.append(top.groupBy("query_id").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias(name)))
    return rows[0].join(rows[1], "query_id").withColumn("metric", F.lit("precision_at_10"))


@query()
def compare_methods(spark, d):
    """Interval, test and effect sizes of precision at 10 of the two halves."""
    return agreement.compare_methods(_two_methods(spark, d), "metric", "v", "g")


@query(with_("rating", """, x AS (SELECT unit AS key, rating AS x FROM rating WHERE rater = 'quality'), y AS (SELECT doc_id AS key, n_chars % 7 AS y FROM documents), z AS (SELECT x, y FROM x JOIN y USING (key)), c AS (SELECT x, y, count(*) AS n FROM z GROUP BY ALL),
  s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x), n AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(t * (t - 1) / 2) AS tx FROM (SELECT sum(n) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT sum(n) AS t FROM c GROUP BY y))
  SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau FROM s, n, tx, ty"""))
def compare_with_metric(spark, d):
    human = X.ratings(spark, d).where("rater = 'quality'").select(F.col("unit").alias("key"), F.col("rating").alias("value"))
    metric = table(spark, d, "documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") % 7).alias("value"))
    return rounded(agreement.compare_with_metric(human, metric), "tau")
