"""Hand-computed values and properties of the operators outside the corpus tools."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velspar.functions import text
from velspar.operators import agreement, channels, fusion, graph, metrics, pairs, ranking, records, regimes, taxonomy
from velspar.operators.components import connected


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], "id string, vector array<double>")


def test_top_k_ties_go_by_id_and_both_paths_agree(spark, points):
    half = round(math.sqrt(0.5), 6)
    got = rows(ranking.top_k(points, points, 2))
    assert got[:2] == [("a", "b", half, 2), ("a", "d", 1.0, 1)]
    assert [r for r in got if r[0] == "b"] == [("b", "a", half, 1), ("b", "c", half, 2)]
    assert got == rows(ranking.top_k_sql(points, points, 2))
    assert rows(ranking.top_k(points, points, 99)) == rows(ranking.top_k_sql(points, points, 99))
    small = ranking.pair_scores(points, points, block=1)
    assert rows(small) == rows(ranking.pair_scores(points, points))


def test_zero_vector_is_an_error(spark):
    with pytest.raises(Exception, match="zero vector"):
        ranking.pair_scores(*[spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "id string, vector array<double>")] * 2).collect()


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([("q", f"c{k}", k, k in (2, 4)) for k in range(1, 6)] + [("n", "c1", 1, False)], "query_id string, candidate_id string, rank int, relevant boolean")
    got = {r["query_id"]: r for r in metrics.per_query(ranks, (1, 2, 5)).collect()}
    assert got["q"]["reciprocal_rank"] == 0.5 and got["q"]["average_precision"] == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert [got["q"][f"recall_at_{k}"] for k in (1, 2, 5)] == [0, 0.5, 1]
    assert got["n"]["average_precision"] is None and got["n"]["recall_at_1"] is None


def test_ndcg(spark):
    gains = spark.createDataFrame([("q", "a", 1, 0.0), ("q", "b", 2, 1.0), ("z", "a", 1, 0.0)], "query_id string, candidate_id string, rank int, gain double")
    got = dict(rows(metrics.ndcg(gains, metrics.ideal_dcg(gains))))
    assert got["q"] == pytest.approx(1 / math.log2(3)) and got["z"] is None


def test_auc(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, p boolean")
    assert metrics.unpaired_auc(df, "s", "p").first()["auc"] == pytest.approx((2 + 1.5) / 4)
    assert metrics.paired_auc(spark.createDataFrame([(1.0, 0.0), (0.5, 0.5)], "a double, b double"), "a", "b").first()["auc"] == 0.75


def test_fusion_rules(spark):
    s = spark.createDataFrame([("q", "a", 0.9, 0.1), ("q", "b", 0.5, 0.5), ("q", "c", 0.1, 0.9)], "query_id string, candidate_id string, v double, g double")
    get = lambda rule, a: {r["candidate_id"]: r["score"] for r in fusion.fuse(s, rule, a).collect()}
    assert get("linear", 1.0) == {"a": 0.9, "b": 0.5, "c": 0.1}
    assert get("rrf", 0.5)["a"] == pytest.approx(0.5 / 61 + 0.5 / 63) and get("rank_linear", 0.5)["b"] == pytest.approx(0.5)
    assert get("max", 0.5)["c"] == pytest.approx(0.45) and get("product", 0.5)["b"] == pytest.approx(0.5)
    scaled = s.withColumn("v", F.col("v") * 3 + 7)
    for rule in ("rank_linear", "rrf", "product"):  # a monotone rescaling changes nothing
        assert {r["candidate_id"]: round(r["score"], 9) for r in fusion.fuse(scaled, rule, 0.3).collect()} == {k: round(x, 9) for k, x in get(rule, 0.3).items()}
    for bad in (("linear", 1.5), ("none", 0.5)):
        with pytest.raises(ValueError):
            fusion.fuse(s, *bad)
    assert fusion.choose_weight(spark.createDataFrame([(0.25, 0.5), (0.75, 0.5), (1.0, 0.4)], "alpha double, metric double")).first()["alpha"] == 0.75


def test_diamond_taxonomy(spark):
    edges = spark.createDataFrame([("r", "x"), ("r", "y"), ("x", "z"), ("y", "z"), ("y", "w"), ("o", "w")], "parent string, child string")
    paths = taxonomy.closure(spark, edges)
    got = {(a, b): c for a, b, c in rows(paths)}
    assert got["z", "r"] == 2 and got["z", "z"] == 0 and len([k for k in got if k[0] == "z"]) == 4
    assert dict(rows(taxonomy.depth(paths, edges))) == {"r": 0, "o": 0, "x": 1, "y": 1, "z": 2, "w": 1}
    labels = spark.createDataFrame([(1, "z"), (2, "w"), (3, "o")], "id int, label string")
    gain = {(a, b): g for a, b, g in rows(taxonomy.graded(paths, labels))}
    assert gain[1, 2] == pytest.approx(1 / 3) and (1, 3) not in gain and gain[2, 3] == pytest.approx(0.5)
    near = {(a, b): c for a, b, c in rows(taxonomy.undirected_distances(spark, edges, 3))}
    assert near["z", "o"] == 3  # by w, though the two have no ancestor in common
    with pytest.raises(ValueError):
        taxonomy.closure(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string").union(spark.createDataFrame([(str(k), str(k + 1)) for k in range(70)], "parent string, child string")))


def test_notations(spark):
    labels = spark.createDataFrame([("25G(+3)",), ("25G(OAK)(+1)",), ("25G",), ("9(a(b))",), ("none",)], "label string")
    known = spark.createDataFrame([("25G",), ("25G(OAK)",), ("9",)], "node string")
    assert dict(rows(taxonomy.resolve(labels, known))) == {"25G(+3)": "25G", "25G(OAK)(+1)": "25G(OAK)", "25G": "25G", "9(a(b))": "9", "none": None}
    edges = spark.createDataFrame([("2", "25G")], "parent string, child string")
    assert ("25G", "25G(OAK)") in rows(taxonomy.with_keyed_labels(edges, spark.createDataFrame([("25G(OAK)",), ("25G(+3)",)], "label string")))


def test_volumes(spark):
    cases = {"uiuc_alciato_pic12.jpg": "uiuc_alciato", "biblia_12.jpg": None, "bsb00027852_00012.jpg": "bsb00027852", "embhab_q12_12r.jpg": "embhab_q12", "plain.jpg": None, "word_12.jpg": None, "a_b_7.jpg": "a_b"}
    df = spark.createDataFrame([(k,) for k in cases], "f string").select("f", text.volume_of(F.col("f")).alias("v"))
    assert dict(rows(df)) == cases


def test_split_is_stable_and_keeps_groups(spark):
    df = spark.createDataFrame([(k, k // 5 if k % 7 else None) for k in range(400)], "id int, g int")
    out = records.split_records(df, "s", "g")
    assert records.leakage(out, "g").isEmpty() and rows(out) == rows(records.split_records(df.orderBy(F.desc("id")), "s", "g"))
    assert not records.leakage(records.split_records(df, "s"), "g").isEmpty()
    with pytest.raises(ValueError):
        records.split_records(df, "s", None, "id", (0.5, 0.1, 0.1))


def test_combined_groups_are_transitive(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "b", "y")], "id int, p string, q string")
    assert rows(records.combine_groups(spark, df, ["p", "q"])) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


@pytest.mark.parametrize("threshold", [0, 3, 9])
def test_banding_misses_no_pair(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [(k, np.int64(np.uint64(h)).item()) for k, h in enumerate(h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for h in base for _ in range(4))]
    values += [(500, values[0][1]), (501, values[0][1]), (502, None)]
    df = spark.createDataFrame(values, "id bigint, hash bigint")
    brute = {(a, b) for a, x in values for b, y in values if a < b and x is not None and y is not None and bin((x ^ y) & (2**64 - 1)).count("1") <= threshold}
    got = {(a, b) for a, b, _ in rows(records.near_pairs(df, threshold))}
    hash_of = dict(values)
    by_value = lambda found: {frozenset((hash_of[a], hash_of[b])) for a, b in found}
    assert got <= brute and by_value(got) == by_value(brute)  # copies meet as a star
    label = {i: i for i, _ in values}
    for a, b in sorted(brute) * 6:
        label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(records.near_groups(spark, df, threshold))) == label


def test_near_pairs_have_every_copy(spark):
    values = [(1, 0b0), (2, 0b0), (3, 0b0), (4, 0b1), (5, 0b1), (6, -1), (7, None)]
    got = sorted(rows(records.near_pairs(spark.createDataFrame(values, "id bigint, hash bigint"), 2)))
    assert got == [(1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 1), (2, 3, 0), (2, 4, 1), (2, 5, 1), (3, 4, 1), (3, 5, 1), (4, 5, 0)]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91)], "a int, b int")
    assert dict(rows(connected(spark, edges))) == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90}


def test_triples(spark):
    r = spark.createDataFrame([(1, "b", 2), (2, "b", 1), (3, "b", None), (4, None, 1)], "id int, book string, position int")
    assert rows(graph.context_triples(r, 1)) == [("1", "adjacent_to", "3"), ("1", "part_of", "b"), ("2", "adjacent_to", "1"), ("2", "part_of", "b"), ("3", "part_of", "b")]
    assert graph.context_triples(r, 0).count() == 3
    with pytest.raises(ValueError):
        graph.context_triples(r, -1)
    t = spark.createDataFrame([("1", "has", "x"), ("2", "has", "1"), ("2", "in", "1")], "head string, relation string, tail string")
    hit = spark.createDataFrame([("1",)], "id string")
    assert [x[3] for x in rows(graph.mask(t, hit, ["has"]))] == [True, False, False] and [x[3] for x in rows(graph.mask(t, hit, ["has"], True))] == [True, True, False]
    assert dict(rows(graph.degrees(t)))["1"] == 3 and tuple(graph.audit(t).first()) == (3, 2, 3)
    with pytest.raises(Exception, match="empty part"):
        graph.normalise(spark.createDataFrame([("a", " ", "b")], "head string, relation string, tail string")).collect()
    assert graph.walks(spark, t, 1, 4).count() == 12 and rows(graph.walks(spark, t, 2, 4, p=0.5, q=2.0)) == rows(graph.walks(spark, t, 2, 4, p=0.5, q=2.0))


def test_krippendorff_and_kendall(spark):
    judge = [("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "a", 2.0), ("u2", "b", 2.0), ("u3", "a", 3.0), ("u3", "b", 3.0), ("u4", "a", 3.0)]
    df = spark.createDataFrame(judge, "unit string, rater string, rating double")
    assert tuple(agreement.krippendorff_alpha(df).first())[0] == pytest.approx(1) and tuple(agreement.krippendorff_alpha(df).first())[3:] == (3, 1)
    assert agreement.krippendorff_alpha(df.withColumn("rating", F.lit(1.0))).first()["alpha"] is None
    tau = lambda p: agreement.kendall_tau_b(spark.createDataFrame(p, "x double, y double")).first()["tau"]
    assert tau([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]) == 1 and tau([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]) == -1 and tau([(1.0, 1.0), (1.0, 2.0)]) is None
    assert tau([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)]) == pytest.approx(1 / 2)


def test_effect_sizes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.5), (4.0, 4.0)], "a double, b double")
    d = np.array([1, 0.5, 0])
    assert agreement.cohens_d(df, "a", "b").first()["d"] == pytest.approx(d.mean() / d.std(ddof=1))
    a, b = np.array([1, 2, 4]), np.array([0, 1.5, 4])
    assert agreement.cliffs_delta(df, "a", "b").first()["delta"] == pytest.approx(np.sign(a[:, None] - b[None, :]).mean())
    assert agreement.cohens_d(spark.createDataFrame([(1.0, 0.0), (2.0, 1.0)], "a double, b double"), "a", "b").first()["d"] == 0


def test_resampling(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("m", float(x), float(x) - 0.2) for x in rng.normal(size=120)], "g string, a double, b double")
    ci = agreement.bootstrap_ci(df, "g", "a", 1000).first()
    assert ci["low"] < ci["mean"] < ci["high"] and ci == agreement.bootstrap_ci(df, "g", "a", 1000).first()
    p = agreement.permutation_test(df, "g", "a", "b", 500).first()
    assert 0 < p["p"] < 0.01 and p["difference"] == pytest.approx(0.2)


def test_regions(spark):
    box = "id int, region_index int, sign int, area double, centroid_x double, centroid_y double, extent_x double, extent_y double"
    df = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.5, 1.0, 1.0), (1, 1, 1, 0.1, 0.5, 0.5, 0.2, 0.2), (1, 2, 1, 0.1, 0.5, 2.0, 0.2, 0.2), (1, 3, 2, 0.1, 0.72, 0.5, 0.2, 0.2), (2, 0, 0, 0.1, 0.0, 0.0, 1.0, 1.0)], box)
    context = {(r["id"], r["region_index"]): r for r in channels.region_context(df).collect()}
    assert context[1, 0]["contains"] == 2 and context[1, 1]["inside"] == 1 and context[1, 0]["above"] == 1 and context[1, 2]["below"] == 3 and context[2, 0]["contains"] == 0
    assert rows(channels.region_groups(spark, df))[:4] == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 1)]
    assert {(a, b): round(c, 6) for a, b, c in rows(channels.repetition(df))} == {(1, "1"): round(2 / 3, 6), (1, "2"): round(1 / 3, 6), (2, "1"): 1.0}
    h = channels.histogram(df, "sign", "area")
    assert sum(r["weight"] ** 2 for r in h.where("id = 1").collect()) == pytest.approx(1)


def test_pairs(spark):
    s = spark.createDataFrame([(1, 2, 0.9, 1.0), (2, 1, 0.9, 1.0), (1, 3, 0.9, 0.1), (1, 4, 0.1, 0.9), (2, 3, 0.5, 0.5), (2, 4, 0.0, 0.0)], "query_id int, candidate_id int, visual double, semantic double")
    got = pairs.select_pairs(s.withColumn("class", pairs.pair_class("visual", "semantic", 0.8, 0.2)).where("class is not null"))
    assert {(r["query_id"], r["candidate_id"]): r["class"] for r in got.collect()} == {(1, 2): "easy_positive", (1, 3): "hard_negative", (1, 4): "hard_positive", (2, 4): "easy_negative"}
    with pytest.raises(ValueError):
        pairs.pair_class("visual", "semantic", 0.2, 0.8)
    eligible = spark.createDataFrame([(k, 100, c, 0.5, x) for k in range(10) for c, x in ((200 + k, 0.49), (300 + k, 0.51), (400 + k, 0.515))], "query_id int, positive_id int, control_id int, target double, score double")
    drawn = pairs.draw_controls(eligible).collect()
    assert len(drawn) == 10 and sum(r["score"] <= r["target"] for r in drawn) == 5


def test_regime_clauses_ignore_unknown_values(spark):
    items = spark.createDataFrame([(1, "a", "s", "m", 1500), (2, "a", "s", "m", 1500), (3, None, "t", "m", 1600)], "id int, book string, stratum string, status string, y int")
    scores = spark.createDataFrame([(a, b, 0.5) for a in (1, 2, 3) for b in (1, 2, 3) if a != b], "query_id int, candidate_id int, score double")
    labels = spark.createDataFrame([(1, "x"), (3, "x"), (2, "y")], "id int, label string")
    get = lambda m, n: {(r[0], r[1]) for r in regimes.search(scores, items, labels, m, n, 9).collect()}
    assert get(["subject"], []) == {(1, 3), (3, 1)} and get(["same_place"], []) == {(1, 2), (2, 1)} and get([], ["other_book"]) == set() and get([], ["other_year"]) == {(1, 3), (2, 3), (3, 1), (3, 2)}


def test_names(spark):
    a = spark.createDataFrame([(1, "ship"), (1, "sea"), (2, "ship"), (3, "dog")], "id int, word string")
    b = spark.createDataFrame([(1, "ship"), (2, "tree"), (4, "dog")], "id int, word string")
    assert rows(agreement.name_agreement(a, b)) == [(1, 0.5, 1), (2, 0.0, 0)]
    lift = {r["word"]: r for r in agreement.name_lift(a, b).collect()}
    assert lift["ship"]["confirmed"] == 0.5 and lift["ship"]["lift"] == 1.0 and lift["sea"]["lift"] is None


def test_pooling_and_assignment(spark):
    import itertools

    from velspar.operators import pooling

    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "z"), (3, "z")], "id int, label string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, vector array<double>")
    got = {r["id"]: r for r in pooling.mean_pool(labels, vectors).collect()}
    assert [round(x, 6) for x in got[1]["vector"]] == [round(math.sqrt(0.5), 6)] * 2 and got[2]["vector"] == [1.0, 0.0] and 3 not in got
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (3, 5), (4, 6)):
        cost = rng.normal(size=(n, m))
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        chosen = pooling.assign(cost)
        assert len(set(chosen)) == n and sum(cost[i, j] for i, j in enumerate(chosen)) == pytest.approx(best)
    df = spark.createDataFrame([(k, float(k % 3)) for k in range(8)], "id int, v double")
    assert [r["band"] for r in pooling.terciles(df, "v").orderBy("place").collect()] == [0, 0, 1, 1, 2, 2, 2, 2]
    white = spark.range(1).select(pooling.lab(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("x")).first()["x"]
    assert white == pytest.approx([100, 0, 0], abs=0.01)
