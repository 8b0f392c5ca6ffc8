"""Whole rows of scores against direct computations, and queries that must not pass on all pairs."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from velspar.operators import metrics, pairs, ranking, rows
from velspar.plans import fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries over all pairs of vectors; their tasks score whole rows.
WHOLE_ROWS = [
    "evaluate_split",
    "evaluation_by_frequency",
    "masked_recovery",
    "search_regime_subject_other_book",
    "search_regime_year",
    "stratified_metrics",
    "subject_kind_breakdown",
    "cross_medium_partners",
    "best_partner_rank",
    "retrieval_metrics_exact",
    "search_regime_medium",
    "search_regime_other_medium_same_subject",
    "bootstrap_ci",
    "cliffs_delta",
    "cohens_d",
    "hard_pairs",
    "late_fusion",
    "matched_control_candidates",
    "matched_controls",
    "max_rule",
    "pair_class_composition",
    "paired_auc",
    "permutation_test",
]


@pytest.mark.parametrize("name", WHOLE_ROWS)
def test_no_query_passes_on_all_pairs(spark, sf, name, monkeypatch):
    real = ranking.pair_scores

    def few(queries, candidates, digits=6, best=None, **other):
        assert best is not None or queries.count() <= 250, "all pairs leave the tasks"
        return real(queries, candidates, digits, best, **other)

    monkeypatch.setattr(ranking, "pair_scores", few)
    got = entry.queries()[name](spark, sf)
    found = [tuple(r) for r in got.collect()]
    if name in entry.oracle_sql():
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        relation = db.sql(entry.oracle_sql()[name])
        order = [relation.columns.index(c) for c in got.columns]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(found, key=key) == sorted((tuple(r[k] for k in order) for r in relation.fetchall()), key=key)


def test_rows_with_nulls_ties_and_text_ids(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1, 3, (60, 3)) + np.array([0, 0, 5])  # many equal cosines
    labels = [None if k % 7 == 0 else "ab"[k % 2] for k in range(60)]
    items = spark.createDataFrame([(f"i{k:02}", [float(x) for x in v], x) for k, (v, x) in enumerate(zip(vectors, labels, strict=True))], "id string, vector array<double>, label string")
    keyed = items.selectExpr("id", "vector", "case when label is not null then array(label) end as keys")
    a, b = items.selectExpr("id query_id", "label x"), items.selectExpr("id candidate_id", "label y")
    ranks = ranking.ranked(ranking.pair_scores(items, items)).join(a, "query_id").join(b, "candidate_id").selectExpr("*", "x = y as relevant")
    want = {r["query_id"]: r for r in metrics.per_query(ranks).collect()}
    got = {r["query_id"]: r for r in rows.label_metrics(keyed, keyed).collect()}
    assert set(got) == set(want) and any(r["n_relevant"] is None for r in want.values())
    for q, r in want.items():
        assert [c for c in r.__fields__ if r[c] is None] == [c for c in r.__fields__ if got[q][c] is None]
        assert all(got[q][c] == pytest.approx(r[c]) for c in r.__fields__[1:] if r[c] is not None)
    best = {(r["query_id"], r["candidate_id"], r["score"], r["rank"]) for r in ranking.ranked(ranks.where("x <> y").select("query_id", "candidate_id", "score")).where("rank <= 4").collect()}
    assert {tuple(r) for r in rows.search(items, items, 4, differ=("label",)).collect()} == best
    partner = ranking.best_partner_ranks(ranks.select("query_id", "candidate_id", "score"), ranks.where("x = y"))
    assert {tuple(r) for r in rows.best_partner(keyed.withColumn("k", items["id"]), keyed.withColumn("k", items["id"]), ("k",)).collect()} == {tuple(r) for r in partner.collect()}


def test_rows_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id bigint, vector array<float>, keys array<string>")
    assert rows.label_metrics(none, none).count() == 0 and rows.search(none, none, 3, True).count() == 0


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_no_group_of_queries_gets_its_own_copy_of_the_candidates(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1300, 64)))], "id bigint, vector array<float>").write.parquet(str(tmp_path / "v"))
    items = spark.read.parquet(str(tmp_path / "v"))
    before = shuffled(spark)
    assert rows.search(items, items, 3).count() == 3900
    assert shuffled(spark) - before < 3 * 1300 * 64 * 4


def test_controls_beside_the_scores_are_those_of_the_joins(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.integers(-2, 3, (80, 4)) + np.array([0, 0, 0, 7]))], "id bigint, vector array<double>")
    strata = spark.createDataFrame([(k, None if k % 9 == 0 else "xy"[k % 2]) for k in range(75)], "id bigint, stratum string")  # the last five are unknown
    labels = spark.createDataFrame([(k, f"l{m}") for k in range(80) if k % 4 for m in {k % 5, k % 7}], "id bigint, label string")
    scores = ranking.pair_scores(vectors, vectors)
    chosen = scores.where("(query_id % 6 = 0 or query_id = 77) and candidate_id % 11 = 4").withColumnRenamed("score", "visual")
    held = labels.groupBy("id").agg(F.collect_list("label").alias("keys"))
    pool = vectors.join(strata, "id").join(held, "id", "left")
    want = {tuple(r) for r in pairs.eligible_controls(chosen, scores, strata, labels).collect()}
    assert len(want) > 20 and {tuple(r) for r in rows.controls(chosen, pool).collect()} == want


def test_queries_that_are_the_candidates_are_not_shuffled_beside_them(spark, tmp_path):
    rng = np.random.default_rng(4)
    spark.createDataFrame([(f"i{k // 2}", [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1300, 64)))], "id string, vector array<float>").write.parquet(str(tmp_path / "v"))
    items = spark.read.parquet(str(tmp_path / "v"))  # every id twice
    before = shuffled(spark)
    got = sorted(tuple(r) for r in rows.search(items, items, 3).collect())
    assert shuffled(spark) - before < 1.5 * 1300 * 64 * 4
    assert got == sorted(tuple(r) for r in rows.search(items.select("*"), items, 3).collect()) and len(got) == 3900


def test_precisions_by_several_vectors_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    data = [(k, *([float(x) for x in v] for v in rng.integers(-1, 3, (2, 3)) + np.array([0, 0, 5])), None if k % 7 == 0 else [] if k % 11 == 0 else ["ab"[k % 2]]) for k in range(70)]
    items = spark.createDataFrame(data, "id bigint, v array<double>, g array<double>, keys array<string>")
    want = {n: {r["query_id"]: r["average_precision"] for r in rows.label_metrics(own, own).collect()} for n in "vg" for own in [items.selectExpr("id", f"{n} as vector", "keys")]}
    got = rows.average_precisions(items, ("v", "g")).collect()
    assert len(got) == 70 and all((r["v"], r["g"]) == (want["v"][r["query_id"]], want["g"][r["query_id"]]) for r in got)


@pytest.mark.parametrize("name", ["cliffs_delta", "cohens_d", "permutation_test"])
def test_both_halves_are_scored_in_one_pass(spark, sf, name, monkeypatch):
    real, calls = rows.score_rows, []
    monkeypatch.setattr(rows, "score_rows", lambda *a, **b: calls.append(a) or real(*a, **b))
    assert entry.queries()[name](spark, sf).count() == 1 and len(calls) == 1


def test_cliffs_delta_runs_the_scoring_once(spark, sf):
    plan = entry.queries()["cliffs_delta"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow each(") == 1  # not once for each side of a union


def test_fused_scores_are_ranked_beside_the_cosines(spark, sf, monkeypatch):
    monkeypatch.setattr(ranking, "ranked", lambda *_: pytest.fail("chosen pairs are shuffled to be ranked"))
    assert entry.queries()["max_rule"](spark, sf).where("rank = 10").count() == 500


@pytest.mark.parametrize("name", ["cross_medium_partners", "best_partner_rank", "search_regime_medium", "search_regime_other_medium_same_subject", "paired_auc"])
def test_rows_of_what_has_no_vector_are_not_shuffled(spark, sf, name, tmp_path, monkeypatch):
    db, big = duckdb.connect(), sf.replace("sf0.001", "sf0.01")
    db.sql(f"SELECT * FROM '{sf}/embeddings.parquet' WHERE vec_id < 120").write_parquet(str(tmp_path / "embeddings.parquet"))
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        db.sql(f"SELECT {key} + k * 15000 AS {key}, * EXCLUDE ({key}, k) FROM '{big}/{t}.parquet', range(8) t(k)").write_parquet(str(tmp_path / f"{t}.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        few = {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert shuffled(spark) - before < 500_000
        monkeypatch.setattr(fixtures, "POOL_IDS", 10)
        assert {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()} == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ranks_from_32_bits_are_those_of_a_sort_by_score_and_position():
    rng = np.random.default_rng(9)
    for size in (1, 2, 700, 1025, 30_000):
        for scores in (rng.normal(0, 0.2, size).clip(-1, 1), rng.integers(-3, 4, size) / 3, np.round(rng.normal(0, 2e-4, size), 7)):  # few and many equal ones
            shares, own = np.flatnonzero(rng.random(size) < 0.3), slice(size // 2, size // 2 + 1)
            by_rank = np.lexsort((np.arange(size), -np.round(scores, 6)))
            by_rank = by_rank[by_rank != own.start]
            got = rows._places(SimpleNamespace(own=own), scores, shares)
            assert got is None if size == 1 else got.tolist() == (np.flatnonzero(np.isin(by_rank, shares)) + 1).tolist()


def row_of_100(product):
    """The row of the first of 100 items with keys of two items each and an attribute of two values."""
    rng = np.random.default_rng(2)
    units, codes = ranking.unit_rows(rng.normal(size=(100, 4))), {"k": np.arange(100) // 3 % 2}
    side = rows.Side(np.arange(100), {}, codes, [units], [np.array([0, 1])])
    holders = [np.array([0, 7]), np.array([0, 9])]
    return rows.Row(0, side, side, slice(0, 1), lambda wanted: np.unique(np.concatenate([holders[w] for w in wanted])), product, 6), units


def test_few_admitted_candidates_are_scored_without_the_whole_row():
    row, units = row_of_100(lambda _: pytest.fail("the whole row is scored"))
    assert row.score(np.array([7, 9])).tolist() == np.round(units[[7, 9]] @ units[0], 6).tolist()


def test_admitted_are_positions_of_what_shares_a_key():
    row, units = row_of_100(lambda k: [units[k]])
    assert row.admitted(True, (), ("k",)).tolist() == [9] and row.admitted(True, ("k",), ()).tolist() == [7]
    assert row.admitted(False, (), ("k",)).tolist() == np.flatnonzero(np.arange(100) // 3 % 2).tolist()


def test_best_partner_and_search_with_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(12)
    data = [(k // 2, [float(x) for x in v], None if k % 9 == 0 else ["ab"[k % 2], f"c{k % 30}"], None if k % 7 == 0 else "xyz"[k % 3]) for k, v in enumerate(rng.integers(-1, 2, (90, 3)) + np.array([0, 0, 3]))]
    unit = ranking.unit_rows([r[1] for r in data])
    scores = np.round(unit @ unit.T, 6)
    rank, found = [], []
    for q in range(90):
        others = sorted((c for c in range(90) if data[c][0] != data[q][0]), key=lambda c: (-scores[q, c], data[c][0], c))
        ok = [c for c in others if data[q][2] and data[c][2] and set(data[q][2]) & set(data[c][2]) and data[q][3] and data[c][3] and data[q][3] != data[c][3]]
        rank += [(data[q][0], others.index(ok[0]) + 1)] if ok else []
        found += [(data[q][0], data[c][0], scores[q, c], k + 1) for k, c in enumerate(ok[:4])]
    items = spark.createDataFrame(data, "id bigint, vector array<double>, keys array<string>, k string").coalesce(1)
    assert sorted(tuple(r) for r in rows.best_partner(items, items, ("k",)).collect()) == sorted(rank) and len(rank) > 40
    assert sorted(tuple(r) for r in rows.search(items, items, 4, True, (), ("k",)).collect()) == sorted(found)
