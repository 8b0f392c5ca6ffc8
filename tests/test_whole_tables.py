"""Queries without SQL read whole tables: compared with direct computations on the smallest tables."""

import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from velspar.operators import agreement
from velspar.plans import more, retrieval


def held(sf):
    out = defaultdict(set)
    for i, label in duckdb.sql(f"SELECT l_orderkey, 'S' || l_suppkey FROM '{sf}/lineitem.parquet'").fetchall():
        out[i].add(label)
    return out


def test_matched_controls_share_no_label(spark, sf, tmp_path):
    db, big = duckdb.connect(), sf.replace("sf0.001", "sf0.01")  # with 500 vectors as well, but with hard positives
    db.sql(f"SELECT vec_id + 1000 AS vec_id, embedding, label FROM '{big}/embeddings.parquet'").write_parquet(str(tmp_path / "embeddings.parquet"))
    db.sql(f"SELECT o_orderkey + 1000 AS o_orderkey, * EXCLUDE o_orderkey FROM '{big}/orders.parquet'").write_parquet(str(tmp_path / "orders.parquet"))
    db.sql(f"SELECT l_orderkey + 1000 AS l_orderkey, l_orderkey % 3 AS l_suppkey FROM '{big}/lineitem.parquet'").write_parquet(str(tmp_path / "lineitem.parquet"))
    got, own = retrieval.matched_controls(spark, str(tmp_path)).collect(), held(tmp_path)
    assert got and not any(own[r["query_id"]] & own[r["control_id"]] for r in got)


def test_adjacency_svd_has_the_whole_graph(spark, sf):
    n = Counter((a, b) for ls in held(sf).values() for a in ls for b in ls if a != b)
    names = sorted({a for a, _ in n})
    matrix = np.array([[n[a, b] for b in names] for a in names], float)
    got = {r["id"]: r["vector"] for r in more.adjacency_svd(spark, sf).collect()}
    assert sorted(got) == names
    x = np.array([got[k] for k in names])
    top = np.sort(np.abs(np.linalg.eigvalsh(matrix)))[::-1][: x.shape[1]]
    assert abs(np.abs(np.linalg.eigvalsh(x.T @ matrix @ x)).max() - top[0]) < 1e-6 * top[0]


def test_adjacency_svd_keeps_its_pairs_out_of_the_driver(spark, sf, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for way in ("toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, way, lambda *_: pytest.fail("a table came to the driver"))
    assert len(more.adjacency_svd(spark, sf).first()["vector"]) == 8


def test_soft_set_match_has_all_items_of_a_book(spark, sf):
    own = held(sf)
    vector = {f"S{i}": np.array(v, float) / np.linalg.norm(v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()}
    book = dict(duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{sf}/orders.parquet'").fetchall())
    sets = {i: [vector[x] for x in ls if x in vector] for i, ls in own.items() if i in book}
    members = defaultdict(list)
    for i in sorted(i for i, vs in sets.items() if vs):
        members[book[i]].append(i)
    got = {(r["a"], r["b"]): r["score"] for r in more.soft_set_match(spark, sf).collect()}
    assert set(got) == {p for ids in members.values() for p in itertools.combinations(ids, 2)}
    for a, b in sorted(got)[:: max(1, len(got) // 40)]:
        x, y = sorted((sets[a], sets[b]), key=len)
        best = max(np.mean([u @ v for u, v in zip(x, p)]) for p in itertools.permutations(y, len(x)))
        assert abs(got[a, b] - best) < 1e-6


def test_resamples_are_the_operators_own(spark, sf):
    p = retrieval.permutation_test(spark, sf).first()["p"]
    assert abs(p * 10_001 - round(p * 10_001)) < 1e-6
    values = retrieval._paired(spark, sf).selectExpr("'v' AS method", "v AS value")
    want = agreement.bootstrap_ci(values, "method", "value", 10_000).first()
    got = retrieval.bootstrap_ci(spark, sf).where("method = 'v'").first()
    assert (got["low"], got["high"]) == (want["low"], want["high"])
