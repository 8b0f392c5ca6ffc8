"""Evaluation, prediction, catalogue functions and comparisons on small cases."""

import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from velspar.functions import text
from velspar.operators import agreement, catalogue, evaluation, prediction
from velspar.plans import evaluation as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_alignment(spark):
    table, manifest = spark.createDataFrame([("b",), ("a",), ("z",)], "id string"), spark.createDataFrame([("a", "t"), ("b", "v")], "id string, split string")
    with pytest.raises(ValueError, match="without a record: z"):
        evaluation.check_alignment(table, manifest)
    with pytest.raises(ValueError, match="more than once: a"):
        evaluation.check_alignment(table, manifest.union(manifest.where("id = 'a'")))
    assert {r["id"] for r in evaluation.select_ids(table, manifest, None).collect()} == {"a", "b"} and evaluation.select_ids(table, manifest, "t").count() == 1


def test_votes_and_metrics(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.4), (1, 4, -0.5), (5, 2, 0.2)], "query_id int, candidate_id int, score double")
    labels = spark.createDataFrame([(2, "x"), (2, "y"), (3, "y"), (4, "z"), (3, "w")], "id int, label string")
    votes = prediction.vote(near, labels, spark.createDataFrame([(1, "w")], "query_id int, label string"))
    got = {(r["query_id"], r["label"]): (r["weight"], r["rank"]) for r in votes.collect()}
    assert got == {(1, "y"): (1.3, 1), (1, "x"): (0.9, 2), (1, "z"): (0.0, 3), (5, "x"): (0.2, 1), (5, "y"): (0.2, 2)}
    m = prediction.prediction_metrics(votes, spark.createDataFrame([(1, "x"), (5, "q")], "query_id int, label string")).first()
    assert (m["n_queries"], m["hits_at_1"], m["hits_at_5"], m["mrr"]) == (2, 0.0, 0.5, 0.25)


def test_manifests(spark):
    payload = {
        "metadata": [
            {"label": "Title", "value": "<b>Emblemata</b>  nova"}, {"label": [{"@language": "de", "@value": "Ort"}, {"@language": "en", "@value": "Published"}], "value": "Vindelicor[um] : Steyner: et al"},
            {"label": "Date", "value": {"@value": "anno 1531?"}}, {"label": "Creator", "value": "Alciato, Andrea -- <a href='https://d-nb.info/gnd/118501844'>GND</a>"}, {"label": "Contributor", "value": "Alciato, A. -- x"}, {"label": "Empty", "value": []},
        ]
    }
    rows = catalogue.parse_manifests(spark.createDataFrame([("v1", json.dumps(payload)), ("v2", "{}"), ("v3", None)], "volume_id string, payload string")).collect()
    first = rows[0].asDict()
    assert first == {"volume_id": "v1", "title": "Emblemata nova", "work_title": None, "place": "vindelicorum", "printer": "steyner-et-al", "year": 1531, "language": None, "creator_gnds": ["118501844"], "creator_names": ["alciato"]}
    assert [r["volume_id"] for r in rows if r["title"] is None and r["year"] is None] == ["v2", "v3"]


def test_scalars(spark):
    df = spark.createDataFrame([("25F23(LION)(+12(a(b(c(d(e))))))x",), ("((((((a))))))b",), ("plain",), (None,), ("(",)], "n string")
    got = [tuple(r) for r in df.select(text.strip_all_keys(df["n"]), text.strip_structural_keys(df["n"])).collect()]
    assert got == [("25F23x", "25F23(LION)(+12(a(b(c(d(e))))))x"), ("b", "((((((a))))))b"), ("plain", "plain"), (None, None), ("(", "(")]
    assert text.slug_of("[Heidelberg] (Ünïon)") == "heidelberg-union" and text.slug_of("vindelicor[um]") == "vindelicorum" and text.slug_of("--") is None
    assert text.slug_of("a" * 59 + " b") == "a" * 59 + "-" and text.slug_of(None) is None


def test_families_and_texts(spark):
    df = spark.createDataFrame([(1, ["a", "c"], "x", " "), (2, ["b"], None, "y"), (3, [], "", None), (4, None, " p ", "q")], "id int, t array<string>, m string, s string")
    got = {r["id"]: r["f"] for r in df.select("id", catalogue.family_of(df["t"], {"one": ["b"], "two": ["a", "b"]}).alias("f")).collect()}
    assert got == {1: "two", 2: "one", 3: None, 4: None}
    assert {r["id"]: r["text"] for r in catalogue.text_of(df, ["m", "s"]).collect()} == {1: "x", 2: "y", 4: "p q"}


def test_methods_against_direct(spark):
    rng = np.random.default_rng(4)
    a = rng.random(40)
    b = a - 0.05 + rng.normal(0, 0.05, 40)
    rows = [("m", float(x), float(y)) for x, y in zip(a, b, strict=True)] + [("m", None, 0.5), ("same", 0.5, 0.5), ("same", 0.25, 0.25)]
    got = {r["metric"]: r for r in agreement.compare_methods(spark.createDataFrame(rows, "metric string, v double, g double"), "metric", "v", "g", 500, 500).collect()}
    d, r = a - b, got["m"]
    assert r["mean_difference"] == pytest.approx(d.mean()) and r["cohens_d"] == pytest.approx(d.mean() / d.std(ddof=1)) and r["n"] == 40
    assert r["cliffs_delta"] == pytest.approx(np.sign(a[:, None] - b[None, :]).mean()) and r["low"] < d.mean() < r["high"] and r["excludes_zero"] and r["p"] < 0.05
    assert (got["same"]["mean_difference"], got["same"]["p"], got["same"]["cohens_d"], got["same"]["excludes_zero"]) == (0.0, 1.0, 0.0, False)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, relation = entry.queries()[name](spark, sf), db.sql(plans.ORACLE[name])
    assert sorted(relation.columns) == sorted(got.columns)
    order = [relation.columns.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[k] for k in order) for r in relation.fetchall()), key=key)
    for x, y in zip(sorted(map(tuple, got.collect()), key=key), want, strict=True):
        assert x == pytest.approx(y)
