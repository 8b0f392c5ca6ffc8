"""The contract's functions, and queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from velspar.plans import retrieval, structure

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["topk_cosine", "retrieval_metrics_exact", "rrf", "hard_pairs", "near_dup_groups", "taxonomy_closure", "graded_relevance", "context_triples", "region_groups", "krippendorff_alpha", "search_regime_subject", "combine_group_keys"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKED) <= set(retrieval.QUERIES) | set(structure.QUERIES)


def test_queries_without_the_subpackage(monkeypatch):
    import sys

    everything = set(entry.queries())
    monkeypatch.setitem(sys.modules, "velspar.llm.registry", None)  # an import of it fails
    assert {n for n in everything if not n.startswith("op") and n != "pipeline"} == set(entry.queries()) > set(CHECKED)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from velspar import session

    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    relation = db.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == sorted(got.columns)
    order = [relation.columns.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[k] for k in order) for r in relation.fetchall()), key=key)
