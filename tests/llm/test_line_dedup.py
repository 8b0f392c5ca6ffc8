"""Line dedup against its SQL and on edge cases."""

import random

import duckdb
import pytest

from velspar.llm import line_dedup as L

ROWS = [(3, "x\ny\nz\nw"), (1, "p\nx\ny\nz\nw\nq"), (2, None), (4, ""), (5, "x\ny\nz\nw\nx\ny\nz\nw"), (6, "é\n\n\né\n\n\n"), (7, "\n" * 50), (8, "a\n" * 300), (9, " \t\nx\n\r\ny"), (10, "x\n\r\ny\nk"), (11, "one")]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def shuffled(seed, n=60):
    """Texts made of common passages, common lines, blank lines and lines of their own."""
    rng = random.Random(seed)
    passages = [[f"passage {p} line {k} {rng.random()}" for k in range(rng.randrange(1, 30))] for p in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(8)):
            part = rng.choice(passages)
            a = rng.randrange(len(part))
            lines += rng.choice([part, part[a:], [rng.choice(["", " ", "common", "too"]) for _ in range(3)], [f"own {i} {rng.random()}" for _ in range(rng.randrange(6))]])
        rows.append((i, "\n".join(lines)))
    return rows


def check(spark, tmp_path, rows):
    frame(spark, rows).write.mode("overwrite").parquet(str(tmp_path / "d"))
    expected = duckdb.connect().sql(L.line_dedup_sql(f"'{tmp_path}/d/*.parquet'")).fetchall()
    assert sorted(map(tuple, L.line_dedup(spark, spark.read.parquet(str(tmp_path / "d"))).collect())) == sorted(expected)


@pytest.mark.parametrize("rows", [ROWS, shuffled(1), shuffled(2)])
def test_against_sql(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_hot_keys_and_salts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SALT", 3)
    monkeypatch.setattr(L, "HOT", 20)
    check(spark, tmp_path, shuffled(3) + [(1000 + k, "the\nsame\nlines\neverywhere") for k in range(40)])


@pytest.mark.parametrize("size", [2, 3, 4, 6, 10, 50])
def test_planted_blocks_are_found(spark, size):
    """Blocks inside unlike documents: every line of the later ones goes, nothing else."""
    rng = random.Random(size)
    block = [f"block line {k}" for k in range(size)]
    rows = []
    for i in range(50):
        own = [f"own {i} {k} {rng.random()}" for k in range(20)]
        at = rng.randrange(21)
        rows.append((i, "\n".join(own[:at] + block + own[at:])))
    got = {r["doc_id"]: r for r in L.line_dedup(spark, frame(spark, rows)).collect()}
    assert sum(r["n_removed"] for r in got.values()) == 49 * size and got[0]["n_removed"] == 0
    assert not any("block" in got[i]["text"] or got[i]["text"].count("own") != 20 for i in range(1, 50))


def test_chunks_have_two_lines_and_survive_insertions(spark):
    lines = [f"line {k}" for k in range(400)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines])), (3, "\n".join(lines[:200] + ["new"] + lines[200:]))]
    chunks = {}
    for r in L.chunked(L.identified(spark, frame(spark, rows))).collect():
        chunks.setdefault(r["id"], []).append(r)
    for own in chunks.values():
        assert all(r["last"] > r["first"] for r in sorted(own, key=lambda r: r["first"])[:-1]) and 40 < len(own) < 130
    keys = {i: {r["key"] for r in own} for i, own in chunks.items()}
    assert len(keys[1] & keys[2]) >= len(keys[1]) - 3 and len(keys[1] & keys[3]) >= len(keys[1]) - 3


def test_repeated_rows_nulls_and_extra_columns(spark):
    rows = [(1, "x\ny\nz\nw", 7, "k"), (1, "x\ny\nz\nw", 7, "k"), (2, "x\ny\nz\nw", 7, None), (None, "x\ny\nz\nw", 7, "n"), (3, None, None, None)]
    docs = frame(spark, rows, "doc_id bigint, text string, n_chars bigint, key string")
    out = L.remove_repeats(spark, docs)
    assert out.columns == docs.columns
    got = sorted(((r[0], r[1], r[2]) for r in out.collect()), key=str)
    assert got == sorted([(1, "x\ny\nz\nw", 7), (1, "", 0), (2, "", 0), (None, "", 0), (3, None, None)], key=str)
    assert sorted((r[0] for r in L.remove_repeats(spark, docs, drop_emptied=True).collect()), key=str) == [1, 3]
    clash = frame(spark, [(1, "a\nb", 1, 2), (2, "a\nb", 3, 4)], "doc_id bigint, text string, id int, first int")
    assert sorted(map(tuple, L.remove_repeats(spark, clash).collect())) == [(1, "a\nb", 1, 2), (2, "", 3, 4)]
    assert L.line_dedup(spark, docs.limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = L.line_dedup(spark, frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
