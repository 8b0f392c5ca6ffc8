"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from velspar.llm import near_dup as N
from velspar.operators.components import connected as components

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "a b c d e f"), (None, "a b c d e")]


def brute(rows):
    sets = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1] or ""), reverse=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a] & sets[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        for a in sets:
            if label[label[a]] != label[a]:
                label[a], changed = label[label[a]], True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def family(seed, groups=6, copies=12, words=60, edits=4):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize("rows", [EDGES, family(1), family(2, 2, 30, 40, 2), family(3, 3, 25, 30, 3)])
def test_against_brute_force(spark, rows):
    got = N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got if r[0] is not None} == brute(rows)
    assert sorted(map(str, (r[1:] for r in got if r[0] is None))) == sorted(str((1, None, True)) for r in rows if r[0] is None)
    assert len(got) == len({r[0] for r in rows if r[0] is not None}) + sum(r[0] is None for r in rows)


def test_kept_row_is_the_one_that_was_judged(spark):
    docs = spark.createDataFrame([(1, "b b b b b b", 1), (1, "a a a a a a", 2), (1, None, 3), (2, "b b b b b b", 4)], "doc_id bigint, text string, n int")
    assert sorted(r["n"] for r in N.keep_first(spark, docs).collect()) == [2, 4]


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.near_duplicates(spark, docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 5, "k"), (2, "a b c", 6, "k"), (None, "a b c", 7, "k")], "doc_id bigint, text string, hub int, key string")
    kept = N.keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] or 0, r[2]) for r in kept.collect()) == [(0, 7), (1, 5)]


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    table = N.probes(128)
    for size in (3, 40, 400):
        same = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, size * 5 // 4 + 1, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(pool[: size + 1]), np.unique(pool[len(pool) - size - 1 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((N.signature(a, table) == N.signature(b, table)).mean() - true)
        assert abs(np.mean(same)) < 0.06


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r[0]: r[1] for r in components(spark, edges).collect()} == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}
