"""Decontamination against all windows of all items."""

import random
from collections import Counter

import numpy as np
import pytest

from velspar.llm import decontaminate as D
from velspar.llm.texthash import NONWORD, one


def bag(h):
    h = h.tolist()
    return Counter(tuple(h[k : k + 5]) for k in range(len(h) - 4)) if len(h) >= 5 else Counter([tuple(h)] if h else [])


def brute(text, items):
    h, out = one(text, NONWORD), {}
    for i, t in items:
        if t is None or i is None or not len(q := one(t, NONWORD)) or not len(h):
            continue
        size = min(len(q), len(h))
        for s in range(len(h) - size + 1):
            b = bag(h[s : s + size])
            if len(q) < 5:
                b = Counter([tuple(h[s : s + size].tolist())])
            both = sum((b & bag(q)).values())
            out[i] = max(out.get(i, 0), both / (b.total() + bag(q).total() - both))
    return {i: x for i, x in out.items() if x >= 0.75}


def text(rng, n):
    return " ".join(rng.choice("the of a to in on it is at by".split()) + str(rng.randrange(60)) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(k, text(rng, rng.randrange(6, 50))) for k in range(20)] + [(50, "tiny item"), (51, None), (52, ""), (50, "tiny item")]
    rows = [(None, "tiny ITEM here"), (900, None), (901, ""), (902, "a tiny, Item!")]
    for k in range(150):
        own = text(rng, rng.randrange(0, 80)).split()
        if k % 3:
            put = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(4)):
                place = rng.randrange(len(put))
                put[place : place + 1] = rng.choice([[], ["new"], [put[place], "more"]])
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w + rng.choice(["", ",", "###"]) for w in put]
        rows.append((k, " ".join(own)))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: {m["item_id"]: m["similarity"] for m in r["matches"]} for r in D.contamination(docs, bench).collect()}
    assert got == {i: pytest.approx(brute(t, items)) for i, t in rows}


def test_keep_clean(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y", 3), (2, "nothing", 4), (None, None, 5)], "doc_id bigint, text string, matches int")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    out = D.keep_clean(docs, bench)
    assert out.columns == docs.columns and sorted(r["matches"] for r in out.collect()) == [4, 5]
    assert D.keep_clean(docs, bench.limit(0)).count() == 3
    assert D.contamination(docs, bench.limit(0)).where("size(matches) > 0").count() == 0
    assert D.contamination(docs.limit(0), bench).collect() == []


def test_blocks_of_items_do_not_change_rows(spark, monkeypatch):
    """Repeated and null ids, on both sides of the block size."""
    rng = random.Random(6)
    items = [(k, text(rng, 12)) for k in range(7)] + [(7, None)]
    rows = [(1, items[0][1]), (1, f"{items[3][1]} x {items[6][1]}"), (1, "clean words only"), (None, items[2][1]), (None, None), (2, items[2][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    seen = []
    for size in (100, 3, 1):
        monkeypatch.setattr(D, "BLOCK", size)
        seen.append(sorted((r["doc_id"] or 0, [m["item_id"] for m in r["matches"]]) for r in D.contamination(docs, bench).collect()))
        assert D.keep_clean(docs, bench).count() == 2
    assert seen[0] == seen[1] == seen[2] == [(0, []), (0, [2]), (1, []), (1, [0]), (1, [3, 6]), (2, [2])]


def test_block_look_up_loses_nothing_and_selects():
    """Against distances to all items: recall 1 within the radius, and few candidates among unlike items."""
    rng = np.random.default_rng(3)
    index = D.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 30))) for k in range(600)])
    base = index.prints[rng.integers(0, 600, 400)]
    flips = np.zeros((400, D.BITS), bool)
    for k in range(400):
        flips[k, rng.choice(D.BITS, rng.integers(0, D.RADIUS + 12), replace=False)] = True
    windows = base ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")
    true = {(w, i) for w, i in zip(*np.nonzero(np.bitwise_count(windows[:, None] ^ index.prints).sum(axis=2) <= D.RADIUS), strict=True)}
    assert set(index.near(30, windows)) == true and len(true) > 250
    unlike = rng.integers(0, 2**63, (2000, D.BITS // 64), dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (2000, D.BITS // 64)).astype(np.uint64)
    share = sum(len(w) for w, _ in index.candidates(30, unlike)) / (2000 * 600)
    assert share < 0.001


def test_radius_holds_similar_windows():
    """Windows at similarity 0.75 and more, short items too, lie within the radius."""
    rng, far = random.Random(9), 0
    for n in [5, 8, 12, 20, 40, 120] * 60:
        own = [f"w{rng.random()}" for _ in range(n)]
        other = list(own)
        at = rng.randrange(n)
        other[at:at] = [f"x{rng.random()}" for _ in range(rng.randrange(1, 4))]
        a, b = one(" ".join(own), NONWORD), one(" ".join(other[:n]), NONWORD)
        x, y = bag(a), bag(b)
        both = sum((x & y).values())
        if both / (x.total() + y.total() - both) >= 0.75:
            prints = [D.packed(D.signs(D.shingles(h, np.array([0, len(h)]), D.WIDTH)[0]).sum(axis=0)) for h in (a, b)]
            far += np.bitwise_count(prints[0] ^ prints[1]).sum() > D.RADIUS
    assert far == 0
