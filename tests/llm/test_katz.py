"""The partitioned Katz model against a direct one, and its normalisation."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from velspar.llm import katz


class Direct:
    def __init__(self, rows):
        self.docs = [(i, t or "") for i, t in rows]
        self.c, self.c2 = Counter(), Counter()
        for i, t in self.docs:
            if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
                tokens = self.tokens(t)
                self.c.update(tokens)
                self.c2.update(zip(["<s>", *tokens], tokens))
        self.n, self.texts = sum(self.c.values()), self.c["</s>"]
        self.d1, self.d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]) for c in (self.c, self.c2))
        self.unknown = 1 - sum(self.p(w) for w in self.c)

    @staticmethod
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "</s>"]

    def p(self, w):
        c = self.c[w]
        return self.unknown if not c else (self.d1[c] if c <= katz.K else 1) * c / (self.n + 1)

    def p2(self, h, w):
        c, ch = self.c2[h, w], self.texts if h == "<s>" else self.c[h]
        if c:
            return (self.d2[c] if c <= katz.K else 1) * c / (ch + 1)
        seen = [v for (g, v) in self.c2 if g == h]
        return self.p(w) * (1 - sum(self.p2(h, v) for v in seen)) / (1 - sum(self.p(v) for v in seen))

    def score(self, t):
        tokens = self.tokens(t)
        return sum(math.log10(self.p2(h, w)) for h, w in zip(["<s>", *tokens], tokens))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    return [(i * 7 + seed, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("rows", [corpus(1), [*corpus(2, 60), (5000, None), (5001, ""), (5002, "solo"), (5002, "solo"), (None, "x y")], [(1, "a b"), (2, "a")]])
def test_against_direct_model(spark, rows):
    direct = Direct(rows)
    got = katz.score(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    v, expected = len(direct.c), []
    for i, t in direct.docs:
        tokens = direct.tokens(t)
        base = sum(math.log10((direct.c[w] + 1) / (direct.n + v + 1)) for w in tokens)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        expected.append((i, held, len(tokens), sum(direct.c[w] > 0 for w in tokens), direct.n, round(base, 4), round(direct.score(t), 4)))
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("part, hot", [(50, 2000), (200, 20), (10**6, 2)])
def test_partitions_and_frequent_contexts_change_nothing(spark, monkeypatch, part, hot):
    rows = [(i, " ".join(["the"] * 3 + [t])) for i, t in corpus(5, 40)]
    monkeypatch.setattr(katz, "PART", part)
    monkeypatch.setattr(katz, "HOT", hot)
    direct = Direct(rows)
    got = {r["doc_id"]: r["score"] for r in katz.score(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: pytest.approx(direct.score(t), abs=1e-4) for i, t in rows}


def test_packing_of_arrays():
    rng = np.random.default_rng(0)
    arrays = [np.sort(rng.integers(0, 2**63, 50).astype(np.uint64)), rng.integers(0, 300, 9).astype(np.uint64), rng.integers(-5, 2**40, 7), np.array([True, False]), rng.random(20) * 50, np.zeros(0, np.uint64), np.zeros(0)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert len(a) == len(b) and np.allclose(a.astype(float), b.astype(float), atol=1e-7) and (a.dtype.kind == "f" or (a == b).all())


def test_contexts_sum_to_one():
    direct = Direct(corpus(3))
    for h in ["<s>", "w1", "w2", "never", *list(direct.c)[:10]]:
        if h != "</s>":
            assert sum(direct.p2(h, w) for w in direct.c) + direct.p2(h, "unknown word") == pytest.approx(1)


def test_empty(spark):
    assert katz.score(spark, spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_discounts_fall_back():
    assert (katz.discounts([0] * 6) == 1).all()
    d = katz.discounts([1000, 300, 150, 90, 60, 45])
    assert (np.diff(d[1:]) > -0.2).all() and (d[1:] > 0).all() and (d[1:] <= 1).all()


@pytest.mark.parametrize(
    "n",
    [
        # The training folds of sf0.01 and sf0.1, unigrams and bigrams: copies swell n5.
        [49663, 12919, 5197, 2729, 2383, 1067],
        [193655, 25105, 6496, 2179, 2497, 618],
        [207344, 59772, 25017, 14274, 13493, 7080],
        [1579638, 246704, 51653, 21705, 18939, 7580],
        [900, 200, 0, 40, 90, 10],
    ],
)
def test_copies_keep_good_turing(n):
    r = np.arange(1, katz.K + 1)
    d = katz.discounts(n)[1:]
    assert (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()
    # Katz's scale: ratios (r + 1) n[r + 1] / (r n[r]) of a power law are ((r + 1) / r) ** (slope + 1), 1 - d in proportion to 1 - ratio.
    z = np.array(n) / [0.5 * ((np.flatnonzero(n[k + 1 :])[0] + 1 if any(n[k + 1 :]) else 1) + (np.flatnonzero(n[:k][::-1])[0] + 1 if k else 1)) for k in range(6)]
    at = np.flatnonzero(n)
    slope = np.polyfit(np.log(at + 1), np.log(z[at]), 1)[0]
    ratio = ((r + 1) / r) ** (slope + 1)
    assert (1 - d) / (1 - d[0]) == pytest.approx((1 - ratio) / (1 - ratio[0]))


def test_absolute_only_without_a_falling_line():
    assert katz.discounts([10, 0, 0, 0, 0, 0])[1:] == pytest.approx([(r - 0.99) / r for r in range(1, 6)])
    assert katz.discounts([10, 9, 10, 9, 12, 11])[1:] == pytest.approx([(r - 10 / 28) / r for r in range(1, 6)])


def test_a_worker_gives_its_memory_back(tmp_path):
    """Resident MB of a process before and after it dealt 60 MB of text: workers live on beside those of later stages."""
    code = """
import numpy as np, pyarrow as pa
from velspar.llm import katz
def resident():
    return int(open("/proc/self/status").read().split("VmRSS:")[1].split()[0]) // 1024
def batches():
    rng = np.random.default_rng(1)
    for first in range(0, 2000, 500):
        texts = [" ".join(map(str, rng.integers(0, 50_000, 5000))) for _ in range(500)]
        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + 500)), pa.array([True] * 500), pa.array(texts)], ["id", "train", "text"])
blobs = sum(b.num_rows for b in katz.deal(batches(), np.zeros(0, np.uint64), 7))
print(blobs, resident())
"""
    rows, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.getcwd()}).stdout.split()
    assert int(rows) == 70 and int(mb) < 220
