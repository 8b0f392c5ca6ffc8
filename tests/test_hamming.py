"""Pairs within a Hamming distance against direct comparison, in one bucket and in several."""

import numpy as np
import pyarrow as pa
import pytest

from velspar.operators import records


def table(n=700, seed=3):
    """Ids and hashes: strangers, near copies of one hash, more copies of it than one entry has, an id with two hashes, a repeated row."""
    rng = np.random.default_rng(seed)
    hashes = [int(x) for x in rng.integers(0, 2**64 - 1, n, dtype=np.uint64)]
    hashes[:150] = [hashes[0]] * 150
    for k in range(150, 300):
        hashes[k] = hashes[0] ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False))
    ids = list(range(n))
    ids[400], ids[401], hashes[401] = 5, 402, hashes[402]
    order = rng.permutation(n)
    return [ids[k] for k in order], [hashes[k] for k in order]


def direct(ids, hashes, threshold):
    rows = sorted(set(zip(ids, hashes, strict=True)))
    return sorted((a, b, d) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if a != b and (d := (x ^ y).bit_count()) <= threshold)


def test_found_pairs_are_neither_joined_nor_shuffled(spark):
    hashes = spark.createDataFrame([(k, 1 << k % 60) for k in range(300)], "id bigint, hash bigint")
    found = records.near_pairs(hashes, 17)
    assert found.count() == 300 * 299 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange") == 1  # of the packed hashes


@pytest.mark.parametrize("threshold", [0, 2, 8, 17, 20, 40, 64])
@pytest.mark.parametrize("whole", [10, 1 << 15])
def test_every_pair_is_found_once(monkeypatch, threshold, whole):
    from velspar.operators import hamming

    monkeypatch.setattr(hamming, "WHOLE", whole)
    ids, hashes = table()
    bands = hamming.layout(threshold, 64, len(ids))
    assert (len(bands) > 1) == (whole == 10 and 2 <= threshold <= 20)
    for name in (int, "é{}".format):
        own = [name(i) for i in ids]
        batches = [b for k in range(3) for b in hamming._pairs(pa.array(own), np.array(hashes, np.uint64), threshold, bands, k, 3)]
        got = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == direct(own, hashes, threshold)


@pytest.mark.parametrize("whole", [10, 1 << 15])
def test_pairs_over_tasks(spark, monkeypatch, whole):
    from velspar.operators import hamming

    monkeypatch.setattr(hamming, "WHOLE", whole)
    monkeypatch.setattr(hamming, "ROWS", 100)
    ids, hashes = table()
    signed = [h - (h >> 63 << 64) for h in hashes]
    df = spark.createDataFrame([*zip(ids, signed, strict=True), (None, signed[0]), (900, None)], "id bigint, hash bigint").repartition(5)
    assert sorted(map(tuple, records.near_pairs(df, 17).collect())) == direct(ids, hashes, 17)
    assert records.near_pairs(df.where("false"), 17).collect() == []


def test_layout_loses_no_pair():
    from velspar.operators import hamming

    for bits in (8, 64):
        for threshold in range(bits + 3):
            bands = hamming.layout(threshold, bits, 1 << 20)
            assert bands == [(0, 0, 0)] or sum(w for _, w, _ in bands) == bits and sum(r + 1 for _, _, r in bands) == threshold + 1
    with pytest.raises(ValueError, match="negative"):
        hamming.layout(-1, 64, 10)
