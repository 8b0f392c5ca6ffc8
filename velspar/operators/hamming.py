"""Pairs of hashes within a Hamming distance, in tasks that hold all hashes, so neither candidates nor pairs are shuffled.

Hashes are packed and shuffled once (16 bytes a row with ids of 8). Chunks of the bits deal them into buckets; a task takes its share of the buckets, and
compares their hashes with those of the buckets whose chunk differs by the band's radius at most. Exact by the pigeonhole principle; time grows with the
square of the table, at a fraction of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.session import shuffle_partitions

#: CHUNK: bits of a band, about. WHOLE: so many hashes or less, or bands that admit over SHARE of the pairs, are not dealt into buckets.
CHUNK, WHOLE, SHARE = 13, 1 << 15, 0.5
#: A task for each ROWS hashes, up to a bound; SLICE: hashes of a bucket that are compared in one unit of work; COPIES: ids of one hash that go by one entry.
ROWS, SLICE, COPIES = 4096, 64, 64
#: Comparisons and pairs that are held at a time.
CELLS, OUT = 1 << 16, 1 << 16


def layout(threshold: int, bits: int, size: int) -> list[tuple[int, int, int]]:
    """(start, width, radius) of each band. The radii, one added to each, make threshold + 1, so hashes within the threshold are within the radius of a band."""
    if threshold < 0:
        raise ValueError("the threshold cannot be negative")
    n = min(threshold + 1, -(-bits // CHUNK))
    widths, radii = ([whole // n + (k < whole % n) for k in range(n)] for whole in (bits, threshold + 1 - n))
    share = sum(sum(comb(w, k) for k in range(r + 1)) / 2**w for w, r in zip(widths, radii, strict=True))
    if size <= WHOLE or share > SHARE:
        return [(0, 0, 0)]
    return [(sum(widths[:k]), w, r) for k, (w, r) in enumerate(zip(widths, radii, strict=True))]


def _chunk(values: np.ndarray, start: int, width: int) -> np.ndarray:
    return (values >> np.uint64(start)) & np.uint64((1 << width) - 1)


def near_entries(values: np.ndarray, threshold: int, bands: list[tuple[int, int, int]], number: int = 0, groups: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, places, distances): each pair of values (uint64) within the threshold once, by the first band that admits it; of every `groups` units of work one."""
    done, unlike, bits = 0, np.empty(0, np.uint64), np.empty(0, np.uint8)
    for k, (start, width, radius) in enumerate(bands):
        chunks = _chunk(values, start, width)
        order = np.argsort(chunks.astype(np.uint16) if width <= 16 else chunks, kind="stable")  # short ones by radix
        ordered, chunks = values[order], chunks[order]
        low = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])[: len(chunks)])
        known, high = chunks[low], np.append(low[1:], len(chunks))
        masks = np.array([sum(1 << i for i in c) for n in range(1, radius + 1) for c in combinations(range(width), n)], np.uint64)
        live = np.arange(len(known)) if radius else np.flatnonzero(high - low > 1)
        ends = np.cumsum(-(-(high - low)[live] // SLICE))
        units = int(ends[-1]) if len(ends) else 0
        for unit in range((number - done) % groups, units, groups):
            place = np.searchsorted(ends, unit, "right")
            at = live[place]
            first = high[at] - SLICE * (ends[place] - unit)  # slices end with the bucket
            own = np.arange(max(first, low[at]), first + SLICE)
            near = known[at] ^ masks
            near = near[near > known[at]]  # the others come to this bucket from theirs
            to = np.searchsorted(known, near)
            to = to[known[np.minimum(to, len(known) - 1)] == near]
            starts, sizes = np.append(own[0], low[to]), np.append(high[at] - own[0], (high - low)[to])
            others = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            theirs, step = ordered[others], max(1, CELLS // len(others))
            size = min(step, len(own)) * len(others)
            if size > len(unlike):
                unlike, bits = np.empty(size, np.uint64), np.empty(size, np.uint8)
            for i in range(0, len(own), step):
                mine = ordered[own[i : i + step], None]
                cells = len(mine) * len(others)
                np.bitwise_xor(mine, theirs, out=unlike[:cells].reshape(len(mine), -1))
                distances = np.bitwise_count(unlike[:cells], out=bits[:cells])
                found = np.flatnonzero(distances <= threshold)
                p, q = own[i + found // len(others)], others[found % len(others)]
                keep = q > p
                for s, w, r in bands[:k]:
                    keep &= np.bitwise_count(_chunk(ordered[p] ^ ordered[q], s, w)) > r
                yield order[p[keep]], order[q[keep]], distances[found[keep]]
        done += units


def _pairs(ids: pa.Array, hashes: np.ndarray, threshold: int, bands: list[tuple[int, int, int]], number: int, groups: int) -> Iterator[pa.RecordBatch]:
    """A task's pairs (a, b, distance) of the ids, a < b."""
    by_id = pc.sort_indices(ids)
    ids, hashes = ids.take(by_id), hashes[by_id.to_numpy()]
    code = np.cumsum(np.append(0, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))  # of equal ids
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], order
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (code[rows[1:]] != code[rows[:-1]]))
    hashes, rows = hashes[fresh], rows[fresh]
    place = np.arange(len(rows))
    run = np.maximum.accumulate(np.where(np.append(True, hashes[1:] != hashes[:-1]), place, 0))
    first = np.flatnonzero((place - run) % COPIES == 0)
    sizes = np.diff(np.append(first, len(rows)))

    def expanded(p: np.ndarray, q: np.ndarray, distance: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = sizes[p] * sizes[q]
        ends = np.cumsum(cells)
        for start in range(0, int(ends[-1]) if len(ends) else 0, OUT):
            cell = np.arange(start, min(start + OUT, ends[-1]))
            of = np.searchsorted(ends, cell, "right")
            offset = cell - (ends - cells)[of]
            x, y = first[p[of]] + offset // sizes[q[of]], first[q[of]] + offset % sizes[q[of]]
            keep = (code[rows[x]] != code[rows[y]]) & ((p != q)[of] | (x < y))
            x, y = rows[x[keep]], rows[y[keep]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.minimum(x, y))), ids.take(pa.array(np.maximum(x, y))), pa.array(distance[of[keep]], pa.int32())], ["a", "b", "distance"])

    copied = np.flatnonzero(sizes > 1)[number::groups]
    yield from expanded(copied, copied, np.zeros(len(copied), int))
    held, n = [], 0
    for found in near_entries(hashes[first], threshold, bands, number, groups):
        held.append(found)
        n += len(found[0])
        if n >= OUT:
            yield from expanded(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from expanded(*(np.concatenate(x) for x in zip(*held, strict=True)))


def pairs_within(hashes: DataFrame, threshold: int, bits: int = 64, size: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all hashes (id, hash) of so many bits within the threshold, equal hashes included. size: a number that rows do not exceed."""
    spark, kind = hashes.sparkSession, dict(hashes.dtypes)["id"]
    size = hashes.count() if size is None else size
    bands, groups = layout(threshold, bits, size), max(1, min(2 * shuffle_partitions(spark), -(-size // ROWS)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Each group's number comes once with every pack, one group after the other."""
        number, held = None, []
        for batch in batches:
            for group, packed in zip(batch.column("number").to_pylist(), batch.column("packed"), strict=True):
                if held and group != number:
                    yield from run(number, held)
                    held = []
                number = group
                held.append(packed.as_buffer())
        if held:
            yield from run(number, held)

    def run(number: int, packs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packs]).combine_chunks()
        return _pairs(table.column("id").chunk(0), table.column("hash").to_numpy().astype(np.int64).view(np.uint64), threshold, bands, number, groups)

    known = hashes.where("id is not null and hash is not null").select("id", F.col("hash").cast("bigint").alias("hash"))
    packed = known.mapInArrow(pack, "packed binary").repartition(1)
    numbers = spark.range(0, groups, 1, groups).select(F.col("id").alias("number"))
    # A product of partitions, not a broadcast: a task reads the hashes from the shuffle, nothing is written for each task.
    return numbers.hint("shuffle_replicate_nl").crossJoin(packed).mapInArrow(each, f"a {kind}, b {kind}, distance int")
