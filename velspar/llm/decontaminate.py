"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up, exact weighted-shingle similarity.

Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased. An item of n words is compared with the windows of n words of a document (a
shorter document is one window). The similarity is that of weighted 5-word shingles, the weight of a shingle being its count:
sum of minima / sum of maxima; 0.75 or more contaminates. Items of fewer than five words are one shingle as a whole.

A window without a shingle of any item has similarity 0 with all of them, so fingerprints are taken of the windows that hold at least one.
A window's SimHash of BITS bits is looked up among the items of its size. The bits are cut into blocks of 64; two fingerprints within RADIUS bits differ
by RADIUS / blocks bits or fewer in one block at least, so the look-up by blocks, which takes the items within that many bits of one block, loses none.
RADIUS lies four and a half standard deviations above the distance expected at similarity 0.75 (44 of 256 bits); of unlike items, which
differ by half of the bits, a block lets fewer than 1 in 1000 pass. What it finds is verified on the shingles.

The items are a stated query set; they go to the executors in blocks of BLOCK items, one after the other over each row, whose matches grow from block to
block. Documents are scanned where they lie: nothing is shuffled. Defined results: null and empty texts match nothing, as do null and empty items; each
item_id of repeated items counts; repeated rows give repeated results; a null doc_id is carried along; ties of similarity go to the first window;
very long texts are one run of their own; columns besides doc_id and text are left out by contamination() and kept by keep_clean(), whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.texthash import NONWORD, WEIGHTS, U, mix, one, shingles, slices, word_hashes, words

WIDTH, BITS, RADIUS, BLOCK = 5, 256, 71, 20_000
_LANES = np.arange(64, dtype=U)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    both = np.concatenate([(mix(hashes + U(k))[:, None] >> _LANES) & U(1) for k in range(BITS // 64)], axis=1)
    return both.astype(np.int8) * np.int8(2) - np.int8(1)


def packed(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of sums of signs, 64 bits a number."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8").astype(U, copy=False)


class Index:
    """Items of one block, by their size in words."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS) -> None:
        self.radius, self.in_block = radius, radius // (BITS // 64)
        self.items = [(i, h) for i, h in ((i, one(t, NONWORD)) for i, t in items) if len(h)]
        self.bags = [Counter(shingles(h, np.array([0, len(h)]), WIDTH)[0].tolist()) for _, h in self.items]
        self.prints = np.array([packed(signs(np.array([*b.elements()], U)).sum(axis=0, dtype=np.int64)) for b in self.bags], U).reshape(len(self.items), BITS // 64)
        sizes_of = np.array([len(h) for _, h in self.items], np.int64)
        self.by_size: dict[int, np.ndarray] = {int(n): np.flatnonzero(sizes_of == n) for n in np.unique(sizes_of)}
        # Each block's numbers of the items of a size, side by side.
        self.blocks = {n: [np.ascontiguousarray(self.prints[own, k]) for k in range(BITS // 64)] for n, own in self.by_size.items()}
        # Which item sizes a shingle stands for, by the shingle's width.
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for width in {min(n, WIDTH) for n in self.by_size}:
            sizes: dict[int, set[int]] = {}
            for (_, h), bag in zip(self.items, self.bags, strict=True):
                if min(len(h), WIDTH) == width:
                    for s in bag:
                        sizes.setdefault(s, set()).add(len(h))
            keys = np.array(sorted(sizes), U)
            sieve = np.zeros(1 << 20, bool)
            sieve[(keys >> U(44)).astype(np.int64)] = True
            self.anchors[width] = keys, sieve, [sorted(sizes[int(s)]) for s in keys]

    def candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, places among the items of size n) that agree in a block up to radius / blocks bits."""
        for first in range(0, len(prints), 256):
            some = prints[first : first + 256]
            close = np.zeros((len(some), len(self.by_size[n])), bool)
            for k, own in enumerate(self.blocks[n]):
                close |= np.bitwise_count(some[:, k, None] ^ own) <= self.in_block
            w, i = np.nonzero(close)
            yield w + first, i

    def near(self, n: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """All (window, item of size n) within the radius."""
        found: list[tuple[int, int]] = []
        for w, i in self.candidates(n, prints):
            item = self.by_size[n][i]
            within = np.bitwise_count(prints[w] ^ self.prints[item]).sum(axis=1) <= self.radius
            found += zip(w[within].tolist(), item[within].tolist(), strict=True)
        return found

    def match(self, hashes: np.ndarray, hits: dict[int, list[int]]) -> dict[int, tuple[float, int]]:
        """hits: positions of shingles by item size. The best (similarity, first word) by item, of those at 0 or more."""
        best: dict[int, tuple[float, int]] = {}
        for n, places in hits.items():
            width, size = min(n, WIDTH), min(n, len(hashes))
            starts = sorted({s for p in places for s in range(max(0, p - size + width), min(p, len(hashes) - size) + 1)})
            first = 0
            while first < len(starts):  # runs of near windows share one table of sums
                last = first
                while last + 1 < len(starts) and starts[last + 1] - starts[last] <= size and last - first < 4096:
                    last += 1
                low, high = starts[first], starts[last] + size
                own, _ = shingles(hashes[low:high], np.array([0, high - low]), width)
                per = max(1, size - width + 1)
                sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)))
                at = np.array(starts[first : last + 1]) - low
                for w, item in self.near(n, packed(sums[at + per] - sums[at])):
                    bag = Counter(own[at[w] : at[w] + per].tolist())
                    both = sum((bag & self.bags[item]).values())
                    similarity = both / (bag.total() + self.bags[item].total() - both)
                    if (known := best.get(item)) is None or (similarity, -starts[first + w]) > (known[0], -known[1]):
                        best[item] = similarity, starts[first + w]
                first = last + 1
        return best

    def search(self, batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
        """(matches) of the texts in each batch's last column, row by row."""
        for batch in batches:
            out = [pa.array([], MATCH)]
            for row, end, data, offsets in slices(batch.column(batch.num_columns - 1)):
                starts, ends, bounds = words(data, offsets, NONWORD)
                hashes = word_hashes(data, starts, ends)
                hits: dict[int, dict[int, list[int]]] = {}
                for width, (keys, sieve, sizes) in self.anchors.items():
                    some, at = shingles(hashes, bounds, width)
                    place = np.flatnonzero(sieve[(some >> U(44)).astype(np.int64)])
                    rank = np.minimum(np.searchsorted(keys, some[place]), len(keys) - 1)
                    right = keys[rank] == some[place]
                    for p, r, text in zip(place[right].tolist(), rank[right].tolist(), (np.searchsorted(at, place[right], "right") - 1).tolist(), strict=True):
                        for n in sizes[r]:
                            hits.setdefault(text, {}).setdefault(n, []).append(p - int(at[text]))
                found: list[list[dict]] = [[] for _ in range(end - row)]
                for text, own in hits.items():
                    for item, (similarity, first) in sorted(self.match(hashes[bounds[text] : bounds[text + 1]], own).items()):
                        if similarity >= least:
                            found[text].append({"item_id": self.items[item][0], "similarity": similarity, "first_word": first, "words": min(len(self.items[item][1]), int(bounds[text + 1] - bounds[text]))})
                out.append(pa.array(found, MATCH))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], ["matches"])


MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())]))
MATCHES = "matches array<struct<item_id:bigint,similarity:double,first_word:bigint,words:bigint>>"


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in order, BLOCK at a time."""
    block: list[tuple[int, str]] = []
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, matches): one row for each row, with the matches of all blocks of items in the items' order."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(f"cast(array() as {MATCHES.split(' ', 1)[1]})").alias("matches"), F.col("text").cast("string").alias("text"))
    for block in blocks(benchmark):
        index = Index(block)

        def grown(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for new in index.search(iter([batch]), least):
                    old = batch.column(1)
                    both = [a + b for a, b in zip(old.to_pylist(), new.column(0).to_pylist(), strict=True)] if len(old.flatten()) else None
                    yield pa.RecordBatch.from_arrays([batch.column(0), new.column(0) if both is None else pa.array(both, MATCH), batch.column(2)], ["doc_id", "matches", "text"])

        rows = rows.mapInArrow(grown, f"doc_id bigint, {MATCHES}, text string")
    return rows.select("doc_id", "matches")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows without any benchmark item, all columns as they were."""
    for block in blocks(benchmark):
        index = Index(block)
        tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

        def kept(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in index.search(iter([batch]), least):
                    keep = pc.equal(pc.list_value_length(found.column(0)), 0)
                    yield from pa.Table.from_arrays([batch.column(0).filter(keep)], ["row"]).to_batches()

        docs = tagged.mapInArrow(kept, tagged.select("row").schema).select("row.*")
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    one_row = found.select("doc_id", F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("similarity"))
    return one_row.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.array_distinct("item_ids").alias("item_ids"), "similarity")
