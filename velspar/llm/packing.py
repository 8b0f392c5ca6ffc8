"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its words ([^\\x20\\x09-\\x0D]+) and one end token, or any number of tokens given to pack_lengths(), such as those of token
files. Several sequence lengths are permitted. Pieces are dealt, longest first, to the open bin that they fill best; if none fits, a bin is opened at the
size of least cost: its length and a price for a sequence, over the tokens it is expected to hold. At the end every bin is downsized to
the least permitted length that holds its contents. The lengths are optimised jointly: each shard is packed under every policy of POLICIES (how
full a new bin is expected to get, and which lengths may be opened), and the packing of least cost, the final lengths and the prices, is kept.
A document longer than the largest length is cut into pieces of that length, all of them kept. sequences() writes the bins' contents.

Rows are dealt to shards by a hash of doc_id and of their place in the input; a shard of about SHARD documents is one task's work and holds only ids and lengths.
The number of shards grows with the input, and so do neither memory nor time of a task, whatever ids repeat. Defined results: a null or empty text is one
piece of one token; repeated rows are packed each; a null doc_id is packed as such; of bins that fit equally the one opened first is taken; very
long texts are many pieces; an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.texthash import slices, words

LENGTHS, PRICE, SHARD, END = (512, 1024, 2048, 4096, 8192), 64, 20_000, "</s>"
#: (how full a new bin is expected to get, the least length that is opened).
POLICIES = tuple((fill, least) for fill in (0.8, 0.95, 1.0) for least in (512, 2048, 8192))
SCHEMA = "shard bigint, bin bigint, capacity bigint, used bigint, place bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(1)):
            _, _, bounds = words(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(bounds) + 1, pa.int64())], ["doc_id", "length"])


def best_fit(sizes: list[int], permitted: tuple[int, ...] = LENGTHS, price: float = PRICE, fill: float = 0.95, least: int = 0) -> list[tuple[int, int]]:
    """(bin, bin's final length) of each piece, in the order of the pieces, which must be at most the largest length."""
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    where = [0] * len(sizes)
    opened = [c for c in permitted if c >= least] or [max(permitted)]
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, bin_ = free.pop(at)
        else:
            room = min((c for c in opened if c >= size), key=lambda c: ((c + price) / (size + fill * (c - size)), c))
            bin_ = len(used)
            used.append(0)
        used[bin_] += size
        where[k] = bin_
        if room > size:
            insort(free, (room - size, bin_))
    final = [min(c for c in permitted if c >= u) for u in used]
    return [(b, final[b]) for b in where]


def cost(placed: list[tuple[int, int]], price: float = PRICE) -> float:
    return sum(c + price for c in dict(placed).values())


def jointly(sizes: list[int], permitted: tuple[int, ...] = LENGTHS, price: float = PRICE) -> list[tuple[int, int]]:
    """The packing of least cost over all policies; of equal ones the first policy's."""
    return min((best_fit(sizes, permitted, price, fill, least) for fill, least in POLICIES), key=lambda placed: cost(placed, price))


def pack(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["doc_id", "length", "piece"], kind="stable", ignore_index=True)
    placed = jointly(shard["n_tokens"].tolist())
    out = pd.DataFrame({"shard": shard["shard"], "bin": [b for b, _ in placed], "capacity": [c for _, c in placed], "doc_id": shard["doc_id"].astype("Int64"), "piece": shard["piece"], "first_token": shard["first_token"], "n_tokens": shard["n_tokens"]})
    out["used"] = out.groupby("bin")["n_tokens"].transform("sum")
    out["place"] = out.groupby("bin")["n_tokens"].cumsum() - out["n_tokens"]
    return out[[c.split()[0] for c in SCHEMA.split(", ")]]


def pack_lengths(rows: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row for each piece of the rows (doc_id, length): its bin, the bin's length and use, and where the piece lies in the document and in the bin."""
    shards = max(1, -(-rows.count() // shard_size))
    most = max(LENGTHS)
    placed = rows.select("doc_id", "length", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))
    pieces = placed.select("shard", "doc_id", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {most}"))).alias("piece"))
    pieces = pieces.select("doc_id", "length", "piece", (F.col("piece") * most).alias("first_token"), F.least(F.lit(most), F.col("length") - F.col("piece") * most).alias("n_tokens"), "shard")
    return pieces.groupBy("shard").applyInPandas(pack, SCHEMA)


def pack_documents(docs: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """pack_lengths() of the documents' words and end tokens."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pack_lengths(rows.mapInArrow(lengths, "doc_id bigint, length bigint"), shard_size)


def sequences(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(shard, bin, capacity, tokens): the words and end tokens of each bin in their places, at most the largest length; doc_ids must be distinct and known."""
    words_of = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.concat(words_of, F.array(F.lit(END))).alias("words"))
    pieces = packed.join(texts, "doc_id").select("shard", "bin", "capacity", "place", F.slice("words", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("words"))
    together = pieces.groupBy("shard", "bin", "capacity").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("pieces"))
    return together.select("shard", "bin", "capacity", F.flatten(F.col("pieces.words")).alias("tokens"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
