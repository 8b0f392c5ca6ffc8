"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

A file set holds rows (doc_id, block, place, ids): block is the range of doc_ids that one task wrote, place the row's number in it. Rows are in
ascending doc_id order through the blocks. Each file has stripes of STRIPE bytes that are read in parallel, an index entry every STRIDE rows and
a Bloom filter on doc_id, so a look-up of ids reads the matching row groups only.

The ids are those that the tokenizers library gives to the whole text. With a byte-level BPE no token crosses the place before a space that
precedes another character, so the library encodes each distinct piece between such places once and the ids are gathered by array; whether a tokenizer
is of this kind is read from its specification, any other encodes whole texts, and one text of every run is compared with its whole encoding.
Defined results: null text is empty and has the end id alone; repeated rows are written each, ties of doc_id by text; rows with a null
doc_id come first; very long texts are encoded alone; an empty table gives an empty file set; columns besides doc_id and text are left out.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velspar.session import materialise, scratch, shuffle_partitions

TOKENIZER = "byte_bpe_50k.json"
END = 0
STRIPE, STRIDE, FALSE_POSITIVES = 16 << 20, 1000, 0.01
#: Pieces that a worker keeps, pieces that are encoded together, and the bytes of a text that a run compares with its whole encoding.
MOST_PIECES, TOGETHER, CHECKED = 600_000, 30_000, 1000
SCHEMA = "doc_id bigint, ids array<int>"
#: Nothing, or white space of any kind at the start.
_BLANK = r"^(?:$|[\s\v\x1c-\x1f\x{85}\pZ])"
_PIECE = re.compile(r"(?= \S)")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, or the name itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer and the ids of the pieces it has encoded; one for each worker process and tokenizer."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.splits = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has a character for each byte
            self.sizes[i] = len(token)
        # Known pieces: their strings (each follows a space, which it leaves out), the runs that used them, and in `store` the ids of the k-th from
        # begin[k] to begin[k + 1].
        self.names, self.runs, self.store, self.begin = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Of too many pieces, those that two runs used stay; those of more runs if that is over half of what may be kept."""
        least = 2
        while np.count_nonzero(self.runs >= least) > MOST_PIECES // 2:
            least += 1
        kept, many = self.runs >= least, np.diff(self.begin)
        self.store = self.store[np.repeat(kept, many)]
        self.names, self.begin = self.names.filter(pa.array(kept)), np.concatenate(([0], np.cumsum(many[kept])))
        self.runs = np.ones(len(self.names), np.int32)

    @classmethod
    def get(cls, name: str) -> Encoder:
        held = sys.modules.setdefault("_velspar_encoders", types.ModuleType("_velspar_encoders"))
        if name not in held.__dict__:
            held.__dict__[name] = cls(name)
        return held.__dict__[name]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def later(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of the distinct pieces in the store. New ones are encoded as one text; the bytes that each id stands for show where
        a piece ends."""
        if len(self.names) > MOST_PIECES:
            self.forget()
        at = pc.index_in(pieces, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)
        new = pieces.filter(pa.array(at < 0))
        at[at < 0] = len(self.names) + np.arange(len(new))
        for k in range(0, len(new), TOGETHER):
            some = new.slice(k, TOGETHER).cast(pa.string())
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)) + 1
            self.begin = np.concatenate((self.begin, self.begin[-1] + ends))
            self.store = np.concatenate((self.store, ids))
        self.names, self.runs = pa.concat_arrays([self.names, new]), np.concatenate((self.runs, np.zeros(len(new), np.int32)))
        self.runs[at] += 1
        return at

    def gather(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that are cut into a head and pieces that follow a space, and the number of ids of each text."""
        coded, at = cut.flatten().dictionary_encode(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        codes = coded.indices.to_numpy()
        used = np.ones(len(codes), bool)
        used[at[:-1]] = False
        used = np.bincount(codes[used], minlength=len(coded.dictionary)) > 0
        own = np.zeros(len(used), np.int64)
        own[used] = self.later(coded.dictionary.filter(pa.array(used)))
        heads = self.whole(coded.dictionary.take(pa.array(codes[at[:-1]])).to_pylist())
        first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in heads], dtype=np.int64)))
        store = np.concatenate((self.store, np.frombuffer(b"".join(heads), np.uint32)))
        begin = np.concatenate((self.begin, self.begin[-1] + first[1:]))
        piece = own[codes]
        piece[at[:-1]] = len(self.begin) - 1 + np.arange(len(heads))
        many = np.diff(begin)[piece]
        until = np.cumsum(many)
        ids = store[np.repeat(begin[piece] - until + many, many) + np.arange(until[-1] if len(until) else 0)]
        return ids, np.diff(np.concatenate(([0], until))[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and the number of ids of each text."""
        if not self.splits:
            found = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        flat, at = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # A piece that is empty or starts with white space does not stand for itself: its text is cut only where one space precedes another character.
        unfit = pc.match_substring_regex(flat, _BLANK).to_numpy(zero_copy_only=False)
        unfit[at[:-1]] = False
        odd = np.add.reduceat(unfit, at[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
        if not odd.any():
            return self.gather(cut)
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        pieces = [[p[bool(k) :] for k, p in enumerate(_PIECE.split(t))] for t in texts.filter(pa.array(odd)).to_pylist()]
        ids, n = self.gather(pa.concat_arrays([cut.filter(pa.array(~odd)), pa.array(pieces, cut.type)]))
        start, back = np.cumsum(n) - n, np.argsort(order)
        many = n[back]
        until = np.cumsum(many)
        return ids[np.repeat(start[back] - until + many, many) + np.arange(until[-1])], many

    def check(self, text: str, ids: np.ndarray) -> None:
        """That the pieces' ids are those of the whole text."""
        if self.whole([text])[0] != ids.astype("<u4").tobytes():
            raise ValueError("the tokenizer encodes a whole text otherwise than its pieces between spaces")


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's specification says that no token crosses the place before a space that precedes another character.

    So it is with the byte-level pattern, in which one space can only be the first character of a word's token, where nothing rewrites the text
    beforehand, no token is drawn by chance and no added token takes in white space.
    """
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"])) for a in spec.get("added_tokens", ()))
    return bool(plain and bpe and added and not spec.get("normalizer"))


def encode(batches: Iterator[pa.RecordBatch], name: str, end: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The ids of runs of rows of about `most` bytes; a longer text is a run of its own. One text of each run is encoded as a whole too and compared."""
    encoder = Encoder.get(name)
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        until, row = np.cumsum(sizes), 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(until, until[row] - sizes[row] + most, "right")))
            ids, n = encoder.encode(batch.column(1).slice(row, last - row))
            k = int(np.argmin(np.abs(sizes[row:last] - CHECKED)))
            stop = int(n[: k + 1].sum())
            encoder.check(batch.column(1)[row + k].as_py(), ids[stop - n[k] : stop])
            offsets = np.concatenate(([0], np.cumsum(n + 1)))
            out = np.full(offsets[-1], end, np.int32)
            inner = np.ones(len(out), bool)
            inner[offsets[1:] - 1] = False
            out[inner] = ids.view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, last - row), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], ["doc_id", "ids"])
            row = last


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Encode every whole text and write the file set; the texts are shuffled once, by ranges of doc_id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    found = placed.mapInArrow(lambda x: encode(x, tokenizer, end), SCHEMA)
    marked = found.select("doc_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "ids")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE)}
    marked.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of a file set, of some doc_ids if given: row groups that cannot hold them are not read."""
    rows = spark.read.schema("doc_id bigint, block int, place bigint, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4"))).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "block", "place", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all rows before. Only these numbers are shuffled, by block."""
    own = materialise(spark, read_tokens(spark, path).mapInArrow(digests, "doc_id bigint, block int, place bigint, n_tokens bigint, ids_crc32 bigint"), "token-digests")
    totals = own.groupBy("block").agg(F.sum("n_tokens").alias("total")).orderBy("block").collect()  # one row for each block
    before, at = [], 0
    for r in totals:
        before.append((r["block"], at))
        at += r["total"]
    offsets = F.broadcast(spark.createDataFrame(before, "block int, before bigint"))
    running = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("place"))
    return own.withColumn("until", running).join(offsets, "block").select("doc_id", (F.col("before") + F.col("until") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(spark, path)
