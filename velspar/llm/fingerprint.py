"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are the pieces of a paragraph: runs of words that end where a word's checksum says so, in short paragraphs words with the word before. A paragraph
(a line) has a digest of its bytes, a section the digest of its paragraphs' digests and the root the digest of the sections'. A section ends after an
empty line, or after a paragraph whose digest is 0 modulo 8, so an insertion moves no boundary beyond it. Equal texts have equal roots; where
two roots differ, the sections and paragraphs that differ locate the edits.

A fingerprint is `root/section:paragraph.pieces,paragraph.pieces;section:...` in lowercase hex: 32 digits for the root, 16 for a
section or paragraph, 8 for each piece. Two fingerprints are compared down their trees: equal roots are alike in full; else branches with the digest of a
section of the other tree count whole, below the others paragraphs with the digest of a paragraph left over count whole, and below those that remain
common pieces count. Likeness is 2 * what counts / all (a paragraph counts one and its pieces; one more is added to all, so different roots stay below 1).

Defined results: null text is an empty text, whose tree has one section of one empty paragraph; repeated rows are neighbours in the order
and each gives a row; ties of doc_id are ordered by text; rows with a null doc_id come last, in the order of a hash of their texts. Very long texts are hashed
as a whole; columns besides doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.session import shuffle_partitions

SHORT = 32
SECTION_EVERY = 8
_WORD = re.compile(rb"\S+")


def digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=16).hexdigest()


def pieces(paragraph: bytes) -> list[str]:
    """Checksums of the leaves: runs of words up to one whose checksum is 0 modulo 4; each word with the one before in a paragraph of under SHORT words."""
    found = _WORD.findall(paragraph)
    if len(found) < SHORT:
        return [f"{zlib.crc32(w, zlib.crc32(v)):08x}" for v, w in zip([b"", *found], found)]  # noqa: B905
    out, own = [], 0
    for word in found:
        own = zlib.crc32(word, own)
        if not zlib.crc32(word) & 3:
            out.append(f"{own:08x}")
            own = 0
    return [*out, f"{own:08x}"] if own else out


def fingerprint(text: str | None) -> str:
    sections: list[list[tuple[str, str]]] = [[]]
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        data = line.encode("utf-8", "surrogatepass")
        own = digest(b"\x00" + data)
        sections[-1].append((own, "".join(pieces(data))))
        if k + 1 < len(lines) and (not line.strip() or int(own[:4], 16) % SECTION_EVERY == 0):
            sections.append([])
    parts, tops = [], []
    for section in sections:
        top = digest(b"\x01" + "".join(d for d, _ in section).encode())
        tops.append(top)
        parts.append(f"{top[:16]}:" + ",".join(f"{d[:16]}.{p}" for d, p in section))
    return digest(b"\x02" + "".join(tops).encode()) + "/" + ";".join(parts)


Section = tuple[str, list[tuple[str, str]]]


def tree(fp: str) -> list[Section]:
    """(digest, paragraphs) of each section; a paragraph is its digest and its pieces side by side."""
    out = []
    for section in fp.split("/", 1)[1].split(";"):
        top, paragraphs = section.split(":", 1)
        out.append((top, [tuple(p.split(".", 1)) for p in paragraphs.split(",")]))
    return out


def size(paragraphs: list[tuple[str, str]]) -> int:
    return len(paragraphs) + sum(len(p) for _, p in paragraphs) // 8


def unmatched(a: list, b: list) -> tuple[list, list, list]:
    """Of two lists of (digest, ...): the members of a with a partner of the same digest in b, and what is left of both."""
    left = Counter(x[0] for x in b)
    both, rest = [], []
    for x in a:
        if left[x[0]] > 0:
            left[x[0]] -= 1
            both.append(x)
        else:
            rest.append(x)
    over, left_b = Counter(x[0] for x in both), []
    for x in b:
        if over[x[0]] > 0:
            over[x[0]] -= 1
        else:
            left_b.append(x)
    return both, rest, left_b


def likeness(a: str, b: str, tree_a: list[Section] | None = None, tree_b: list[Section] | None = None) -> float:
    if a[:32] == b[:32]:
        return 1.0
    x, y = tree(a) if tree_a is None else tree_a, tree(b) if tree_b is None else tree_b
    total = sum(size(ps) for _, ps in x) + sum(size(ps) for _, ps in y)
    same, x, y = unmatched(x, y)
    common = sum(size(ps) for _, ps in same)
    same, p, q = unmatched([p for _, ps in x for p in ps], [p for _, ps in y for p in ps])
    common += size(same)
    bags = [Counter(pieces[k : k + 8] for _, pieces in ps for k in range(0, len(pieces), 8)) for ps in (p, q)]
    return 2 * (common + sum((bags[0] & bags[1]).values())) / (total + 1)


def edits(a: str, b: str) -> list[tuple[str, int, int]]:
    """What differs, down the trees: ('a' or 'b', section, paragraph) of each paragraph that the other tree lacks."""
    if a[:32] == b[:32]:
        return []
    out = []
    for name, own, other in (("a", tree(a), tree(b)), ("b", tree(b), tree(a))):
        numbered = [(t, i, ps) for i, (t, ps) in enumerate(own)]
        _, rest, left = unmatched(numbered, other)
        paragraphs = [(d, i, j) for _, i, ps in rest for j, (d, _) in enumerate(ps)]
        out += [(name, i, j) for _, i, j in unmatched(paragraphs, [p for _, ps in left for p in ps])[1]]
    return out


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, ghost) in order; each is compared with the next of its part. The last of a part is a ghost, which gives no row."""
    names = [c.split()[0] for c in OUT.split(", ")]
    held = None
    rows: list[list] = [[] for _ in names]
    size = 0
    for batch in batches:
        for part, doc_id, text, ghost in zip(*(batch.column(k) for k in range(4)), strict=True):
            text = text.as_py() or ""
            part = part.as_py()
            fp = fingerprint(text)
            own = tree(fp)
            if held is not None and held[0] == part:
                changed = edited(held[2], text)
                new = fingerprint(changed) if changed != held[2] else held[3]
                values = (held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[3], new, likeness(held[3], new, held[4]), likeness(held[3], fp, held[4], own))
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
                size += len(held[3]) + len(new)
            held = None if ghost.as_py() else (part, doc_id.as_py(), text, fp, own)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)
                rows, size = [[] for _ in names], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, which ends in the start of the next document by descending doc_id; after the last comes the first.

    Documents are dealt by ranges of doc_id, in one shuffle of the texts. The first row of each range goes to the range before it as well, as a
    ghost: one row for each partition, found by an aggregation.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    lows = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("p")).first()["p"] or []
    bounds = sorted({x for x in lows}, reverse=True)  # one number for each partition
    part = F.lit(0)
    if bounds:
        ranges = F.array(*[F.lit(x).cast("bigint") for x in bounds])
        part = F.size(F.filter(ranges, lambda b: b > F.col("doc_id")))
    # Rows without a doc_id are spread over n more parts, by the hash that orders them.
    tie = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.floor(tie * n / (1 << 20)).cast("int")).otherwise(part)
    dealt = docs.withColumn("part", part).withColumn("tie", tie)
    # The first row of a part: the greatest doc_id, or the least tie.
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"), F.min("tie").alias("least")).orderBy("part").collect()  # 2 n rows at most
    if not heads:
        return spark.createDataFrame([], OUT)
    before = {h["part"]: heads[k - 1]["part"] for k, h in enumerate(heads)}
    least_of = F.create_map(*[F.lit(x) for h in heads for x in (h["part"], h["least"])])
    head_of = F.create_map(*[F.lit(x) for h in heads for x in (h["part"], h["head"])])
    before_of = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    first = dealt.where(F.col("doc_id").eqNullSafe(head_of[F.col("part")]) & F.col("tie").eqNullSafe(least_of[F.col("part")]))
    # Of rows that tie at the head, the one that sorts first; ties are rare, and the least text is found by an aggregation.
    first = first.groupBy("part", "doc_id").agg(F.min("text").alias("text")).select(before_of[F.col("part")].alias("part"), "doc_id", "text", F.lit(True).alias("ghost"))
    rows = dealt.select("part", "doc_id", "text", F.lit(False).alias("ghost"), "tie").union(first.withColumn("tie", F.lit(0)))
    placed = rows.repartition(n, "part").sortWithinPartitions(F.col("part"), F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text"))
    return placed.select("part", "doc_id", "text", "ghost").mapInArrow(compare, OUT)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
