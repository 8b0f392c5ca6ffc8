"""MinHash near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set holds its distinct 5-word shingles (64-bit hashes).
Documents of equal sets form a class at once. Representatives of classes meet in banded buckets; in a bucket every member is a
candidate with one hub, not with every other. A candidate becomes a link only if 100 * intersection >= 75 * union on the full sets.
What a star can miss is then settled exactly: where the members of a hub's buckets lie in several components, they are dealt to tiles of
two chunks of TILE members, and in a tile the members outside its largest component count their common shingles with all others through an
inverted index. A tile gives out links between components alone, at most one for a member and a component.

Defined results: null text, empty text and text without words have an empty set, are linked with nothing and kept. Rows repeated under one
doc_id count once; of different texts under one doc_id the smallest counts, and keep_first() keeps its row. Rows with a null doc_id have no
identity: they are linked with nothing, have a null component and stay. Very long texts are runs of their own; other columns are left out by
near_duplicates() and kept by keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.joins import join_by_frequency
from velspar.llm.texthash import WEIGHTS, U, mix, shingles, slices, word_hashes, words
from velspar.operators.components import connected as components
from velspar.session import materialise, shuffle_partitions

BANDS, ROWS = 32, 4
#: Ids and pairs are broadcast up to this many rows (16 bytes each); beyond it the same joins shuffle.
BROADCAST_ROWS = 250_000
#: Members of a hub that one task verifies, and members of a torn star in one chunk of a tile.
CHUNK, TILE = 512, 1024


def probes(bins: int) -> np.ndarray:
    """probes[t, i]: the bin that empty bin i asks at its t-th attempt."""
    return (mix(np.arange(64 * bins, dtype=U) + U(12345)) % U(bins)).astype(np.int64).reshape(64, bins)


def signature(unique: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted distinct shingle hashes: the least hash in each bin, empty bins filled from random full bins."""
    bins = table.shape[1]
    place = ((unique >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    full = np.zeros(bins, bool)
    out = np.zeros(bins, U)
    out[place[first]] = unique[first]
    full[place[first]] = True
    empty = np.flatnonzero(~full)
    for t in range(len(table)):
        if not len(empty):
            return out
        asked = table[t, empty]
        hit = full[asked]
        out[empty[hit]] = out[asked[hit]]
        empty = empty[~hit]
    if len(empty):  # few full bins: the nearest full bin upwards, in a circle
        at = np.flatnonzero(full)
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    table = probes(bands * rows)
    weights = np.resize(WEIGHTS[:rows], bands * rows).reshape(bands, rows)
    for batch in batches:
        ids = batch.column(0)
        for row, end, data, offsets in slices(batch.column(1)):
            starts, ends, bounds = words(data, offsets)
            hashes, at = shingles(word_hashes(data, starts, ends), bounds)
            size, low, high, keys = [], [], [], []
            for k in range(end - row):
                unique = np.unique(hashes[at[k] : at[k + 1]])
                size.append(len(unique))
                low.append(int(mix(unique).sum(dtype=U).view(np.int64)))
                high.append(int(mix(unique ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).view(np.int64)))
                if len(unique):
                    sign = signature(unique, table).reshape(bands, rows)
                    keys.append(mix((sign * weights).sum(axis=1, dtype=U) + np.arange(bands, dtype=U) * U(0x632BE59BD9B4E019)).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(size, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "low", "high", "keys"])


def verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and part, the hub's own text first; yields the links."""
    hub, own = None, np.zeros(0, U)
    for batch in batches:
        hubs, parts, roles, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        a, b = [], []
        for row, end, data, offsets in slices(batch.column(4)):
            starts, ends, bounds = words(data, offsets)
            hashes, at = shingles(word_hashes(data, starts, ends), bounds)
            for k in range(end - row):
                unique = np.unique(hashes[at[k] : at[k + 1]])
                r = row + k
                if roles[r] == 0:
                    hub, own = (hubs[r], parts[r]), unique
                elif hub == (hubs[r], parts[r]):
                    n, m = len(own), len(unique)
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    both = len(np.intersect1d(own, unique, assume_unique=True))
                    if 100 * both >= percent * (n + m - both) and both:
                        a.append(hubs[r])
                        b.append(ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows (of fixed width) are few; else it is joined by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def links(spark: SparkSession, texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, other) of representatives that are similar on their full sets, as (a, b).

    Texts of the others go once to their hub's part; a hub of many others is sent to several parts, so no task gets an unbounded group.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    others = texts.join(small(pairs.join(parts, "hub").select("hub", F.col("other").alias("doc_id"), F.pmod(F.xxhash64("other"), "parts").alias("part")), n), "doc_id").select("hub", "part", F.lit(1).alias("role"), "doc_id", "text")
    hubs = texts.join(small(parts.select(F.col("hub").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")), n), "doc_id").select(F.col("doc_id").alias("hub"), "part", F.lit(0).alias("role"), "doc_id", "text")
    dealt = others.union(hubs).repartition(shuffle_partitions(spark), "hub", "part").sortWithinPartitions("hub", "part", "role")
    return materialise(spark, dealt.mapInArrow(lambda x: verify(x, percent), "a bigint, b bigint"), "links")


def settle(members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between members (id, component, set) of different components."""
    labels = np.array([c for _, c, _ in members])
    names, which, size = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    sizes = np.array([len(s) for _, _, s in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    _, term = np.unique(np.concatenate([s for _, _, s in members]), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(term))))
    at = np.concatenate(([0], np.cumsum(sizes)))
    largest, out = int(size.argmax()), []
    for x in np.flatnonzero(which != largest).tolist():
        terms = term[at[x] : at[x + 1]]
        n = first[terms + 1] - first[terms]
        place = np.repeat(first[terms] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posting[place], minlength=len(members))
        near = np.flatnonzero((100 * both >= percent * (sizes + sizes[x] - both)) & (both > 0) & (which != which[x]))
        out += [(members[x][0], members[near[k]][0]) for k in np.unique(which[near], return_index=True)[1]]
    return out


def settle_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, i, j, component, doc_id, text) come tile by tile."""
    tile, held = None, []

    def links_of(held: list) -> pa.RecordBatch:
        found = settle(held, percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        for row, end, data, offsets in slices(batch.column(5)):
            starts, ends, bounds = words(data, offsets)
            hashes, at = shingles(word_hashes(data, starts, ends), bounds)
            for k in range(end - row):
                *own, component, doc_id = keys[row + k]
                if own != tile:
                    if held:
                        yield links_of(held)
                    tile, held = own, []
                held.append((doc_id, component, np.unique(hashes[at[k] : at[k + 1]])))
    if held:
        yield links_of(held)


def torn_links(spark: SparkSession, texts: DataFrame, stars: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links that the stars (hub, other) missed: those between members of one star that lie in different components."""
    label = groups.withColumnRenamed("node", "other")
    labelled = stars.join(label, "other", "left").withColumn("component", F.coalesce("component", "other"))
    torn = labelled.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count("*") / TILE).cast("int").alias("chunks")).where("least <> most").select("hub", "chunks")
    chunk = F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int")
    rows = labelled.join(torn, "hub").withColumn("chunk", chunk)
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    rows = materialise(spark, rows.select("hub", F.col("other").alias("doc_id"), "component", F.explode(tiles).alias("tile")).select("hub", "doc_id", "component", "tile.i", "tile.j"), "torn")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    dealt = texts.join(small(rows, n), "doc_id").select("hub", "i", "j", "component", "doc_id", "text").repartition(shuffle_partitions(spark), "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc_id")
    return materialise(spark, dealt.mapInArrow(lambda x: settle_tiles(x, percent), "a bigint, b bigint"), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document; see the module."""
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = every.where("doc_id is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = materialise(spark, docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
    signed = materialise(spark, docs.mapInArrow(lambda x: signatures(x, bands, rows), "doc_id bigint, n_shingles bigint, low bigint, high bigint, keys array<bigint>"), "signatures")
    classes = materialise(spark, signed.where("n_shingles > 0").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    chosen = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id")
    members = chosen.select(F.explode(F.array_distinct("keys")).alias("key"), F.col("doc_id").alias("other"))
    shared = materialise(spark, members.groupBy("key").agg(F.count("*").alias("n"), F.min("other").alias("hub")).where("n > 1"), "buckets")
    all_members = shared.agg(F.sum("n")).first()[0] or 0
    members = join_by_frequency(members, shared, ["key"], "n", all_members)  # of buckets with two members at least
    stars = materialise(spark, members.where("hub <> other").select("hub", "other").distinct(), "stars")
    found = links(spark, docs, stars, percent)
    groups = components(spark, found)
    torn = torn_links(spark, docs, stars, groups, percent)
    if not torn.isEmpty():
        groups = components(spark, found.union(torn))
    of_class = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("low", "high", F.col("n_shingles").alias("size_of_set"), F.coalesce("component", "rep").alias("component_id"), "size")
    worded = signed.where("n_shingles > 0").select("doc_id", "low", "high", F.col("n_shingles").alias("size_of_set"))
    # A class of copies may hold a third of all documents; texts without words are in none.
    full = join_by_frequency(worded, of_class, ["low", "high", "size_of_set"], "size", signed.count()).select("doc_id", F.col("size_of_set").alias("n_shingles"), "component_id")
    full = full.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    known = full.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    unknown = every.where("doc_id is null").mapInArrow(lambda x: signatures(x, 1, 1), "doc_id bigint, n_shingles bigint, low bigint, high bigint, keys array<bigint>")
    return known.unionByName(unknown.select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay: one of each group, the one with the smallest doc_id, as one row; rows with a null doc_id stay too."""
    kept = near_duplicates(spark, docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    known = rows.where("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        known = known.groupBy("id").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", F.xxhash64("row").alias("tie"), "row")).alias("least")).select("least.row")
    return known.select("row.*").unionByName(docs.where("doc_id is null"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicates_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of near_duplicates() over a table of distinct, known doc_ids: all shared shingles are counted."""
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {documents}),
    s AS (
      SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) >= 5 THEN ws[i:i + 4] ELSE ws END, ' ')) AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM {documents} UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM {documents} d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
