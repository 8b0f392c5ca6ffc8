"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, hash-partitioned count tables.

Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and one end for each text; the context of a text's first token is a start mark.
With c the counts in training texts, N their sum, d and D the Good-Turing discounts of unigrams and bigrams (1 above K = 5):

    P(w)     = d(c(w)) c(w) / (N + 1)                 c(w) > 0; unknown tokens share what is left
    P(w | h) = D(c(h w)) c(h w) / (c(h) + 1)          c(h w) > 0
             = a(h) P(w)                              else, a(h) = (1 - sum of the former over w) / (1 - sum of their P(w))

The 1 in each denominator keeps some mass for what was not seen where no count is discounted, so a(h) > 0 and every context sums to 1 exactly.

All texts are read as token pairs, counted for each document in blocks and dealt by a hash of the token to partitions, as packed arrays. A
partition holds all pairs of its tokens, so it counts c(w) and c(h w) over all training texts and scores each pair where its counts
lie. Discounts come later: a document's score needs only how many of its pairs have each small count. What a(h) needs is summed by context in each partition
and dealt to the context's partition, as are the pairs that back off; their weights return to the documents. Tokens with a
share of at least 1 / HOT of all (so at most HOT) are dealt by the whole pair, their counts taken beforehand, and where such a token (or a text's start)
is a context, its weight is sent to the pairs: no partition grows with a frequent word. There is a partition for each PART tokens, so a task's
pairs do not grow with the input; nothing but the counts and weights of hot tokens and a few sums reach the driver.

The order is two. Every pair of the corpus is shuffled once, which is what takes the disk (README has figures); triples would be half as much again.

Defined results: null and empty texts are their end alone; each row is a document, rows with the same doc_id too; rows with a null doc_id train and are
not held out; without training texts every token is unknown and both scores are 0.0 a token; an empty table gives no rows; very long texts
are read by runs of BLOCK tokens and more; other columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.texthash import U, mix, slices, tidied, tidy, word_hashes, words
from velspar.session import materialise

K, HOT, BLOCK, PART, UNIT = 5, 2000, 1 << 20, 2_000_000, 1 << 26
START, END = U(0x5DEECE66D1234567), U(0x2545F4914F6CDD1D)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: 64-bit ones by their differences (tables are sorted), other integers in their least width, numbers with
    a fraction in units of 1 / UNIT, so that sums do not depend on their order."""
    out = []
    for a in arrays:
        kind = a.dtype.kind
        if kind == "f":
            a = np.rint(a * UNIT).astype(np.int64)
        wide = kind != "u" and a.dtype.itemsize == 8 or kind == "u" and len(a) and a.max() >> U(32)
        if wide:
            a = np.diff(a.view(U), prepend=U(0))
        elif kind == "u" and len(a):
            a = a.astype(np.min_scalar_type(int(a.max())))
        out.append((kind, wide, a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, wide, dtype, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(dtype).itemsize
        a = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).reshape(-1).view(dtype)
        if wide:
            a = np.cumsum(a, dtype=U)
            a = a if kind == "u" else a.view(np.int64)
        out.append(a / UNIT if kind == "f" else a)
    return out


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, contexts, document of each, ids, whether they train) of blocks of texts of about BLOCK tokens; columns are id, train and text."""
    tokens, contexts, at, ids, train, size = [], [], [], [], [], 0
    for batch in batches:
        own, use = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in slices(batch.column(2)):
            starts, ends, bounds = words(data, offsets)
            n = end - row
            last = bounds[1:] + np.arange(n)
            token = np.empty(bounds[-1] + n, U)
            token[last] = END
            inner = np.ones(len(token), bool)
            inner[last] = False
            token[inner] = word_hashes(data, starts, ends)
            context = np.empty_like(token)
            context[1:] = token[:-1]
            context[bounds[:-1] + np.arange(n)] = START
            tokens.append(token)
            contexts.append(context)
            at.append(np.repeat(np.arange(n) + sum(map(len, ids)), np.diff(bounds) + 1))
            ids.append(own[row:end].astype(np.int64))
            train.append(use[row:end].astype(bool))
            size += len(token)
            if size >= BLOCK:
                yield tuple(map(np.concatenate, (tokens, contexts, at, ids, train)))
                tokens, contexts, at, ids, train, size = [], [], [], [], [], 0
    if size:
        yield tuple(map(np.concatenate, (tokens, contexts, at, ids, train)))


@tidied
def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of tokens with a share of 1 / (2 HOT) in a block, and under token null the size of the block."""
    for token, *_ in read(batches):
        own, n = np.unique(token, return_counts=True)
        own, n = own[n * 2 * HOT >= len(token)], n[n * 2 * HOT >= len(token)]
        yield pa.RecordBatch.from_arrays([pa.array([None, *own.view(np.int64)], pa.int64()), pa.array([len(token), *n], pa.int64())], ["token", "n"])


@tidied
def trained(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, n): counts of hot tokens in training texts; under null all their tokens, and -1 under START's place the texts."""
    for token, _, at, _, use in read(batches):
        token = token[use[at]]
        n = np.zeros(len(hot), np.int64)
        if len(hot):
            rank = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            n = np.bincount(rank[hot[rank] == token], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array([None, int(START.view(np.int64)), *hot.view(np.int64)], pa.int64()), pa.array([len(token), int(use.sum()), *n], pa.int64())], ["token", "n"])


@tidied
def deal(batches: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed pairs of each block for each partition."""
    for token, context, at, ids, use in read(batches):
        table = np.unique(np.append(token, START))
        t, c = np.searchsorted(table, token).astype(U), np.searchsorted(table, context).astype(U)
        bits, docs = U(int(len(table)).bit_length()), U(int(len(ids)).bit_length())
        key = np.sort((t << (bits + docs)) | (c << docs) | at.astype(U))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        doc, c, t = key & ((U(1) << docs) - U(1)), (key >> docs) & ((U(1) << bits) - U(1)), key >> (bits + docs)
        of_token = (mix(table) % U(parts)).astype(np.int64)
        is_hot = np.isin(table, hot)
        part = np.where(is_hot[t], (mix(table[t] ^ mix(table[c])) % U(parts)).astype(np.int64), of_token[t])
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            o = order[bounds[p] : bounds[p + 1]]
            if len(o):
                run = np.flatnonzero(np.concatenate(([True], t[o][1:] != t[o][:-1])))
                seen, index = np.unique(c[o], return_inverse=True)
                local, place = np.unique(doc[o], return_inverse=True)
                blob = pack(table[t[o][run]], np.diff(np.append(run, len(o))).astype(U), table[seen], index.astype(U), ids[local.astype(np.int64)], use[local.astype(np.int64)], place.astype(U), n[o].astype(U))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])


def among(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    rank = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return rank, table[rank] == values


@tidied
def count(part: int, blobs: list[bytes], hot: np.ndarray, hot_n: np.ndarray, parts: int) -> Iterator[tuple[str, int, bytes]]:
    """(kind, target partition, blob) of one partition's pairs: see the module."""
    # Blobs bring their own tables of tokens, contexts and documents; each pair is numbered by the partition's tables in 32 bits.
    tokens, contexts, ids = (np.unique(np.concatenate(x)) for x in zip(*[[y[k].astype(U if k < 4 else np.int64) for k in (0, 2, 4)] for y in map(unpack, blobs)], strict=True))
    use = np.zeros(len(ids), bool)
    columns: list[list[np.ndarray]] = [[] for _ in range(4)]
    for k, blob in enumerate(blobs):
        blobs[k] = b""
        own_tokens, runs, own_contexts, index, own_ids, own_use, place, n = unpack(blob)
        at = np.searchsorted(ids, own_ids).astype(np.int32)
        use[at] = own_use
        for column, x in zip(columns, (np.repeat(np.searchsorted(tokens, own_tokens).astype(np.int32), runs.astype(np.int64)), np.searchsorted(contexts, own_contexts).astype(np.int32)[index], at[place], n.astype(np.int32)), strict=True):
            column.append(x)
    t, c, d, n = map(np.concatenate, columns)
    del columns
    pair, p = np.unique(t.astype(U) << U(32) | c.astype(U), return_inverse=True)
    p = p.astype(np.int32)
    learned = np.where(use[d], n, 0)
    c_token = np.bincount(t, learned, len(tokens)).astype(np.int64)
    own = np.ones(len(tokens), bool)
    if len(hot):
        rank = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        own = hot[rank] != tokens
        c_token = np.where(own, c_token, hot_n[rank])
    c_pair = np.bincount(p, learned, len(pair)).astype(np.int64)
    del learned
    # Sums for the documents.
    ct, cp = c_token[t], c_pair[p]
    seen = cp > 0
    add = lambda w, where=slice(None): np.bincount(d[where], w[where], len(ids))
    log = np.where(seen, np.where(cp > K, np.log10(np.maximum(cp, 1)), 0), np.where(ct > K, np.log10(np.maximum(ct, 1)), 0))
    sums = [add(n), add(n * (ct > 0)), add(n * np.log10(ct + 1)), add(n * log)]
    sums += [add(n, seen & (cp == r)) for r in range(1, K + 1)] + [add(n, ~seen & (ct == r)) for r in range(K + 1)] + [add(n, ~seen & (ct > K))]
    counts = [0, 1, *range(4, len(sums))]
    target = (mix(ids.view(U) + U(3)) % U(parts)).astype(np.int64)
    for q in np.unique(target).tolist():
        o = target == q
        yield "doc", q, pack(ids[o], *[x[o].astype(U) if k in counts else x[o] for k, x in enumerate(sums)])
    del sums, log, ct, cp, p, t
    # Pairs that back off, for their contexts.
    far = (mix(contexts + U(5)) % U(parts)).astype(np.int64)
    frequent_context = among(contexts, np.sort(np.append(hot, START)))[1]
    off = np.flatnonzero(~seen)
    off_part = np.where(frequent_context[c[off]], part, far[c[off]])  # a frequent context's pairs stay where they are, spread by token
    for q in np.unique(off_part).tolist():
        o = off[off_part == q]
        h, index = np.unique(c[o], return_inverse=True)
        local, place = np.unique(d[o], return_inverse=True)
        yield "off", q, pack(contexts[h], index.astype(U), ids[local], place.astype(U), n[o].astype(U))
    # What the weights of contexts need of the seen pairs.
    known = c_pair > 0
    c_of, t_of = (pair[known] & U(0xFFFFFFFF)).astype(np.int64), (pair[known] >> U(32)).astype(np.int64)
    cp, ct = c_pair[known], c_token[t_of]
    by = lambda w=None, where=slice(None): np.bincount(c_of[where], None if w is None else w[where], len(contexts))
    table = [by(np.where(ct > K, ct, 0))] + [by(None, ct == r) for r in range(1, K + 1)] + [by(None, cp == r) for r in range(1, K + 1)]
    some = by() > 0
    for q in np.unique(far[some]).tolist():
        o = some & (far == q)
        for kind, o in (("context", o & ~frequent_context), ("frequent", o & frequent_context)):
            if o.any():
                yield kind, q, pack(contexts[o], *[x[o].astype(U) for x in table])
    mine = own & (c_token > 0)
    place = (mix(tokens + U(5)) % U(parts)).astype(np.int64)
    for q in np.unique(place[mine]).tolist():
        o = mine & (place == q)
        yield "token", q, pack(tokens[o], c_token[o].astype(U))
    stats = [*(int((c_token[own] == r).sum()) for r in range(1, K + 2)), *(int((cp == r).sum()) for r in range(1, K + 2)), int(mine.sum())]
    yield "stats", 0, pack(np.array(stats, np.int64))


def smoothed(n: list[int]) -> np.ndarray | None:
    """Simple Good-Turing's numbers of types with counts 1 to len(n): the line through log Z over log r, where Z is n shared out over the gap between
    its neighbours that are not 0. None where the line falls no faster than 1 / r, as no discount follows from it then."""
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return None
    before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    slope, level = np.polyfit(np.log(r), np.log(np.array(n)[r - 1] / (0.5 * (after - before))), 1)
    return np.exp(level + slope * np.log(np.arange(1, len(n) + 1))) if slope < -1 else None


def good_turing(n: np.ndarray) -> np.ndarray | None:
    """Discounts for counts 1 to K, the entry for 0 is 1; None if one does not lie in (0, 1]."""
    r, a = np.arange(1, K + 1), (K + 1) * n[K] / n[0]
    out = np.append(1.0, ((r + 1) * n[1:] / n[:-1] / r - a) / (1 - a)) if a < 1 else np.zeros(K + 1)
    return out if (out > 0).all() and (out <= 1).all() else None


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts for counts 1 to K from the numbers n of types with counts 1 to K + 1; d[0] is not used.

    Good-Turing by n as they are; where that does not lie in (0, 1] for every count, as groups of copies swell single n, by the smoothed n. Only where
    these do not fall faster than 1 / r, or fewer than two n are above 0, absolute discounting by n1 / (n1 + 2 n2) stands in.
    """
    found = good_turing(np.array(n, float)) if all(n) else None
    if found is None and (line := smoothed(n)) is not None:
        found = good_turing(line)
    if found is not None:
        return found
    out = np.ones(K + 1)
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out[1:] = [(r - min(cut, 0.99)) / r for r in range(1, K + 1)]
    return out


def weights(blobs: list[list[np.ndarray]], tokens: np.ndarray, n: np.ndarray, total: int, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, log10 of a(h) (c(h) + 1)) from the sums of each context and the counts n of the sorted tokens."""
    contexts, index = np.unique(np.concatenate([np.zeros(0, U), *(x[0].astype(U) for x in blobs)]), return_inverse=True)
    sums = [np.bincount(index, np.concatenate([np.zeros(0), *(x[k].astype(float) for x in blobs)]), len(contexts)) for k in range(1, 2 * K + 2)]
    rank, known = among(contexts, tokens)
    c = np.where(known, n[rank] if len(n) else 0, 0).astype(float)
    r = np.arange(1, K + 1)
    low, small = np.array(sums[1 : K + 1]).reshape(K, -1), np.array(sums[K + 1 :]).reshape(K, -1)
    left = 1 - (c - (r * (1 - d2[1:])) @ small) / (c + 1)
    rest = 1 - (sums[0] + (r * d1[1:]) @ low) / (total + 1)
    return contexts, np.log10(left / rest) + np.log10(c + 1)


@tidied
def back_off(rows: list[tuple[str, bytes]], frequent_weights: tuple[np.ndarray, np.ndarray], total: int, d1: np.ndarray, d2: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Of one partition of contexts: what the pairs that back off add to their documents, (target partition, blob)."""
    found: dict[str, list[list[np.ndarray]]] = {"context": [], "token": [], "off": []}
    for kind, blob in rows:
        found[kind].append(unpack(blob))
    if not found["off"]:
        return
    tokens = np.concatenate([np.zeros(0, U), *(x[0].astype(U) for x in found["token"])])
    n = np.concatenate([np.zeros(0, np.int64), *(x[1].astype(np.int64) for x in found["token"])])
    order = np.argsort(tokens)
    both = [np.concatenate(x) for x in zip(weights(found["context"], tokens[order], n[order], total, d1, d2), frequent_weights, strict=True)]
    order = np.argsort(both[0])
    contexts, weight = both[0][order], both[1][order]
    ids = np.concatenate([x[2][x[3]] for x in found["off"]])
    h = np.concatenate([x[0].astype(U)[x[1]] for x in found["off"]])
    many = np.concatenate([x[4].astype(float) for x in found["off"]])
    rank, known = among(h, contexts)
    own = np.where(known, weight[rank] if len(weight) else 0.0, 0.0)  # an unknown context: a = 1, c = 0
    docs, d = np.unique(ids, return_inverse=True)
    x = np.bincount(d, own * many, len(docs))
    target = (mix(docs.view(U) + U(3)) % U(parts)).astype(np.int64)
    for q in np.unique(target).tolist():
        yield q, pack(docs[target == q], x[target == q])


def finish(rows: list[tuple[str, bytes]], total: int, types: int, d1: np.ndarray, d2: np.ndarray, unknown: float) -> dict[str, np.ndarray]:
    """The scores of one partition of documents."""
    own = [unpack(b) for kind, b in rows if kind == "doc"]
    ids, d = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
    s = [np.bincount(d, np.concatenate([x[k].astype(float) for x in own]), len(ids)) for k in range(1, len(own[0]))]
    back = np.zeros(len(ids))
    for kind, blob in rows:
        if kind == "back":
            docs, x = unpack(blob)
            back[np.searchsorted(ids, docs)] += x
    n, known, plus, log = s[:4]
    r = np.arange(1, K + 1)
    seen, off = np.array(s[4 : 4 + K]), np.array(s[4 + K :])  # off: unknown, counts 1 to K, above
    out = log - plus + back + np.log10(d2[1:] * r) @ seen + np.log10(d1[1:] * r) @ off[1 : K + 1] - off[1:].sum(axis=0) * np.log10(total + 1) + off[0] * np.log10(unknown)
    return {"id": ids, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": plus - n * np.log10(total + types + 1), "score": out}


def blobs_by(df: DataFrame, parts: int, column: str) -> DataFrame:
    """A partition's rows together: each partition's blobs are one group and one task."""
    return df.repartitionById(parts, F.col(column)).groupBy(column)


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learns from the documents that are not held out, scores all."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = docs.groupBy("id").count().where("count > 1 or id is null").isEmpty()
    if not plain:  # numbers tell the rows apart; they are written with them, so they stay the same
        docs = materialise(spark, docs.withColumn("id", F.monotonically_increasing_id()), "documents")
    known = docs
    docs = docs.select("id", train.alias("train"), "text")
    shares = docs.mapInArrow(frequent, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    size = F.sum(F.when(F.col("token").isNull(), F.col("n")))
    shares = materialise(spark, shares, "token-shares")
    everything = shares.agg(size.alias("n")).first()["n"] or 0
    parts = max(1, -(-everything // PART))
    hot = np.sort(np.array([r["token"] for r in shares.where(F.col("token").isNotNull() & (F.col("n") * HOT >= everything)).collect()], np.int64).view(U))  # HOT tokens at most
    sums = {r["token"]: r["n"] for r in docs.mapInArrow(lambda x: trained(x, hot), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    hot_n = np.array([sums.get(int(x), 0) for x in hot.view(np.int64)], np.int64)
    total, texts = sums.get(None, 0), sums.get(int(START.view(np.int64)), 0)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        out = [*count(int(frame["part"].iloc[0]), list(frame["blob"]), hot, hot_n, parts)]
        return pd.DataFrame(out, columns=["kind", "target", "blob"])

    dealt = docs.mapInArrow(lambda x: deal(x, hot, parts), "part int, blob binary")
    tables = materialise(spark, blobs_by(dealt, parts, "part").applyInPandas(counted, "kind string, target int, blob binary"), "katz-counts")
    stats = [sum(x) for x in zip(*[unpack(r["blob"])[0].tolist() for r in tables.where("kind = 'stats'").select("blob").collect()], strict=True)] or [0] * (2 * K + 3)
    n1, n2, types = stats[: K + 1], stats[K + 1 : 2 * K + 2], stats[-1] + int((hot_n > 0).sum())
    # Hot tokens may have small counts in training texts of a small corpus.
    n1 = [n + int((hot_n == r + 1).sum()) for r, n in enumerate(n1)]
    d1, d2 = discounts(n1), discounts(n2)
    unknown = 1 - (total - sum(r * (1 - d1[r]) * n1[r - 1] for r in range(1, K + 1))) / (total + 1)

    frequent_tokens = np.append(hot, START)
    frequent_n = np.append(hot_n, texts)
    order = np.argsort(frequent_tokens)
    frequent_tokens, frequent_n = frequent_tokens[order], frequent_n[order]

    def weighed(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = weights([unpack(b) for b in frame["blob"]], frequent_tokens, frequent_n, total, d1, d2)
        return pd.DataFrame({"h": h.view(np.int64), "w": w})

    own = blobs_by(tables.where("kind = 'frequent'"), parts, "target").applyInPandas(weighed, "h bigint, w double").collect()  # HOT contexts and the start
    frequent_weights = np.array([r["h"] for r in own], np.int64).view(U), np.array([r["w"] for r in own], float)

    def backed(frame: pd.DataFrame) -> pd.DataFrame:
        out = [*back_off(list(zip(frame["kind"], frame["blob"], strict=True)), frequent_weights, total, d1, d2, parts)]
        return pd.DataFrame([("back", q, b) for q, b in out], columns=["kind", "target", "blob"])

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        out = finish(list(zip(frame["kind"], frame["blob"], strict=True)), total, types, d1, d2, unknown)
        tidy()
        return pd.DataFrame(out)

    back = blobs_by(tables.where("kind in ('context', 'token', 'off')"), parts, "target").applyInPandas(backed, "kind string, target int, blob binary")
    every = tables.where("kind = 'doc'").union(back)
    scores = blobs_by(every, parts, "target").applyInPandas(finished, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    scores = scores.withColumn("doc_id", F.col("id")) if plain else scores.join(known.select("id", "doc_id"), "id")
    return scores.select("doc_id", (~train).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
