"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, calibrated rejection.

Subwords are byte 2-, 3- and 4-grams of the whole text; A-Z is lower-cased and every byte that is no letter counts as one white-space
byte, so digits, punctuation and junk between words do not weigh. An n-gram hashes into one of BUCKETS rows of an embedding; a text is the mean of
its rows. Prediction folds embedding and softmax into one table, so a text costs one look-up for each n-gram.

The model is fitted on a bounded sample: `per_lang` documents or so of each language (PER_LANG), those of the least hashes of doc_id, and of many
languages so many fewer each that they are TOTAL together; rows repeated under one doc_id count once in it. Their
n-gram counts, not their texts, go to one task that fits: at most BUCKETS pairs a document. A fifth of the sample is kept out of training to fit the
temperature of the softmax and the threshold of rejection: the score that all but 1 in 1000 of its rightly predicted documents reach.

Defined results: null text and text without a letter give `und` with score 0.0 and are rejected; one row for each row of the input, repeated
rows included; a null doc_id is carried along and is not held out. Without any labelled row every text is `und`; ties of languages go to the first by
name; very long texts are runs of their own; other columns are left out by identify() and kept by keep_known(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.sampling import least_hashes, one_row_each
from velspar.llm.texthash import slices

BUCKETS, DIM, SIZES, PER_LANG, TOTAL = 1 << 14, 16, (2, 3, 4), 800, 8000
MOST_REJECTING = 0.5
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes from each position on, and whether they hold at most one white-space byte and a letter."""
    folded = _FOLD[data]
    blank = (folded == 0x20).astype(np.int8)
    size = max(0, len(data) - n + 1)
    out, blanks = np.full(size, n * 0x2545F491 & 0xFFFFFFFF, np.uint32), np.zeros(size, np.int8)
    for k in range(n):
        out = (out ^ folded[k : k + size]) * _FACTORS[k]
        out ^= out >> np.uint32(15)
        blanks += blank[k : k + size]
    return (out >> np.uint32(7)) & np.uint32(BUCKETS - 1), blanks <= 1


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse n-gram counts of whole texts, with the label."""
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(1)):
            at, weight = [], []
            for k in range(end - row):
                own = data[offsets[k] : offsets[k + 1]]
                total = sum(np.bincount(g[ok], minlength=BUCKETS) for g, ok in (grams(own, n) for n in SIZES))
                seen = np.flatnonzero(total)
                at.append(seen.astype(np.int32))
                weight.append(total[seen].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(at, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float32()))], ["lang", "at", "weight"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 2.0, seed: int = 7) -> Model:
    """SGD over sparse counts; every fifth row calibrates."""
    sample = [r for r in sample if len(r[1])]
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    languages = sorted({lang for lang, _, _ in sample})
    index = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    rows = [(index[lang], np.asarray(at), np.asarray(w, np.float32) / np.float32(np.sum(w))) for lang, at, w in sample]
    train = [r for k, r in enumerate(rows) if k % 5] or rows
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            y, at, w = train[k]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = w @ embedding[at]
            p = softmax(hidden @ weights + bias)
            p[y] -= 1
            back = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= np.float32(0.01) * now * p
            embedding[at] -= (now * np.float32(len(at)) ** np.float32(0.5)) * w[:, None] * back
    table = (embedding @ weights).astype(np.float32)
    held = [r for k, r in enumerate(rows) if not k % 5] or rows
    logits = np.array([w @ table[at] + bias for _, at, w in held]).reshape(len(held), len(languages))
    truth = np.array([y for y, _, _ in held], int)
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = softmax(logits / temperature)
    right = p[np.arange(len(truth)), truth][p.argmax(axis=1) == truth]
    threshold = min(MOST_REJECTING, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(languages, table, bias, float(temperature), threshold)


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fit on labelled rows (doc_id, text, lang) of `docs`."""
    known = one_row_each(docs.where("lang is not null and text is not null").select("doc_id", "text", "lang"))
    languages = max(1, known.select("lang").distinct().count())
    chosen = least_hashes(known, "lang", max(1, min(per_lang, TOTAL // languages)))  # TOTAL ids at most
    picked = known.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("lang", "text")
    fitted = picked.mapInArrow(counts, "lang string, at array<int>, weight array<float>").repartition(1).mapInArrow(trained, _FITTED).collect()  # a bounded sample, and one row
    if not fitted:
        return fit([])
    r = fitted[0]
    return Model(list(r["languages"]), np.frombuffer(r["table"], np.float32).reshape(BUCKETS, -1) if r["languages"] else fit([]).table, np.frombuffer(r["bias"], np.float32), r["temperature"], r["threshold"])


_FITTED = "languages array<string>, table binary, bias binary, temperature double, threshold double"


def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of counts(), as one row: fitted in a task, so that the driver holds neither sample nor embedding."""
    rows = []
    for batch in batches:
        at, weight = ([v[a:b] for a, b in zip(o[:-1], o[1:], strict=True)] for v, o in ((c.values.to_numpy(), c.offsets.to_numpy().tolist()) for c in (batch.column("at"), batch.column("weight"))))
        rows += zip(batch.column("lang").to_pylist(), at, weight, strict=True)
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    rng = np.random.default_rng(1)
    m = fit([rows[k] for k in rng.permutation(len(rows))])
    cells = [pa.array([m.languages], pa.list_(pa.string())), pa.array([m.table.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary()), pa.array([float(m.temperature)]), pa.array([float(m.threshold)])]
    yield pa.RecordBatch.from_arrays(cells, ["languages", "table", "bias", "temperature", "threshold"])


def predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, "und"], object)
    n = len(model.languages)
    for batch in batches:
        ids = batch.column(0)
        for row, end, data, offsets in slices(batch.column(1)):
            total, many = np.zeros((end - row, n)), np.zeros(end - row)
            for size in SIZES:
                at, ok = grams(data, size)
                text = np.searchsorted(offsets, np.arange(len(at)), "right") - 1 if end - row > 1 else np.zeros(len(at), int)
                use = np.flatnonzero(ok & (np.arange(len(at)) + size <= offsets[text + 1]))
                at, text = at[use], text[use]
                many += np.bincount(text, minlength=end - row)
                for k in range(n):
                    total[:, k] += np.bincount(text, model.table[at, k], minlength=end - row)
            letters = np.concatenate(([0], np.cumsum(_ASCII[data])))
            plain = letters[offsets[1:]] == letters[offsets[:-1]]
            for k in np.flatnonzero(plain):
                plain[k] = not any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
            if n:
                p = softmax((total / np.maximum(many, 1)[:, None] + model.bias) / model.temperature)
                best = np.where(plain, n, p.argmax(axis=1))
                score = np.where(plain, 0.0, p.max(axis=1))
            else:
                best, score = np.zeros(end - row, int), np.zeros(end - row)
            refused = (best == n) | (score < model.threshold)
            yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(names[best], pa.string()), pa.array(score), pa.array(refused)], ["doc_id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda x: predict(x, model), "doc_id bigint, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "text", "lang")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language that the model accepts, all columns as they were."""
    model = learn(training_rows(docs))
    names = docs.columns
    tagged = docs.select(F.struct(*names).alias("row"), F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches(predict(iter([batch.select([1, 2])]), model)).combine_chunks() if batch.num_rows else None
            if found is not None:
                keep = pc.invert(found.column("rejected")).combine_chunks()
                yield from pa.Table.from_arrays([batch.column(0).filter(keep)], ["row"]).to_batches()

    return tagged.mapInArrow(kept, tagged.select("row").schema).select("row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(training_rows(docs)))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
