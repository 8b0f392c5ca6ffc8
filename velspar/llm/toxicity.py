"""Toxicity by a weighted finite-state pattern grammar.

Clauses are scored, not isolated words. A clause is a run of words up to a sentence end, a colon, a semicolon or a line feed. Each word becomes a symbol: an
insult with its weight, a threat, a target (someone spoken to or of), a negation, a word of reported speech, a quotation mark, or nothing. Small
transducers read the symbols: one marks insults and threats after a negation, one those in reported speech or between
quotation marks, one those with a target in the clause. They are composed into one machine, whose outputs add up the weight of
each kind of match in the document; a logistic function of log(1 + sum) of each kind is the score.

The insult lexicon is learned from labels: words and beginnings of words (PREFIXES letters) whose documents are toxic. Document counts
are taken over all training rows; those with the same set of 5-word shingles and the same label are copies and count once, texts without words each. A word is kept if LEAST unlike toxic documents hold it, documents that share half of their other candidates counting as
one, so the words of a copied document do not enter; of the rest, beginnings above all, a greedy cover keeps those that explain FEW toxic
documents which no other entry explains, five for each other document that holds them. This choice and the logistic function are fitted on a bounded sample: SAMPLE toxic and 3 * SAMPLE other rows of the least
hash. Threats, targets, negations and words of reported speech are the short lists below.

Defined results: null and empty texts, and texts without a match, have the score of the logistic function at zero; without labelled rows every
score is 0.0; repeated rows give a row each; a null doc_id is carried along and is not held out. A document labelled in several rows is toxic if one of
them says so, and of texts repeated under one doc_id the least is learned from. Of entries that gain the same the whole word is taken, then the longer
beginning; very long texts are scored whole; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm.sampling import least_hashes, one_row_each
from velspar.llm.texthash import mix, shingles, slices, word_hashes, words
from velspar.session import materialise

SAMPLE, PREFIXES, LEAST, FEW = 3000, (3, 4, 5, 6, 7, 8), 5, 3
#: A candidate's toxic documents are LIFT times as many, for each other document, as chance gives; an entry of the lexicon has PURE toxic ones for each other.
LIFT, PURE = 20, 5
#: Marked documents are joined by broadcast up to this many (16 bytes each), else by a shuffle.
BROADCAST_ROWS = 250_000
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?:;\n]|[\"“”„«»]")

THREATS = frozenset("kill murder hurt destroy strangle stab shoot beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours he his him she her they them their du dich dir dein ihr euch sie ihn ihm tu te toi vous ton ta il elle ils elles lui usted ustedes tú ellos ellas él ella".split())
NEGATIONS = frozenset("not no never nobody none isn aren wasn don doesn nicht kein keine keiner niemals nie pas jamais aucun aucune ne nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote writes called calls claimed quoted reported sagte sagt schrieb nannte behauptete dit disait écrit appelé affirme dijo dice escribió llamó afirma".split())

#: Kinds of match, in the order of the logistic function's weights.
KINDS = ("insult", "targeted", "negated", "reported", "threat", "threat_targeted", "threat_off")


class Transducer:
    """Deterministic: arcs (state, symbol) -> (state, output). A symbol without an arc passes unchanged and keeps the state."""

    def __init__(self, arcs: dict[tuple, tuple], start: object = 0) -> None:
        self.arcs, self.start = arcs, start

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))


class Composed(Transducer):
    """The second reads what the first writes; product states are made as they are reached."""

    def __init__(self, first: Transducer, second: Transducer) -> None:
        super().__init__({}, (first.start, second.start))
        self.first, self.second = first, second

    def step(self, state: tuple, symbol: str) -> tuple[object, str]:
        if (state, symbol) not in self.arcs:
            a, middle = self.first.step(state[0], symbol)
            b, out = self.second.step(state[1], middle)
            self.arcs[state, symbol] = (a, b), out
        return self.arcs[state, symbol]


def negation(reach: int = 3) -> Transducer:
    """Insults and threats within `reach` words after a negation are off. The state counts down."""
    arcs: dict[tuple, tuple] = {}
    for s in range(reach + 1):
        arcs[s, "NEG"] = reach, "-"
        arcs[s, "END"] = 0, "END"
        for symbol in ("INSULT", "THREAT", "TARGET", "-", "REPORT"):
            arcs[s, symbol] = max(0, s - 1), f"{symbol}_OFF" if s and symbol in ("INSULT", "THREAT") else symbol
    return Transducer(arcs)


def reported() -> Transducer:
    """After a word of reported speech up to the clause's end, and between quotation marks, matches are reported. States: plain, reported, quoted."""
    arcs: dict[tuple, tuple] = {(s, "REPORT"): (1 if s == 0 else s, "-") for s in range(3)} | {(0, "QUOTE"): (2, "-"), (1, "QUOTE"): (2, "-"), (2, "QUOTE"): (0, "-")}
    arcs |= {(s, "END"): (0, "END") for s in range(3)}
    for s in (1, 2):
        arcs |= {(s, x): (s, x.split("_")[0] + "_REPORTED") for x in ("INSULT", "INSULT_OFF", "THREAT", "THREAT_OFF")}
    return Transducer(arcs)


def targeted() -> Transducer:
    """A target before the match in its clause. States: none, seen."""
    arcs: dict[tuple, tuple] = {(s, "TARGET"): (1, "-") for s in (0, 1)} | {(s, "END"): (0, "END") for s in (0, 1)}
    return Transducer(arcs | {(1, x): (1, f"{x}_AT") for x in ("INSULT", "THREAT")})


OUTPUTS = {"INSULT": 0, "INSULT_AT": 1, "INSULT_OFF": 2, "INSULT_REPORTED": 3, "THREAT": 4, "THREAT_AT": 5, "THREAT_OFF": 6, "THREAT_REPORTED": 6}


@dataclass
class Grammar:
    plain: dict[str, float] = field(default_factory=dict)
    prefix: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS)))
    bias: float = -30.0

    def __post_init__(self) -> None:
        self.lengths = sorted({len(p) for p in self.prefix})
        self.machine = Composed(Composed(negation(), reported()), targeted())

    def insult(self, word: str) -> float:
        return self.plain.get(word) or next((w for n in self.lengths if len(word) > n and (w := self.prefix.get(word[:n]))), 0.0)

    def matches(self, text: str) -> np.ndarray:
        """The summed weight of each kind of match in the whole text."""
        out = np.zeros(len(KINDS))
        lower = text.lower()
        words = set(_WORD.findall(lower))
        hit = {w: self.insult(w) for w in words & self.plain.keys()}
        for n in self.lengths:
            hit |= {w: v for w in words if len(w) > n and (v := self.prefix.get(w[:n]))}
        if not hit and not words & THREATS:
            return out
        state = self.machine.start
        for token in _TOKEN.findall(lower):
            weight = hit.get(token, 0.0)
            symbol = "INSULT" if weight else "THREAT" if token in THREATS else "TARGET" if token in TARGETS else "NEG" if token in NEGATIONS else "REPORT" if token in REPORTS else "END" if token in ".!?:;\n" else "QUOTE" if token in '"“”„«»' else "-"
            state, got = self.machine.step(state, symbol)
            if got in OUTPUTS:
                out[OUTPUTS[got]] += weight or 1.0
        return out

    def score(self, sums: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(np.log1p(sums) @ self.weights) + self.bias))))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, is_prefix, toxic, others): documents of a batch that hold each word or beginning."""
    for batch in batches:
        sums: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            for n in PREFIXES:
                for p in {w[:n] for w in words if len(w) > n}:
                    sums.setdefault((p, True), [0, 0])[0 if toxic else 1] += 1
            for w in words:
                sums.setdefault((w, False), [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.bool_()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["entry", "is_prefix", "toxic", "others"])


Entry = tuple[str, bool]  # a word, or a beginning


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, a, b): two sums of hashes over each text's set of shingles, which only texts of equal sets share; 0 for a text without words."""
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(2)):
            starts, ends, bounds = words(data, offsets)
            hashes, at = shingles(word_hashes(data, starts, ends), bounds)
            text = np.repeat(np.arange(end - row), np.diff(at))
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, text = hashes[new], text[new]
            sums = np.zeros((2, end - row), np.uint64)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            if len(first):
                for k in range(2):
                    sums[k, text[first]] = np.add.reduceat(mix(hashes + np.uint64(k + 1)), first)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), *(pa.array(x.view(np.int64)) for x in sums)], ["doc_id", "toxic", "a", "b"])


def unlike(holders: list[np.ndarray], entry: int, enough: int) -> bool:
    """Whether `enough` of the documents are unlike: none shares half of its candidates, the entry aside, with one counted before."""
    leaders: list[np.ndarray] = []
    for own in holders:
        rest = own[own != entry]
        both = [len(np.intersect1d(rest, x, assume_unique=True)) for x in leaders]
        if not len(rest) or all(3 * n < len(rest) + len(x) for n, x in zip(both, leaders, strict=True)):
            leaders.append(rest)
            if len(leaders) >= enough:
                return True
    return False


def choose(docs: list[tuple[int, np.ndarray]], entries: list[Entry], least: int = LEAST, few: int = FEW) -> list[Entry]:
    """The entries of the lexicon, from the candidates (numbers of entries) that each sampled document holds."""
    n = len(entries)
    false = np.bincount(np.concatenate([np.zeros(0, int), *(own for toxic, own in docs if not toxic)]), minlength=n)
    toxic = [own for t, own in docs if t]
    holds: list[list[int]] = [[] for _ in range(n)]
    for k, own in enumerate(toxic):
        for e in own.tolist():
            holds[e].append(k)
    chosen = [e for e in range(n) if not entries[e][1] and len(holds[e]) >= max(least, PURE * false[e]) and unlike([toxic[k] for k in holds[e]], e, least)]
    left = set(range(len(toxic))) - {k for e in chosen for k in holds[e]}
    rest = {e: set(holds[e]) & left for e in set(range(n)) - set(chosen) if len(holds[e]) >= few}
    while left and rest:
        # Of equal gains the whole word, then the longer beginning: the narrower entry.
        best = max(rest, key=lambda e: (len(rest[e]) - PURE * false[e], not entries[e][1], len(entries[e][0]), entries[e][0]))
        if len(rest[best]) - PURE * false[best] < few:
            break
        chosen.append(best)
        left -= rest.pop(best)
        rest = {e: ks & left for e, ks in rest.items() if len(ks & left) >= few}
    return [entries[e] for e in chosen]


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps for weights that are drawn to `prior`; kinds that never occur stay there."""
    design = np.column_stack((x, np.ones(len(x))))
    centre, pull = np.append(prior, -2.0), np.append(np.full(x.shape[1], strength), 1e-4)
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + pull * (w - centre)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull + 1e-9)
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Fit on `docs` (doc_id, text) with labels (doc_id, toxic); only known labels count."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = F.broadcast(marks) if labels.count() <= BROADCAST_ROWS else marks
    known = one_row_each(docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text")))
    marked = known.join(marks, "doc_id").select("doc_id", "text", "toxic")
    sketch = marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text").mapInArrow(sketches, "doc_id bigint, toxic int, a bigint, b bigint")
    wordless = F.when((F.col("a") == 0) & (F.col("b") == 0), F.col("doc_id"))
    kept = sketch.groupBy("a", "b", "toxic", wordless.alias("wordless")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    kept = materialise(marked.sparkSession, kept, "toxicity-rows")
    rows = marked.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "doc_id")
    sums = rows.select("text", "toxic").mapInArrow(word_counts, "entry string, is_prefix boolean, toxic bigint, others bigint").groupBy("entry", "is_prefix").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
    base = rows.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    lift = 1.0 if base >= 1 else max(0.0, base) / (1 - base)
    strong = sums.where((F.col("toxic") >= FEW) & (F.col("toxic") >= LIFT * lift * F.col("others")))
    picked = least_hashes(rows, "toxic", {1: SAMPLE, 0: 3 * SAMPLE})
    sample = marked.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")  # 4 * SAMPLE ids or so
    # Entries that no sampled row holds cannot be chosen nor tell sampled rows apart; the rest are bounded by the sample.
    present = sample.mapInArrow(word_counts, "entry string, is_prefix boolean, toxic bigint, others bigint").select("entry", "is_prefix").distinct()
    found = strong.join(present, ["entry", "is_prefix"], "left_semi").orderBy(F.desc(F.col("toxic") - F.col("others")), "is_prefix", "entry").collect()
    entries = [(r["entry"], r["is_prefix"]) for r in found]
    weight = {(r["entry"], r["is_prefix"]): r["toxic"] / (r["toxic"] + PURE * r["others"] + 1) for r in found}
    words_of, beginnings = {e: k for k, (e, p) in enumerate(entries) if not p}, {e: k for k, (e, p) in enumerate(entries) if p}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                own = set(_WORD.findall((text or "").lower()))
                out.append(sorted({words_of[w] for w in own if w in words_of} | {beginnings[w[:n]] for w in own for n in PREFIXES if len(w) > n and w[:n] in beginnings}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["toxic", "entries"])

    table = sample.mapInArrow(held, "toxic int, entries array<int>").toArrow().combine_chunks()
    held_entries = table.column(1).combine_chunks()
    flat, cuts = held_entries.values.to_numpy(), held_entries.offsets.to_numpy().tolist()
    seen = sorted(((t, flat[a:b]) for t, a, b in zip(table.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True)), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    chosen = choose(seen, entries)
    grammar = Grammar({e: weight[e, p] for e, p in chosen if not p}, {e: weight[e, p] for e, p in chosen if p})

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grammar.matches(t or "").tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.float64()))], ["toxic", "sums"])

    fitted = sample.mapInArrow(kinds, "toxic int, sums array<double>").collect()
    if fitted:
        fitted.sort(key=lambda r: (r["toxic"], r["sums"]))
        x = np.log1p(np.array([r["sums"] for r in fitted]))
        prior = np.array([1.4, 1.7, 0.4, 0.6, 1.2, 2.1, 0.2])
        grammar.weights, grammar.bias = logistic(x, np.array([r["toxic"] for r in fitted], float), prior)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grammar.score(grammar.matches(t.as_py() or "")) for t in part.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = score(docs, learn(docs.where(fold != 1).select("doc_id", "text"), labels.where(fold != 1)))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
