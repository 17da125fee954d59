"""Operator 10: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings with their log-odds) is learned from labelled rows, never given; features are
lexicon densities, their nearness to second-person words, capitals, punctuation and obfuscation rates.  Lexicon, trees and
calibration are fitted on a bounded sample of labelled rows; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import stage, unstage

#: Labelled rows that a model is fitted on at most, in order of a hash of doc_id.
LABELLED_ROWS = 20_000
#: Lexicon: candidates at most, toxic texts that must hold an entry, and its least log-odds.
CANDIDATES, LEAST_TEXTS, LEAST_ODDS = 20_000, 4, 2.0
#: Letters of a word beginning; words around a lexicon word in which a second-person word counts as near.
STEM, NEAR = 5, 5
#: Trees: rounds, depth, bins, learning rate, L2 penalty.
ROUNDS, DEPTH, BINS, RATE, PENALTY = 120, 3, 64, 0.15, 1.0

#: Second-person words of the languages at hand, in lower case.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
_ENDS = ["", ".", ",", "!", "?", ";", ":", ".\"", "!!"]
_OBFUSCATED = re.compile(r"[A-Za-z]+[0-9@$*#%&!]+[A-Za-z]+|[A-Za-z]{2,}[*$%&#]{2,}|\b(?:[A-Za-z][.\-_ ]){3,}[A-Za-z]\b")
_CAPITALS = bytes(range(65, 91))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str) -> set[str]:
    """Distinct lexicon keys of a text: words, and beginnings of longer words marked by a star."""
    words = {w.strip(".,;:!?\"'()") for w in text.lower().split()}
    words.discard("")
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


class Features:
    """Dense features of a text, given a lexicon key -> log-odds."""

    size = 16

    def __init__(self, lexicon: dict[str, float]):
        self.words = {w + end: v for w, v in lexicon.items() if not w.endswith("*") for end in _ENDS}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
        self.second = {w + end for w in SECOND_PERSON for end in _ENDS}

    def of(self, text: str) -> list[float]:
        raw = text.encode()
        words = text.lower().split()
        n, size = max(1, len(words)), max(1, len(raw))
        full, stems, second = self.words, self.stems, self.second
        hits = [(i, w) for i, w in enumerate(words) if w in full or (w[:STEM] in stems and len(w) > STEM)]
        total = best = 0.0
        exact = near = 0
        for i, w in hits:
            weight = max(full.get(w, 0.0), stems.get(w[:STEM], 0.0) if len(w) > STEM else 0.0)
            total += weight
            best = max(best, weight)
            exact += w in full
            near += any(x in second for x in words[max(0, i - NEAR) : i + NEAR + 1])
        capitals = len(raw) - len(raw.translate(None, _CAPITALS))
        marks = len(raw) - len(raw.translate(None, _PUNCTUATION))
        odd = sum(1 for _ in _OBFUSCATED.finditer(text)) if marks or not text.isalpha() else 0
        return [
            np.log1p(len(words)),
            total,
            total / n,
            best,
            float(len(hits)),
            len(hits) / n,
            float(exact),
            float(len({w for _, w in hits})),
            near / n,
            float(near),
            capitals / size,
            marks / size,
            raw.count(b"!") / n,
            raw.count(b"?") / n,
            odd / n,
            (len(raw) - len(text)) / size,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t or "") for t in texts], float).reshape(len(texts), self.size)


@dataclass
class Trees:
    """Boosted trees of one depth: split features and thresholds by level order, and leaf values."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaves[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Logistic loss, second-order gains, histogram splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    inner, nodes = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            own = at - first
            best = np.zeros(wide)
            for j, edge in enumerate(edges):
                if not len(edge):
                    continue
                key = own * BINS + binned[:, j]
                g = np.bincount(key, grad, wide * BINS).reshape(wide, BINS)
                h = np.bincount(key, hess, wide * BINS).reshape(wide, BINS)
                gl, hl = g.cumsum(1)[:, : len(edge)], h.cumsum(1)[:, : len(edge)]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                cut = gain.argmax(1)
                value = gain[np.arange(wide), cut]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + wide][better] = j
                threshold[first : first + wide][better] = edge[cut[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, grad, nodes) / (np.bincount(leaf, hess, nodes) + PENALTY)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = [(b[k], (b[0] + 0.5 * rate) / (b[1] + 0.5)) for rate in [float(y.mean())] for b in blocks for k in (2, 3)]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None], features: Features) -> np.ndarray:
        """Calibrated probabilities: constant below and above the fitted range, a tiny slope keeps the trees' order."""
        if self.trees is None:
            return np.full(len(texts), float(self.knots[1][0]))
        margin = self.trees.margin(features.matrix(texts))
        value = np.interp(margin, *self.knots)
        return np.clip(value * 0.999 + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def is_held_out(doc_id: Column | str) -> Column:
    """Rows that no label is learned from: crc32 of the id's decimal text is divisible by 5.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    known = labels.filter("toxic is not null and doc_id is not null").filter(~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", (F.col("toxic") != 0).cast("int").alias("toxic"))


def _learn_lexicon(sample: DataFrame) -> dict[str, float]:
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def counted(wanted: frozenset | None):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            counts: Counter = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    found = tokens(text or "")
                    counts.update(found if wanted is None else found & wanted)
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

        return run

    def top(rows: DataFrame, wanted: frozenset | None, least: int) -> dict[str, int]:
        found = rows.select("text").mapInArrow(counted(wanted), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r["key"]: r["n"] for r in found.orderBy(F.desc("n"), "key").limit(CANDIDATES).collect()}

    toxic = top(sample.filter("toxic = 1"), None, LEAST_TEXTS)
    clean = top(sample.filter("toxic = 0"), frozenset(toxic), 1) if toxic else {}
    n1, n0 = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    odds = {k: float(np.log((n + 0.5) / n1) - np.log((clean.get(k, 0) + 0.5) / n0)) for k, n in toxic.items()}
    return {k: v for k, v in odds.items() if v >= LEAST_ODDS}


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most `rows` labelled rows, none of them held out.

    Three quarters of them give the lexicon and the trees, the others only calibrate, so no feature of theirs has seen
    their labels.  Without labelled rows, or with labels of one kind, the score is a constant: the share of toxic labels, or
    0.  Null texts count as empty; a doc_id labelled twice is toxic if any label says so; rows that share a labelled doc_id
    are all labelled.
    """
    sample = stage(_sample(docs, labels, rows), "labelled")
    lexicon = _learn_lexicon(sample.filter(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % 4 != 0))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features(lexicon)
        for batch in batches:
            matrix = features.matrix(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(list(matrix), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = sample.mapInArrow(measure, "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    unstage(sample)
    y = np.array([r["toxic"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, (np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    x = np.array([r["x"] for r in got])
    second = np.array([zlib.crc32(f"fold {r['doc_id']}".encode()) % 4 == 0 for r in got])
    if len(set(y[second].tolist())) < 2 or len(set(y[~second].tolist())) < 2:
        second[:] = False
    trees = fit_trees(x[~second], y[~second])
    use = second if second.any() else ~second
    return Model(lexicon, trees, isotonic(trees.margin(x[use]), y[use]))


def _scorer(model: Model, text: str, score: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features(model.lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                scores = model.scores(part.column(text).to_pylist(), features)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, score])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without words; texts of any length are read whole; null ids stay null and are
    not held out; repeated rows repeat; a score of exactly 0.5 is predicted 1; an empty table gives no rows; other columns
    are not read, so their names may clash with ours.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model, "text", "__score"), "doc_id long, text string, __score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, in all columns of `docs`, whose score is below `least`; a score of `least` goes.

    Null texts are scored as empty ones and stay null; repeated rows repeat; an empty table stays empty; other columns may
    have any names.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots don't pass mapInArrow
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    scored = plain.mapInArrow(_scorer(model, plain.columns[docs.columns.index("text")], "score"), schema)
    return scored.filter(F.col("score") < least).drop("score").toDF(*docs.columns)
