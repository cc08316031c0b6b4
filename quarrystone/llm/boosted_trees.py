"""Quality classifier: histogram gradient-boosted trees over statistics of documents.

Statistics of whole texts are computed where the texts are; those of a bounded sample of labelled documents come to the
driver, are cut into quantile bins, and trees of a fixed depth are grown level by level from histograms of gradients.
A tree is five levels of a heap laid out flat: node i has its children at 2i + 1 and 2i + 2, so all trees are three
arrays, and all rows walk down all trees together, a level a step, by indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .common import small_batches, texts
from .quality import Lines

#: Bound of the training sample: documents of either label, whatever their length; only their statistics are collected.
SAMPLE_DOCS = 4000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, and what is added to it against leaves of few rows.
LEAF, DAMP = 2.0, 1.0
#: Labels are learned from rows whose crc32(doc_id) has another remainder than this by FOLDS.
FOLDS, HELD_OUT = 3, 1
RESULT = "doc_id long, held_out boolean, score double, predicted int"

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b".?:;,", b"|", b"#", b"*", b"$", b"%", b"&", b"<>", b"\"'`()[]{}", b"=_/\\@+~^-")
_shares = np.zeros((256, len(_GROUPS) + 1))
for _k, _chars in enumerate(_GROUPS):
    _shares[list(_chars), _k] = 1
_shares[128:, -1] = 1
_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
N_STATISTICS = len(_GROUPS) + 1 + 13


def statistics(values: list[bytes]) -> np.ndarray:
    """A row of numbers for each whole text; zeros for one without words."""
    lines = Lines(values)
    bytes_ = np.array([np.bincount(np.frombuffer(v, np.uint8), minlength=256) for v in values], np.float64).reshape(-1, 256)
    size, n_words, n_lines = (np.maximum(x, 1).astype(np.float64) for x in (bytes_.sum(axis=1), lines.n_words, lines.sizes))
    times = [Counter(w) for w in lines.words]
    distinct = np.array([len(c) for c in times]) / n_words
    commonest = np.array([max(c.values(), default=0) for c in times]) / n_words
    shares = bytes_ / size[:, None]
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(axis=1)
    per_line = lambda x: np.add.reduceat(x.astype(np.float64), lines.edges[:-1]) / n_lines if len(values) else np.zeros(0)  # noqa: E731  every text has a line
    kinds = bytes_ @ _shares
    kinds[:, 0] /= np.maximum(bytes_[:, _LETTERS].sum(axis=1), 1)
    kinds[:, -1] /= size
    kinds[:, 1:-1] /= n_words[:, None]
    rows = np.column_stack((
        kinds, np.log1p(lines.n_words), np.log1p(lines.sizes), lines.word_chars / n_words, lines.n_symbols / n_words, lines.n_dup / n_lines, lines.n_repeat / n_words,
        distinct, commonest, entropy, lines.n_words / n_lines, per_line(lines.line_words == 0), per_line((lines.line_words > 0) & (lines.line_words <= 2)),
        np.array([max(map(len, w), default=0) for w in lines.words]) / n_words,
    ))
    return np.where(lines.n_words[:, None] > 0, rows, 0.0)


@dataclass(frozen=True)
class Trees:
    """All trees, flat: which statistic each inner node asks for, up to which value rows go left, and the leaves' values."""

    feature: np.ndarray  # trees x (2**depth - 1)
    limit: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        inner, n = self.feature.shape[1], len(rows)
        node = np.zeros((len(self.feature), n), np.int64)
        tree, row = np.arange(len(self.feature))[:, None], np.arange(n)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[row, self.feature[tree, node]] > self.limit[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=0))))


def _binned(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of the bin of each value, upper edges of each column's bins); the last bin has no edge."""
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in rows.T]
    edges = [e[e < c.max()] for e, c in zip(edges, rows.T, strict=True)]
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T, strict=True)], axis=1), edges


def _grown(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, limit, leaf values, leaf of each row) of a tree for the gradients; nodes without a gain send all rows left."""
    n, width = bins.shape
    feature, limit, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
    last = np.array([len(e) for e in edges])
    for level in range(depth):
        first, many = 2**level - 1, 2**level
        cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + bins
        sums = [np.bincount(cell.ravel(), np.repeat(x, width), many * width * BINS).reshape(many, width, BINS) for x in (slope, curve)]
        g, h = (np.cumsum(s, axis=2) for s in sums)
        all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
        gain = g**2 / (h + DAMP) + (all_g - g) ** 2 / (all_h - h + DAMP) - all_g**2 / (all_h + DAMP)
        able = (np.arange(BINS) < last[:, None]) & (h >= LEAF) & (all_h - h >= LEAF)
        gain = np.where(able, gain, 0).reshape(many, -1)
        best = gain.argmax(axis=1)
        for k in np.flatnonzero(gain[np.arange(many), best] > 1e-9):
            feature[first + k], at = divmod(int(best[k]), BINS)
            limit[first + k] = edges[feature[first + k]][at]
        split = np.where(np.isfinite(limit[node]), best[node - first] % BINS, BINS)
        node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > split)
    place = node - (2**depth - 1)
    leaf = np.bincount(place, slope, 2**depth) / (np.bincount(place, curve, 2**depth) + DAMP)
    return feature, limit, leaf, place


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost trees on the logistic loss; without rows of both labels a constant."""
    share = (weights[labels == 1].sum() + 1) / (weights.sum() + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    found = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(set(labels.tolist())) < 2:
        return found
    bins, edges = _binned(rows)
    score, grown = np.full(len(rows), base), []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        feature, limit, leaf, place = _grown(bins, edges, weights * (labels - chance), weights * chance * (1 - chance), depth)
        grown.append((feature, limit, RATE * leaf))
        score += RATE * leaf[place]
    return Trees(*(np.stack(x) for x in zip(*grown, strict=True)), base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def described(docs: DataFrame, label: str) -> DataFrame:
    """The label and the statistics of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            rows = statistics(values)
            edges = np.arange(0, rows.size + 1, rows.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rows.ravel()))], ["quality", "statistics"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(label).cast("int").alias("quality"), "text").mapInArrow(run, "quality int, statistics array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Trees of at most `sample_docs` documents of either label, in a seeded order of ids, weighted to all labels' shares."""
    good = F.col("quality") == 1
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    counts = {bool(r["good"]): r["n"] for r in known.groupBy(good.alias("good")).agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for cond in (good, ~good)]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # a bounded number of ids
    rows = picked.where("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("row")).select("doc_id", "row.text", "row.quality")  # a bounded number of rows
    found = sorted((int(r["quality"] == 1), r["statistics"]) for r in described(rows, "quality").select("quality", "statistics").collect())
    marks = np.array([y for y, _ in found], np.int64)
    n = np.bincount(marks, minlength=2)
    share = np.array([counts.get(False, 0), counts.get(True, 0)]) / max(1, sum(counts.values()))
    return fit(np.array([x for _, x in found]).reshape(-1, N_STATISTICS), marks, (share * len(found) / np.maximum(n, 1))[marks])


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts have zeros for statistics and are scored by them. Repeated rows are scored each; null ids
    stay null and aren't held out. Null labels and those of unknown documents are left out, and of several labels of one
    id the smallest counts. Without labels of both kinds the score is their share. No rows give none.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            score = model.value.scores(statistics(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [f.split()[0] for f in RESULT.split(", ")])

    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return spread(rows, "doc_id", "text").mapInArrow(run, RESULT)
