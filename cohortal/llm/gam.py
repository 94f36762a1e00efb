"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned. Cyclic boosting goes round the features;
each round fits one shallow tree to the current gradients of one feature's bins
and adds a small step of it to the feature's lookup table. Then the pairs of
features that explain most of what is left get two-dimensional tables in the
same way. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.sampling import bounded_sample
from cohortal.llm.stats import COUNTS, with_counts
from cohortal.llm.words import small_batches

TRAINING = 20_000  # labelled texts per class that are learned from
BINS = 32
PAIR_BINS = 8
ROUNDS = 120  # cycles over the features
PAIR_ROUNDS = 60
PAIRS = 6
LEAVES = 3
STEP = 0.15
SHRINK = 1.0  # added to the hessian of a leaf
PREDICT_FROM = 0.7

#: Feature: (count, per count).
RATIOS = (
    ("n_words", None), ("n_chars", None), ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"),
    ("n_repeat_words", "n_words"), ("n_words", "n_lines"), ("n_distinct_words", "n_words"), ("n_upper", "n_letters"),
    ("n_digits", "n_chars"), ("n_stops", "n_words"), ("n_commas", "n_words"), ("n_marks", "n_words"), ("n_long_words", "n_words"),
    ("n_short_words", "n_words"), ("n_capital_words", "n_words"), ("n_stop_words", "n_words"), ("n_same_as_before", "n_words"),
    ("n_letters", "n_chars"), ("longest_line", "n_chars"),
)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x features; a ratio over nothing is 0."""
    columns = [np.log1p(counts[a]) if b is None else counts[a] / np.maximum(1, counts[b]) for a, b in RATIOS]
    return np.stack(columns, axis=1).astype(np.float64)


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one after another, then Newton steps per leaf."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(hessian)))
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            middle = np.arange(a + 1, b)
            if len(middle):
                gains = gain_of(a, middle) + gain_of(middle, b) - gain_of(a, b)
                spot = int(gains.argmax())
                best = max(best, (float(gains[spot]), int(middle[spot])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SHRINK)
    return out


def _quadrants(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis of a two-dimensional table: gain and leaf values."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    g_row, g_col, h_row, h_col = g[:-1, -1:], g[-1:, :-1], h[:-1, -1:], h[-1:, :-1]
    corner_g, corner_h = g[:-1, :-1], h[:-1, :-1]
    parts = (
        (corner_g, corner_h), (g_row - corner_g, h_row - corner_h), (g_col - corner_g, h_col - corner_h),
        (g[-1, -1] - g_row - g_col + corner_g, h[-1, -1] - h_row - h_col + corner_h),
    )
    gains = sum(a**2 / (b + SHRINK) for a, b in parts)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(gradient)
    for (a, b), rows, columns in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2):
        out[rows, columns] = a[i, j] / (b[i, j] + SHRINK)
    return float(gains[i, j]), out


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, and tables of the chosen pairs."""

    constant: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    """Boost main effects in cycles, then the pairs with the largest gain on what is left."""
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(n_features)]
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(n_features)]
    share = min(max((y * weight).sum() / weight.sum(), 1e-3), 1 - 1e-3)
    constant = float(np.log(share / (1 - share)))
    total = np.full(len(y), constant)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for j in range(n_features):
            p = 1 / (1 + np.exp(-total))
            gradient = np.bincount(bins[j], weight * (y - p), minlength=len(tables[j]))
            hessian = np.bincount(bins[j], weight * p * (1 - p), minlength=len(tables[j]))
            step = STEP * _tree(gradient, hessian)
            tables[j] += step
            total += step[bins[j]]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(n_features)]

    def flat(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(small[a] * shape[1] + small[b], values, minlength=shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(n_features):
        for b in range(a + 1, n_features):
            if len(coarse[a]) and len(coarse[b]):
                gains.append((_quadrants(flat(a, b, weight * (y - p)), flat(a, b, weight * p * (1 - p)))[0], a, b))
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in pairs:
            p = 1 / (1 + np.exp(-total))
            _, step = _quadrants(flat(a, b, weight * (y - p)), flat(a, b, weight * p * (1 - p)))
            values += STEP * step
            total += STEP * step[small[a], small[b]]
    return AdditiveModel(constant, edges, tables, coarse, pairs)


def score_quality(docs: DataFrame, labels: DataFrame, settle, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7).

    Labels of documents whose crc32(doc_id) mod 4 is 2 are never learned from;
    documents with several different labels, null ids or null labels are left
    out of learning. Null and empty texts are scored as texts of no words.
    Repeated rows are scored row by row. Without labels of both classes every
    score is the share of label 1 (0.5 without any).
    """
    counts = settle(with_counts(docs.withColumnRenamed(doc, "doc_id"), ["doc_id"], COUNTS, text), "gam-counts")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    clear = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_top")).where("quality = _top and quality in (0, 1)").drop("_top")
    )
    known = counts.where(~held).join(clear, F.col("doc_id") == F.col("_doc"))
    rows = bounded_sample(known, "quality", TRAINING, F.col("doc_id"), 2).select("quality", *COUNTS).toPandas()
    y = rows["quality"].to_numpy(dtype=np.float64)
    if 0 < y.sum() < len(y):
        model = fit(features({c: rows[c].to_numpy() for c in COUNTS}), y, np.ones(len(y)))
    else:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        model = AdditiveModel(float(np.log(share / (1 - share))), [], [], [], [])
    parts = (model.constant, model.edges, model.tables, model.pair_edges, model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveModel(*parts)
        for batch in batches:
            score = own.score(features({c: batch.column(2 + k).to_numpy() for k, c in enumerate(COUNTS)}))
            predicted = pa.array((score >= PREDICT_FROM).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), predicted], names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc].dataType.simpleString()
    return counts.select("doc_id", held.alias("held_out"), *COUNTS).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
