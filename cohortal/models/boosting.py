"""Histogram boosting with any twice differentiable loss, for several targets at once.

Features are binned once by quantiles. Each level of each round is one
aggregation: gradient and hessian sums by (target, node, feature, bin), which
each task adds up in arrays, so a level shuffles at most as many rows per task
as there are such cells and no training row. Losses are column expressions.
The driver sees those sums, whose number depends on parameters only, picks the
splits, and turns the finished trees into column expressions again.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cohortal.core.settle import discard, settle
from cohortal.models.base import stored_params
from cohortal.sources.files import write_params

HOLD_ROUNDS = 5  # rounds kept as expressions before the margins are written down
_STEPS = 10_000  # hash cells of a row draw
_TOGETHER = 1 << 16  # rows whose sums are added in one step of a task


@dataclass(frozen=True)
class Loss:
    """A loss of (truth y, margin s): ``gradient``, ``hessian`` and ``value`` are columns."""

    name: str
    power: float = 1.1  # variance power of the Tweedie deviance, between 1 and 2
    delta: float = 0.9  # where the Huber loss turns linear

    def gradient(self, y: Column, s: Column) -> Column:
        if self.name == "tweedie":
            return F.exp((2 - self.power) * s) - y * F.exp((1 - self.power) * s)
        if self.name == "huber":
            return F.greatest(F.least(s - y, F.lit(self.delta)), F.lit(-self.delta))
        if self.name == "logistic":
            return _sigmoid(s) - y
        return s - y

    def hessian(self, y: Column, s: Column) -> Column:
        if self.name == "tweedie":
            return (2 - self.power) * F.exp((2 - self.power) * s) - (1 - self.power) * y * F.exp((1 - self.power) * s)
        if self.name == "logistic":
            return _sigmoid(s) * (1 - _sigmoid(s))
        return F.lit(1.0)

    def value(self, y: Column, s: Column) -> Column:
        if self.name == "tweedie":
            return F.exp((2 - self.power) * s) / (2 - self.power) - y * F.exp((1 - self.power) * s) / (1 - self.power)
        if self.name == "huber":
            r = F.abs(s - y)
            return F.when(r <= self.delta, 0.5 * r * r).otherwise(self.delta * (r - 0.5 * self.delta))
        if self.name == "logistic":
            return F.greatest(s, F.lit(0.0)) - y * s + F.log1p(F.exp(-F.abs(s)))
        return 0.5 * (s - y) * (s - y)

    def start(self, mean: float | None, median: float | None) -> float:
        """Margin before the first tree."""
        mean = 0.0 if mean is None else mean
        if self.name == "tweedie":
            return math.log(max(mean, 1e-6))
        if self.name == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return math.log(p / (1 - p))
        return (median or 0.0) if self.name == "huber" else mean

    def output(self, s: Column) -> Column:
        """Prediction of a margin; an outlying Tweedie margin stays finite."""
        if self.name == "tweedie":
            return F.exp(F.least(s, F.lit(700.0)))
        return _sigmoid(s) if self.name == "logistic" else s


LOSSES = ("tweedie", "huber", "logistic", "squared")


def _sigmoid(s: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


@dataclass
class Growth:
    """How trees grow. ``patience`` 0 never stops early; without validation rows all rounds are kept."""

    rounds: int = 50
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    l1: float = 0.0
    l2: float = 1.0
    min_rows: int = 20
    min_gain: float = 0.0
    max_step: float = 0.0  # bound of a leaf before the rate; 0 for none
    row_share: float = 1.0
    rows_every: int = 5  # rounds between two draws of rows
    feature_share: float = 1.0
    patience: int = 0
    seed: int = 42


# A tree is a list of nodes: [feature, bin, threshold, left, right] goes left below the threshold,
# [value] is a leaf. Node 0 is the root.
Tree = list[list[float]]


def _tree_sql(tree: Tree, test, leaf, node: int = 0) -> str:
    part = tree[node]
    if len(part) == 1:
        return leaf(node, part[0])
    below, above = (_tree_sql(tree, test, leaf, int(k)) for k in part[3:])
    return f"CASE WHEN {test(part)} THEN {below} ELSE {above} END"


def _by_bin(part) -> str:
    return f"bins[{int(part[0])}] <= {int(part[1])}"


def _value(_node, value) -> str:
    return f"{float(value)!r}D"


def forest_column(trees: Sequence[Tree], start: float, test) -> Column:
    """Start margin plus all trees, as one expression that is cut into pieces of a hundred trees."""
    parts = [F.lit(float(start))]
    for k in range(0, len(trees), 100):
        values = ", ".join(_tree_sql(t, test, _value) for t in trees[k : k + 100])
        parts.append(F.expr(f"aggregate(array({values}), 0.0D, (a, v) -> a + v)"))
    return reduce(lambda a, b: a + b, parts)


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 rising edges at approximate quantiles, none at the minimum: a bin is edge <= x < next."""
    if not width:
        return []
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(
        *[F.percentile_approx(F.nanvl(F.col("x")[k], F.lit(None)), at, 10_000).alias(f"q{k}") for k in range(width)],
        *[F.min(F.nanvl(F.col("x")[k], F.lit(None))).alias(f"m{k}") for k in range(width)],
    ).first()
    return [sorted({float(v) for v in found[f"q{k}"] or [] if v > found[f"m{k}"]}) for k in range(width)]


def with_bins(rows: DataFrame, edges: Sequence[Sequence[float]]) -> DataFrame:
    """Replace the values ``x`` by their bin numbers ``bins``; NaN has the last bin of a feature."""
    names = [f"_x{k}" for k in range(len(edges))]
    out = rows.select("*", *[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    cut = {n: [-math.inf, *e, math.inf] for n, e in zip(names, edges) if e}
    if cut:
        made = [f"{n}b" for n in cut]
        out = Bucketizer(splitsArray=list(cut.values()), inputCols=list(cut), outputCols=made, handleInvalid="keep").transform(out)
    number = [F.col(f"{n}b") if n in cut else F.isnan(n).cast("int") for n in names]
    bins = F.array(*[b.cast("smallint") for b in number]).cast("array<smallint>")
    return out.select(*[c for c in rows.columns if c != "x"], bins.alias("bins"))


def level_sums(rows: DataFrame, loss: Loss, nodes: Sequence[Column], margins: Sequence[Column]) -> DataFrame:
    """(target, node, feature, bin, g, h, n): gradient and hessian sums and rows of one level, in one aggregation.

    ``rows`` has bins, w and y (one entry per target). Rows whose node or truth
    is null count for no target. Each task adds up its own rows in arrays, so
    that no row is multiplied by targets and features; Spark adds up the tasks.
    """
    # Leaves and margins are columns of their own, so that gradients and hessians do not work them out again.
    named = [c.alias(f"_{n}{t}") for n, given in (("node", nodes), ("s", margins)) for t, c in enumerate(given)]
    rows = rows.select("bins", "y", "w", *named)
    columns = []
    for t in range(len(nodes)):
        y, s = F.col("y")[t], F.col(f"_s{t}")
        node = F.when(y.isNotNull(), F.col(f"_node{t}"))
        g, h = F.col("w") * loss.gradient(y, s), F.col("w") * loss.hessian(y, s)
        columns += [F.coalesce(c, F.lit(e)).alias(f"{n}{t}") for n, c, e in (("node", node.cast("int"), -1), ("g", g, 0.0), ("h", h, 0.0))]
    n_targets, together = len(columns) // 3, _TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def add(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            lists = table.column(0).combine_chunks()
            bins = lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.int64)
            width, top = bins.shape[1], int(bins.max(initial=-1)) + 1
            places = bins + np.arange(width) * top
            for t in range(n_targets):
                node, g, h = (table.column(1 + 3 * t + k).to_numpy() for k in range(3))
                for one in (np.flatnonzero(np.bincount(node + 1)) - 1).tolist():
                    if one < 0:
                        continue
                    own = np.flatnonzero(node == one)
                    cells = places[own].ravel()
                    sums = np.stack([np.bincount(cells, None if v is None else np.repeat(v[own], width), minlength=width * top) for v in (g, h, None)], axis=-1)
                    sums = sums.reshape(width, top, 3)
                    if (before := total.get((t, one))) is not None:
                        size = max(top, before.shape[1])
                        sums, before = (np.pad(x, ((0, 0), (0, size - x.shape[1]), (0, 0))) for x in (sums, before))
                        sums = sums + before
                    total[t, one] = sums

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= together:
                add(held)
                held = []
        if held:
            add(held)
        for (t, one), sums in total.items():
            feature, bin_ = np.nonzero(sums[..., 2])
            g, h, n = sums[feature, bin_].T
            number = lambda v, kind: pa.array(np.broadcast_to(v, len(n)).astype(kind))
            arrays = [number(t, np.int32), number(one, np.int32), number(feature, np.int32), number(bin_, np.int16), pa.array(g), pa.array(h), number(n, np.int64)]
            yield pa.RecordBatch.from_arrays(arrays, names=["target", "node", "feature", "bin", "g", "h", "n"])

    cells = rows.select("bins", *columns).mapInArrow(run, "target int, node int, feature int, bin smallint, g double, h double, n long")
    return cells.groupBy("target", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def split_gains(cells: DataFrame, growth: Growth) -> DataFrame:
    """``cells`` (feature, bin, g, h, n) of one node with the ``gain`` of sending all bins up to each one left; null where a side has too few rows.

    The same figures as ``best_splits``, as a table; ``cells`` is small, one row per feature and bin.
    """
    up, whole = W.partitionBy("feature").orderBy("bin"), W.partitionBy("feature")
    left = {c: F.sum(c).over(up) for c in ("g", "h", "n")}
    total = {c: F.sum(c).over(whole) for c in ("g", "h", "n")}
    score = lambda g, h: F.pow(F.greatest(F.abs(g) - growth.l1, F.lit(0.0)), F.lit(2.0)) / (h + growth.l2)
    gain = score(left["g"], left["h"]) + score(total["g"] - left["g"], total["h"] - left["h"]) - score(total["g"], total["h"])
    enough = (left["n"] >= growth.min_rows) & (total["n"] - left["n"] >= growth.min_rows)
    return cells.withColumn("gain", F.when(enough, gain))


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(sums: np.ndarray, growth: Growth, usable: np.ndarray) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """(gain, feature, bin, sums left, sums right) of one node from ``sums`` (feature, bin, [g, h, n]).

    Left is every bin up to the named one. Of equal gains the first feature and bin win; a gain of 0 or less means no split.
    """
    whole = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = whole - left
    score = lambda s: _shrunk(s[..., 0], growth.l1) ** 2 / (np.maximum(s[..., 1], 0) + growth.l2 + 1e-12)
    gain = score(left) + score(right) - score(whole)
    allowed = (left[..., 2] >= growth.min_rows) & (right[..., 2] >= growth.min_rows) & usable[:, None]
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size:
        return -np.inf, 0, 0, whole, whole
    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[k, b]), int(k), int(b), left[k, b], right[k, b]


def _leaf(whole: np.ndarray, growth: Growth) -> float:
    step = -float(_shrunk(whole[0], growth.l1)) / (max(float(whole[1]), 0.0) + growth.l2 + 1e-12)
    if growth.max_step:
        step = min(max(step, -growth.max_step), growth.max_step)
    return growth.rate * step


@dataclass
class BoostedTrees:
    """Fitted trees per target, cut to the best round of each; ``curve`` holds the validation loss per round and target."""

    loss: Loss
    starts: list[float]
    trees: list[list[Tree]]
    n_features: int
    curve: list[list[float]] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    @property
    def best_rounds(self) -> list[int]:
        return [len(t) for t in self.trees]

    def margin(self, target: int = 0) -> Column:
        """Margin column; reads the array ``_x`` that ``transform`` makes of the vector."""
        return forest_column(self.trees[target], self.starts[target], lambda p: f"_x[{int(p[0])}] < {float(p[2])!r}D")

    def transform(self, df: DataFrame, names: Sequence[str], vector: str = "features") -> DataFrame:
        """Add one prediction per target."""
        wide = df.withColumn("_x", vector_to_array(F.col(vector)))
        return wide.select(*df.columns, *[self.loss.output(self.margin(t)).alias(n) for t, n in enumerate(names)])

    def importance(self) -> list[float]:
        """Share of each feature in the gains of all splits."""
        total = sum(self.gains)
        return [g / total if total else 0.0 for g in self.gains]

    def save(self, path: str) -> None:
        payload = {"loss": [self.loss.name, self.loss.power, self.loss.delta], "starts": self.starts, "trees": self.trees}
        payload |= {"n_features": self.n_features, "curve": self.curve, "gains": self.gains}
        write_params(SparkSession.active(), payload, f"{path}/params")


def load_boosted(spark: SparkSession, path: str) -> BoostedTrees:
    p = stored_params(spark, path)
    return BoostedTrees(Loss(*p["loss"]), p["starts"], p["trees"], p["n_features"], p["curve"], p["gains"])


def _frontier(tree: Tree, active: set[int]) -> Column:
    """Number of the active leaf that a row falls into; null elsewhere."""
    return F.expr(_tree_sql(tree, _by_bin, lambda n, _v: str(n) if n in active else "CAST(NULL AS INT)"))


def fit_boosted(
    data: DataFrame, targets: Sequence[str], loss: Loss, growth: Growth | None = None, *, vector: str = "features",
    weight: str | None = None, validation: str | None = None, edges: Sequence[Sequence[float]] | None = None,
) -> BoostedTrees:
    """Boost all targets together: one aggregation per level for all of them.

    ``data`` has a vector of features, the targets (a null target leaves the row
    out for it), and perhaps a weight and a boolean column that marks
    validation rows. Validation rows never enter a sum; after every round their
    mean loss is taken, each target keeps the rounds up to its lowest loss (the
    first of equals), and fitting ends when no target has improved for
    ``patience`` rounds.
    """
    growth = growth or Growth()
    if loss.name not in LOSSES:
        raise ValueError(f"unknown loss: {loss.name}")
    y = F.array(*[F.col(t).cast("double") for t in targets])
    rows = settle(
        data.select(
            F.monotonically_increasing_id().alias("row"), vector_to_array(F.col(vector)).alias("x"), y.alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
            (F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)).alias("held"),
        ),
        "boost-rows",
    )
    train = rows.where("NOT held")
    facts = train.agg(
        F.max(F.size("x")).alias("width"),
        *[F.try_divide(F.sum(F.when(F.col("y")[t].isNotNull(), F.col("w") * F.col("y")[t])), F.sum(F.when(F.col("y")[t].isNotNull(), F.col("w")))).alias(f"mean{t}") for t in range(len(targets))],
        *[F.percentile_approx(F.col("y")[t], 0.5).alias(f"median{t}") for t in range(len(targets))],
    ).first()
    width = facts["width"] or 0
    starts = [loss.start(facts[f"mean{t}"], facts[f"median{t}"]) for t in range(len(targets))]
    edges = [list(e) for e in (edges if edges is not None else quantile_edges(train, width, growth.bins))]
    width = len(edges)
    state = settle(with_bins(rows, edges).withColumn("s", F.array(*[F.lit(s) for s in starts])), "boost-state")
    discard(rows)
    with_held = validation is not None and not state.where("held").isEmpty()
    top = max((len(e) for e in edges), default=0) + 2
    draw, gains, curve = random.Random(growth.seed), [0.0] * width, []
    trees: list[list[Tree]] = [[] for _ in targets]
    pending = 0
    for number in range(growth.rounds):
        margins = [F.col("s")[t] + forest_column(trees[t][number - pending :], 0.0, _by_bin) if pending else F.col("s")[t] for t in range(len(targets))]
        own = state.where("NOT held")
        if growth.row_share < 1:
            cell = F.pmod(F.xxhash64("row", F.lit(growth.seed), F.lit(number // max(1, growth.rows_every))), F.lit(_STEPS))
            own = own.where(cell < int(growth.row_share * _STEPS))
        usable = np.zeros(width, bool)
        usable[draw.sample(range(width), max(1, round(growth.feature_share * width))) if width else []] = True
        grown = _grow(own, loss, growth, margins, width, top, edges, usable, gains)
        for t, tree in enumerate(grown):
            trees[t].append(tree)
        pending += 1
        if with_held:
            after = [F.col("s")[t] + forest_column(trees[t][number + 1 - pending :], 0.0, _by_bin) for t in range(len(targets))]
            losses = [F.avg(F.when(F.col("y")[t].isNotNull(), F.col("w") * loss.value(F.col("y")[t], s))) for t, s in enumerate(after)]
            curve.append([math.inf if v is None else v for v in state.where("held").agg(*losses).first()])
            best = [min(range(len(curve)), key=lambda k: curve[k][t]) for t in range(len(targets))]
            if growth.patience and number - max(best) >= growth.patience:
                break
        if all(len(t[0]) == 1 and t[0][0] == 0.0 for t in grown):
            break
        if pending == HOLD_ROUNDS and number + 1 < growth.rounds:
            moved = [F.col("s")[t] + forest_column(trees[t][number + 1 - pending :], 0.0, _by_bin) for t in range(len(targets))]
            old, state, pending = state, settle(state.withColumn("s", F.array(*moved)), "boost-state"), 0
            discard(old)
    discard(state)
    if with_held and curve:
        trees = [ts[: min(range(len(curve)), key=lambda k: curve[k][t]) + 1] for t, ts in enumerate(trees)]
    return BoostedTrees(loss, starts, trees, width, curve, gains)


def _grow(
    rows: DataFrame, loss: Loss, growth: Growth, margins: Sequence[Column], width: int, top: int,
    edges: Sequence[Sequence[float]], usable: np.ndarray, gains: list[float],
) -> list[Tree]:
    """One tree per target, level by level."""
    grown: list[Tree] = [[[0.0]] for _ in margins]
    active: list[set[int]] = [{0} for _ in margins]
    for _ in range(growth.depth):
        if not any(active) or not width:
            break
        nodes = [_frontier(tree, own) for tree, own in zip(grown, active)]
        found = level_sums(rows, loss, nodes, margins).toArrow()
        keys = [found.column(c).to_numpy() for c in ("target", "node", "feature", "bin")]
        sums: dict[tuple[int, int], np.ndarray] = {
            (t, n): np.zeros((width, top, 3)) for t, n in set(zip(keys[0].tolist(), keys[1].tolist()))
        }
        values = np.stack([found.column(c).to_numpy().astype(float) for c in ("g", "h", "n")], axis=1)
        for t, n, f, b, v in zip(*(k.tolist() for k in keys), values):
            sums[t, n][f, b] = v
        for t, tree in enumerate(grown):
            following: set[int] = set()
            for node in sorted(active[t]):
                if (t, node) not in sums:
                    continue
                if node == 0:
                    tree[0] = [_leaf(sums[t, 0][0].sum(axis=0), growth)]
                gain, f, b, left, right = best_splits(sums[t, node], growth, usable)
                # The last bin of NaN values has no edge of its own to split at.
                if gain <= growth.min_gain or b >= len(edges[f]):
                    continue
                gains[f] += gain
                tree += [[_leaf(left, growth)], [_leaf(right, growth)]]
                tree[node] = [f, b, edges[f][b], len(tree) - 2, len(tree) - 1]
                following |= {len(tree) - 2, len(tree) - 1}
            active[t] = following
    return grown
