"""Prediction post-processing as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from cohortal.functions.scalars import clip

REVENUE_INF = 2000.0


def enforce_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise later horizons to the running maximum of the earlier ones."""
    made = {c: F.greatest(*[F.col(p) for p in cols[: i + 1]]) for i, c in enumerate(cols) if i}
    return df.withColumns(made) if made else df


def clip_between_horizons(df: DataFrame, d1: str, d7: str, d14: str) -> DataFrame:
    """Three-horizon variant: bound d7 by d1 and d14, then widen both around it."""
    mid = F.least(F.greatest(F.col(d7), F.col(d1)), F.col(d14))
    return df.withColumns({d7: mid, d1: F.least(F.col(d1), mid), d14: F.greatest(F.col(d14), mid)})


def gate(p: Column, power: float = 1.0, cap: float = 1.0, cutoff: float = 0.0) -> Column:
    """Gate factor of a probability: 0 up to the cut-off, else clipped p to a power."""
    capped = clip(p, 0.0, cap)
    return F.when(capped <= F.lit(cutoff), F.lit(0.0)).otherwise(F.pow(capped, F.lit(float(power))))


def gate_revenue(
    revenue: Column, p: Column, power: float = 1.0, floor: float = 0.0, cap: float = 1.0, cutoff: float = 0.0
) -> Column:
    """Blend a revenue prediction with zero."""
    return F.greatest(F.lit(float(floor)), revenue * gate(p, power, cap, cutoff))


def whale_multiplier(
    p: Column,
    boost: float = 0.0,
    low: float = 1.0,
    high: float = 1.0,
    power: float = 1.0,
    cap: float = 1.0,
    cutoff: float = 0.1,
) -> Column:
    """Multiplicative boost from the probability of a very large spender."""
    return clip(F.lit(float(low)) + F.lit(float(boost)) * gate(p, power, cap, cutoff), low, high)


def scale_probability(p: Column, alpha: float) -> Column:
    """clip(p)**alpha; an alpha that is not positive or about 1 leaves p as it is."""
    inside = clip(p, 0.0, 1.0)
    if alpha <= 0.0 or abs(alpha - 1.0) <= 1e-5:
        return inside
    return F.pow(inside, F.lit(float(alpha)))


def final_gate(prediction: Column, p: Column, cutoff: float) -> Column:
    """Zero where the buyer probability does not pass the cut-off."""
    return F.when(p <= F.lit(cutoff), F.lit(0.0)).otherwise(prediction)


def expected_value(p: Column, log_revenue: Column) -> Column:
    """P(buyer) times the back-transformed revenue; NaN -> 0, +inf -> 2000, negatives -> 0."""
    revenue = F.expm1(log_revenue)
    safe = (
        F.when(revenue.isNull() | F.isnan(revenue), F.lit(0.0))
        .when(revenue == F.lit(float("inf")), F.lit(REVENUE_INF))
        .when(revenue == F.lit(float("-inf")), F.lit(0.0))
        .otherwise(revenue)
    )
    return F.greatest(F.lit(0.0), p * safe)


def meta_features(
    df: DataFrame,
    horizons: Mapping[str, str],
    weights: Mapping[str, float],
    gating: Mapping[str, Any] | None = None,
    whale_gating: Mapping[str, Any] | None = None,
    buyer: str = "buyer_proba",
    whale: str | None = "whale_proba",
    feature_cap: float | None = None,
) -> list[Column]:
    """Inputs of the stacking stage as one projection.

    ``horizons`` maps names (``d1``, ``d7``…) in increasing order to prediction
    columns; ``weights`` gives the share of each in the weighted revenue.
    """
    gating, whale_gating = gating or {}, whale_gating or {}
    p = F.col(buyer)
    cap, cutoff = float(gating.get("cap", 1.0)), float(gating.get("cutoff", 0.0))
    clipped = clip(p, 0.0, cap)
    powered = gate(p, float(gating.get("power", 1.0)), cap, cutoff)
    made: dict[str, Column] = {
        "buyer_proba": p,
        "buyer_proba_clipped": clipped,
        "buyer_gate_mask": (clipped > F.lit(cutoff)).cast("double"),
        "buyer_gate_powered": powered,
    }
    if whale is not None and whale in df.columns:
        w = F.col(whale)
        w_cap, w_cut = float(whale_gating.get("cap", 1.0)), float(whale_gating.get("cutoff", 0.1))
        w_gate = gate(w, float(whale_gating.get("power", 1.0)), w_cap, w_cut)
        made |= {
            "whale_proba": w,
            "whale_gate_mask": (clip(w, 0.0, w_cap) > F.lit(w_cut)).cast("double"),
            "whale_gate_powered": w_gate,
            "buyer_whale_product": p * w,
            "joint_gate_powered": powered * w_gate,
        }
    primary = F.col(horizons.get("d7", next(iter(horizons.values()))))
    money = {f"revenue_{name}": F.col(c) for name, c in horizons.items()}
    money["weighted_revenue"] = sum(
        [F.lit(float(weights.get(name, 0.0))) * F.col(c) for name, c in horizons.items()], F.lit(0.0)
    )
    money["buyer_x_revenue"] = p * primary
    money["gated_revenue"] = powered * primary
    if feature_cap is not None:
        money = {name: clip(c, 0.0, float(feature_cap)) for name, c in money.items()}
    return [c.alias(name) for name, c in {**made, **money}.items()]
