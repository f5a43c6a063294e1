"""Score and probability arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, bound: float = 20.0) -> Column:
    """ln(p / (1-p)) held within ±bound; 0 and 1 map to the bounds."""
    inner = F.ln(p / (F.lit(1.0) - p))
    return (
        F.when(p <= 0.0, F.lit(-bound))
        .when(p >= 1.0, F.lit(bound))
        .otherwise(F.least(F.greatest(inner, F.lit(-bound)), F.lit(bound)))
    )


def finite_logit(z: Column, bound: float = 50.0) -> Column:
    """NaN becomes 0; everything else, infinities too, is held within ±bound."""
    return F.when(F.isnan(z), F.lit(0.0)).otherwise(F.least(F.greatest(z, F.lit(-bound)), F.lit(bound)))


def inside_unit(p: Column, eps: float = 1e-9) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def js_divergence(p: Column, q: Column, eps: float = 1e-9) -> Column:
    """Jensen-Shannon divergence of two yes/no distributions."""
    p, q = inside_unit(p, eps), inside_unit(q, eps)
    m = (p + q) / 2.0

    def against_mean(a: Column) -> Column:
        b, mb = F.lit(1.0) - a, F.lit(1.0) - m
        return a * F.ln(a / m) + b * F.ln(b / mb)

    return (against_mean(p) + against_mean(q)) / 2.0


def quality(class_logit: Column, centre_logit: Column) -> Column:
    return sigmoid(class_logit) * sigmoid(centre_logit)


def decision_confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2.0


def is_correct(p: Column, label: Column, cut: float = 0.5) -> Column:
    return F.when((p >= cut) == (label.cast("int") == 1), F.lit(1)).otherwise(F.lit(0))


def in_mid_band(p: Column, low: float = 0.2, high: float = 0.8) -> Column:
    return (p > low) & (p < high)


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    p = inside_unit(p, eps)
    return -(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))


def width_bin(conf: Column, bins: int) -> Column:
    """1-based equal-width bin, each ``(low, high]`` and the first closed at 0.

    Edges are multiples of the double 1/bins. NULL outside [0, 1] and for NaN: such
    rows are in no bin.
    """
    step = 1.0 / bins
    near = F.greatest(F.lit(1), F.ceil(conf * bins).cast("int"))
    exact = (
        F.when((near > 1) & (conf <= (near - 1) * F.lit(step)), near - 1)
        .when((near < bins) & (conf > near * F.lit(step)), near + 1)
        .otherwise(near)
    )
    return F.when(~F.isnan(conf) & (conf >= 0.0) & (conf <= 1.0), exact)


def edge_bin(conf: Column, edges: Column) -> Column:
    """Same bins with free edges (sorted array of doubles): 1-based, NULL outside."""
    first = F.element_at(edges, 1)
    last = F.element_at(edges, -1)
    below = F.size(F.filter(edges, lambda e: e < conf))
    return F.when(~F.isnan(conf) & (conf >= first) & (conf <= last), F.greatest(F.lit(1), below))
