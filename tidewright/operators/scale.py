"""Numeric scalers: one aggregate to fit, one projection to apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TableError, as_list, numeric_columns, q, require_numeric
from .quantiles import quantiles

# Accepted spellings.
METHODS = {
    "minmax": "minmax",
    "min_max": "minmax",
    "standard": "standard",
    "zscore": "standard",
    "robust": "robust",
    "log": "log",
    "custom": "custom",
}


@dataclass
class Scaler:
    """Fitted scaler: every method but log is `low + (x - shift) / factor * width`."""

    method: str
    columns: dict[str, tuple[float, float]]
    low: float = 0.0
    width: float = 1.0

    def expression(self, column: str) -> Column:
        x = q(column).cast("double")
        if self.method == "log":
            return F.log1p(x)
        shift, factor = self.columns[column]
        if self.method in ("minmax", "custom"):
            return F.lit(self.low) + (x - F.lit(shift)) / F.lit(factor) * F.lit(self.width)
        return (x - F.lit(shift)) / F.lit(factor)


def fit_scaler(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    method: str = "standard",
    feature_range: tuple[float, float] = (0.0, 1.0),
    approx: bool = False,
) -> Scaler:
    """Learn the scaling of all columns in one pass over them."""
    kind = METHODS.get(method)
    if kind is None:
        raise TableError(f"unknown scaling method {method!r}")
    columns = require_numeric(df, as_list(columns) or numeric_columns(df))
    low, high = feature_range
    if kind in ("minmax", "custom") and low >= high:
        raise TableError("the range must grow")
    if not columns:
        return Scaler(kind, {}, low, high - low)
    params: dict[str, tuple[float, float]] = {}
    if kind == "robust":
        for c, (q1, mid, q3) in quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx).items():
            params[c] = (mid or 0.0, ((q3 or 0.0) - (q1 or 0.0)) or 1.0)
        return Scaler(kind, params)
    a, b = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
    row = df.agg(
        *[a(q(c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[b(q(c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    for i, c in enumerate(columns):
        first, second = row[f"a{i}"], row[f"b{i}"]
        if first is None:
            params[c] = (0.0, 1.0)
            continue
        first, second = float(first), float(second)
        if kind == "log":
            if first <= 0:
                raise TableError(f"log scaling needs positive values in {c}")
            params[c] = (0.0, 1.0)
        elif kind == "standard":
            params[c] = (first, second or 1.0)
        else:
            if kind == "custom" and first == second:
                raise TableError(f"cannot scale constant column {c}")
            params[c] = (first, (second - first) or 1.0)
    return Scaler(kind, params, low, high - low)


def fit_scalers(df: DataFrame, columns: dict[str, Sequence[str]]) -> dict[str, dict[str, Scaler]]:
    """Scalers of single columns by method (minmax or standard), all from one aggregate."""
    wanted = [(m, c) for m, names in columns.items() for c in names]
    ends = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}
    row = df.agg(*[f(q(c)).alias(f"{x}{i}") for i, (m, c) in enumerate(wanted) for x, f in zip("ab", ends[m])]).first()
    out: dict[str, dict[str, Scaler]] = {}
    for i, (m, c) in enumerate(wanted):
        first, second = row[f"a{i}"], row[f"b{i}"]
        params = (0.0, 1.0) if first is None else (float(first), (float(second) if m == "standard" else float(second) - float(first)) or 1.0)
        out.setdefault(m, {})[c] = Scaler(m, {c: params})
    return out


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: scaler.expression(c) for c in scaler.columns if c in df.columns})


def scale_numeric(df: DataFrame, columns=None, method: str = "standard", feature_range=(0.0, 1.0), approx: bool = False) -> DataFrame:
    """Fit and apply; several columns share the pass and the projection."""
    return apply_scaler(df, fit_scaler(df, columns, method, feature_range, approx))
