"""Labels, costs and escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cost factor of a chart type; other types count 1.0.
CHART_COST = {
    "histogram": 1.0,
    "scatter": 1.2,
    "boxplot": 1.5,
    "timeseries": 2.0,
    "heatmap": 3.0,
    "custom": 4.0,
}
STYLING_COST, RESOLUTION_COST, ANIMATION_COST = 1.5, 2.0, 3.0


def corr_strength(r: Column) -> Column:
    return (
        F.when(r > 0.7, "strong positive")
        .when(r > 0.3, "moderate positive")
        .when(r > -0.3, "weak")
        .when(r > -0.7, "moderate negative")
        .when(r.isNotNull(), "strong negative")
    )


def skew_label(s: Column) -> Column:
    return (
        F.when(F.abs(s) < 0.5, "approximately normal")
        .when(s > 0.5, "right-skewed")
        .when(s.isNotNull(), "left-skewed")
    )


def trend_label(change_percent: Column) -> Column:
    return (
        F.when(change_percent > 10, "increasing")
        .when(change_percent < -10, "decreasing")
        .otherwise("relatively stable")
    )


def request_cost(size: Column, chart: Column, styled: Column, high_resolution: Column, animated: Column) -> Column:
    """Cost of a chart request from its data size, type and options."""
    by_size = F.log10(F.greatest(size.cast("double"), F.lit(10.0))) / 4
    by_type = F.lit(1.0)
    for name, factor in CHART_COST.items():
        by_type = F.when(chart == name, F.lit(factor)).otherwise(by_type)

    def option(flag: Column, factor: float) -> Column:
        return F.when(flag, F.lit(factor)).otherwise(F.lit(1.0))

    return F.round(
        by_size * by_type * option(styled, STYLING_COST) * option(high_resolution, RESOLUTION_COST) * option(animated, ANIMATION_COST),
        2,
    )


def sanitize_text(text: Column, max_length: int | None = None) -> Column:
    """Escape markup. Angle brackets and quotes go first, so their entities are escaped again."""
    out = text
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("&", "&amp;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out if max_length is None else F.substring(out, 1, max_length)


def escape_html(text: Column) -> Column:
    """Escape markup once, ampersands first."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
