"""Rounding, shares, formats, tiers and other numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column | str, digits: int = 2) -> Column:
    """Round half up, after removing the noise of the summation order: a sum of
    cents that is a tie must not fall on either side by its last bits."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.round(F.round(v, digits + 4), digits)


def rounded(value: Column, digits: int = 2) -> Column:
    """Round; anything that is not a finite number becomes NULL."""
    v = value.cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, rnd(v, digits))


def share_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent, one decimal; NULL without a whole."""
    return rounded(part / F.nullif(whole.cast("double"), F.lit(0.0)) * 100, 1)


SEVERITIES = ["critical", "high", "medium", "low", "info"]


def severity_from_share(money: Column, revenue: Column) -> Column:
    """Severity of an amount by its share of revenue."""
    share = F.abs(money) / F.nullif(revenue.cast("double"), F.lit(0.0))
    known = (
        F.when(share >= 0.20, "critical").when(share >= 0.08, "high").when(share >= 0.03, "medium")
        .when(share >= 0.01, "low").otherwise("info")
    )
    return F.when(F.coalesce(revenue, F.lit(0.0)) <= 0, F.when(money != 0, "medium").otherwise("info")).otherwise(known)


def severity_rank(severity: Column) -> Column:
    """0 is the worst; an unknown word comes last."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1
    return F.when(place >= 0, place).otherwise(9)


def fingerprint(*parts: Column | str) -> Column:
    """Identity of a finding: built from what it is about, never from a value."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.left(F.sha1(F.concat_ws("|", *cols)), F.lit(32))


def figure_text(value: Column, unit: Column) -> Column:
    """The one way a figure is printed in its unit."""
    return (
        F.when(unit == "percent", F.concat(F.format_number(value, 1), F.lit("%")))
        .when(unit.isin("count", "days"), F.format_number(F.bround(value, 0), 0)).otherwise(F.format_number(value, 2)))


def amount_text(value: Column, currency: str | None = None) -> Column:
    """Money as text: no decimals from a thousand on, the sign before the currency."""
    size = F.when(F.abs(value) >= 1000, F.format_number(F.abs(value), 0)).otherwise(F.format_number(F.abs(value), 2))
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.lit(currency + " " if currency else ""), size)


def in_quiet_hours(hour: Column, start: int | None, end: int | None) -> Column:
    """Inside the quiet hours, which may wrap midnight."""
    if start is None or end is None or start == end:
        return F.lit(False)
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.70, "High").when(p >= 0.40, "Medium").when(p.isNotNull(), "Low")
