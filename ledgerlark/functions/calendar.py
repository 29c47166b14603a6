"""Ramadan and Eid as day features."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Announced first days of Ramadan.
RAMADAN = ["2019-05-06", "2020-04-24", "2021-04-13", "2022-04-02", "2023-03-23", "2024-03-11", "2025-03-01", "2026-02-18", "2027-02-08",
           "2028-01-28", "2029-01-16", "2030-01-05", "2031-12-15", "2032-12-04", "2033-11-23", "2034-11-12", "2035-11-01"]
# Offsets in days from the first day of Ramadan, both ends included.
SPANS = {"pre_ramadan": (-7, -1), "ramadan": (0, 28), "eid_fitr": (29, 32), "eid_adha": (99, 102), "post_eid": (33, 42)}


def _inside(day: Column, span: tuple[int, int]) -> Column:
    out = F.lit(False)
    for text in RAMADAN:
        first = date.fromisoformat(text)
        out = out | day.between(F.lit(first + timedelta(days=span[0])), F.lit(first + timedelta(days=span[1])))
    return out


def event_columns(day: Column) -> dict[str, Column]:
    """0/1 columns per event, and a ramp that rises from 0 to 1 over Ramadan."""
    out = {name: _inside(day, span).cast("double") for name, span in SPANS.items()}
    ramp = F.lit(0.0)
    for text in RAMADAN:
        offset = F.date_diff(day, F.lit(date.fromisoformat(text)))
        ramp = F.when(offset.between(0, 28), offset / 28.0).otherwise(ramp)
    return {**out, "ramadan_ramp": ramp}
