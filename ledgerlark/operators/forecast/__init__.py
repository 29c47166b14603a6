"""Forecasts for a whole panel of series at once.

Series, back-test folds and models are rows: one grouped aggregate fits every
series, fold and closed-form model, so nothing loops over series and nothing is
solved per series in Python.  A series is at most as long as its calendar, so
per-series arrays and windows stay small however many series there are.
"""
