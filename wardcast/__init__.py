"""Demand projections from patient contacts and population forecasts, as Spark DataFrame plans."""

from wardcast.columns import COLS, Cols

__all__ = ["COLS", "Cols"]
