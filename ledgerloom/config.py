"""Default column names used when a step does not name its own columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnDefaults:
    revenue: str = "Revenue"
    cogs: str = "COGS"
    expenses: str = "Expenses"
    type: str = "Type"
    date: str = "Date"


DEFAULTS = ColumnDefaults()
