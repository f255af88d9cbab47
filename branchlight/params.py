"""Analysis parameters, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisParams:
    min_coverage: int = 7
    max_coverage: int = 30
    forecast_days: int = 30
    safety_stock: int = 0
    reorder_point: int = 0
    stagnant_period: int = 90

    def __post_init__(self) -> None:
        lowest = {"min_coverage": 1, "max_coverage": 1, "forecast_days": 1, "safety_stock": 0,
                  "reorder_point": 0, "stagnant_period": 1}
        for name, low in lowest.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"{name} must be a whole number, got {value!r}")
            if value < low:
                raise ValueError(f"{name} must be at least {low}, got {value}")
        if self.forecast_days > 365:
            raise ValueError(f"forecast_days must be at most 365, got {self.forecast_days}")
        if self.min_coverage >= self.max_coverage:
            raise ValueError("min_coverage must be less than max_coverage")


def check_date_range(start: str, end: str) -> None:
    import datetime as dt

    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if first > last:
        raise ValueError(f"start date {start} lies after end date {end}")


def check_limit(limit: int, low: int = 1, high: int = 1000) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}, got {limit}")
    return limit
