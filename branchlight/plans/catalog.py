"""Imports every query module so that the registry is complete."""

from . import (  # noqa: F401
    q_dashboard, q_forecast, q_inventory, q_operations, q_privacy, q_reports)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
