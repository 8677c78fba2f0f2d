"""The registered queries and their oracles."""

from . import generic, history, locks, reports
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
