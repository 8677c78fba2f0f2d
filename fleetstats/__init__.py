"""Analytics over telemetry snapshots of a fleet of database servers, on Spark."""

from . import functions, operators, plans, sources, streaming
from .sources import Snapshot, append, open_snapshot

__all__ = ["Snapshot", "append", "functions", "open_snapshot", "operators", "plans", "sources",
           "streaming"]
