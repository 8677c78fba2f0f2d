"""The resource and lock reports, and growth of counters, on data as it arrives."""

from .intervals import deltas_stream
from .locks import arrivals, lock_overview_stream, restrict
from .resource import dtu_stream, resource_fit_stream

__all__ = ["arrivals", "deltas_stream", "dtu_stream", "lock_overview_stream", "resource_fit_stream", "restrict"]
