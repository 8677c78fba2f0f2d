"""Generic DataFrame operators. Each takes column names and an optional ``scope``:
the columns within which "all rows" is meant (a server and a snapshot, say)."""

from .asof import deltas, last_before, lookup_as_of
from .chain import chain_levels, deadlock_tails, pick_blocker, same_lead_only, shown_levels
from .joins import join_same, lookup
from .ranking import first_per_group, leading, page, pareto, running, share_of_total, top_n
from .ratio import conditional_rollup, fit_ratio, latest_or_label

__all__ = [
    "chain_levels", "conditional_rollup", "deadlock_tails", "deltas", "first_per_group", "fit_ratio",
    "join_same", "last_before", "leading", "latest_or_label", "lookup", "lookup_as_of", "page", "pareto", "pick_blocker", "running",
    "same_lead_only", "share_of_total", "shown_levels", "top_n",
]
