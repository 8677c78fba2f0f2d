"""Reports over snapshots, one module per subject."""

from . import (
    backups, dimensions, indexes, intervals, inventory, lock_steps, locks, memory_io, plancache, queries,
    resource, storage, waits,
)

__all__ = [
    "backups", "dimensions", "indexes", "intervals", "inventory", "lock_steps", "locks", "memory_io",
    "plancache", "queries", "resource", "storage", "waits",
]
