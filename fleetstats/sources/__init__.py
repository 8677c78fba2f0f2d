"""Snapshot tables, their Parquet layout, and scratch tables."""

from .landing import Landed, land, publish_landed
from .schemas import KEYS, schema, tables
from .scratch import scratch_dir, settle, together
from .snapshot import Snapshot, append, as_of, latest, open_snapshot, read, restrict
from .store import Store, publish, sweep

__all__ = [
    "KEYS", "Landed", "Snapshot", "Store", "append", "as_of", "land", "latest", "open_snapshot", "publish", "publish_landed", "read", "restrict", "schema", "scratch_dir",
    "settle", "sweep", "tables", "together",
]
