"""Plain listings of the fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import database_name, pick


def database_files(snap) -> DataFrame:
    """Files of every database."""
    out = database_name(snap["master_files"], snap)
    return pick(out, snap, "database_name", "name", "type_desc", "physical_name")


def databases(snap) -> DataFrame:
    """Compatibility level, recovery model and state of every database."""
    return pick(snap["databases"], snap, "name", "compatibility_level", "recovery_model_desc",
                "state_desc")


def filegroups(snap) -> DataFrame:
    """Filegroups of every database."""
    return snap["filegroups"]


def configuration(snap) -> DataFrame:
    """Configuration values by name."""
    return snap["configurations"].orderBy(*snap.keys_, "name")


def privileged_logins(snap) -> DataFrame:
    """Logins that may administer the server or its security."""
    admins = snap["logins"].filter((F.col("sysadmin") == 1) | (F.col("securityadmin") == 1))
    return pick(admins, snap, "name", "denylogin", "isntname", "isntgroup", "isntuser")
