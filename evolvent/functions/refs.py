"""Type references as written in declarations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target(ref: Column) -> Column:
    """The type a reference names: its text before the first ``<``, trimmed, ``/`` read as ``.``; null if blank."""
    head = F.regexp_replace(F.substring_index(ref, "<", 1), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.nullif(F.translate(head, "/", "."), F.lit(""))


def simple_name(fqn: Column) -> Column:
    """Text after the last ``.`` or ``$``."""
    return F.regexp_extract(fqn, r"([^.$]*)$", 1)


def package_name(fqn: Column) -> Column:
    """Text before the last ``.``; empty in the default package."""
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)
