"""Text expressions of knowledge-graph construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(c: Column) -> Column:
    """Lower case; everything but letters a-z and digits becomes one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_id(name: Column, kind: Column) -> Column:
    return canonical_name(F.concat_ws("_", name, kind))
