"""Equi joins in which null keys meet each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, which may be null on both sides; ``left`` keeps its key columns.

    No hint: Spark broadcasts a side only under its own size threshold, and otherwise shuffles both and
    splits oversized partitions at run time, so a hot key of the large side does not stay in one task.
    """
    own = {k: f"_key{i}" for i, k in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in own.items()])
    return left.join(right.withColumnsRenamed(own), on, how).drop(*own.values())
