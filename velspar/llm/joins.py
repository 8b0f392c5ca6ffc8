"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least 1 / HOT of the counted rows is frequent, so there are HOT frequent keys at most.
HOT = 2000


def join_by_frequency(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with `counted` (one row a key, `n` of `total` rows have it): frequent keys by broadcast, so their rows stay where they
    are, and the others by a shuffle, in which no key is large."""
    frequent = counted.where(F.col(n) * HOT >= total)
    rare = counted.where(F.col(n) * HOT < total)
    here = rows.join(F.broadcast(frequent), keys)
    there = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(rare, keys)
    return here.unionByName(there)
