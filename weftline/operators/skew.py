"""Joins whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, or from this share of all rows if that is more; so at most 1000 keys are hot.
HOT_ROWS, HOT_SHARE = 50_000, 0.001


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, int(total * HOT_SHARE))


def hot_split_join(rows: DataFrame, reps: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows inner join reps on key, where reps has one row per key and hot is the part of reps whose keys are hot.

    Rows of hot keys meet a broadcast of the few hot rows where they lie; only the rest is shuffled. hot must be bounded,
    e.g. by hot_limit. Rows with a null key are dropped, as in any inner join.
    """
    values = [c for c in reps.columns if c != key]
    mark = hot.select(F.col(key), F.struct(*values).alias("__hot"))
    tried = rows.join(F.broadcast(mark), key, "left")
    met = tried.filter(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col("__hot")[v].alias(v) for v in values])
    rest = tried.filter(F.col("__hot").isNull()).select(*rows.columns).join(reps, key)
    return met.unionByName(rest.select(*met.columns))
