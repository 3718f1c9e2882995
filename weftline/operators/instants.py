"""Mixed timestamp formats and zones of several tables, as one UTC instant per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.timestamps import canonical_zone, with_instant


@dataclass(frozen=True)
class DateField:
    """One column of one table: its key column, the date column, the column of its source if any, and whether a key may come twice."""

    frame: DataFrame
    key: str
    value: str
    source: str | None = None
    repeats: bool = False


#: The zone table is broadcast only up to this many rows (a row is well under 100 bytes).
ZONE_ROWS = 100_000


def zone_table(zones: DataFrame) -> DataFrame:
    """One row per source: a valid zone or null, and day_first. Several rows of a source: the least zone, any day_first."""
    return zones.filter(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.min(canonical_zone(F.col("time_zone"))).alias("__zone"), F.max("day_first").alias("__first"))


def normalise_instants(fields: list[DateField], zones: DataFrame) -> DataFrame:
    """field_name, row_key, utc_micros: one row per key whose value names an instant.

    Values without a zone are local to the zone of their source in zones(source_name, time_zone, day_first), UTC where the
    source is null, absent or has no known zone. Null keys and values that name no instant give no row. A key that is
    delivered several times gives one row, the earliest instant if its values differ. Other columns are ignored.
    """
    parts = []
    for f in fields:
        source = F.col(f.source) if f.source else F.lit(None).cast("string")
        parts.append(f.frame.select(F.lit(f.value).alias("field_name"), F.col(f.key).cast("string").alias("row_key"), source.alias("source_name"), F.col(f.value).alias("__value"), F.lit(f.repeats).alias("__repeats")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(F.col("row_key").isNotNull() & F.col("__value").isNotNull())
    small = zone_table(zones)
    if zones.limit(ZONE_ROWS + 1).count() <= ZONE_ROWS:
        small = F.broadcast(small)
    rows = with_instant(rows.join(small, "source_name", "left"), "__value", "__zone", "__first", "utc_micros")
    rows = rows.filter(F.col("utc_micros").isNotNull())
    once = rows.filter(~F.col("__repeats")).select("field_name", "row_key", "utc_micros")
    again = rows.filter(F.col("__repeats")).groupBy("field_name", "row_key").agg(F.min("utc_micros").alias("utc_micros"))
    return once.unionByName(again)
