"""Change data: snapshot diffs, deterministic ids, last-wins dedupe and the event fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two snapshots: keys, columns o (old row or null) and n (new row or null)."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    return o.join(n, keys, "full_outer")


def event_id(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar: the same change always has the same id."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def state_hash(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """sha256 over the sorted parts of each key, so row order plays no role."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ",").cast("binary"), 256).alias("state_hash"))
