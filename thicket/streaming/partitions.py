"""A table in monthly partitions: written by month, created ahead, emptied months dropped, reads pruned to a range.

A month is a folder month=yyyy-MM. A batch writes its rows of a month as files
of its own under batch=N, so one that runs again writes the same files again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import _listed, remove

#: Months created ahead, and months after which an empty one is dropped.
AHEAD, KEPT = 3, 6


def shifted(month: dt.date, by: int) -> dt.date:
    n = month.year * 12 + month.month - 1 + by
    return dt.date(n // 12, n % 12 + 1, 1)


def write(rows: DataFrame, path: str, at: str, batch: int) -> None:
    """Adds a batch. Rows without a time go to the month of no name, null."""
    parts = rows.withColumns({"month": F.date_format(at, "yyyy-MM"), "batch": F.lit(batch)})
    # Spread by month and hash: a month with most of the rows is written by many tasks.
    parts.repartition("month", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy("month", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def months(spark: SparkSession, path: str) -> list[str]:
    return [x.rpartition("=")[2] for x in _listed(spark, path) if "/month=" in x]


def create_ahead(spark: SparkSession, path: str, today: dt.date, ahead: int = AHEAD) -> list[str]:
    """Folders of this month and those ahead; gives those that were not there."""
    known, made = set(months(spark, path)), []
    for k in range(ahead + 1):
        month = f"{shifted(today, k):%Y-%m}"
        if month not in known:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
            made.append(month)
    return made


def drop_empty(spark: SparkSession, path: str, today: dt.date, kept: int = KEPT) -> list[str]:
    """Removes months that are older than ``kept`` and have no rows; gives their names."""
    dropped = []
    for month in months(spark, path):
        try:
            old = dt.date.fromisoformat(f"{month}-01") < shifted(today, -kept)
        except ValueError:
            continue
        if old and not _listed(spark, f"{path}/month={month}"):
            remove(spark, f"{path}/month={month}")
            dropped.append(month)
    return dropped


def delete_before(spark: SparkSession, path: str, first: dt.date) -> list[str]:
    """Empties the months before the one of ``first``; the folders stay for drop_empty."""
    emptied = []
    for month in months(spark, path):
        if month[:4].isdigit() and month < f"{first:%Y-%m}":
            for part in _listed(spark, f"{path}/month={month}"):
                remove(spark, part)
            emptied.append(month)
    return emptied


def read(spark: SparkSession, path: str, schema: str, at: str, low: dt.datetime | None = None, high: dt.datetime | None = None) -> DataFrame:
    """The rows of [low, high), of whose months alone files are read."""
    rows = spark.read.schema(f"{schema}, month string, batch long").parquet(path)
    if low is not None:
        rows = rows.where((F.col("month") >= f"{low:%Y-%m}") & (F.col(at) >= F.lit(low)))
    if high is not None:
        rows = rows.where((F.col("month") <= f"{high:%Y-%m}") & (F.col(at) < F.lit(high)))
    return rows.drop("month", "batch")
