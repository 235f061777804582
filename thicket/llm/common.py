"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, stored  # noqa: F401  (the operators import them from here)

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, for Python functions over whole texts: from here on its session sends them at most ``rows`` rows in a batch, as the 10,000 that are usual can be gigabytes of text."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    return df


def set_aside(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but those of own under names that no operator uses, and what gives a result its names back."""
    names = [c if c in own else f"__aside_{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])


def fold_crc(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo folds (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def once(key: str, make: Callable[[], Any]) -> Any:
    """make()'s value, made once a process: tasks of a worker share a loaded vocabulary. Only the last key is kept."""
    kept = sys.modules.setdefault("_thicket_kept", types.ModuleType("_thicket_kept")).__dict__.setdefault("values", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to hold few Python objects at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
