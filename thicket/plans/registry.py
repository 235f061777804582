"""Queries register here with the SQL that they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and fixture views of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def with_tables(self, **frames: DataFrame) -> Tables:
        """These tables with some replaced, for views of a part of them."""
        other = Tables(self.spark, self.sf_dir)
        for name, frame in frames.items():
            setattr(other, name, frame)
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            frame = fixtures.view(self, name)
        else:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; fx_ views that sql names become its CTEs."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            ORACLES[name] = fixtures.with_views(sql)
        return build

    return add


def names_in(sql: str) -> list[str]:
    return re.findall(r"\bfx_\w+", sql)
