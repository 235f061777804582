"""Counter rates, quantiles of buckets, sustained alerts and rate-limit audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increase(series: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Adds _inc: the growth of a counter since its last sample; a drop is a reset, and counts from zero."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    return series.withColumn("_inc", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def over_time(rows: DataFrame, keys: list[str], ts: str, step: int, width: int, **sums: Column) -> DataFrame:
    """Range vectors at evaluation steps: keys, at, and the sums over the rows of (at - width, at], for each multiple ``at`` of step seconds that has any.

    Two levels: rows are added up by step first, and each step's sum goes to the
    width / step evaluations that see it; so nothing is sorted, and a series with
    most of the rows is small before it is shuffled.
    """
    if width % step:
        raise ValueError("the width must be a multiple of the step")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    end = -F.floor(-micros / (step * 1_000_000))  # the step whose end is at or behind the row
    by_step = rows.groupBy(*keys, end.cast("long").alias("_step")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    seen = by_step.withColumn("_at", F.explode(F.sequence(F.col("_step"), F.col("_step") + (width // step - 1))))
    return seen.groupBy(*keys, F.timestamp_seconds(F.col("_at") * step).alias("at")).agg(*[F.sum(name).alias(name) for name in sums])


def avg_over_time(rows: DataFrame, keys: list[str], ts: str, value: Column, step: int, width: int) -> DataFrame:
    """keys, at, average, n: the mean of the samples in each range."""
    found = over_time(rows, keys, ts, step, width, _s=value.cast("double"), n=F.when(value.isNotNull(), 1).otherwise(0))
    return found.select(*keys, "at", F.try_divide("_s", "n").alias("average"), "n")


def rate_ratio(series: DataFrame, keys: list[str], ts: str, order: str, value: str, part: Column, step: int, width: int) -> DataFrame:
    """at, ratio: the rate of the series of ``part`` by that of all, where there is any. Counters grow by increase(), in the order of ``order``."""
    grown = increase(series, keys, order, value)
    seconds = F.lit(float(width))
    found = over_time(grown, [], ts, step, width, part=F.when(part, F.col("_inc")).otherwise(0.0) / seconds, whole=F.col("_inc") / seconds)
    return found.where("whole > 0").select("at", (F.col("part") / F.col("whole")).alias("ratio"))


def sustained(rows: DataFrame, keys: list[str], at: str, fires: Column) -> DataFrame:
    """Islands of successive rows that fire: keys, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    island = F.sum(F.when(fires, 0).otherwise(1)).over(w)
    return rows.withColumn("_island", island).where(fires).groupBy(*keys, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def histogram_quantile(rates: Column, bounds: tuple[float, ...], q: float) -> Column:
    """The q-quantile from cumulative rates of buckets (one for each bound, then all): linear inside the first bucket that reaches the rank.

    The first bucket starts at zero; a rank beyond the last bound gives that bound.
    """
    rank = F.lit(q) * rates[len(bounds)]
    out = F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        low, under = (float(bounds[k - 1]), rates[k - 1]) if k else (0.0, F.lit(0.0))
        out = F.when(rates[k] >= rank, low + (bounds[k] - low) * (rank - under) / (rates[k] - under)).otherwise(out)
    return F.when(rates[len(bounds)] > 0, out)
