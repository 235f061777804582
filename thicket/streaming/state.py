"""Stream jobs with state of a key: exact distinct counts, and a sliding-log rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .published import Change, Store, Table, sink

# Exact distinct counts in two levels: a key of state tells whether a package is new to its ecosystem, and what that adds meets the totals of a store.

TOTALS = {"ecosystems": Table("ecosystem string, packages long, versions long, last_published timestamp", ("ecosystem",), ("ecosystem",))}


def package_deltas(events: DataFrame) -> DataFrame:
    """What each micro-batch adds, by rows: ecosystem, packages (1 where one is new), versions, last_published. State is one key a package.

    Spark itself tells which packages are new; a version is a row as it comes.
    """
    new = events.where("event_type = 'new_version'").select("ecosystem", "package_id", "published_at")
    first = new.dropDuplicates(["ecosystem", "package_id"]).select("ecosystem", F.lit(1).cast("long").alias("packages"), F.lit(0).cast("long").alias("versions"), F.lit(None).cast("timestamp").alias("last_published"))
    return first.unionByName(new.select("ecosystem", F.lit(0).cast("long").alias("packages"), F.lit(1).cast("long").alias("versions"), F.col("published_at").alias("last_published")))


def total_changes(deltas: DataFrame, store: Store) -> dict[str, Change]:
    add = deltas.groupBy("ecosystem").agg(F.sum("packages").alias("packages"), F.sum("versions").alias("versions"), F.max("last_published").alias("last_published"))
    old = store.read("ecosystems").join(add.select("ecosystem"), "ecosystem", "left_semi")
    both = old.unionByName(add).groupBy("ecosystem").agg(F.sum("packages").alias("packages"), F.sum("versions").alias("versions"), F.max("last_published").alias("last_published"))
    return {"ecosystems": Change(both, ("versions",))}


def ecosystem_totals(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Keeps packages (distinct, exactly), versions and the last publication of each ecosystem in a store; a batch that runs again adds nothing twice."""
    return sink(package_deltas(events), store, lambda batch: total_changes(batch, store), checkpoint)


# The limiter: a request passes while fewer than the limit have passed in the window before it; those that do not pass are not counted.

WINDOW_SECONDS = 60
#: Requests a minute and burst factor of each tier; unlimited ones keep no log.
TIERS: dict[str, tuple[int, float] | None] = {"free": (300, 1.0), "pro": (600, 1.5), "enterprise": (6000, 2.0), "unlimited": None}
DECISION = "allowed boolean, remaining long, reset_after long"


class Log:
    """The times, in seconds, at which a key's last requests passed."""

    def __init__(self, limit: int | None, window: int, times: Any = ()):
        self.limit, self.window, self.times = limit, window, deque(times)

    def decide(self, now: int) -> tuple[bool, int | None, int]:
        """Whether a request passes, how many could follow, and seconds until one more can. One that comes after later ones counts as at their time."""
        if self.limit is None:
            return True, None, 0
        times = self.times
        if times:
            now = max(now, times[-1])
        while times and times[0] <= now - self.window:
            times.popleft()
        if len(times) < self.limit:
            times.append(now)
            return True, self.limit - len(times), 0
        return False, 0, (max(0, times[0] + self.window - now) if times else self.window)


def limit_of(tier: str | None, tiers: dict[str, tuple[int, float] | None]) -> int | None:
    """A tier's limit with its burst; unknown tiers are free."""
    found = tiers.get(tier, tiers["free"]) if tier is not None else tiers["free"]
    return None if found is None else int(found[0] * found[1])


def limited(requests: DataFrame, key: str, at: str, order: str, tier: str = "tier", tiers: dict[str, tuple[int, float] | None] = TIERS, window: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """requests (key, order, at, tier) with allowed, remaining and reset_after; a key's tier is that of each request.

    A stream keeps the log of a key until the watermark is a window past it, and
    gives no answer to requests that come behind the watermark. A
    batch sorts by key and time and walks through, with one log in memory.
    """
    kinds = dict(requests.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, order, at, tier)) + ", " + DECISION
    rows = requests.select(key, order, at, tier, F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000).cast("long").alias("_s"))

    def decided(frame: pd.DataFrame, log: Log) -> pd.DataFrame:
        found = []
        for name, second in zip(frame[tier], frame["_s"], strict=True):
            log.limit = limit_of(name, tiers)
            found.append(log.decide(int(second)))
        out = frame.drop(columns="_s")
        return out.assign(allowed=[x for x, _, _ in found], remaining=pd.array([x for _, x, _ in found], "Int64"), reset_after=[x for _, _, x in found])

    if requests.isStreaming:

        def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            frame = pd.concat(list(frames)).sort_values(["_s", order])
            log = Log(None, window, state.get[0] if state.exists else ())
            yield decided(frame, log)
            if log.times:
                state.update((list(log.times),))
                state.setTimeoutTimestamp(max((log.times[-1] + window) * 1000, state.getCurrentWatermarkMs() + 1))

        return rows.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = object(), Log(None, window)
        for frame in frames:
            for name, part in frame.groupby(key, sort=False, dropna=False):
                if name != last and not (pd.isna(name) and last is None):
                    log = Log(None, window)
                last = None if pd.isna(name) else name
                yield decided(part, log)

    return rows.repartition(key).sortWithinPartitions(key, "_s", order).mapInPandas(walk, schema)


def denied_by(decisions: DataFrame, *keys: str | Column) -> DataFrame:
    """Requests, those denied, and the longest wait, by keys."""
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("denied"), F.max("reset_after").alias("longest_wait"))
