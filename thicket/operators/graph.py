"""Traversals of an edge table (src, dst) by frontier joins.

Each level is a join of the frontier with the edges, less what is known, and is
written to the shared folder, so the plan of a level holds no other level's and
a lost executor loses nothing. Only ids and depths travel. Depth is clamped to 1..10, as an unbounded walk of a dense
graph is its whole transitive closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, stored_counted

MAX_DEPTH = 10


def clamp(n: int, low: int = 1, high: int = MAX_DEPTH) -> int:
    return max(low, min(high, n))


def bfs(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = False) -> DataFrame:
    """origin, id, depth: what each origin reaches, at its least depth; roots has (origin, id), ids of the edges' type.

    Backward by default: the dependents of a package stand at the src of its
    incoming edges. An origin itself is not in the result. A level joins the last
    one, whose stored size lets Catalyst broadcast it while it is small, so the
    edges are read but not shuffled; repeated edges do no harm.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(here).alias("id"), F.col(there).alias("_next"))
    seen = roots.select("origin", "id", F.lit(0).alias("depth"))
    frontier = seen.select("origin", "id")
    found = []
    for k in range(1, clamp(depth) + 1):
        new = steps.join(frontier, "id").select("origin", F.col("_next").alias("id")).distinct()
        level, rows = stored_counted(new.join(seen, ["origin", "id"], "left_anti").withColumn("depth", F.lit(k)), "level")
        found.append(level)
        if k == clamp(depth) or not rows:
            break
        seen = seen.unionByName(level)
        frontier = level.select("origin", "id")
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def reach(edges: DataFrame, root: str | int, depth: int, forward: bool = False) -> DataFrame:
    """id, depth of what root reaches."""
    roots = edges.sparkSession.range(1).select(F.lit(root).alias("origin"), F.lit(root).alias("id"))
    return bfs(edges, roots.select(*[F.col(c).cast(edges.schema["src"].dataType) for c in ("origin", "id")]), depth, forward).select("id", "depth")


def typed_reach(types: dict[tuple[str, str], DataFrame], kind: str, root: int, depth: int, forward: bool = False) -> DataFrame:
    """id, depth of what root, a node of that kind, reaches over edges that lie apart by the kinds of their ends.

    A level reads those edges alone whose near end is of a kind that the last
    level found; ids of different kinds differ, so what is known is kept by kind.
    """
    near, far = (0, 1) if forward else (1, 0)
    here, there = ("src", "dst") if forward else ("dst", "src")
    spark = next(iter(types.values())).sparkSession
    start = spark.range(1).select(F.lit(root).cast("long").alias("id"))
    seen: dict[str, DataFrame] = {kind: start}
    frontier, found = {kind: start}, []
    for k in range(1, clamp(depth) + 1):
        reached: dict[str, DataFrame] = {}
        for kinds, edges in types.items():
            if kinds[near] in frontier:
                new = edges.select(F.col(here).alias("id"), F.col(there).cast("long").alias("_next")).join(frontier[kinds[near]], "id").select(F.col("_next").alias("id"))
                reached[kinds[far]] = reached[kinds[far]].unionByName(new) if kinds[far] in reached else new
        frontier = {}
        for own, new in reached.items():
            new = new.distinct()
            level, rows = stored_counted(new.join(seen[own], "id", "left_anti") if own in seen else new, "level")
            if rows:
                frontier[own] = level
                seen[own] = seen[own].unionByName(level) if own in seen else level
                found.append(level.withColumn("depth", F.lit(k)))
        if not frontier:
            break
    if not found:
        return start.where("false").withColumn("depth", F.lit(0))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def core(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge in, or without one out, are peeled off until none is: all cycles are in there."""
    now, left = stored_counted(edges.where("src <> dst").distinct(), "edges")
    while left:
        ends = now.select(F.col("dst").alias("src")).distinct()
        starts = now.select(F.col("src").alias("dst")).distinct()
        after, n = stored_counted(now.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"), "core")
        if n == left:
            return after
        now, left = after, n
    return now


def shortest_path(edges: DataFrame, start: str, end: str, hops: int) -> DataFrame:
    """One row (path, hops) of the shortest path, ties by the least path text; no row if there is none.

    One path a node and level is enough: of two to the same node at the same
    depth the lesser stays the lesser whatever follows.
    """
    spark = edges.sparkSession
    edges = stored(edges, "edges")
    frontier = spark.range(1).select(F.lit(start).alias("id"), F.lit(start).alias("path"))
    seen = frontier.select("id")
    for k in range(1, clamp(hops) + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id"), F.concat_ws(">", "path", "dst").alias("path"))
        level = stored(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "level")
        hit = level.where(F.col("id") == end)
        if not hit.isEmpty():
            return hit.select("path", F.lit(k).alias("hops"))
        if level.isEmpty():
            break
        seen, frontier = seen.unionByName(level.select("id")), level
    return spark.createDataFrame([], "path string, hops int")


def trails(edges: DataFrame, start: str, end: str, hops: int, limit: int) -> DataFrame:
    """Paths of at most ``hops`` edges, no edge twice, shortest first; the walk back from end bounds what is enumerated."""
    spark = edges.sparkSession
    edges = stored(edges, "edges")
    near = reach(edges, end, hops)
    useful = stored(edges.join(near.select(F.col("id").alias("src")).unionByName(spark.range(1).select(F.lit(end).alias("src"))), "src", "left_semi").join(near.select(F.col("id").alias("dst")).unionByName(spark.range(1).select(F.lit(end).alias("dst"))), "dst", "left_semi").select("src", "dst"), "useful")
    walk = spark.range(1).select(F.lit(start).alias("id"), F.lit(start).alias("path"), F.array().cast("array<string>").alias("used"))
    out = None
    for k in range(1, clamp(hops) + 1):
        edge = F.concat_ws(">", "src", "dst")
        walk = walk.join(useful, walk["id"] == useful["src"]).where(~F.array_contains("used", edge)).select(F.col("dst").alias("id"), F.concat_ws(">", "path", "dst").alias("path"), F.concat("used", F.array(edge)).alias("used"))
        walk = stored(walk, "trails")
        hit = walk.where(F.col("id") == end).select("path", F.lit(k).alias("hops"))
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("hops", "path").limit(limit)
