"""Indexed nearest neighbours by cosine: cells of a coarse quantiser, eight-bit residuals, exact rescoring.

Building: centroids come from a bounded sample (TRAIN_ROWS rows of the least
hashes of their ids); then every row is assigned to its nearest centroid, and
what it differs by is kept in one signed byte a dimension, with the length of the
error that this makes. The table is sorted by cell, so a search of some cells
reads their row groups alone, and of those the codes, not the vectors.

How many cells a search probes is measured when the index is built: as many as
the sample's own rows need to find RECALL of their nearest neighbours in the sample.

Searching: queries come in blocks of about QUERY_BLOCK. A code gives an interval that
holds the exact score, so a task keeps all rows that can still be among the
best k of its own, and what the tasks kept is compared again, by Spark, before the
vectors of the few that are left are read and scored exactly. With ``exact``,
cells beyond the probed ones follow wherever a centroid's score and the cell's
radius leave room for a better row, so the answer is that of a full scan.

Defined cases: rows without a vector or of another length than most of the
sample's are not indexed; a vector of length zero has score 0; equal scores
(rounded to six digits) rank by id; a query never finds the row of its own id; an
empty table gives an empty result. Of rows that are equal a task keeps as many as
an answer can use, those of the least ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import stored

#: Rows that the centroids are fitted on, and cells, at most; rounds of fitting.
TRAIN_ROWS, MAX_CELLS, FIT_ROUNDS = 16_384, 4096, 8
QUERY_BLOCK = 4096
#: Scores that a task holds at once, so that large cells need no more memory than small ones.
PIECE = 1 << 20
#: What a search of some cells shall find of the nearest rows, and the rows of the sample that it is measured on.
RECALL, MEASURED, NEIGHBOURS = 0.95, 256, 10
#: What single precision may add to a score, and rounding to six digits.
SLACK = 2e-5


@dataclass
class Index:
    table: DataFrame
    centroids: np.ndarray
    #: Of each cell, how far its farthest row is from the centroid; below zero if it has none.
    radii: np.ndarray
    #: Cells that a search probes where it is not told how many.
    probes: int


def unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > V.TINY)


def centres(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Spherical k-means; a centroid that no row chooses keeps its place."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        moved = unit(sums)
        found = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, found)
    return found


def needed(sample: np.ndarray, found: np.ndarray, recall: float) -> int:
    """The least number of cells in which rows of the sample find that share of their nearest neighbours."""
    asked = sample[:MEASURED]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = np.argmax(sample @ found.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ found.T), axis=1), axis=1)  # where each cell stands in a row's order
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(column.flatten().cast(pa.float32())).reshape(-1, size)


def build(rows: DataFrame, id_col: str, vector_col: str, keep: tuple[str, ...] = (), cells: int | None = None, recall: float = RECALL, seed: int = 7) -> Index:
    """The index of all rows; columns of keep can filter a search."""
    vector = F.col(vector_col)
    known = rows.where(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) > 0))
    near = known.select(vector.alias("v"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(TRAIN_ROWS).select("v").toArrow().column(0).combine_chunks()
    sizes = Counter(pc.list_value_length(near).to_pylist())
    kind = dict(rows.dtypes)[id_col]
    size = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    sample = unit(matrix(near.filter(pc.equal(pc.list_value_length(near), size)), size)) if size else np.zeros((0, 0), np.float32)
    n = known.count() if cells is None else 0
    count = min(len(sample), MAX_CELLS, cells or max(1, round(n**0.5)))
    found = centres(sample, count, seed) if count else sample
    fields = rows.select(F.col(id_col).alias("id"), *keep, vector.alias("vector"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column("vector"), size))
            cell = np.argmax(x @ found.T, axis=1)
            rest = x - found[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(rest.astype(np.float64) - scale[:, None].astype(np.float64) * codes, axis=1)
            more = {"cell": pa.array(cell, pa.int32()), "scale": pa.array(scale, pa.float32()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error), "radius": pa.array(np.linalg.norm(rest, axis=1).astype(np.float64))}
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], names=[*b.schema.names, *more])

    schema = f"id {kind}, " + "".join(f"{c} {dict(rows.dtypes)[c]}, " for c in keep) + f"vector {dict(rows.dtypes)[vector_col]}, cell int, scale float, codes binary, error double, radius double"
    coded = fields.where(F.size("vector") == size).where(~F.exists("vector", lambda x: x.isNull())).mapInArrow(code, schema)
    table = stored(coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "vector-index")
    radii = np.full(count, -1.0)
    for cell, radius in table.groupBy("cell").agg(F.max("radius")).collect():  # a row a cell
        radii[cell] = radius
    return Index(table, found, radii, needed(sample, found, recall) if count else 1)


def pieces(rows_at: np.ndarray, queries: int) -> list[np.ndarray]:
    """Rows in parts whose scores against that many queries are at most PIECE (one row at least); none without queries."""
    step = max(1, PIECE // max(1, queries))
    return [rows_at[k : k + step] for k in range(0, len(rows_at), step)] if queries else []


def kept(rows: DataFrame, asked: np.ndarray, numbers: np.ndarray, centroids: np.ndarray, probed: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """What can be among the best k of each query (a row of asked) in its probed cells: q (its number), cell, id, low, high (bounds of the score)."""
    base = (asked @ centroids.T).astype(np.float32)
    cells = np.flatnonzero(probed.any(axis=0)).tolist()
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, waiting, size, types = floor.copy(), [], 0, None

        def prune() -> pa.Table:
            nonlocal size
            t = pa.concat_tables(waiting)
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("low", "descending"), ("high", "descending"), ("same", "ascending"), ("id", "ascending")]))
            q, low, high, same = (t.column(c).to_numpy() for c in ("q", "low", "high", "same"))
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            full = rank == k - 1
            least[q[full]] = np.maximum(least[q[full]], low[full])
            # Rows that are equal stand in a run, by id: those beyond the k-th are never needed.
            new = np.r_[True, (q[1:] != q[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (same[1:] != same[:-1])] if len(q) else np.zeros(0, bool)
            at = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            waiting[:] = [t.filter(pa.array((high >= least[q]) & (at < k)))]
            size = len(waiting[0])
            return waiting[0]

        limit = 1 << 18
        for b in batches:
            cell, scale, error = (np.asarray(b.column(c)) for c in ("cell", "scale", "error"))
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int8).reshape(len(b), -1)
            same = np.asarray(b.column("same"))
            pairs: list[tuple[int, np.ndarray, np.ndarray]] = []
            for c in np.unique(cell).tolist():
                qs = np.flatnonzero(probed[:, c])
                pairs.extend((c, qs, rows_at) for rows_at in pieces(np.flatnonzero(cell == c), len(qs)))
            for c, qs, rows_at in pairs:
                score = base[qs, c][:, None] + (asked[qs] @ codes[rows_at].T.astype(np.float32)) * scale[rows_at]
                high = score + (error[rows_at] + SLACK)
                x, y = np.nonzero(high >= least[qs][:, None])
                if len(x):
                    low = score[x, y] - (error[rows_at[y]] + SLACK)
                    waiting.append(pa.table({"q": qs[x], "cell": pa.array(cell[rows_at[y]], pa.int32()), "id": b.column("id").take(pa.array(rows_at[y])), "low": low.astype(np.float64), "high": high[x, y].astype(np.float64), "same": same[rows_at[y]]}))
                    size += len(x)
                    if size > limit:
                        prune()
                        limit = max(1 << 18, 2 * size)
        if waiting:
            left = prune()
            yield from left.set_column(0, "q", pa.array(numbers[left.column("q").to_numpy()])).select(["q", "cell", "id", "low", "high"]).to_batches()

    # Few cells go to the scan as a filter; of many, most rows are wanted anyway.
    some = rows.where(F.col("cell").isin(cells)) if len(cells) <= 1000 else rows
    return some.select("id", "cell", "scale", "error", "codes", F.xxhash64("codes", "scale").alias("same")).mapInArrow(run, f"q long, cell int, id {kind}, low double, high double")


def scored(index: Index, rows: DataFrame, block: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The exact scores of what the bounds leave of found: q, qid, id, score. block: q, qid, qvector."""
    found = stored(found, "vector-candidates")
    order = Window.partitionBy("q").orderBy(F.desc("low"))
    floors = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("q", F.col("low").alias("floor"))
    left = found.join(floors, "q", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("q", "cell", "id")
    exact = rows.select("cell", "id", "vector").join(left, ["cell", "id"]).join(block, "q")
    score = F.round(V.cosine(F.col("vector"), F.col("qvector")), 6)
    return exact.select("q", "qid", "id", score.alias("score")).where(~F.col("id").eqNullSafe(F.col("qid")))


def search(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
    """The k nearest rows of each query: qid, rank (from 1), id, score."""
    rows = index.table if where is None else index.table.where(where)
    size = index.centroids.shape[1] if len(index.centroids) else -1
    asked = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).alias("qvector")).where((F.size("qvector") == size) & ~F.exists("qvector", lambda x: x.isNull()))
    asked = stored(asked.withColumn("no", F.monotonically_increasing_id()), "vector-queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for number in range(blocks):
        part = one_block(index, rows, asked.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == number), k, probes or index.probes, exact)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind, own = dict(rows.dtypes)["id"], dict(asked.dtypes)["qid"]
        return queries.sparkSession.createDataFrame([], f"qid {own}, rank int, id {kind}, score double")
    return found


def one_block(index: Index, rows: DataFrame, block: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
    """The answers to one block of queries."""
    numbers = block.orderBy("no").select("no", "qvector").toArrow()
    vectors = unit(matrix(numbers.column("qvector").combine_chunks(), index.centroids.shape[1]))
    nos = numbers.column("no").to_numpy()
    block = block.withColumnRenamed("no", "q")
    base = vectors @ index.centroids.T
    base[:, index.radii < 0] = -np.inf
    probed = np.zeros(base.shape, bool)
    count = min(probes, base.shape[1])
    np.put_along_axis(probed, np.argpartition(-base, count - 1, axis=1)[:, :count], True, axis=1)
    floor = np.full(len(nos), -np.inf)
    best = scored(index, rows, block, kept(rows, vectors, nos, index.centroids, probed, floor, k + 1), k + 1)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = lambda frame: frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if exact:
        best = stored(ranked(best).drop("rank"), "vector-best")
        at = {no: n for n, no in enumerate(nos.tolist())}
        for q, n, score in best.groupBy("q").agg(F.count(F.lit(1)), F.min("score")).collect():  # a row a query of the block
            if n == k:
                floor[at[q]] = score - SLACK
        rest = (base + index.radii + SLACK >= floor[:, None]) & ~probed & (index.radii >= 0)
        if rest.any():
            best = best.unionByName(scored(index, rows, block, kept(rows, vectors, nos, index.centroids, rest, floor, k + 1), k + 1))
    return ranked(best).select("qid", "rank", "id", "score")


def recall(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """Per query: how many of its exact k nearest rows a search of some cells finds, against all rows: qid, wanted, found, recall."""
    want = search(index, queries, id_col, vector_col, k, probes, exact=True).select("qid", "id")
    got = search(index, queries, id_col, vector_col, k, probes).select("qid", "id", F.lit(1).alias("hit"))
    by = want.join(got, ["qid", "id"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return by.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
