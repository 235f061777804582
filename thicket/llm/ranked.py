"""Ranked lexical search for many queries at once, by common subexpressions.

The score of a document is a sum over a query's terms, so queries that share
terms share parts of their sums. The queries come in blocks of a bounded size.
For each block:

1. mine: terms that the same queries hold become one set; then, with the sets of
   each query in order of how many queries hold them, the pairs of neighbours
   that most queries share become sets of their own, again and again. The result
   is a DAG: a node is a term or the sum of two nodes, a query a list of nodes.
2. index: every document is read once, and keeps its length and how often it
   holds each of the block's terms; stored.
3. evaluate: each task takes documents a few hundred at a time and works out
   every node once for all of them, in the order of the DAG: these are the partial
   accumulators. Queries add up their nodes, and a task keeps the best k of each.
4. Spark ranks what the tasks kept.

What is sent to tasks is one block: its terms, weights and DAG (BLOCK_BYTES of
query text, or one query if that alone is longer).

Defined cases: a null or empty text has no terms; such documents count nowhere
and are no results; such queries give no rows. Repeated documents are results
each; equal scores rank by id, nulls last; queries that share an id are ranked
each for themselves. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

#: Bytes of query text in a block, at the mean.
BLOCK_BYTES = 1 << 23
#: Bytes of a text that are cut into terms at once.
WINDOW = 1 << 22
#: Numbers in the accumulators of the documents that a task evaluates at once.
CELLS = 1 << 22
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: A-Z to a-z, and what parts terms to a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if TERM.match(bytes([b])) else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, window by window; a window ends between terms."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(FOLD).split()
        at = end


class Numbers(dict):
    """Terms numbered from 1; 0 for all others."""

    def __missing__(self, term: bytes) -> int:
        return 0


def mine(queries: list[list[int]]) -> tuple[list[int], list[tuple[int, int]], list[list[int]]]:
    """The DAG of a block of queries, each a list of terms with repeats.

    Gives the term of each leaf, the two nodes that each further node adds up
    (numbered on from the leaves), and the nodes of each query. The n-th
    repeat of a term in a query is a leaf of its own, so that a set
    holds no node twice.
    """
    leaf_of: dict[tuple[int, int], int] = {}
    held: list[list[int]] = []
    for line in queries:
        held.append([leaf_of.setdefault((t, k), len(leaf_of)) for t, n in sorted(Counter(line).items()) for k in range(n)])
    leaves = [t for t, _ in leaf_of]
    nodes: list[tuple[int, int]] = []

    def add(a: int, b: int) -> int:
        nodes.append((a, b))
        return len(leaves) + len(nodes) - 1

    owners: list[list[int]] = [[] for _ in leaves]
    for q, line in enumerate(held):
        for leaf in line:
            owners[leaf].append(q)
    together: dict[tuple[int, ...], list[int]] = {}
    for leaf, qs in enumerate(owners):
        together.setdefault(tuple(qs), []).append(leaf)
    lines: list[list[int]] = [[] for _ in queries]
    # Sets of most queries first, so that what many share stands side by side.
    for qs, line in sorted(together.items(), key=lambda x: (-len(x[0]), x[1])):
        if len(qs) > 1:
            while len(line) > 1:  # a balanced tree of sums
                line = [add(*line[k : k + 2]) if k + 1 < len(line) else line[k] for k in range(0, len(line), 2)]
        for q in qs:
            lines[q] += line
    while True:
        seen = Counter(pair for line in lines for pair in zip(line, line[1:], strict=False))
        best = {pair: n for pair, n in seen.items() if n > 1}
        if not best:
            return leaves, nodes, lines
        made: dict[tuple[int, int], int] = {}
        for q, line in enumerate(lines):
            out, k = [], 0
            while k < len(line):
                pair, after = tuple(line[k : k + 2]), tuple(line[k + 1 : k + 3])
                # A pair gives way to the next one if that is shared by more.
                if pair in best and best[pair] >= best.get(after, 0):
                    out.append(made[pair] if pair in made else made.setdefault(pair, add(*pair)))
                    k += 2
                else:
                    out.append(line[k])
                    k += 1
            lines[q] = out


def plans(queries: DataFrame, blocks: int) -> DataFrame:
    """One row a block: the terms, the DAG, and the numbers and nodes of its queries; stored. queries: _no, _query."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        lines, who = [], []
        for no, text in sorted(zip(group["_no"], group["_query"], strict=True)):
            line = [numbers.setdefault(t, len(numbers)) for part in terms_of(text) for t in part]
            if line:
                lines.append(line)
                who.append(no)
        leaves, nodes, sums = mine(lines)
        return pd.DataFrame([{"block": key[0], "terms": list(numbers), "leaves": leaves, "a": [x for x, _ in nodes], "b": [x for _, x in nodes], "nodes": [n for s in sums for n in s], "counts": [len(s) for s in sums], "queries": who}])

    schema = "block long, terms array<binary>, leaves array<int>, a array<int>, b array<int>, nodes array<int>, counts array<int>, queries array<long>"
    by = queries.withColumn("_block", F.pmod(F.xxhash64("_no"), F.lit(blocks)))
    return stored(by.groupBy("_block").applyInPandas(run, schema), "ranked-plans")


class Dag:
    """A block's DAG, ready to be evaluated."""

    def __init__(self, plan: dict):
        self.leaves = np.array(plan["leaves"], np.int64)
        a, b = np.array(plan["a"], np.int64), np.array(plan["b"], np.int64)
        first, depth = len(self.leaves), np.zeros(len(self.leaves) + len(a), np.int64)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            depth[first + k] = max(depth[x], depth[y]) + 1
        # Nodes of one depth are added up together.
        self.rounds = [(first + at, a[at], b[at]) for d in range(1, depth.max(initial=0) + 1) for at in [np.flatnonzero(depth[first:] == d)]]
        self.size = len(depth)
        self.nodes, counts = np.array(plan["nodes"], np.int64), np.array(plan["counts"], np.int64)
        self.starts = np.cumsum(counts) - counts
        self.queries = np.array(plan["queries"], np.int64)

    def evaluate(self, of_terms: np.ndarray) -> np.ndarray:
        """of_terms: a row a term, a column a document. Gives a row a query: its sums."""
        acc = np.empty((self.size, of_terms.shape[1]), np.int64)
        acc[: len(self.leaves)] = of_terms[self.leaves]
        for at, a, b in self.rounds:
            acc[at] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.nodes], self.starts, axis=0)


def indexed(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """id, n (terms of the text), and the numbers and counts of the block's terms in it; rows without terms go. Stored."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers((t, k + 1) for k, t in enumerate(terms))
        for b in batches:
            keep, lengths, sizes, found, counts = [], [], [0], [], []
            for k, text in enumerate(b.column("t")):
                n, here = 0, Counter()
                for part in terms_of(text.as_py()):
                    n += len(part)
                    at, times = np.unique(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)), return_counts=True)
                    here.update(dict(zip(at.tolist(), times.tolist(), strict=True)))
                if n:
                    here.pop(0, None)
                    keep.append(k)
                    lengths.append(n)
                    sizes.append(sizes[-1] + len(here))
                    found.extend(here)
                    counts.extend(here.values())
            as_list = lambda x, t: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int64()), as_list(np.array(found, np.int32) - 1, pa.int32()), as_list(counts, pa.int64())], names=["id", "n", "terms", "counts"])

    return stored(rows.mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<long>"), "ranked-index")


def best(index: DataFrame, plan: dict, weights: list[int], documents: int, total: int, k: int) -> DataFrame:
    """What each task keeps of its documents: _no, score, id; the best k of each query."""
    kind = dict(index.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, w = Dag(plan), np.array(weights, np.int64)
        step = max(16, min(1024, CELLS // (len(w) + dag.size + len(dag.nodes))))
        floor = np.ones(len(dag.queries), np.int64)  # scores below it are no results
        kept: pa.Table | None = None
        waiting: list[pa.Table] = []

        def prune() -> pa.Table:
            rows = pa.concat_tables(waiting)
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
            q = rows.column("q").to_numpy()
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            full = rank == k - 1
            floor[q[full]] = rows.column("score").to_numpy()[full]
            waiting[:] = [rows.filter(pa.array(rank < k))]
            return waiting[0]

        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                n = np.asarray(b.column("n"))
                m = np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
                doc = np.repeat(np.arange(len(b)), np.asarray(b.column("terms").value_lengths()))
                term, tf = np.asarray(b.column("terms").flatten()), np.asarray(b.column("counts").flatten())
                of_terms = np.zeros((len(w), len(b)), np.int64)
                of_terms[term, doc] = w[term] * (10**9 * tf // (1000 * tf + 8 * m[doc]))
                scores = dag.evaluate(of_terms)
                q, d = np.nonzero(scores >= floor[:, None])
                waiting.append(pa.table({"q": q, "score": scores[q, d], "id": b.column("id").take(pa.array(d))}))
                if sum(map(len, waiting)) > 1 << 16 or kept is None:
                    kept = prune()
        if waiting:
            rows = prune()
            for b in pa.table({"_no": dag.queries[rows.column("q").to_numpy()], "score": rows.column("score"), "id": rows.column("id")}).to_batches():
                yield b

    return stored(index.mapInArrow(run, f"_no long, score long, id {kind}"), "ranked-best")


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"_no long, score long, id {kind}")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each query: query id, rank (from 1), document id, score."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("_qid"), F.col(query_text).cast("string").cast("binary").alias("_query"))
    asked = stored(asked.withColumn("_no", F.monotonically_increasing_id()), "ranked-queries")
    size = asked.agg(F.sum(F.octet_length("_query")).alias("n")).first()["n"] or 0
    found = None
    blocks = plans(asked.select("_no", "_query"), max(1, -(-size // block_bytes)))
    for (block,) in blocks.select("block").orderBy("block").toLocalIterator():
        plan = blocks.where(F.col("block") == block).first().asDict()
        if not plan["queries"]:
            continue
        terms = [bytes(t) for t in plan.pop("terms")]
        index = indexed(docs, id_col, text_col, terms)
        whole = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
        if not whole["documents"]:
            break
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log((2.0 * whole["documents"] + 2) / (2 * F.col("df") + 1)))
        weights = [0] * len(terms)
        for term, w in held.select("term", weight.cast("long")).toLocalIterator():
            weights[term] = w
        part = best(index, plan, weights, whole["documents"], whole["total"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = empty(spark, dict(docs.select(id_col).dtypes)[id_col])
    order = Window.partitionBy("_no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("_no", "_qid"), "_no").select(F.col("_qid").alias(query_id), "rank", F.col("id").alias(id_col), "score")
