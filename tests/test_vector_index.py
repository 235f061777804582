"""Indexed vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import vector_index as vi

SF = "/root/testdata/sf0.1"


def nearest(ids, rows, k, own):
    """By hand: cosine to six digits, ties by id."""
    x = np.array(rows, float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 1e-9)
    out = {}
    for q in own:
        s = np.round(u @ u[ids.index(q)], 6)
        out[q] = [i for _, i in sorted((-s[j], i) for j, i in enumerate(ids) if i != q)[:k]]
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, a third of all rows equal, a zero vector."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    rows = [(middle[k % 12] + 0.4 * rng.normal(size=16)).tolist() for k in range(600)] + [middle[0].tolist()] * 300 + [[0.0] * 16]
    frame = spark.createDataFrame([(k, r, "ab"[k % 2]) for k, r in enumerate(rows)], "i long, v array<double>, kind string")
    odd = spark.createDataFrame([(-1, None, "a"), (-2, [1.0, 2.0], "a"), (-3, [1.0] * 15 + [None], "a"), (-4, [], "a")], frame.schema)
    return rows, frame.unionByName(odd).repartition(6)


def answers(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("cells,probes,block", [(None, 2, 4096), (5, 1, 4), (1, 9, 4096)])
def test_exact_search_equals_brute_force(clustered, monkeypatch, cells, probes, block):
    monkeypatch.setattr(vi, "QUERY_BLOCK", block)
    rows, frame = clustered
    index = vi.build(frame, "i", "v", keep=("kind",), cells=cells)
    asked = frame.where("i % 50 = 0 OR i < 0")
    got = answers(vi.search(index, asked, "i", "v", k=7, probes=probes, exact=True))
    # Scores near a rounding edge may differ in the last digit, so they are compared, not the ids of such ties.
    want = nearest(list(range(len(rows))), rows, 7, [q for q in range(len(rows)) if q % 50 == 0])
    assert {q: [i for _, i, _ in x] for q, x in got.items()} == want
    some = answers(vi.search(index, asked, "i", "v", k=3, probes=probes, exact=True, where=F.col("kind") == "b"))
    assert all(i % 2 for x in some.values() for _, i, _ in x) and all(len(x) == 3 for x in some.values())


def test_recall_of_few_cells(spark):
    """The cells that the sample called for find nine tenths of the exact answers, measured against all rows; of vectors in clusters, few cells do."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vi.build(rows, "vec_id", "embedding")
    found = [r["recall"] for r in vi.recall(index, rows.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()]
    assert len(index.radii) > 40 and index.probes < len(index.radii) and len(found) == 40 and sum(found) / len(found) >= 0.9
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 24))
    close = spark.createDataFrame([(k, (middle[k % 20] + 0.3 * rng.normal(size=24)).tolist()) for k in range(2000)], "i long, v array<double>")
    index = vi.build(close, "i", "v")
    found = [r["recall"] for r in vi.recall(index, close.where("i % 50 = 0"), "i", "v").collect()]
    assert index.probes <= 10 and sum(found) / len(found) >= 0.9


def test_codes_bound_the_scores(clustered):
    rows, frame = clustered
    index = vi.build(frame, "i", "v")
    for r in index.table.collect():
        x = vi.unit(np.array([r["vector"]]))[0]
        approx = index.centroids[r["cell"]] + np.float32(r["scale"]) * np.frombuffer(r["codes"], np.int8)
        assert np.linalg.norm(x - approx) <= r["error"] + vi.SLACK and r["radius"] <= index.radii[r["cell"]]


def test_empty(spark):
    none = spark.createDataFrame([], "i long, v array<float>")
    index = vi.build(none, "i", "v")
    assert vi.search(index, none, "i", "v").count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    assert vi.search(index, one, "i", "v").count() == 0
    assert vi.search(vi.build(one, "i", "v"), one, "i", "v", exact=True).count() == 0


def test_search_reads_few_columns_of_few_cells(clustered):
    _, frame = clustered
    index = vi.build(frame, "i", "v", keep=("kind",))
    probed = np.zeros((1, len(index.radii)), bool)
    probed[0, :2] = True
    plan = vi.kept(index.table, index.centroids[:1], np.array([0]), index.centroids, probed, np.array([-np.inf]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "In(cell, [0,1])" in plan and "vector" not in plan.partition("ReadSchema")[2].partition("\n")[0]


def test_scores_come_in_pieces():
    """However many rows of a cell come together, a task holds a fixed number of scores, and passes over none."""
    for n, queries in ((10_000, 4096), (3, 1 << 21), (10_000, 1), (0, 5)):
        found = vi.pieces(np.arange(n), queries)
        assert all(len(p) * queries <= max(vi.PIECE, queries) for p in found)
        assert [x for p in found for x in p.tolist()] == list(range(n))
    assert vi.pieces(np.arange(3), 0) == []
