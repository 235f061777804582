"""Tables that are published together: streams, failures, reruns."""

import pytest
from pyspark.sql import functions as F

from thicket.streaming import published


def event(kind, package, version, at, number, *dependencies):
    return (kind, package, "npm", package.upper(), version, [(d, ">=1") for d in dependencies], at, number)


def frame(spark, rows):
    text = "kind string, package_id string, ecosystem string, name string, version string, dependencies array<struct<dependency:string,requirement:string>>, at string, event_id long"
    return spark.createDataFrame(rows, text).withColumn("at", F.to_timestamp("at"))


def store_at(spark, path, buckets=4):
    return published.Store(spark, f"file://{path}/store", published.GRAPH, buckets)


def edges(store, manifest=None):
    return sorted((r["package_id"], r["version"], r["dependency"]) for r in published.edges(store.read("dependencies", manifest)).collect())


BATCHES = (
    [event("published", "a", "1", "2024-01-02", 1, "x", "y"), event("published", "b", "1", "2024-01-01", 2, "x")],
    [event("published", "a", "1", "2024-01-03", 3, "z"), event("yanked", "b", "1", "2024-01-02", 4), event("published", "c", "1", "2024-01-01", 5)],
    [event("published", "a", "1", "2024-01-01", 6, "old"), event("deleted", "c", None, "2024-01-04", 7), event("published", "b", "2", "2024-01-05", 8, "y", "y")],
)


def test_stream_of_events(spark, tmp_path):
    """Late events change nothing but first times; replaced lists go as a whole, empty ones too; a yank keeps its list."""
    store = store_at(spark, tmp_path)
    for k, rows in enumerate(BATCHES):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(published.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    published.graph_sink(stream, store, f"{tmp_path}/ck").awaitTermination()
    assert edges(store) == [("a", "1", "z"), ("b", "1", "x"), ("b", "2", "y"), ("b", "2", "y")]
    assert {(r["package_id"], r["version"]): (str(r["published_at"])[:10], r["yanked"]) for r in store.read("versions").collect()} == {("a", "1"): ("2024-01-01", False), ("b", "1"): ("2024-01-01", True), ("b", "2"): ("2024-01-05", False), ("c", "1"): ("2024-01-01", False)}
    assert {r["package_id"]: r["deleted"] for r in store.read("packages").collect()} == {"a": False, "b": False, "c": True}
    published.graph_sink(stream, store, f"{tmp_path}/ck").awaitTermination()
    assert len(store.batches()) == 3


def test_readers_never_see_half_a_batch(spark, tmp_path, monkeypatch):
    """A batch that fails between its tables shows nothing; run again it is there once."""
    store = store_at(spark, tmp_path)
    assert store.commit(0, published.graph_changes(frame(spark, BATCHES[0])))
    before = edges(store), sorted(map(tuple, store.read("packages").collect()))
    with monkeypatch.context() as m:
        m.setattr(published.Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(1, published.graph_changes(frame(spark, BATCHES[1])))
    assert (edges(store), sorted(map(tuple, store.read("packages").collect()))) == before
    assert store.commit(1, published.graph_changes(frame(spark, BATCHES[1])))
    assert not store.commit(1, published.graph_changes(frame(spark, BATCHES[2])))
    assert edges(store) == [("a", "1", "z"), ("b", "1", "x")]


def test_old_files_go_and_old_readers_stay(spark, tmp_path):
    store = store_at(spark, tmp_path, buckets=1)
    held = None
    for number, rows in enumerate(BATCHES):
        if number == 2:
            held = store.manifest()
        store.commit(number, published.graph_changes(frame(spark, rows)))
    assert edges(store, held) == [("a", "1", "z"), ("b", "1", "x")]
    folders = sorted(p.parent.name for p in (tmp_path / "store" / "dependencies").glob("*/bucket=0"))
    assert folders == ["batch-000000000001", "batch-000000000002"]


def test_empty_store(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.read("packages").count() == 0 and store.batches() == []
    store.commit(0, published.graph_changes(frame(spark, [])))
    assert store.read("packages").count() == 0 and store.batches() == [0]
