"""The release pipeline: stored snapshots, diffs against them, reruns."""

from pyspark.sql import functions as F

from thicket.streaming import analysis, published

OLD = "pub struct A;\nimpl A { pub fn f(&self, x: i32) -> u8 { 1 } pub fn gone(&self) {} fn hidden() {} pub fn shut() {} }\npub fn g() {}\n"
NEW = "pub struct A;\nimpl A { pub fn f(&self, x: i64) -> u8 { 1 } pub fn hidden() {} fn shut() {} }\npub const g: u8 = 1;\n"


def tables(spark, releases, files):
    r = spark.createDataFrame(releases, "package_id string, version string, previous_version string, size_bytes long, at string, event_id long").withColumn("at", F.to_timestamp("at"))
    return r, spark.createDataFrame(files, "package_id string, version string, path string, source string")


def events(store):
    return {(r["kind"], r["package_id"], r["version"]): r for r in store.read("events").collect()}


RELEASES = [("p", "1", None, None, "2024-01-01", 1), ("p", "2", "1", 10, "2024-01-02", 2), ("big", "1", None, 1 << 40, "2024-01-02", 3), ("none", "1", "0", None, "2024-01-02", 4)]
FILES = [("p", "1", "src/a.rs", OLD), ("p", "2", "src/a.rs", NEW), ("p", "2", "src/bad.rs", "fn b() {"), ("p", "2", "README.md", "pub fn no() {}"), ("big", "1", "a.rs", "pub fn x() {}")]
CHANGES = {("A::f", "signature_changed", "breaking"), ("A::gone", "removed", "breaking"), ("A::hidden", "added", "info"), ("A::shut", "visibility_reduced", "breaking"), ("g", "kind_changed", "breaking")}


def test_stream_with_stored_snapshots(spark, tmp_path):
    """The previous version was published by an earlier batch, even an earlier run of the stream."""
    releases, files = tables(spark, RELEASES, FILES)
    store = published.Store(spark, f"file://{tmp_path}/store", analysis.TABLES, 4)
    stream = lambda: spark.readStream.schema(releases.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    releases.where("event_id = 1").write.parquet(f"{tmp_path}/in/1")
    analysis.analyse(stream(), files, store, f"{tmp_path}/ck").awaitTermination()
    assert set(events(store)) == {("api_parsed", "p", "1"), ("embeddings_generated", "p", "1")}
    releases.where("event_id > 1").write.parquet(f"{tmp_path}/in/2")
    analysis.analyse(stream(), files, store, f"{tmp_path}/ck").awaitTermination()
    got = events(store)
    found = got["breaking_changes_detected", "p", "2"]
    assert {tuple(c) for c in found["changes"]} == CHANGES and found["breaking"] == 4 and found["previous_version"] == "1"
    assert not [k for k in got if k[1] == "big"] and [k[0] for k in got if k[1] == "none"] == ["api_parsed"]
    snapshot = store.read("snapshots").where("package_id = 'p' AND version = '2'").first()
    assert (snapshot["files"], snapshot["errors"], len(snapshot["symbols"])) == (2, 1, 6)
    vectors = store.read("vectors").where("package_id = 'p' AND version = '1'").collect()
    assert {v["path"] for v in vectors} == {"A", "A::f", "A::gone", "A::shut", "g"} and all(abs(sum(x * x for x in v["vector"]) - 1) < 1e-9 for v in vectors)


def test_one_batch_and_reruns(spark, tmp_path):
    """Both versions in one batch give the same; a batch that runs again changes nothing, ids of events stay."""
    releases, files = tables(spark, RELEASES, FILES)
    store = published.Store(spark, f"file://{tmp_path}/store", analysis.TABLES, 4)
    store.commit(0, analysis.analysed(releases, files, store))
    once = {k: r["id"] for k, r in events(store).items()}
    assert {tuple(c) for c in events(store)["breaking_changes_detected", "p", "2"]["changes"]} == CHANGES
    assert not store.commit(0, analysis.analysed(releases, files, store))
    store.commit(1, analysis.analysed(releases, files, store))
    assert {k: r["id"] for k, r in events(store).items()} == once


def test_sources_are_scanned_once(spark):
    """Broken files are counted with the symbols, not by a second pass of the scanner."""
    releases, files = tables(spark, RELEASES, FILES)
    got = analysis.snapshots(releases, files)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["package_id"], r["version"]): (r["files"], r["errors"]) for r in got.collect()}["p", "2"] == (2, 1)


def test_dear_rows_are_computed_once(spark, tmp_path):
    """Of a change with owners each row is computed one time a batch, in the first batch and in one that meets stored rows."""
    seen = spark.sparkContext.accumulator(0)
    store = published.Store(spark, f"file://{tmp_path}/store", {"t": published.Table("k long, v long", ("k",), ("k",))}, 4)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    for batch, (start, end) in enumerate(((0, 20), (10, 30))):
        rows = spark.range(start, end).select(F.col("id").alias("k"), F.lit(batch).cast("long").alias("v"))
        store.commit(batch, {"t": published.Change(rows.mapInPandas(counted, "k long, v long"), ("v",), owners=rows.select("k"), unique=True)})
    assert seen.value == 40
    assert sorted(map(tuple, store.read("t").collect())) == [(k, int(k >= 10)) for k in range(30)]


def test_equal_sources_are_one(spark):
    """A source that many releases hold is read once; files of a release are put together by path, and one file alone gives the same."""
    releases, files = tables(spark, [(p, "1", None, None, "2024-01-01", k) for k, p in enumerate("abcd")], [(p, "1", f"{p}.rs", OLD) for p in "abc"] + [("c", "1", "x.rs", "pub fn g(y: u8) {}\nfn own() {"), ("c", "1", "y.py", "")])
    read = analysis.sources(files)
    assert read.count() == 2
    held = analysis.held(releases.drop("size_bytes"), files)
    ones = held.where("package_id <> 'c'")
    got = {r["package_id"]: r for r in analysis.of_several(held, read).collect()}
    assert {r["package_id"]: r for r in analysis.of_one(ones, read).collect()} == {p: got[p] for p in "abd"}
    assert got["a"]["hash"] == got["b"]["hash"] != got["c"]["hash"] and not got["d"]["symbols"]
    assert (got["c"]["files"], got["c"]["errors"]) == (3, 1)
    assert {s["path"]: s["signature"] for s in got["c"]["symbols"] if s["path"] in ("g", "own")} == {"g": "g() | g(y : u8)", "own": "own()"}


def test_vectors_are_kept_by_slot(spark, tmp_path):
    """What is stored of a vector are its few slots, what is read is whole."""
    from thicket.functions import embedding

    releases, files = tables(spark, RELEASES, FILES)
    store = published.Store(spark, f"file://{tmp_path}/store", analysis.TABLES, 4)
    store.commit(0, analysis.analysed(releases, files, store))
    kept = store._files("vectors", sum(store.manifest()["vectors"].values(), []))
    assert "vector" not in kept.columns and kept.where("size(slots) > 60").count() == 0
    got = {r["path"]: r["vector"] for r in store.read("vectors").where("version = '1'").collect()}
    want = embedding.lexical_vectors(spark.createDataFrame([(p, p.replace("::", " ")) for p in got], "path string, t string"), "path", "t").collect()
    assert got == {r["path"]: r["vector"] for r in want}


def test_rows_that_stay_are_not_written_again(spark, tmp_path):
    """A batch of other keys leaves the stored folders as they are; one with a stored owner writes that bucket anew."""
    store = published.Store(spark, f"file://{tmp_path}/store", {"t": published.Table("k long, v long", ("k",), ("k",))}, 1)
    folders = []
    for batch, (start, end) in enumerate(((0, 5), (5, 9), (4, 6))):
        rows = spark.range(start, end).select(F.col("id").alias("k"), F.lit(batch).cast("long").alias("v"))
        store.commit(batch, {"t": published.Change(rows, ("v",), owners=rows.select("k"), unique=True)})
        folders.append(store.manifest()["t"]["0"])
    assert folders[1][:-1] == folders[0] and len(folders[2]) == 1 and folders[2][0] not in folders[1]
    assert sorted(map(tuple, store.read("t").collect())) == [(k, 2 if k in (4, 5) else int(k > 5)) for k in range(9)]
