"""State of stream jobs: exact distinct counts and the sliding log, against batches and by hand."""

from collections import Counter

from pyspark.sql import functions as F

from thicket.streaming import published, state, views

EVENTS = "event_type string, package_id string, ecosystem string, published_at timestamp"


def test_exact_distinct_stream(spark, tmp_path):
    """Packages that come again in later batches, and in later runs, count once."""
    rows = [("new_version" if k % 7 else "metadata", f"p{k * k % 23}", "ab"[k % 2], f"2024-01-01 00:{k % 60:02}:00") for k in range(200)]
    frame = spark.createDataFrame(rows, "event_type string, package_id string, ecosystem string, t string").select("event_type", "package_id", "ecosystem", F.to_timestamp("t").alias("published_at"))
    store = published.Store(spark, f"file://{tmp_path}/store", state.TOTALS, 2)
    run = lambda: state.ecosystem_totals(views.file_source(spark, f"{tmp_path}/in/*", EVENTS, 1), store, f"{tmp_path}/ck").awaitTermination()
    first, second = frame.randomSplit([0.5, 0.5], 3)
    first.repartition(2).write.parquet(f"{tmp_path}/in/1")
    run()
    second.repartition(2).write.parquet(f"{tmp_path}/in/2")
    run()
    run()
    got = sorted(map(tuple, store.read("ecosystems").collect()))
    assert got == sorted(map(tuple, views.ecosystem_stats(frame).collect())) and len(store.batches()) == 4


def test_totals_of_a_batch_that_runs_again(spark, tmp_path):
    store = published.Store(spark, f"file://{tmp_path}/store", state.TOTALS, 2)
    deltas = spark.createDataFrame([("a", 1, 2, None), ("a", 1, 1, None)], "ecosystem string, packages long, versions long, last_published timestamp")
    for number in (0, 0, 1):
        store.commit(number, state.total_changes(deltas, store))
    assert [tuple(r) for r in store.read("ecosystems").collect()] == [("a", 4, 6, None)]


TIERS = {"free": (2, 1.0), "pro": (2, 1.5), "unlimited": None}
REQUESTS = [("x", 1, 0, "free"), ("x", 2, 10, "free"), ("x", 3, 20, "free"), ("x", 4, 59, "free"), ("x", 5, 60, "free"), ("x", 6, 61, "free"), ("x", 7, 70, "free"), ("y", 8, 0, "pro"), ("y", 9, 0, "pro"), ("y", 10, 0, "pro"), ("y", 11, 0, "pro"), (None, 12, 5, None), (None, 13, 5, "other"), (None, 14, 5, "free"), ("z", 15, 0, "unlimited"), ("z", 16, 0, "unlimited"), ("z", 17, 0, "unlimited"), ("x", 18, 500, "free")]
DENIED = {3: 40, 4: 1, 6: 9, 11: 60, 14: 60}


def requests(spark, rows=REQUESTS):
    return spark.createDataFrame(rows, "client string, id long, s long, tier string").withColumn("at", F.timestamp_seconds(F.col("s") + 1000)).drop("s")


def test_limiter_by_hand(spark):
    """Denied requests leave no trace in the log; bursts, unknown tiers, null keys."""
    got = {r["id"]: r for r in state.limited(requests(spark), "client", "at", "id", tiers=TIERS).collect()}
    assert {k: r["reset_after"] for k, r in got.items() if not r["allowed"]} == DENIED
    assert [got[k]["remaining"] for k in (1, 2, 8, 9, 10, 15, 18)] == [1, 0, 2, 1, 0, None, 1]
    assert state.limit_of("pro", state.TIERS) == 900 and state.limit_of("enterprise", state.TIERS) == 12_000


def test_limiter_stream_equals_batch(spark, tmp_path):
    """Batches cut the log of a key anywhere; it goes on where it was."""
    rows = requests(spark, [r for r in REQUESTS if r[0] is not None])
    for k, (low, high) in enumerate(((0, 15), (15, 60), (60, 1000))):
        rows.where((F.unix_timestamp("at") - 1000).between(low, high - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
        views.run_available(state.limited(stream, "client", "at", "id", tiers=TIERS, late="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    columns = ["client", "id", "allowed", "remaining", "reset_after"]
    want = state.limited(rows, "client", "at", "id", tiers=TIERS).select(columns)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_limiter_of_a_hot_key(spark):
    """Never more passes in a window than the limit, and no request is denied that had room."""
    rows = [("hot", k, k * 7 % 1000, "pro") for k in range(3000)]
    got = sorted(state.limited(requests(spark, rows).repartition(5), "client", "at", "id", tiers={"free": (1, 1.0), "pro": (20, 1.5)}).collect(), key=lambda r: (r["at"], r["id"]))
    passed = Counter()
    for r in got:
        s = int(r["at"].timestamp())
        room = sum(passed[x] for x in range(s - 59, s + 1)) < 30
        assert r["allowed"] == room
        passed[s] += r["allowed"]


def test_distinct_packages_need_no_python(spark, tmp_path):
    """Each package was a call of Python with a frame of its own."""
    spark.range(1).selectExpr("'new_version' AS event_type", "'p' AS package_id", "'e' AS ecosystem", "timestamp'2024-01-01' AS published_at").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_type string, package_id string, ecosystem string, published_at timestamp").parquet(f"{tmp_path}/in")
    plan = state.package_deltas(stream)._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Deduplicate" in plan
