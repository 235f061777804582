"""Protobuf records, the polling source, monthly partitions, range vectors and licence choices."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket.functions import licences
from thicket.operators import timeseries
from thicket.sources import keyset, protobuf
from thicket.streaming import partitions

VERSION = {
    "meta": {"event_id": "e1", "source": "x", "traceparent": "", "occurred_at": {"seconds": -5, "nanos": 999_999_999}, "schema_version": "1"},
    "ecosystem": "npm", "package_name": "päckage", "version": "1.0.0", "yanked": False, "tarball_url": "https://a.test/p.tgz", "integrity": "", "size_bytes": 1 << 40,
    "published_at": {"seconds": 1_700_000_000, "nanos": 123_456_789}, "dependencies": [{"name": "a", "version_range": "^1", "is_peer": True}, {"name": "b" * 300, "version_range": "", "is_peer": False}], "dev_dependencies": [], "optional_dependencies": [],
}


def test_protobuf_round_trip():
    data = protobuf.encode(VERSION, protobuf.VERSION_UPSERTED)
    assert protobuf.decode(data, protobuf.VERSION_UPSERTED) == VERSION
    for cut in range(len(data)):
        try:
            protobuf.decode(data[:cut], protobuf.VERSION_UPSERTED)
        except protobuf.Malformed:
            pass
    assert protobuf.decode(b"", protobuf.PACKAGE_DELETED)["reason"] == ""


def test_protobuf_wire_rules():
    """Unknown fields are skipped, the last value counts, nested messages merge, lists can be packed."""
    f = {1: ("n", "int32", False), 2: ("m", {1: ("a", "string", False), 2: ("b", "string", False)}, False), 3: ("list", "int64", True), 4: ("x", "double", False)}
    nested = lambda **m: protobuf.encode({"m": m}, {2: f[2]})
    unknown = b"\x48\x05" + b"\x51" + b"8bytes!!" + b"\x5d" + b"four" + b"\x62\x03abc"
    data = b"\x08\x01" + unknown + b"\x08\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01" + nested(a="1") + nested(b="2") + b"\x1a\x03\x01\xac\x02" + b"\x18\x07" + b"\x21" + b"\0\0\0\0\0\0\xf0\x3f"
    assert protobuf.decode(data, f) == {"n": -1, "m": {"a": "1", "b": "2"}, "list": [1, 300, 7], "x": 1.0}
    for bad in (b"\x08", b"\x00\x01", b"\x0a\x01a", b"\x12\x05ab", b"\x0b", b"\x12\x02\x0a\x01", b"\x08" + b"\xff" * 11, b"\x12\x03\x0a\x01\xff"):
        with pytest.raises(protobuf.Malformed):
            protobuf.decode(bad, f)


def test_protobuf_equals_the_library():
    """Records that the public library writes read the same, and the other way round."""
    pool_of = pytest.importorskip("google.protobuf.descriptor_pool")
    from google.protobuf import descriptor_pb2, json_format, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    kinds = {"string": 9, "bool": 8, "int64": 3, "int32": 5}

    def add(name, fields):
        m = file.message_type.add(name=name)
        for number, (field, kind, repeated) in fields.items():
            f = m.field.add(name=field, number=number, label=3 if repeated else 1, type=11 if isinstance(kind, dict) else kinds[kind])
            if isinstance(kind, dict):
                f.type_name = f".t.{name}{number}"
                add(f"{name}{number}", kind)

    add("V", protobuf.VERSION_UPSERTED)
    pool = pool_of.DescriptorPool()
    pool.Add(file)
    kind = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.V"))
    data = protobuf.encode(VERSION, protobuf.VERSION_UPSERTED)
    theirs = kind.FromString(data)
    assert protobuf.decode(theirs.SerializeToString(), protobuf.VERSION_UPSERTED) == VERSION
    assert json_format.MessageToDict(theirs, preserving_proto_field_name=True)["size_bytes"] == str(1 << 40)


def test_version_events(spark):
    wire = lambda **m: protobuf.encode(VERSION | m, protobuf.VERSION_UPSERTED)
    values = [wire(), wire(yanked=True), wire(tarball_url="  "), b"\xff\xff", b'{"package_id": "npm:a", "version": "1", "tarball_url": "u"}', b"{broken", None, b"", wire(size_bytes=0, published_at=None)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "error_id int, value binary")
    got = {r["error_id"]: r for r in protobuf.version_events(frame, "value").collect()}
    assert got[0]["package_id"] == "npm:päckage" and [d["name"] for d in got[0]["dependencies"]] == ["a", "b" * 300] and got[0]["size_bytes"] == 1 << 40
    assert got[0]["published_at"].replace(tzinfo=dt.UTC) == dt.datetime.fromtimestamp(1_700_000_000, dt.UTC).replace(microsecond=123_456)
    assert [got[k]["error"] for k in (1, 2, 7)] == ["yanked", "no archive", "no archive"] and got[3]["error"].startswith("malformed") and got[5]["error"].startswith("malformed")
    assert got[4]["package_id"] == "npm:a" and got[4]["error"] is None and got[6]["error"] == "empty"
    assert got[8]["size_bytes"] is None and got[8]["published_at"] is None and got[8]["error"] is None


def test_keyset_source(spark, tmp_path):
    """Ties go over pages, a stopped stream goes on, late rows behind the mark are not read, new ones are."""
    spark.dataSource.register(keyset.KeysetSource)
    rows = [(k, f"2024-01-01 0{k % 3}:00:00") for k in range(20)]
    frame = lambda x: spark.createDataFrame(x, "id long, t string").select("id", F.to_timestamp("t").alias("t"))
    pages = []

    def run():
        source = spark.readStream.format("keyset").schema("id long, t timestamp").options(path=f"{tmp_path}/in", time="t", id="id", page=6).load()
        q = source.writeStream.foreachBatch(lambda b, n: pages.append([(r["t"].hour, r["id"]) for r in b.collect()])).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        pages[:] = [p for p in pages if p]

    run()
    assert pages == []
    frame(rows).repartition(3).write.parquet(f"{tmp_path}/in")
    run()
    order = sorted((k % 3, k) for k, _ in rows)
    assert pages == [order[k : k + 6] for k in range(0, 20, 6)]
    frame([(100, "2024-01-01 00:00:00"), (101, "2024-01-01 02:00:00"), (102, "2024-01-01 05:00:00"), (103, None)]).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sum(pages, []) == [*order, (2, 101), (5, 102)]


def test_keyset_pages_run_again(tmp_path):
    """A page is what lies between its offsets, whatever came since."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    pq.write_table(pa.table({"id": [3, 1, 2, 5], "t": ["a", "a", "b", "b"]}), f"{tmp_path}/x.parquet")
    reader = keyset.KeysetReader({"path": str(tmp_path), "time": "t", "id": "id", "page": "3"}, StructType([StructField("id", LongType()), StructField("t", StringType())]))
    first, mark = reader.read(reader.initialOffset())
    assert list(first) == [(1, "a"), (3, "a"), (2, "b")] and mark == {"time": "b", "id": 2}
    pq.write_table(pa.table({"id": [9], "t": ["z"]}), f"{tmp_path}/y.parquet")
    assert list(reader.readBetweenOffsets(reader.initialOffset(), mark)) == [(1, "a"), (3, "a"), (2, "b")]
    assert list(reader.read(mark)[0]) == [(5, "b"), (9, "z")]


def test_monthly_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    rows = spark.createDataFrame([(k, f"2024-{1 + k % 4:02}-{1 + k % 28:02} 10:00:00") for k in range(100)] + [(100, None)], "id long, t string").select("id", F.to_timestamp("t").alias("at"))
    for batch in (0, 1, 1):
        partitions.write(rows.where(F.col("id") % 2 == batch), path, "at", batch)
    low, high = dt.datetime(2024, 2, 10), dt.datetime(2024, 3, 5)
    found = partitions.read(spark, path, "id long, at timestamp", "at", low, high)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.where((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high))).collect())
    assert partitions.read(spark, path, "id long, at timestamp", "at").count() == 101
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan
    today = dt.date(2024, 11, 20)
    assert partitions.create_ahead(spark, path, today) == ["2024-11", "2024-12", "2025-01", "2025-02"] and partitions.create_ahead(spark, path, today) == []
    assert partitions.drop_empty(spark, path, today) == []
    assert partitions.delete_before(spark, path, dt.date(2024, 3, 1)) == ["2024-01", "2024-02"]
    assert partitions.drop_empty(spark, path, today) == ["2024-01", "2024-02"]
    assert partitions.read(spark, path, "id long, at timestamp", "at").where("at < '2024-03-01'").count() == 0


def test_over_time_by_hand(spark):
    """Each evaluation sees (at - width, at], its own edge included and the other not."""
    rows = spark.createDataFrame([("a", s, v) for s, v in ((0, 1.0), (60, 0.0), (61, 1.0), (300, 0.0))], "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {int(r["at"].timestamp()): (round(r["average"], 6), r["n"]) for r in timeseries.avg_over_time(rows, ["k"], "t", F.col("v"), 60, 120).collect()}
    assert got == {0: (1.0, 1), 60: (0.5, 2), 120: (0.5, 2), 180: (1.0, 1), 300: (0.0, 1), 360: (0.0, 1)}
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(5000), float(rng.randrange(10))) for _ in range(400)]
    frame = spark.createDataFrame(points, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {(r["k"], int(r["at"].timestamp())): r["x"] for r in timeseries.over_time(frame, ["k"], "t", 50, 500, x=F.col("v")).collect()}
    want = {(k, at): [v for q, s, v in points if q == k and at - 500 < s <= at] for k in "ab" for at in range(0, 5600, 50)}
    assert got == {k: sum(v) for k, v in want.items() if v}


@pytest.mark.parametrize("line,allowed,want", [
    ("MIT OR Apache-2.0", {"MIT", "Apache-2.0"}, ["MIT"]), ("GPL-3.0-only OR Apache-2.0", {"Apache-2.0"}, ["Apache-2.0"]),
    ("(GPL-3.0-only OR MIT) AND (ISC OR BSD-3-Clause)", {"MIT", "BSD-3-Clause"}, ["MIT", "BSD-3-Clause"]), ("MIT AND GPL-3.0-only", {"MIT"}, None),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"GPL-2.0-only", "MIT"}, ["GPL-2.0-only WITH Classpath-exception-2.0"]), ("MIT AND MIT", {"MIT"}, ["MIT", "MIT"]),
    ("MIT AND", {"MIT"}, None), ("", {"MIT"}, None), (None, {"MIT"}, None),
])
def test_licence_choice(line, allowed, want):
    assert licences.choice(licences.postfix(line), frozenset(allowed)) == want


def test_keyset_batches_of_pages_read_no_rows_far_behind(spark, tmp_path):
    """A batch holds whole pages, is read by several tasks, and opens row groups up to its last row only."""
    spark.dataSource.register(keyset.KeysetSource)
    spark.range(100).selectExpr("id", "id div 3 AS t").repartitionByRange(5, "t", "id").sortWithinPartitions("t", "id").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    reader = keyset.KeysetReader({"path": f"{tmp_path}/in", "time": "t", "id": "id", "page": "4"}, schema)
    assert reader.marks(reader.initialOffset(), 3) == [{"time": k // 3, "id": k} for k in (3, 7, 11)]
    assert reader.marks({"time": 31, "id": 95}, 3) == [{"time": 33, "id": 99}] and reader.marks({"time": 33, "id": 99}, 3) == []
    assert len(reader.groups(reader.table(), {"time": 20, "id": 60})) < 5
    batches = {}

    def run():
        source = spark.readStream.format("keyset").schema("id long, t long").options(path=f"{tmp_path}/in", time="t", id="id", page=4, pages=3).load()
        q = source.writeStream.foreachBatch(lambda b, n: batches.update({n: ([r["id"] for r in b.collect()], b.rdd.getNumPartitions())})).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    run()
    kept = [ids for _, (ids, _) in sorted(batches.items()) if ids]
    assert [len(x) for x in kept] == [12] * 8 + [4] and sum(kept, []) == list(range(100))
    assert batches[0][1] == 3
    run()
    assert sorted(sum((ids for ids, _ in batches.values()), [])) == list(range(100))


def test_protobuf_tags_are_made_once_a_table(monkeypatch):
    """A writer knows the tags of its fields, so messages of short texts call for no number; long texts and large numbers do."""
    write = protobuf.writer(protobuf.VERSION_UPSERTED)
    small = {"meta": {"event_id": "1"}, "ecosystem": "npm", "dependencies": [{"name": "a", "version_range": "^1", "is_peer": False}, {"name": "", "is_peer": False}, None]}
    large = {"version": "x" * 300, "size_bytes": -1, "published_at": {"seconds": 1 << 40, "nanos": 0}}
    want = protobuf.encode(small, protobuf.VERSION_UPSERTED)
    with monkeypatch.context() as m:
        m.setattr(protobuf, "number_bytes", None)
        assert write(small) == want
    assert want == b"\x0a\x03\x0a\x01" + b"1" + b"\x12\x03npm" + b"\x52\x07\x0a\x01a\x12\x02^1" + b"\x52\x00"
    got = protobuf.decode(write(large), protobuf.VERSION_UPSERTED)
    assert (got["version"], got["size_bytes"], got["published_at"]) == (large["version"], -1, large["published_at"])


def test_protobuf_takes_arrays_apart_by_columns():
    rows = [None, {"a": [1, None], "b": None}, {"a": None, "b": {"c": "x"}}, {"a": [], "b": {"c": None}}]
    for array in (pa.array(rows), pa.array([rows, None, [], rows]), pa.array([b"ab", None])):
        for part in (array, array[1:], array[2:3], array[:0]):
            assert protobuf.values_of(part) == part.to_pylist()
