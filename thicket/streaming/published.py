"""Several tables that change together: each batch's changes are published by one manifest.

A store is a folder with a folder of files for each table and a list of
manifests, one a batch. A batch writes the buckets that it touches as new files,
of all tables, and then one manifest, which names the folders of every
bucket; only that makes them visible, so a reader sees all tables before a
batch or all after it. A bucket whose stored rows a batch cannot replace is not
written again, but gets one more folder. A batch that runs again after its manifest was written
changes nothing; one that failed before it starts anew.

Files that neither the newest manifest nor the one before names are removed, so
a reader that has just begun keeps what it reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .views import remove

MANIFESTS = "_manifests"
#: Tasks that a bucket's rows are dealt to at most.
PARTS = 32
#: Folders of a bucket at most; then its rows are written together.
FOLDERS = 8


@dataclass(frozen=True)
class Table:
    """schema in DDL; rows are told apart by keys and lie in buckets by owner, columns of every key.

    A reader sees the columns of schema, or the expressions in shown over them.
    """

    schema: str
    keys: tuple[str, ...]
    owner: tuple[str, ...]
    shown: tuple[str, ...] = ()


@dataclass
class Change:
    """What a batch does to a table: its rows take the place of those of their keys that come before them by order.

    Of the columns in least, the least value stays. Where rows are dear, owners
    gives the owner columns of all that they can have, and unique says that each
    key is there once, so that rows are computed one time and are compared only
    in buckets that hold some of their owners. Where the table's rows are wide, rows can hold only what they
    are made from, with the owner columns: late, an array of structs over it, is
    evaluated after the shuffle.
    """

    rows: DataFrame
    order: tuple[str, ...]
    least: tuple[str, ...] = ()
    owners: DataFrame | None = None
    unique: bool = False
    late: Column | None = None


@dataclass
class Store:
    spark: SparkSession
    path: str
    tables: dict[str, Table]
    buckets: int = 64
    _names: list[str] = field(default_factory=list)

    def _place(self, path: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the published batches."""
        place, files = self._place(f"{self.path}/{MANIFESTS}")
        found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(x[:-5]) for x in found if x.endswith(".json") and not x.startswith(("_", ".")))

    def manifest(self, number: int | None = None) -> dict[str, dict[str, list[str]]]:
        """Table -> bucket -> folders, as of a batch (the newest); empty before the first."""
        known = self.batches()
        if not known:
            return {t: {} for t in self.tables}
        name = f"{self.path}/{MANIFESTS}/{known[-1] if number is None else number:012d}.json"
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(name, wholetext=True).collect()))

    def read(self, table: str, manifest: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
        """The rows of a table; tables that are read by one manifest belong together."""
        found = (self.manifest() if manifest is None else manifest).get(table, {})
        rows, shown = self._files(table, sum(found.values(), [])), self.tables[table].shown
        return rows.selectExpr(*shown) if shown else rows

    def _files(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:  # Catalyst knows that it is empty, and leaves out the joins with it
            fields = StructType.fromDDL(self.tables[table].schema).fields
            return self.spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        return self.spark.read.schema(self.tables[table].schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def commit(self, number: int, changes: dict[str, Change]) -> bool:
        """Merges a batch's changes and publishes them; False if the batch was there already."""
        known = self.batches()
        if number in known:
            return False
        before = self.manifest()
        after = {t: dict(before.get(t, {})) for t in self.tables}
        for name, change in changes.items():
            self._merge(name, change, before.get(name, {}), after[name], f"{name}/batch-{number:012d}")
        self._publish(number, after)
        self._clean([self.manifest(n) for n in known[-1:]] + [after], self.manifest(known[-2]) if len(known) > 1 else {})
        return True

    def _bucket(self, table: Table) -> Column:
        return F.pmod(F.xxhash64(*table.owner), F.lit(self.buckets)).cast("int")

    def _merge(self, name: str, change: Change, old: dict[str, list[str]], new: dict[str, list[str]], folder: str) -> None:
        table = self.tables[name]
        columns = StructType.fromDDL(table.schema).names
        rows = change.rows if change.late is not None else change.rows.select(*columns)
        touched: list[int] = []
        met: list[int] = []  # buckets that can hold rows of the same keys, or have many folders
        if old:  # else there is nothing to read again
            owners = rows if change.owners is None else change.owners
            touched = sorted(r[0] for r in owners.select(self._bucket(table).alias("b")).distinct().collect())  # at most ``buckets`` numbers
            if not touched:
                return
            met = [b for b in touched if str(b) in old]
            if change.unique and change.owners is not None:
                met = self._shared(table, self._files(name, sum((old[str(b)] for b in met), [])), change.owners)
                met += [b for b in touched if b not in met and len(old.get(str(b), [])) >= FOLDERS]
        kept = sum((old[str(b)] for b in met), [])
        # Dealt once: rows of a key meet in their task, are compared there and written from there.
        by = table.owner if change.late is not None else table.keys
        place = [self._bucket(table).alias("bucket"), F.pmod(F.hash(*by), F.lit(PARTS)).alias("_part")]
        dealt = rows.select(*place, F.lit(1).alias("_new"), F.struct(*rows.columns).alias("_r"))
        if kept:
            before = self._files(name, kept)
            if change.late is None:
                dealt = dealt.unionByName(before.select(*place, F.lit(0).alias("_new"), F.struct(*columns).alias("_r")))
            else:
                dealt = dealt.unionByName(before.select(*place, F.lit(0).alias("_new"), F.struct(*columns).alias("_old")), allowMissingColumns=True)
        dealt = dealt.repartition("bucket", "_part")
        if change.late is not None:
            made = dealt.select("bucket", "_part", "_new", "_r.*", *(["_old"] if kept else []))
            made = made.withColumn("_made", F.when(F.col("_new") == 0, F.array("_old")).otherwise(change.late) if kept else change.late)
            # Outer, as Catalyst would else ask for arrays that are not empty, and evaluate them before the shuffle too.
            dealt = made.select("bucket", "_part", "_new", F.explode_outer("_made").alias("_r")).where("_r IS NOT NULL")
        out = dealt.select("bucket", "_part", "_new", *[F.col(f"_r.{c}").alias(c) for c in columns])
        if kept or not change.unique:
            # Of equal orders the newer batch's row stays. Hashes come first, as they sort faster than keys.
            same = Window.partitionBy("bucket", "_part", "_hash", *table.keys)
            later = F.lag(F.lit(1)).over(same.orderBy(*[F.desc(c) for c in (*change.order, "_new")]))
            out = out.withColumn("_hash", F.xxhash64(*table.keys)).withColumns({"_later": later} | {f"_{c}": F.min(c).over(same) for c in change.least}).where("_later IS NULL")
        out = out.select("bucket", *[F.col(f"_{c}" if c in change.least else c).alias(c) for c in columns])
        out.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        place, files = self._place(f"{self.path}/{folder}")
        written = {s.getPath().getName().partition("=")[2] for s in files.listStatus(place) if s.isDirectory()}
        for b in map(str, met):
            new.pop(b, None)
        for b in written:
            new[b] = [*new.get(b, []), f"{folder}/bucket={b}"]

    def _shared(self, table: Table, stored: DataFrame, owners: DataFrame) -> list[int]:
        """The buckets of stored rows whose owners are among these."""
        a, b = stored.select(*table.owner).alias("a"), owners.select(*table.owner).alias("b")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in table.owner]
        return sorted(r[0] for r in a.join(b, same, "left_semi").select(self._bucket(table).alias("b")).distinct().collect())

    def _publish(self, number: int, manifest: dict[str, dict[str, list[str]]]) -> None:
        """The manifest appears whole, by a rename."""
        name = f"{self.path}/{MANIFESTS}/{number:012d}.json"
        draft, files = self._place(f"{self.path}/{MANIFESTS}/_{number:012d}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not files.rename(draft, self._place(name)[0]):
            raise OSError(f"cannot publish {name}")

    def _clean(self, live: list[dict[str, dict[str, list[str]]]], old: dict[str, dict[str, list[str]]]) -> None:
        used = {x for m in live for buckets in m.values() for folders in buckets.values() for x in folders}
        for buckets in old.values():
            for x in set(sum(buckets.values(), [])) - used:
                remove(self.spark, f"{self.path}/{x}")


def sink(stream: DataFrame, store: Store, changes: Callable[[DataFrame], dict[str, Change]], checkpoint: str) -> StreamingQuery:
    """Every micro-batch's changes into the store, all that a stream has now."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.persist()
            store.commit(number, changes(batch))
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The package graph. A version's dependencies are one row, so they change as a whole; edges() gives them one by one.
GRAPH = {
    "packages": Table("package_id string, ecosystem string, name string, deleted boolean, updated_at timestamp, last_event long", ("package_id",), ("package_id",)),
    "versions": Table("package_id string, version string, published_at timestamp, yanked boolean, updated_at timestamp, last_event long", ("package_id", "version"), ("package_id", "version")),
    "dependencies": Table("package_id string, version string, dependencies array<struct<dependency:string,requirement:string>>, updated_at timestamp, last_event long", ("package_id", "version"), ("package_id", "version")),
}
ORDER = ("updated_at", "last_event")
#: What the graph's sink reads: kind is published, yanked or deleted.
EVENT = "kind string, package_id string, ecosystem string, name string, version string, dependencies array<struct<dependency:string,requirement:string>>, at timestamp, event_id long"


def graph_changes(events: DataFrame) -> dict[str, Change]:
    """A batch of events as changes of the package graph, whatever order they come in: the latest of a key counts.

    A published version's dependencies take the place of those that it had, a yank keeps them.
    """
    newest = F.struct("at", "event_id")

    def latest(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
        last = [F.max_by(c, newest).alias(name) for name, c in columns.items()]
        return rows.groupBy(*keys).agg(*last, F.min("at").alias("published_at"), F.max(newest).alias("_n")).withColumns({"updated_at": F.col("_n.at"), "last_event": F.col("_n.event_id")})

    of_versions, key = events.where("version IS NOT NULL AND kind <> 'deleted'"), ["package_id", "version"]
    packages = latest(events, ["package_id"], ecosystem=F.col("ecosystem"), name=F.col("name"), deleted=F.col("kind") == "deleted")
    versions = latest(of_versions, key, yanked=F.col("kind") == "yanked")
    lists = latest(of_versions.where("kind = 'published'"), key, dependencies=F.coalesce("dependencies", F.array().cast("array<struct<dependency:string,requirement:string>>")))
    return {"packages": Change(packages, ORDER), "versions": Change(versions, ORDER, ("published_at",)), "dependencies": Change(lists, ORDER)}


def graph_sink(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of events into the package graph: packages, versions and dependencies change together."""
    return sink(events, store, graph_changes, checkpoint)


def edges(dependencies: DataFrame) -> DataFrame:
    return dependencies.select("package_id", "version", F.explode("dependencies").alias("e")).select("package_id", "version", "e.dependency", "e.requirement")
