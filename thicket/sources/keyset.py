"""A stream of the rows of a table that changes, page by page in the order of (time, id).

The offset is the (time, id) of the last row read, so rows that tie with it in
time are neither lost nor read twice; Spark keeps it in the query's checkpoint.
A page is a bounded number of rows; a micro-batch has a number of whole pages, and fewer only where the rows end. The driver finds
where pages end, by times and ids alone, and tasks read the rows in between. A page that runs again has the rows between
its two offsets.

    spark.dataSource.register(KeysetSource)
    spark.readStream.format("keyset").schema(...).option("path", ...).option("time", "updated_at").option("id", "id").load()

Defined cases: rows without a time or an id are not read; rows that come later
with an earlier (time, id) than the offset are not read, as in any such poll; a
table that is not there yet, or has no rows, gives none. Times are told apart to
the microsecond.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType, TimestampType

#: Rows in a page.
PAGE = 1000


class KeysetSource(DataSource):
    """Options: path (Parquet, in a store that Arrow reads), time, id, page, pages (in a micro-batch, 1 if not given)."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("the schema of the rows must be given")

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(KeysetReader(dict(self.options), schema), int(self.options.get("pages", 1)))


class KeysetReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.time, self.id, self.columns = options["path"], options["time"], options["id"], schema.names
        self.zoned = {f.name for f in schema.fields if isinstance(f.dataType, TimestampType)}
        self.page = int(options.get("page", PAGE))

    def initialOffset(self) -> dict[str, Any]:
        return {"time": None, "id": None}

    def table(self) -> ds.Dataset | None:
        store, place = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if store.get_file_info(place).type == fs.FileType.NotFound:
            return None
        found = ds.dataset(place, filesystem=store, format="parquet", exclude_invalid_files=True)
        return found if self.time in found.schema.names else None

    def after(self, table: ds.Dataset, mark: dict[str, Any]) -> pc.Expression:
        time, key = pc.field(self.time), pc.field(self.id)
        if mark["time"] is None:
            return time.is_valid() & key.is_valid()
        kind = table.schema.field(self.time).type
        at = mark["time"]
        if pa.types.is_timestamp(kind):
            at = dt.datetime.fromisoformat(at)
            at = at.replace(tzinfo=dt.UTC if kind.tz else None)
        at = pa.scalar(at, kind)
        return (time > at) | ((time == at) & (key > pa.scalar(mark["id"], table.schema.field(self.id).type)))

    def mark(self, time: Any, key: Any) -> dict[str, Any]:
        return {"time": time.isoformat() if isinstance(time, dt.datetime) else time, "id": key}

    def marks(self, start: dict[str, Any], pages: int) -> list[dict[str, Any]]:
        """Where the next pages end, the last of which can be short. Row groups are read by their least times, as far as rows of the pages can be in them."""
        table, n = self.table(), self.page * pages
        if table is None:
            return []
        test, by, kept = self.after(table, start), [(self.time, "ascending"), (self.id, "ascending")], None
        for least, group in self.groups(table, start):
            if kept is not None and len(kept) >= n:
                if len(kept) > 2 * n:
                    kept = kept.take(pc.select_k_unstable(kept, n, by))
                if least is not None and least > pc.max(kept.column(self.time)).as_py():
                    break
            rows = group.to_table(columns=[self.time, self.id], filter=test)
            kept = rows if kept is None else pa.concat_tables([kept, rows])
        if kept is None or not len(kept):
            return []
        kept = kept.sort_by(by)[:n]
        ends = [min(k + self.page, len(kept)) - 1 for k in range(0, len(kept), self.page)]
        found = self.rows(kept.take(ends), [self.time, self.id])
        return [self.mark(*x) for x in found]

    def groups(self, table: ds.Dataset, start: dict[str, Any]) -> list[tuple[Any, ds.ParquetFileFragment]]:
        """Row groups that can hold rows behind start, with their least times; those without any come first. Timestamps count as without, as INT96 has none."""
        found, kept = [], not pa.types.is_timestamp(table.schema.field(self.time).type)
        for g in (g for f in table.get_fragments() for g in f.split_by_row_group()):
            known = (g.row_groups[0].statistics or {}).get(self.time) if kept else None
            if known is None or start["time"] is None or known["max"] >= start["time"]:
                found.append((known["min"] if known else None, g))
        return sorted(found, key=lambda x: (x[0] is not None, x[0]) if x[0] is not None else (False,))

    def between(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[pa.RecordBatch]:
        table = self.table()
        if table is not None:
            found = table.to_table(columns=self.columns, filter=self.after(table, start) & ~self.after(table, end))
            yield from self.typed(found.sort_by([(self.time, "ascending"), (self.id, "ascending")])).to_batches()

    def typed(self, table: pa.Table) -> pa.Table:
        """As Spark takes them: times to the microsecond, in UTC; those without a zone are so already."""
        for k, f in enumerate(table.schema):
            if pa.types.is_timestamp(f.type):
                table = table.set_column(k, f.name, pc.cast(pc.cast(table.column(k), pa.timestamp("us", f.type.tz), safe=False), pa.timestamp("us", "UTC" if f.name in self.zoned else None)))
        return table

    def rows(self, table: pa.Table, columns: list[str] | None = None) -> list[tuple]:
        return [tuple(r[c] for c in columns or self.columns) for r in self.typed(table).to_pylist()]

    def least(self, table: ds.Dataset, test: pc.Expression) -> pa.Table | None:
        """The first rows that pass, in order: at most a page and one batch are held."""
        kept: pa.Table | None = None
        for batch in table.scanner(columns=self.columns, filter=test, batch_size=16_384).to_batches():
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            if len(kept) > self.page:
                kept = kept.take(pc.select_k_unstable(kept, self.page, [(self.time, "ascending"), (self.id, "ascending")]))
        return kept.sort_by([(self.time, "ascending"), (self.id, "ascending")]) if kept is not None and len(kept) else None

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        table = self.table()
        page = self.least(table, self.after(table, start)) if table is not None else None
        if page is None:
            return iter(()), start
        rows = self.rows(page)
        last = dict(zip(self.columns, rows[-1], strict=True))
        return iter(rows), self.mark(last[self.time], last[self.id])

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:
        table = self.table()
        if table is None or start == end:
            return iter(())
        found = table.to_table(columns=self.columns, filter=self.after(table, start) & ~self.after(table, end))
        return iter(self.rows(found.sort_by([(self.time, "ascending"), (self.id, "ascending")])))


class Span(InputPartition):
    def __init__(self, start: dict[str, Any], end: dict[str, Any]):
        self.start, self.end = start, end


class KeysetStream(DataSourceStreamReader):
    """Micro-batches of pages; each task reads some of a batch's pages."""

    #: Tasks of a micro-batch at most.
    TASKS = 16

    def __init__(self, reader: KeysetReader, pages: int):
        self.reader, self.pages = reader, pages
        self.at: dict[str, Any] | None = None
        self.ends: dict[str, list[dict[str, Any]]] = {}

    def initialOffset(self) -> dict[str, Any]:
        return self.reader.initialOffset()

    def latestOffset(self) -> dict[str, Any]:
        start = self.initialOffset() if self.at is None else self.at
        ends = self.reader.marks(start, self.pages)
        if ends:
            self.at = ends[-1]
            self.ends[json.dumps(self.at)] = ends
        return start if not ends else self.at

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[InputPartition]:
        # As for Spark's simple readers: a stream that starts again plans its last batch first.
        if self.at is None:
            self.at = end
        ends = self.ends.get(json.dumps(end), [end])
        step = -(-len(ends) // self.TASKS)
        cuts = [start, *ends[step - 1 : -1 : step], end]
        return [Span(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a != b]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.reader.between(partition.start, partition.end)

    def commit(self, end: dict[str, Any]) -> None:
        if self.at is None:
            self.at = end
        self.ends.pop(json.dumps(end), None)
