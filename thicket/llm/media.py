"""Media columns: payloads stored as 8-bit audio in zip archives, read back by a Spark data source.

A writer puts each payload as a WAV file (8-bit mono samples, one a byte) into
deflated zip archives in the shared folder. The data source ``thicket_media``
plans byte ranges over those archives from their file sizes alone; the task of
a range reads the archive's central directory, takes the members whose local
header starts in its range, reads each by its offset, and retries each one
alone. Batches stream out through Arrow at a bounded size. A retried or
speculative task writes an archive of its own name, and only archives that a
finished task reported are read.

Defined cases: a null text is empty; an empty payload is 64 zero bytes; null or
repeated ids are members like any other, and may be of any type that has a text,
of any length; a member that stays unreadable gives a
row with ``error`` set and the other columns null; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, stored, text_batches

PAD = 64
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
#: Ranges that are planned at most; beyond, each covers more bytes and several archives.
MOST_RANGES = 100_000
BATCH_BYTES = 4 << 20
#: The member that holds the ids of the others, whose names are their numbers.
IDS = "ids"
TRIES = 3
WAV_HEADER = "<4sI4s4sIHHIIHH4sI"
LOCAL_HEADER = "<4s5H3I2H"
MEMBER_SCHEMA = "doc_id string, n_bytes long, media binary, payload binary, error string"
ARROW_SCHEMA = pa.schema([("doc_id", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])


def padded(payload: bytes, unit: int = PAD) -> bytes:
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; a whole number of 64 needs no pad byte."""
    return struct.pack(WAV_HEADER, b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    head = struct.unpack_from(WAV_HEADER, media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[12] != len(media) - struct.calcsize(WAV_HEADER):
        raise ValueError("not an 8-bit WAV file")
    return media[struct.calcsize(WAV_HEADER) :]


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores every text; returns one row an archive: path, bytes, members."""
    root = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(root)
        files.create_dir(where, recursive=True)
        done, out, archive, name, count, ids = [], None, None, "", 0, []

        def close() -> None:
            table = pa.table({"id": pa.array(ids, pa.string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            archive.writestr(IDS, sink.getvalue().to_pybytes(), compresslevel=1)
            ids.clear()
            archive.close()
            done.append((name, out.tell(), count))
            out.close()

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name, count = f"{where}/{uuid.uuid4().hex}.zip", 0
                    out = io.BufferedWriter(_Raw(files.open_output_stream(name)), 1 << 20)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                raw = text.as_py().encode() if text.is_valid else b""
                member = zipfile.ZipInfo(f"{count}/{len(raw)}.wav")
                member.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(member, to_wav(padded(raw)), compresslevel=1)
                ids.append(key.as_py())
                count += 1
                if out.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "members"])

    rows = text_batches(docs).select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t"))
    return stored(rows.mapInArrow(write, "path string, bytes long, members long"), "media-index").withColumn("root", F.lit(root))


class _Raw(io.RawIOBase):
    """A pyarrow output stream as a file that zipfile can write to without seeking back."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


class ByteRange(InputPartition):
    """Ranges (path, start, end) of archives that one task reads."""

    def __init__(self, *pieces: tuple[str, int, int]):
        self.pieces = pieces


class MediaReader(DataSourceReader):
    """options: index (folder of the table of archives), range_bytes, tries."""

    def __init__(self, options: dict):
        self.index, self.root = options["index"], options["root"]
        self.range_bytes, self.tries = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        import pyarrow.parquet as pq

        files, where = fs.FileSystem.from_uri(self.index)
        names = [info.path for info in files.get_file_info(fs.FileSelector(where)) if info.path.endswith(".parquet")]
        archives = [row for name in names for row in pq.read_table(name, filesystem=files, columns=["path", "bytes"]).to_pylist()]
        size = max(self.range_bytes, -(-sum(a["bytes"] for a in archives) // MOST_RANGES))
        found, pieces, held = [], [], 0
        for a in archives:
            for at in range(0, a["bytes"], size):
                pieces.append((a["path"], at, at + size))
                held += min(size, a["bytes"] - at)
                if held >= size // 2:
                    found.append(ByteRange(*pieces))
                    pieces, held = [], 0
        return [*found, ByteRange(*pieces)] if pieces else found

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no archives, so no ranges
            return
        files, _ = fs.FileSystem.from_uri(self.root)
        for path, start, end in part.pieces:
            with files.open_input_file(path) as f:
                listed, error = self.tried(files, f, path, lambda source: zipfile.ZipFile(source).infolist())
                if listed is None:
                    raise OSError(f"{path}: {error}")  # no member is known, so the task fails and Spark runs it anew
                ids = self.ids(files, f, path, listed)
                rows, held = [], 0
                for m in sorted((m for m in listed if start <= m.header_offset < end and m.filename != IDS), key=lambda m: m.header_offset):
                    rows.append(self.member(files, f, path, m, ids))
                    held += m.file_size
                    if held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
                yield self.batch(rows)

    def tried(self, files, f, path: str, read: Callable[[Any], Any]) -> tuple[Any, str | None]:
        """What read gives for the open archive, or after a failure for one opened anew; else the error."""
        error = None
        for k in range(self.tries):
            try:
                return read(f if k == 0 else files.open_input_file(path)), None
            except (OSError, ValueError, zlib.error, struct.error, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.1 * 2**k if k + 1 < self.tries else 0)
        return None, error

    def ids(self, files, f, path: str, listed: list[zipfile.ZipInfo]) -> list[str | None]:
        """The ids of an archive's members, by number. An archive of another writer has none."""
        own = [m for m in listed if m.filename == IDS]
        if not own:
            return []
        raw, error = self.tried(files, f, path, lambda source: read_member(source, own[0]))
        if raw is None:
            raise OSError(f"{path}: {error}")
        return pa.ipc.open_stream(raw).read_all().column("id").to_pylist()

    def member(self, files, f, path: str, m: zipfile.ZipInfo, ids: list[str | None]) -> tuple:
        number, _, rest = m.filename.partition("/")
        key = ids[int(number)] if ids else None

        def read(source) -> tuple[bytes, bytes]:
            media = read_member(source, m)
            return media, from_wav(media)

        found, error = self.tried(files, f, path, read)
        return (key, None, None, None, error) if found is None else (key, int(rest.partition(".")[0]), *found, None)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(ARROW_SCHEMA)], schema=ARROW_SCHEMA)


def read_member(f, m: zipfile.ZipInfo) -> bytes:
    """One member by its offset, its checksum verified."""
    f.seek(m.header_offset)
    head = struct.unpack(LOCAL_HEADER, f.read(struct.calcsize(LOCAL_HEADER)))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    f.seek(m.header_offset + struct.calcsize(LOCAL_HEADER) + head[9] + head[10])
    raw = f.read(m.compress_size)
    data = zlib.decompress(raw, -15) if m.compress_type == zipfile.ZIP_DEFLATED else raw
    if zlib.crc32(data) != m.CRC or len(data) != m.file_size:
        raise ValueError("checksum differs")
    return data


class MediaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "thicket_media"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, index: DataFrame, **options) -> DataFrame:
    """The members of all archives of index (as write_archives returns it): doc_id, n_bytes, media, payload, error."""
    spark.dataSource.register(MediaDataSource)
    files = index.inputFiles()
    if not files:
        return spark.createDataFrame([], MEMBER_SCHEMA)
    root = files[0].rsplit("/", 1)[0]
    reader = spark.read.format("thicket_media").option("index", root).option("root", root)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def feature(payload: bytes) -> str:
    """Level, loudness, zero crossings and the histogram of 16 levels of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x, minlength=256)
    values = np.arange(256)
    n = len(x)
    mean = int(levels @ values) / n
    rms = (int(levels @ (values - 128) ** 2) / n) ** 0.5
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    shares = levels.reshape(16, 16).sum(axis=1) * 1000 // n
    return f"mean={mean:.3f};rms={rms:.3f};crossings={crossings};levels=" + ",".join(map(str, shares))


def features(members: DataFrame) -> DataFrame:
    """Digests and the feature of each member read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, payload = b.column("media"), b.column("payload")
            rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)) if p is not None else (None,) * 6 for p, m in zip(payload.to_pylist(), media.to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], b.column("error")], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return members.mapInArrow(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Stores every text of docs as media and returns the digests and features of what is read back; ids keep their type."""
    found = features(read_archives(docs.sparkSession, write_archives(docs, id_col, text_col), **options))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)
