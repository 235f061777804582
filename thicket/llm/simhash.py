"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint is 8 bytes. Two that differ in at most 3 bits share at least 5
bytes at their positions, so they share some triple of positions that lies in
one half of the fingerprint (three of five shared positions are in one half):
8 posting keys a fingerprint, each of three positional bytes, reach every pair.
Inside a posting the shared positional bytes of each pair are tallied, pairs
below 5 dropped, the rest verified bit by bit.

Equal fingerprints are one class before the index, so copies never pair up. A
posting larger than BLOCK splits into blocks, whose pairs of blocks are rows of
their own; each gives a spanning forest of its links, not all pairs. Components
of the links give each document its class.

Defined cases: a null or empty text has fingerprint 0, linked like any other;
texts below the shingle length are one shingle; repeated rows and repeated ids
stay rows; a null id takes part, and component_id is the smallest id that is
not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside, stored, text_batches
from .components import components

SHINGLE = 3
MAX_BITS = 3
LEAST_BYTES = 8 - MAX_BITS
BLOCK = 2048
#: Position triples inside either half of the fingerprint.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among left, or between left and right (fingerprints as uint64)."""
    nodes = left if right is None else np.concatenate([left, right])
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    shift = 0 if right is None else len(left)
    other = left if right is None else right
    as_bytes = other.view(np.uint8).reshape(-1, 8)
    for k in range(len(left)):
        at = k + 1 if right is None else 0
        if at >= len(other):
            break
        tally = (as_bytes[at:] == left[k : k + 1].view(np.uint8)).sum(axis=1)
        near = np.flatnonzero(tally >= LEAST_BYTES) + at
        if len(near):
            near = near[np.bitwise_count(other[near] ^ left[k]) <= MAX_BITS]
        for m in near.tolist():
            a, b = find(k), find(m + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((k, m + shift))
    return [(int(nodes[a]), int(nodes[b])) for a, b in out]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """distinct: fp (signed long), each once. Gives a, b: links whose components are those of all links."""
    byte = lambda p: F.shiftright(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
    keys = [F.shiftleft(F.lit(k).cast("long"), 24) + F.shiftleft(byte(p), 16) + F.shiftleft(byte(q), 8) + byte(r) for k, (p, q, r) in enumerate(TRIPLES)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Most postings hold one fingerprint; the sizes of the others decide how many blocks they split into.
    sizes = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "postings")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = index.join(sizes, "key").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    # Where there is one block, a posting is one row; else one for each pair of blocks.
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("_own", "_with").alias("x"), F.greatest("_own", "_with").alias("y"), F.struct("_own", "fp").alias("m"))
    postings = rows.groupBy("key", "x", "y").agg(F.collect_list("m").alias("members"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            members = b.column("members")
            flat, at = members.flatten(), np.concatenate([[0], np.cumsum(np.asarray(members.value_lengths()))])
            own, fps = np.asarray(flat.field(0)), np.asarray(flat.field(1)).view(np.uint64)
            for k, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                o, f = own[at[k] : at[k + 1]], np.ascontiguousarray(fps[at[k] : at[k + 1]])
                if len(f) == 2 and x == y:
                    if (int(f[0]) ^ int(f[1])).bit_count() <= MAX_BITS:
                        found.append((int(f[0]), int(f[1])))
                elif x == y:
                    found += forest(f, None)
                else:
                    found += forest(f[o == x], f[o == y])
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return postings.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable through links, its own included)."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    found = components(links(classes.select("fp")))
    of_root = found.join(classes, found["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = stored(found.join(of_root, "root").select(F.col("node").alias("fp"), "component"), "components")
    classes = classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    out = marked.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id, nulls last (of rows that share it, the one of the smallest text hash).

    Where ids repeat, a stored row key tells rows apart, so an id decides for its
    own row alone. The keys that go are joined, not those that stay: they are the
    fewer, so the texts stay where they are as long as Catalyst finds their table
    small.
    """
    rows, named = set_aside(docs, (id_col, text_col))
    own = id_col
    if not rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        own = "__row"
        rows = stored(rows.withColumn(own, F.concat_ws("-", F.lower(F.hex(F.xxhash64(F.col(text_col)))), F.expr("uuid()"))), "rows")
    key = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col(own).alias("row"))
    marked = near_duplicates(rows.select(key.alias("key"), text_col), "key", text_col)
    gone = stored(marked.where(~F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.row").alias("__gone")), "gone")
    return named(rows.join(gone, F.col(own).eqNullSafe(F.col("__gone")), "left_anti"))
