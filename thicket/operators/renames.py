"""The best match of each removed symbol among the new ones of its package and kind.

All pairs of a package and kind are compared: the threshold leaves nothing to
block by without loss. Their symbols meet in a task, sorted, the removed ones
first and the new ones by path, and are read as a stream: a task holds the
removed symbols of one block, the new ones of one Arrow batch, and a bounded
number of pairs. Packages with many removed symbols come apart in blocks, each
of which meets all new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of name and signature, and the least similarity, in units of 1e-9.
NAME, SIGNATURE, LEAST = 0.4, 0.6, 700_000_000
#: Removed symbols of a block on average, pairs that are compared at once, and cells of a table of edits.
BLOCK, PAIRS, CELLS = 4096, 1 << 15, 1 << 21
OUT = pa.schema([(c, pa.string()) for c in ("pkg", "path", "kind", "signature", "new_path")])


class Texts:
    """Strings as a grid of code points, a column each, without the prefix that all share."""

    def __init__(self, texts: pa.Array):
        self.sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.octets = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(1, int(self.sizes.max(initial=0)))
        grid = np.array(texts.to_pylist(), f"U{width}").view(np.uint32).reshape(len(texts), width)
        grid = np.ascontiguousarray((grid.astype(np.uint8) if int(grid.max(initial=0)) < 256 else grid).T)
        least, same = int(self.sizes.min(initial=width)), 0
        while same < least and (grid[same] == grid[same, 0]).all():
            same += 1
        self.grid, self.left = grid[same:], self.sizes - same

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the texts a and b, pair by pair: 1 for equal ones, less by the share of edits."""
        out = np.empty(len(a))
        step = max(1, CELLS // (len(self.grid) + 1))
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            out[at : at + step] = 1 - self.edits(x, y) / np.maximum(np.maximum(self.octets[x], self.octets[y]), 1)
        return out

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Levenshtein distances, one cell of the tables of all pairs at a time."""
        size_a, size_b = self.left[a], self.left[b]
        rows, columns = int(size_a.max(initial=0)), int(size_b.max(initial=0))
        kind = np.uint8 if max(rows, columns) < 255 else np.int32
        of_a, of_b = self.grid[:rows].take(a, axis=1), self.grid[:columns].take(b, axis=1)
        line = np.repeat(np.arange(columns + 1, dtype=kind)[:, None], len(a), axis=1)
        out = size_b.copy()  # of empty texts a
        for i in range(1, rows + 1):
            corner = line[0].copy()
            line[0] = i
            for j in range(1, columns + 1):
                corner += of_a[i - 1] != of_b[j - 1]
                cell = np.minimum(line[j], line[j - 1])
                cell += kind(1)
                np.minimum(cell, corner, out=cell)
                corner = line[j].copy()
                line[j] = cell
            ends = np.flatnonzero(size_a == i)
            out[ends] = line[size_b[ends], ends]
        return out


def billionths(x: np.ndarray) -> np.ndarray:
    """x in units of 1e-9, halves up by their decimal digits, as round does."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[k] = int(Decimal(repr(float(x[k]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return out


def signature_shares(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signatures' part of the similarity; those that repeat are compared once."""
    n = len(texts.sizes)
    both, at = np.unique(a * n + b, return_inverse=True)
    return (SIGNATURE * texts.likeness(both // n, both % n))[at]


def best_in(rows: pa.Table, removed: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the removed rows, whose new rows are n from first on: the greatest similarity, or -1, and the first row that has it."""
    score, where = np.full(len(removed), -1, np.int64), np.zeros(len(removed), np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return score, where
    column = lambda c: rows.column(c).combine_chunks()
    names, coded = Texts(column("name")), column("signature").dictionary_encode()
    signatures, code = Texts(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n[some])
    at = 0
    while at < len(some):  # as many removed rows as make a bounded number of pairs, or one
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        part = some[at:till]
        starts = np.cumsum(n[part]) - n[part]
        a = np.repeat(removed[part], n[part])
        b = np.arange(len(a)) + np.repeat(first[part] - starts, n[part])
        share = signature_shares(signatures, code[a], code[b])
        # Pairs whose signatures alone rule the least similarity out are not compared by name.
        near = np.flatnonzero(share >= LEAST / 1e9 - NAME - 1e-9)
        order = np.full(len(a), -1, np.int64)
        order[near] = billionths(NAME * names.likeness(a[near], b[near]) + share[near])
        order = np.where(order >= LEAST, order << 32 | (2**32 - 1 - b), -1)
        best = np.maximum.reduceat(order, starts)
        score[part], where[part] = np.where(best >= 0, best >> 32, -1), np.where(best >= 0, 2**32 - 1 - (best & 2**32 - 1), 0)
        at = till
    return score, where


def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after the other, the removed before the new, which come by path."""
    carried = None  # removed rows of the block that the last batch ended in, with what was found for them
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        fresh = fresh.append_column("score", pa.array(np.full(len(fresh), -1))).append_column("new_path", pa.nulls(len(fresh), pa.string()))
        rows = fresh if carried is None else pa.concat_tables([carried, fresh])
        rows = rows.combine_chunks()
        if not len(rows):
            continue
        differs = np.zeros(len(rows), bool)
        for c in ("pkg", "kind", "block"):
            x = rows.column(c)
            differs[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False) if len(x) > 1 else False
        block = np.cumsum(differs)
        new = rows.column("is_new").to_numpy().astype(bool)
        removed = np.flatnonzero(~new)
        of_new = block[new]
        place = np.flatnonzero(new)
        low, high = np.searchsorted(of_new, block[removed], "left"), np.searchsorted(of_new, block[removed], "right")
        first = np.append(place, 0)[np.minimum(low, len(place))]
        score, where = best_in(rows, removed, first, high - low)
        before = rows.column("score").to_numpy()[removed]
        better = score > before  # of equal ones the earlier path stays
        paths = rows.column("path").combine_chunks()
        found = pc.if_else(pa.array(better), paths.take(pa.array(where)), rows.column("new_path").combine_chunks().take(pa.array(removed)))
        held = rows.take(pa.array(removed))
        held = held.set_column(held.schema.get_field_index("score"), "score", pa.array(np.maximum(score, before)))
        held = held.set_column(held.schema.get_field_index("new_path"), "new_path", found)
        last = block[removed] == block[-1]
        carried = held.filter(pa.array(last))
        yield from results(held.filter(pa.array(~last)))
    if carried is not None:
        yield from results(carried)


def results(held: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from held.filter(pc.greater_equal(held.column("score"), 0)).select(OUT.names).cast(OUT).to_batches()


def best(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """pkg, path, kind, signature, new_path of the removed symbols that have a match; rows: symbols (pkg, kind, path, name, signature) with gone and new, which tell whether each was removed and whether it is there now.

    sizes (pkg, kind, n) can give a bound on the removed symbols of each package and kind, where counting them is dear.
    """
    rows = rows.select("pkg", "kind", "path", "name", "signature", "gone", "new").where("(gone OR new) AND pkg IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL AND signature IS NOT NULL")
    sizes = rows.where("gone").groupBy("pkg", "kind").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    # A row for each package and kind of more symbols than a block has, so few.
    large = sizes.select("pkg", "kind", F.ceil(F.col("n") / BLOCK).alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("path", "name", "signature"), blocks)
    places = F.concat(F.when(F.col("gone"), F.array(F.struct(own.alias("block"), F.lit(0).alias("is_new")))).otherwise(F.array()), F.when(F.col("new"), F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("is_new")))).otherwise(F.array()))
    dealt = rows.join(F.broadcast(large), ["pkg", "kind"], "left").select("pkg", "kind", "path", "name", "signature", F.explode_outer(places).alias("p")).select("pkg", "kind", "p.*", "path", "name", "signature")
    return dealt.repartition("pkg", "kind", "block").sortWithinPartitions("pkg", "kind", "block", "is_new", "path").mapInArrow(matches, ", ".join(f"{c} string" for c in OUT.names))
