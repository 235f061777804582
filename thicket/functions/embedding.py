"""Hashed lexical vectors: what a text is made of, hashed into a vector of fixed length.

The features are arrays of strings that Catalyst builds; only the hashing of a
batch runs in Python, on whole arrays. A null text counts as an empty one, whose
only feature is the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import TINY

DIMENSION = 384
# 64-bit FNV-1a, and the weight of each kind of feature.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WEIGHTS = {"txt": 0.25, "tok": 1.0, "pre": 0.15, "suf": 0.15, "tri": 0.2, "bi": 0.3}
AFFIXES = range(3, 7)


def features(text: Column) -> Column:
    """kind:value strings: the text, its words, their ends and trigrams, and neighbouring words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    ends = lambda w: F.flatten(F.array(*[F.when(F.length(w) >= n, F.array(F.concat(F.lit("pre:"), F.left(w, F.lit(n))), F.concat(F.lit("suf:"), F.right(w, F.lit(n))))).otherwise(F.array().cast("array<string>")) for n in AFFIXES]))
    starts = lambda w: F.when(F.length(w) >= 3, F.sequence(F.lit(1), F.length(w) - 2)).otherwise(F.array().cast("array<int>"))
    trigrams = lambda w: F.transform(starts(w), lambda k: F.concat(F.lit("tri:"), w.substr(k, F.lit(3))))
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(
        F.array(F.concat(F.lit("txt:"), low)),
        F.transform(words, lambda w: F.concat(F.lit("tok:"), w)),
        F.flatten(F.transform(words, ends)),
        F.flatten(F.transform(words, trigrams)),
        F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(F.lit("bi:"), a, F.lit("_"), b)),
    )


def fnv1a(values: list[str]) -> np.ndarray:
    """The hash of each string's UTF-8 bytes, byte by byte over all strings that long at once."""
    raw = [v.encode() for v in values]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    falling = -sizes[order]
    h = np.full(len(raw), FNV_START, np.uint64)
    for k in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(falling, -k))  # strings longer than k
        h[:n] = (h[:n] ^ data[first[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def grid_of(lists: pd.Series, dimension: int) -> np.ndarray:
    """A row a list of features, of length 1: each feature adds its weight at its hash modulo dimension, odd hashes negatively."""
    codes, known = pd.factorize(np.concatenate([np.asarray(x, object) for x in lists] or [np.array([], object)]))
    known = known.tolist()
    hashes = fnv1a(known)
    sign = 1.0 - 2.0 * (hashes & np.uint64(1)).astype(np.float64)
    weight = np.array([WEIGHTS[v.partition(":")[0]] for v in known], np.float64) * sign
    grid = np.zeros((len(lists), dimension))
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    np.add.at(grid, (at, (hashes % np.uint64(dimension)).astype(np.int64)[codes]), weight[codes])
    size = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    return grid / np.where(size > TINY, size, 1.0)


def lexical_vectors(rows: DataFrame, key: str | list[str], text: str, dimension: int = DIMENSION) -> DataFrame:
    """key (one column or several) and vector of each row."""
    keys = [key] if isinstance(key, str) else key

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({k: frame[k] for k in keys} | {"vector": list(grid_of(frame["f"], dimension))})

    kinds = dict(rows.select(*keys).dtypes)
    return rows.select(*keys, features(F.col(text)).alias("f")).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", vector array<double>")


def lexical_sparse(rows: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """key, slots and values: what is not zero in the vector of each row, by ascending slot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grid = grid_of(frame["f"], dimension)
            at, slot = np.nonzero(grid)
            ends = np.searchsorted(at, np.arange(1, len(frame)))
            yield pd.DataFrame({key: frame[key], "slots": np.split(slot.astype(np.int32), ends), "values": np.split(grid[at, slot], ends)})

    kind = dict(rows.select(key).dtypes)[key]
    return rows.select(key, features(F.col(text)).alias("f")).mapInPandas(run, f"`{key}` {kind}, slots array<int>, values array<double>")


#: SQL: the whole vector of such slots and values, each value behind its run of zeros.
WHOLE = "flatten(concat(transform(slots, (s, k) -> concat(array_repeat(0D, s - if(k = 0, 0, slots[k - 1] + 1)), array(`values`[k]))), array(array_repeat(0D, {} - coalesce(element_at(slots, -1) + 1, 0)))))"


def lexical_slots(rows: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """key, slot and value of what is not zero in the vector of each row: a few of its slots, so whole vectors stay in the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grid = grid_of(frame["f"], dimension)
            at, slot = np.nonzero(grid)
            yield pd.DataFrame({key: frame[key].to_numpy()[at], "slot": slot.astype(np.int32), "value": grid[at, slot]})

    kind = dict(rows.select(key).dtypes)[key]
    return rows.select(key, features(F.col(text)).alias("f")).mapInPandas(run, f"`{key}` {kind}, slot int, value double")
