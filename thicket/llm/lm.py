"""Language-model scoring by deleted interpolation of n-gram estimates.

The probability of a word after its predecessor mixes three estimates: bigram
and unigram maximum likelihood, and uniform over the vocabulary with one place
for unknown words. The mixture weights depend on the frequency bucket of the
context (its log2 count) and are learned by expectation-maximisation on
held-out counts: each training occurrence is scored with its own count deleted.

The corpus is cut into chunks of CHUNK words. A chunk keeps its token numbers
and its vocabulary (64-bit hashes) in a stored table, and asks for the counts of
its distinct unigrams and bigrams. Requests meet in hash buckets, which add up
the training counts of all chunks and answer each, in groups of FAN where more
chunks ask; so no task holds more than one chunk or that many requests, and the
volume follows the corpus.

Defined cases: a null or empty text is the end token alone; repeated rows and
ids are rows like any other (a null id counts as empty text in the split); with
no training rows every count is 0; an empty table gives an empty result; other
columns are ignored. Words are told apart by XXH64, so two share a count with a
chance of about n**2 / 2**65 among n distinct words; bigrams by 48 bits, so one of n
shares its count with a chance of n / 2**48.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_crc, stored, text_batches

CHUNK = 1 << 20
#: Hash keys that a bucket holds at the mean.
BUCKET_KEYS = 1 << 20
END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)
CLASSES = 40
#: Log-ratio bins of the held-out statistics: step of a nat / 4.
STEP = 0.25
#: Bins on each side; the number of the bin of an estimate that is zero.
NONE = 500
ROUNDS = 100
#: Numbers that are not worth a compressed frame: a chunk asks a bucket for few once there are many buckets.
FEW = 16
#: Requests that a bucket answers at once.
FAN = 4096


class Numbers(dict):
    """Words (bytes) numbered from 1 in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a bigram from those of its words: 48 bits in the upper end of the number."""
    x = (first ^ (first >> np.uint64(29))) * MIX
    x = (x ^ second) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFF0000)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of x, and which of them each element is."""
    order = np.argsort(x)
    line = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(line[1:], line[:-1], out=new[1:])
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return line[new], of


def pack(x: np.ndarray) -> bytes:
    """An array of integers as byte planes, compressed where there are more than a few."""
    if len(x) <= FEW:
        return b"\0" + np.ascontiguousarray(x).tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data[1:], kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def chunked(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, chunk: int) -> DataFrame:
    """One row a chunk: doc ids, held-out flags, token numbers and their vocabulary; stored."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = text_batches(docs).select(F.col(id_col).alias("k"), (fold_crc(F.col(id_col), folds) == held).alias("h"), F.col(text_col).cast("string").alias("t"))
    schema = f"chunk string, ids array<{kind}>, held array<boolean>, lengths array<int>, tokens binary, vocabulary binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        keys, held_out, lengths, tokens, memo, n = [], [], [], [], Numbers(), 0

        def close() -> pa.RecordBatch:
            vocabulary = np.array([END, *[np.uint64(xxhash.xxh64_intdigest(w, 42)) for w in memo]], np.uint64)
            row = [uuid.uuid4().hex, keys, held_out, lengths, pack(np.concatenate(tokens)), vocabulary.tobytes(), n]
            types = [pa.string(), pa.list_(kinds), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["chunk", "ids", "held", "lengths", "tokens", "vocabulary", "n"])

        kinds, last = None, np.zeros(1, "<u4")  # the end token
        for b in batches:
            kinds = b.schema.field(0).type
            for k, h, text in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), b.column("t"), strict=True):
                found = (text.as_py() or "").encode().lower().split()  # bytes know ASCII letters and white space only
                line = np.fromiter(map(memo.__getitem__, found), "<u4", len(found))
                tokens += (line, last)
                lengths.append(len(found) + 1)
                keys.append(k)
                held_out.append(h)
                n += len(found) + 1
                if n >= chunk:
                    yield close()
                    keys, held_out, lengths, tokens, memo, n = [], [], [], [], Numbers(), 0
        if keys:
            yield close()

    return stored(rows.mapInArrow(run, schema), "lm-chunks")


class Chunk:
    """A chunk's tokens by local number, and its distinct bigrams."""

    def __init__(self, row: dict):
        self.tokens = unpack(row["tokens"], "<u4").astype(np.int32)
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        size = int(self.tokens.max()) + 1
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[starts] = size  # the start of a text, a context only
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.size = size
        pairs, self.pair_of = distinct(before * size + self.tokens)
        self.pair_first, self.pair_second = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)

    def keys(self, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the bigrams."""
        words = np.frombuffer(vocabulary, np.uint64)
        return words, pair_key(np.append(words, START)[self.pair_first], words[self.pair_second])

    def train_pairs(self) -> np.ndarray:
        """How often the training texts of the chunk hold each bigram."""
        return np.bincount(self.pair_of[~self.held[self.doc]], minlength=len(self.pair_first))


def spread(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each bucket (a range of keys) starts in it."""
    order = np.argsort(keys)
    bucket = ((keys[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return order, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


REQUEST = "bucket int, chunk string, kind int, keys binary, counts binary"


def requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk, bucket and kind (1 words, 2 bigrams): the sorted keys, and their training counts in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = Chunk(row)
            words, pairs = c.keys(row["vocabulary"])
            own = c.train_pairs()
            uni = np.bincount(c.pair_second, weights=own, minlength=c.size).astype("<u8")
            for kind, keys, counts in ((1, words, uni), (2, pairs, own.astype("<u8"))):
                order, at = spread(keys, buckets)
                full = np.flatnonzero(np.diff(at)).tolist()
                keys, counts = keys[order], counts[order]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.string()), pa.array([kind] * len(full), pa.int32()), pa.array([pack(np.diff(keys[at[k] : at[k + 1]], prepend=np.uint64(0))) for k in full], pa.binary()), pa.array([pack(counts[at[k] : at[k + 1]]) for k in full], pa.binary())], names=["bucket", "chunk", "kind", "keys", "counts"])

    return chunks.select("chunk", "held", "lengths", "tokens", "vocabulary").mapInArrow(run, REQUEST)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a chunk is large."""
    for b in batches:
        for k in range(len(b)):
            yield b.slice(k, 1).to_pylist()[0]


REPLY = "bucket int, chunk string, kind int, counts binary, total long, known long"


def merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys that the requests of a group hold, their counts, which of them each asked key is, and where each request's keys end."""
    keys = [np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in group["keys"]]
    found, of = distinct(np.concatenate(keys))
    counts = np.bincount(of, weights=np.concatenate([unpack(x, "<u8") for x in group["counts"]]), minlength=len(found)).astype("<u8")
    return found, counts, of, np.cumsum([len(k) for k in keys])[:-1]


def answers(asked: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """bucket, chunk, kind, counts: the total training counts in the order asked; total, known: their sum and number, in one row (chunk null) of each bucket of words.

    A word that every chunk holds brings a request of each to its bucket. Up to
    ``fan`` of them are answered at once; of more, groups of that many are merged
    to one request each, which is answered in the same way, and then
    answer their own. So no task holds more than about ``fan`` requests.
    """
    groups = -(-chunks // fan)
    if groups > 1:
        part = asked.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("string"))

        def merge(group: pd.DataFrame) -> pd.DataFrame:
            found, counts, _, _ = merged(group)
            first = group.iloc[0]
            return pd.DataFrame({"bucket": [first["bucket"]], "chunk": [first["g"]], "kind": [first["kind"]], "keys": [pack(np.diff(found, prepend=np.uint64(0)))], "counts": [pack(counts)]})

        whole = answers(stored(part.groupBy("bucket", "kind", "g").applyInPandas(merge, REQUEST), "lm-merged"), groups, fan)

        def pass_on(group: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
            _, _, of, bounds = merged(group)
            counts = unpack(reply["counts"].iloc[0], "<u8")
            out = group[["bucket", "chunk", "kind"]].copy()
            out["counts"] = [pack(counts[x]) for x in np.split(of, bounds)]
            return out.assign(total=0, known=0)

        replies = whole.where("chunk IS NOT NULL").withColumnRenamed("chunk", "g")
        own = part.groupBy("bucket", "kind", "g").cogroup(replies.groupBy("bucket", "kind", "g")).applyInPandas(pass_on, REPLY)
        return stored(own.unionByName(whole.where("chunk IS NULL")), "lm-answers")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, counts, of, bounds = merged(group)
        out = group[["bucket", "chunk", "kind"]].copy()
        out["counts"] = [pack(counts[part]) for part in np.split(of, bounds)]
        if group["kind"].iloc[0] == 1:
            out = pd.concat([out, pd.DataFrame({"bucket": [out["bucket"].iloc[0]], "chunk": [None], "kind": [1], "counts": [None]})])
            out["total"], out["known"] = int(counts.sum(dtype=np.uint64)), int(np.count_nonzero(counts))
        else:
            out["total"], out["known"] = 0, 0
        return out

    return stored(asked.groupBy("bucket", "kind").applyInPandas(run, REPLY), "lm-answers")


def counted(chunks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """The chunks with the total training counts of their words and bigrams (packed, by local number); stored."""
    by_chunk = replies.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "counts")).alias("parts"))
    kind = chunks.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                part = b.slice(k, 1)
                row = part.drop_columns(["ids"]).to_pylist()[0]
                out = []
                for kind, keys in zip((1, 2), Chunk(row).keys(row["vocabulary"]), strict=True):
                    found = sorted((p["bucket"], p["counts"]) for p in row["parts"] if p["kind"] == kind)
                    counts = np.empty(len(keys), "<u8")
                    counts[spread(keys, buckets)[0]] = np.concatenate([unpack(x, "<u8") for _, x in found])
                    out.append(pa.array([pack(counts)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("ids", "held", "lengths", "tokens")], *out], names=["ids", "held", "lengths", "tokens", "words", "pairs"])

    joined = chunks.select("chunk", "ids", "held", "lengths", "tokens", "vocabulary").join(by_chunk, "chunk")
    return stored(joined.mapInArrow(run, f"ids {kind}, held array<boolean>, lengths array<int>, tokens binary, words binary, pairs binary"), "lm-counted")


def context_counts(word: np.ndarray, train_docs: int) -> np.ndarray:
    """How often each word stands before another in the training texts: always, but for the end token, which never does."""
    out = np.append(word, train_docs)
    out[0] = 0
    return out


def klass(counts: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: 0 if unseen, else 1 + floor(log2)."""
    return np.where(counts > 0, np.minimum(CLASSES - 1, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)), 0)


def fit(cells: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) by class from binned log-ratios of the estimates to the uniform one."""
    weights = np.full((CLASSES, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0)
    by = {}
    for k, u, b, n in cells:
        by.setdefault(k, []).append((u, b, n))
    for k, rows in by.items():
        u, b, n = (np.array(x, float) for x in zip(*rows, strict=True))
        ratio = np.stack([np.ones_like(u), np.where(u > -NONE, np.exp(u * STEP), 0), np.where(b > -NONE, np.exp(b * STEP), 0)], axis=1)
        w = weights[k].copy()
        for _ in range(ROUNDS):
            mixed = ratio * w
            new = ((mixed / mixed.sum(axis=1, keepdims=True)) * n[:, None]).sum(axis=0) / n.sum()
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-7:
                break
        weights[k] = w
    # No event is impossible, whatever the held-out counts show.
    weights = np.maximum(weights, [1e-6, 1e-9, 0])
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the interpolated model), log10."""
    chunks = chunked(docs, id_col, text_col, folds, held, chunk)
    total = chunks.select(F.sum("n").alias("n"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs"), F.count(F.lit(1)).alias("chunks")).first()
    tokens, train_docs = int(total["n"] or 0), int(total["docs"] or 0)
    buckets = max(1, math.ceil(tokens / BUCKET_KEYS))
    replies = answers(requests(chunks, buckets), total["chunks"])
    n_train, n_vocabulary = (int(x or 0) for x in replies.where("chunk is null").agg(F.sum("total"), F.sum("known")).first())
    uniform = 1 / (n_vocabulary + 1)
    full = counted(chunks, replies, buckets)

    def opened(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
        c = Chunk(row)
        word, pair = unpack(row["words"], "<i8"), unpack(row["pairs"], "<i8")
        return c, word, pair, context_counts(word, train_docs)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c, word, pair, context = opened(row)
            own = c.train_pairs()
            seen = np.flatnonzero(own)
            ctx = context[c.pair_first[seen]]
            k = klass(ctx - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                u = np.log((word[c.pair_second[seen]] - 1) / max(n_train - 1, 1) / uniform)
                bi = np.log((pair[seen] - 1) / (ctx - 1) / uniform)
            bin_ = lambda x: np.where(np.isfinite(x), np.clip(np.round(np.nan_to_num(x, neginf=0.0, posinf=0.0) / STEP), -NONE + 1, NONE - 1), -NONE).astype(np.int64) + NONE
            cell, of = distinct((k * 2 * NONE + bin_(u)) * 2 * NONE + bin_(bi))
            n = np.bincount(of, weights=own[seen])
            yield pa.RecordBatch.from_arrays([pa.array(cell // (4 * NONE * NONE)), pa.array(cell // (2 * NONE) % (2 * NONE) - NONE), pa.array(cell % (2 * NONE) - NONE), pa.array(n, pa.float64())], names=["k", "u", "b", "n"])

    # One row a cell of (class, two log-ratio bins): a fixed number, however large the corpus.
    cells = full.drop("ids").mapInArrow(held_out, "k long, u long, b long, n double").groupBy("k", "u", "b").agg(F.sum("n").alias("n")).collect()
    weights = fit([tuple(r) for r in cells])

    kind = dict(docs.select(id_col).dtypes)[id_col]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, light = b.column("ids"), b.drop_columns(["ids"])
            for at, row in enumerate(rows_of([light])):
                c, word, pair, context = opened(row)
                ctx = context[c.pair_first]
                w = weights[klass(ctx)]
                p = w[:, 0] * uniform + w[:, 1] * word[c.pair_second] / max(n_train, 1) + w[:, 2] * pair / np.maximum(ctx, 1)
                base = np.log10((word + 1) / (n_train + n_vocabulary + 1))
                by_doc = lambda x, c=c: np.bincount(c.doc, weights=x, minlength=len(c.lengths))
                out = [ids[at].values, c.held, c.lengths, by_doc((word > 0)[c.tokens]).astype(np.int64), np.full(len(c.lengths), n_train), by_doc(base[c.tokens]), by_doc(np.log10(p)[c.pair_of])]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return full.mapInArrow(scores, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
