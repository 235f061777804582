"""Quality rules: base counts of words, symbols and repeats, and tokeniser fertility.

Two public vocabularies measure each whole text: characters per token under both
(PIECES with byte fallback, MULTI of bytes), the share of byte-fallback tokens
and the mean entropy of the tokens over blocks of BLOCK. Bands for each measure
come from all rows: for each language, and for each script, the median and
FENCE times its distance to the quartiles, never narrower than FLOOR. Texts
count once however often they repeat, so a group of copies moves no band. A
text takes the band of its language, where that has LEAST_TEXTS texts or more,
else that of its script, else WIDE; one outside any of its bands is rejected.

Defined cases: a null or empty text has no words and fails the base rules; a
null or rare language takes the band of the script of most letters of the whole
text (ties in the order of the alphabet, OTHER where there is no letter);
ties, repeated rows and further columns change nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, set_aside, slices, stored, text_batches

PIECES, MULTI = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 0.5
#: Words that a task numbers before it starts anew.
MEMO = 100_000
#: Characters of a text that go to a vocabulary at once: cuts are at white space, which no token spans.
CUT = 1 << 15
#: Tokens of a block of the entropy.
BLOCK = 128
#: Below this many distinct words a window of three fits one 64-bit number.
PACKED = 1 << 21
#: Ids of the byte-fallback tokens of PIECES; the one of a line feed is white space, and counts as none.
BYTES, LINE_FEED = (3, 258), 13
MEASURES = ("chars_per_token", "chars_per_token_multi", "fallback_share", "entropy")
#: Distinct texts that a language or script needs for bands of its own.
LEAST_TEXTS = 100
#: Distances from the median to a quartile that a band reaches, and how far it reaches at least.
FENCE = 8.0
FLOOR = {"chars_per_token": 0.15, "chars_per_token_multi": 0.15, "fallback_share": 0.02, "entropy": 0.25}
#: Bands of texts whose script is as rare as their language.
WIDE = {"chars_per_token": (0.2, 12.0), "chars_per_token_multi": (0.2, 12.0), "fallback_share": (0.0, 1.0), "entropy": (2.0, 16.0)}


class Words(dict):
    """Words (bytes) numbered in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=1 << 16)
def script_of(char: str) -> str:
    """The first word of a letter's Unicode name, which for letters of scripts is the script; empty for other characters."""
    return unicodedata.name(char, "OTHER").partition(" ")[0] if char.isalpha() else ""


def main_script(text: str) -> str:
    """The script of most letters of the text."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else "OTHER"
    counts: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if script := script_of(char):
            counts[script] += n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "OTHER"


#: Where a text can be cut: before white space behind anything else, a place that no token of either vocabulary spans.
CUT_AT = re.compile(r"(?<=\S)(?: (?!\Z)|[\t\n\x0b\x0c])")


def cuts(text: str, most: int = CUT) -> Iterator[str]:
    """The text in parts of at least ``most`` characters, each but the first with the white space before it; a run without white space is never cut."""
    at = 0
    while at < len(text):
        found = CUT_AT.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def block_entropy(tokens: np.ndarray, block: int = BLOCK) -> float:
    """The mean entropy, in bits, of the tokens of equal blocks of at least ``block`` (or all there are)."""
    n = len(tokens)
    k = max(1, n // block)
    key = np.sort((np.arange(n, dtype=np.int64) * k // n << 32) | tokens)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, n))
    of = key[starts] >> 32
    p = counts / np.bincount(of, weights=counts)[of]
    return float(-(p * np.log2(p)).sum() / k)


class Meter:
    """Measures texts with both vocabularies."""

    def __init__(self, pieces: str, multi: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(multi, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.number = Words()

    def measure(self, text: str) -> tuple:
        raw = text.encode()
        words = raw.split()  # bytes know ASCII white space only
        if len(self.number) > MEMO:
            self.number = Words()
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        symbols = sum(text.count(c) for c in SYMBOLS)
        return (len(words), chars, symbols, repeated_lines(raw), repeated_words(ids), *self.fertility(text, chars), main_script(text))

    def fertility(self, text: str, chars: int) -> tuple[float, ...]:
        if not chars:
            return (0.0,) * len(MEASURES)
        tokens, n = [], 0
        for k, part in enumerate(cuts(text)):
            # The library puts a space before each text itself: the part's own goes, or the one put before another sign.
            own = k and part[0] == " "
            found = self.pieces.encode(part[1:] if own else part, num_threads=1)
            tokens.append(np.array(found[1:] if k and not own else found, np.int64))
            n += len(self.multi.encode_ordinary(part))
        ids = np.concatenate(tokens)
        low, high = BYTES
        fallback = (ids >= low) & (ids <= high) & (ids != LINE_FEED)
        return chars / max(len(ids), 1), chars / max(n, 1), float(fallback.mean()) if len(ids) else 0.0, block_entropy(ids) if len(ids) else 0.0


def repeated_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of three that the text holds twice or more."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < PACKED:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1].astype(np.int64)
        key = (pairs[:-1] << 32) | ids[2:]
    order = np.argsort(key)
    line = key[order]
    same = line[1:] == line[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measures(docs: DataFrame, text_col: str = "text", pieces: str | None = None, multi: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, the base counts, the fertility measures and the main script of each row."""
    paths = (pieces or public_tokenizers.path(PIECES), multi or public_tokenizers.path(MULTI))
    rows = text_batches(docs).select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES, "script")
    types = [pa.int64()] * 5 + [pa.float64()] * len(MEASURES) + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = once("\n".join(paths), lambda: Meter(*paths))
        for b in slices(batches):
            found = [meter.measure(t.as_py() or "") for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([r[k] for r in found], t) for k, t in enumerate(types)]], names=[*keep, *names])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{n} {'long' if k < 5 else 'string' if n == 'script' else 'double'}" for k, n in enumerate(names)])
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def bands(measured: DataFrame, key: str, fence: float = FENCE, floor: dict[str, float] = FLOOR, least: int = LEAST_TEXTS) -> DataFrame:
    """One row for each value of key that has enough texts: key, and bands (a struct of low and high for each measure).

    The quartiles are bounded sketches over all texts that pass the base rules,
    each set of measures counted once.
    """
    texts = measured.where(~base_failed() & F.col(key).isNotNull()).select(key, *MEASURES).distinct()
    by = texts.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]).where(F.col("_n") >= least)

    def band(m: str) -> Column:
        q1, q2, q3 = (F.col(m)[k] for k in range(3))
        return F.struct((q2 - F.greatest(fence * (q2 - q1), F.lit(floor[m]))).alias("low"), (q2 + F.greatest(fence * (q3 - q2), F.lit(floor[m]))).alias("high")).alias(m)

    return stored(by.select("_key", F.struct(*[band(m) for m in MEASURES]).alias("_bands")), "bands")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",), fence: float = FENCE, floor: dict[str, float] = FLOOR, least: int = LEAST_TEXTS, **options) -> DataFrame:
    """The columns of keep, the base counts, the measures, base_failed and kept. Texts are measured once and stored: bands and verdicts both read that."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    measured = stored(measures(docs.withColumn("_lang", lang.cast("string")), text_col, keep=(*keep, "_lang"), **options), "measures")
    found = measured
    for key, name in (("_lang", "_by_lang"), ("script", "_by_script")):
        own = bands(measured, key, fence, floor, least).select(F.col("_key").alias(f"{name}_key"), F.col("_bands").alias(name))
        found = found.join(own, F.col(key) == F.col(f"{name}_key"), "left")
    wide = F.struct(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")).alias(m) for m, (low, high) in WIDE.items()])
    band = F.coalesce("_by_lang", "_by_script", wide)
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(band[m]["low"], band[m]["high"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).select(*keep, *counts, *MEASURES, "script", "base_failed", "kept")


def filter_docs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that are kept, all columns unchanged, whatever the names of those that are not read."""
    rows, named = set_aside(docs, (text_col, lang_col))
    return named(judge(rows, text_col, lang_col, keep=tuple(rows.columns), **options).where("kept"))
