"""BPE encoding and decoding by tree concatenation.

A text up to PIECE characters is encoded by the tokenizers library, word by
word with a memo. A longer one is halved until its parts are that short; the
parts spread over tasks, one row a piece, are encoded apart (halved again to
LEAF characters), and each join is then repaired: a window around it is encoded
anew and grown until its tokens meet the left part's on one side and the right
part's on the other. Sides meet in a token of the same id over the same characters that
both sides place alike; as neighbouring tokens decide whether a sequence is the
encoding of its text, tokens beyond such a meeting stay valid. A window that
reaches both ends is the plain encoding.

Defined cases: a null or empty text has no tokens; null or repeated ids and
ties are rows like any other; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import once, slices, stored, text_batches

VOCABULARY = "word_bpe_49k.json"
LEAF = 1 << 13
PIECE = 1 << 15
WINDOW = 64
#: Words that a task remembers the tokens of.
MEMO = 60_000

SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Marks that end a word; none starts a contraction or a special token.
CLOSING = ",.;:!?#%$&*|)"


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write bytes 0xA1-0xAC and 0xAE-0xFF as themselves, 0x7F-0xA0 and 0xAD in order from U+0121."""
    apart = [*range(0x7F, 0xA1), 0xAD]
    return {b: 0x121 + k for k, b in enumerate(apart)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """One vocabulary with its token strings, and the tokens of words seen before."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [self.tokenizer.id_to_token(k) or "" for k in range(n)]
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}

    def plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their (start, end) characters."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.array(got.offsets, np.int64).reshape(-1, 2)

    def whole(self, text: str) -> bytes:
        """Ids (little-endian bytes) of a text, each word looked up: no token spans ASCII white space."""
        words, memo = SPACE.sub(" ", text).split(" "), self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        slow = []
        for w in words:
            if w not in memo:
                ids = self.simple(w)
                if ids is None:
                    slow.append(w)
                else:
                    memo[w] = ids
        if slow:
            slow = list(dict.fromkeys(slow))
            for w, got in zip(slow, self.tokenizer.encode_batch(slow, add_special_tokens=False), strict=True):
                memo[w] = array("I", got.ids).tobytes()
        return b"".join([memo[w] for w in words])

    def simple(self, word: str) -> bytes | None:
        """Ids of Latin letters with closing marks behind them; None for any other word.

        There the normalizer only lower-cases and the letters and the marks are
        one pre-token each, so the model itself is all that is left to run.
        """
        core = word.rstrip(CLOSING)
        if not core.isalpha() or max(core) >= "\u0250":
            return None
        if not core.isascii() and not (core.lower().isalpha() and unicodedata.is_normalized("NFC", core)):
            return None
        out = self.memo.get(core) if len(core) < len(word) else None
        if out is None:
            low = core.lower()
            if not core.isascii():
                low = low.encode().decode("latin-1").translate(BYTE_LETTERS)
            out = array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
            if len(core) < len(word):
                self.memo[core] = out
        if len(core) == len(word):
            return out
        marks = word[len(core) :]
        if marks not in self.memo:
            self.memo[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        return out + self.memo[marks]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder: the token strings, a space between."""
        s = self.strings
        return " ".join([s[k] for k in ids.tolist()])

    def encode(self, text: str, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Tree concatenation of one text."""
        if len(text) <= leaf:
            return self.plain(text)
        mid = len(text) // 2
        left, right = self.encode(text[:mid], leaf), self.encode(text[mid:], leaf)
        return self.join(text, mid, left, (right[0], right[1] + mid))

    def join(self, text: str, at: int, left: tuple, right: tuple, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of text from those of text[:at] and text[at:] (offsets of the whole text)."""
        (li, lo), (ri, ro) = left, right
        while True:
            i = int(np.searchsorted(lo[:, 0], at - window)) if at > window else 0
            j = int(np.searchsorted(ro[:, 1], at + window, "right")) if at + window < len(text) else len(ri)
            start = int(lo[i, 0]) if i and i < len(lo) else (0 if not i else at)
            end = int(ro[j - 1, 1]) if j and j < len(ri) else (len(text) if j == len(ri) else at)
            mi, mo = self.plain(text[start:end])
            mo = mo + start
            # Beyond the window's ends nothing is repaired, so a side whose end it reaches needs no meeting.
            p = (0, 0) if i == 0 else self.meet(li[i:], lo[i:], mi, mo, at, first=True)
            q = (len(mi), len(ri)) if j == len(ri) else self.meet(ri[:j], ro[:j], mi, mo, at, first=False)
            if p is not None and q is not None:
                a, b = p
                c, d = q
                keep = i + a if i else 0
                if b <= c:
                    return np.concatenate([li[:keep], mi[b:c], ri[d:]]), np.concatenate([lo[:keep], mo[b:c], ro[d:]])
            if i == 0 and j == len(ri):
                return mi, mo
            window *= 2

    @staticmethod
    def meet(side: np.ndarray, spans: np.ndarray, ids: np.ndarray, own: np.ndarray, at: int, first: bool) -> tuple[int, int] | None:
        """Where the window's tokens and a side's are the same two tokens in a row.

        first: the left side; gives (tokens kept of side, first token of the window
        after them). Else the right side: (end of the window's tokens, first token kept of side).
        """
        if len(ids) < 2 or len(side) < 2:
            return None
        tokens = lambda i, s: list(zip(i.tolist(), s[:, 0].tolist(), s[:, 1].tolist(), strict=True))
        a, b = tokens(side, spans), tokens(ids, own)
        # Two tokens that share a character (parts of one) say too little of where a token starts.
        clear = lambda x, k: x[k][2] <= x[k + 1][1]
        at_b = {x: k for k, x in enumerate(b)}
        ks = range(len(a) - 1) if first else range(len(a) - 2, -1, -1)
        for k in ks:
            m = at_b.get(a[k])
            if m is not None and m + 1 < len(b) and a[k + 1] == b[m + 1] and clear(a, k) and (a[k + 1][2] <= at if first else a[k][1] >= at):
                return (k + 1, m + 1) if first else (m + 1, k + 1)
        return None


def pieces(text: str, most: int) -> list[str]:
    """Cuts of at most ``most`` characters, by halving."""
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    return pieces(text[:mid], most) + pieces(text[mid:], most)


def joined(encoder: Encoder, texts: list[str], parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours joined pair by pair, as the leaves of a tree; parts have offsets of their own."""
    while len(texts) > 1:
        new_texts, new_parts = [], []
        for k in range(0, len(texts) - 1, 2):
            whole, at = texts[k] + texts[k + 1], len(texts[k])
            right = parts[k + 1]
            new_texts.append(whole)
            new_parts.append(encoder.join(whole, at, parts[k], (right[0], right[1] + at)))
        if len(texts) % 2:
            new_texts.append(texts[-1])
            new_parts.append(parts[-1])
        texts, parts = new_texts, new_parts
    return parts[0]


def digests(encoder: Encoder, ids: bytes) -> tuple[int, str, str]:
    decoded = encoder.decode(np.frombuffer(ids, "<u4"))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF, piece: int = PIECE, keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids (array of int).

    Texts up to ``piece`` characters finish where they are read. Longer ones are cut
    into pieces, dealt over all tasks, and joined again by row.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = text_batches(docs).select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    out = "k {}, n_tokens long, ids_sha256 string, decoded_sha256 string{}".format(kind, ", ids array<int>" if keep_ids else "")
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def finish(encoder: Encoder, keys, found: list[bytes]) -> pa.RecordBatch:
        rows = [digests(encoder, ids) for ids in found]
        columns = [keys, *[pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string()))]]
        if keep_ids:
            columns.append(pa.array([np.frombuffer(ids, "<i4") for ids in found], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(path, lambda: Encoder(path))
        for batch in slices(batches):
            found = [encoder.whole(text.as_py()) for text in batch.column("t")]
            yield finish(encoder, batch.column("k"), found)

    done = rows.where(F.char_length("t") <= piece).mapInArrow(short, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row, text in zip(batch.column("k").to_pylist(), batch.column("row").to_pylist(), batch.column("t").to_pylist(), strict=True):
                cuts = pieces(text, piece)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cuts), batch.schema.field("k").type), pa.array([row] * len(cuts), pa.string()), pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.string())], names=["k", "row", "no", "t"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(path, lambda: Encoder(path))
        for batch in slices(batches, 32):
            parts = [encoder.encode(text, leaf) for text in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k", "row", "no", "t")], pa.array([i.astype("<u4").tobytes() for i, _ in parts], pa.binary()), pa.array([o.astype("<i4").tobytes() for _, o in parts], pa.binary())], names=["k", "row", "no", "t", "i", "o"])

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        encoder = once(path, lambda: Encoder(path))
        group = group.sort_values("no")
        parts = [(np.frombuffer(i, "<u4"), np.frombuffer(o, "<i4").astype(np.int64).reshape(-1, 2)) for i, o in zip(group["i"], group["o"], strict=True)]
        ids = joined(encoder, list(group["t"]), parts)[0].astype("<u4").tobytes()
        row = [group["k"].iloc[0], *digests(encoder, ids)]
        return pd.DataFrame([row + [np.frombuffer(ids, "<i4")] * keep_ids], columns=names)

    # A stored row id keeps rows of equal ids apart.
    long = rows.where(F.char_length("t") > piece).withColumn("row", F.expr("uuid()"))
    long = stored(long.mapInArrow(cut, f"k {kind}, row string, no int, t string"), "bpe-pieces")
    spread = long.repartition("row", "no").mapInArrow(leaves, f"k {kind}, row string, no int, t string, i binary, o binary")
    # tree() gets the pieces of one text, which make one row of the result.
    return done.unionByName(spread.groupBy("row").applyInPandas(tree, out)).withColumnRenamed("k", id_col)
