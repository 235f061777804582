"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees on seeded samples give conjunctive rules (their paths) over the
statistics of a text; a lasso logistic fit keeps a few of them with weights.
The kept rules compile to Spark column expressions, which score all rows. The
fit uses at most TRAIN_ROWS labelled rows, those of the lowest hashes.

Defined cases: a null or empty text has statistics 0 and is scored like any
other; a null id counts as empty text in the split; null labels are not learned
from; with labels of one class only, or none, the score is the smoothed share
of good labels; repeated rows and ties change nothing; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_crc, set_aside, slices, stored, text_batches
from .quality_rules import Words, repeated_lines, repeated_words

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 20_000
FOLDS, HELD = 4, 2
TREES, DEPTH, CUTS, LEAST_LEAF = 40, 3, 24, 5
LASSO = 0.001
SEED = 11
STATISTICS = ("n_words", "word_chars_mean", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share", "bang_share", "distinct_share", "top_share", "same_next_share", "repeat_share", "dup_line_share", "words_per_line", "short_line_share")
MEMO = 100_000
#: Hash values that rows are sampled by.
SPREAD = 1 << 50

_CODES = np.arange(256)
UPPER = (_CODES >= 65) & (_CODES <= 90)
LETTER = UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
DIGIT = (_CODES >= 48) & (_CODES <= 57)
SPACE = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
MARK = ~(LETTER | DIGIT | SPACE)
SYMBOL = np.isin(_CODES, np.frombuffer(b"#*$%&<>", np.uint8))


def statistics(text: str, number: Words) -> tuple[float, ...]:
    """STATISTICS of a text; letters of the shares of case are ASCII."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    line = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]])))
    chars = len(raw) - int(codes[SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(codes[65:91].sum() + codes[97:123].sum())
    return (
        float(n), chars / n, int(codes[UPPER].sum()) / max(letters, 1), int(codes[DIGIT].sum()) / chars, int(codes[MARK].sum()) / chars,
        int(codes[SYMBOL].sum()) / chars, int(codes[124]) / n, int(codes[33]) / n, len(counts) / n, int(counts.max()) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeated_words(ids) / n, repeated_lines(raw) / len(lines), n / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and STATISTICS of each row."""
    rows = text_batches(docs).select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Words()
        for b in slices(batches):
            found = []
            for t in b.column("_text"):
                found.append(statistics(t.as_py() or "", number))
                if len(number) > MEMO:
                    number = Words()
            grid = np.array(found, np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(grid[:, k]) for k in range(len(STATISTICS))]], names=[*keep, *STATISTICS])

    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{s} double" for s in STATISTICS]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.parts:
            out &= x[:, k] > t if above else x[:, k] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.parts:
            c = F.col(STATISTICS[k])
            out = out & (c > F.lit(t) if above else c <= F.lit(t))
        return out


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: tuple = (), depth: int = DEPTH) -> list[Rule]:
    """The paths of one tree: at each node the best split by Gini among a random half of the statistics."""
    found = [Rule(tuple(sorted(path)))] if path else []
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return found
    best, split = 0.0, None
    base = len(y) * y.mean() * (1 - y.mean())
    for k in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        for t in cuts[k]:
            right = x[:, k] > t
            n = int(right.sum())
            if LEAST_LEAF <= n <= len(y) - LEAST_LEAF:
                a, b = y[right].mean(), y[~right].mean()
                gain = base - n * a * (1 - a) - (len(y) - n) * b * (1 - b)
                if gain > best + 1e-9:
                    best, split = gain, (int(k), float(t), right)
    if split:
        k, t, right = split
        for above, part in ((True, right), (False, ~right)):
            found += grow(x[part], y[part], cuts, rng, (*path, (k, above, t)), depth - 1)
    return found


def lasso(r: np.ndarray, y: np.ndarray, strength: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    w, v, b, c, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    step = 4 / max(1.0, float((r.sum(axis=1) + 1).max()))
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(r @ v + c, -40, 40))) - y) / n
        new = v - step * (r.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        nb = c - step * e.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the kept rules with their weights."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1], method="midpoint")) for k in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        part = rng.choice(len(y), min(len(y), 4000), replace=False)
        rules |= dict.fromkeys(grow(x[part], y[part], cuts, rng))
    grid = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    seen: dict[bytes, int] = {}
    for k in range(grid.shape[1]):  # rules that hold on the same rows are one
        seen.setdefault(np.packbits(grid[:, k]).tobytes(), k)
    keep = sorted(seen.values())
    b, w = lasso(grid[:, keep].astype(np.float64), y)
    names = list(rules)
    return b, [(names[k], float(v)) for k, v in zip(keep, w, strict=True) if abs(v) > 1e-6]


def score_column(b: float, rules: list[tuple[Rule, float]]) -> Column:
    """The fitted model as one column expression over STATISTICS."""
    z = F.lit(b)
    for rule, w in rules:
        z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of keep, held_out, score, predicted. Labels of held-out rows are never read."""
    keep = keep or (id_col,)
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_y")).where(F.col("_y").isNotNull() & (fold_crc(F.col(id_col), FOLDS) != HELD)).distinct()
    # A share of the hashes that leaves a little more than train_rows, of which the lowest stay: no task sends more than it must.
    spare = min(1.0, 1.2 * train_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(SPREAD)) < int(spare * SPREAD))
    # About 1.2 * train_rows rows whatever the number of labels: Catalyst sees the stored size and broadcasts it or not.
    known = stored(known, "labelled")
    own = docs.select(*dict.fromkeys((*keep, text_col)))
    light = keep == (id_col,)
    # The statistics of all rows serve both the fit and the scores where they are all that is kept of a row.
    stats = stored(with_statistics(own, text_col, keep), "statistics") if light else with_statistics(own.join(known, id_col, "left_semi"), text_col, (id_col,))
    sample = stats.join(known, id_col).orderBy(F.pmod(F.xxhash64(id_col), F.lit(SPREAD)), *STATISTICS).limit(train_rows).select(*STATISTICS, "_y").toPandas().to_numpy(np.float64).reshape(-1, len(STATISTICS) + 1)
    b, rules = fit(sample[:, :-1], sample[:, -1])
    scored = stats if light else with_statistics(own, text_col, keep)
    return scored.withColumn("held_out", fold_crc(F.col(id_col), FOLDS) == HELD).withColumn("score", score_column(b, rules)).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*keep, "held_out", "score", "predicted")


def filter_docs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are predicted good, all columns unchanged, whatever the names of those that are not read."""
    rows, named = set_aside(docs, (id_col, text_col))
    return named(classify(rows, labels, id_col, text_col, keep=tuple(rows.columns), **options).where("predicted = 1"))
