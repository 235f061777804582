"""Exact dedup by a tree merge of sorted digest runs.

Every text, without its ASCII white space, becomes a digest. Each input
partition is a run: its digests sorted, equal ones merged. Runs meet in rounds
of a tree whose node joins 2**fan_bits of them: a round sorts and merges, by
digest, the runs whose numbers agree but for their lowest bits, and keeps of
equal digests the row that stays and the number of rows. So a digest that a
third of all rows share is one entry a run before it moves, and a merge never
holds more of it than the fan of the tree. The answers go back down the same
tree: each round tells the runs below what became of their digests, so again no
key meets more than one fan of rows (at the leaves: those of one fan of input
partitions).

An entry is told apart by SHA-256 and verified by the byte length and a second
hash of the same text: rows that agree in one and not in the others never merge.

Defined cases: a null text is empty text, and all empty texts are one group;
of equal texts the one with most code points stays, then the smallest id, nulls
last; of rows that share their id and text exactly one stays; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, stored

#: Runs that meet in one merge, as a power of two.
FAN_BITS = 4
#: What makes texts equal: the digest, and the two that verify it.
KEY = ("_digest", "_bytes", "_check")


def bare(text: Column) -> Column:
    """The text without ASCII white space."""
    for space in " \t\n\v\f\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digested(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One light row a document, with its run (the input partition) and its row number; stored, as every round's tree ends at them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.char_length(text).alias("_chars"), bare(text).alias("_bare"))
    rows = rows.select("_id", *[f"_keep_{c}" for c in keep], "_chars", F.unhex(F.sha2(F.col("_bare").cast("binary"), 256)).alias("_digest"), F.octet_length("_bare").alias("_bytes"), F.xxhash64("_bare").alias("_check"))
    return stored(rows.withColumns({"_run": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "exact-rows")


def merged(entries: DataFrame, fan_bits: int) -> DataFrame:
    """One round: the runs of each node of the tree as one run."""
    up = F.shiftright("_run", fan_bits).alias("_run")
    return stored(entries.groupBy(up, *KEY).agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n")), "exact-run")


def told(below: DataFrame, answers: DataFrame, fan_bits: int) -> DataFrame:
    """below with the answer (_best, _n) that the run above has for its digest."""
    above = answers.select(F.col("_run").alias("_up"), *[F.col(k).alias(f"{k}_up") for k in KEY], "_best", "_n")
    same = (F.shiftright("_run", fan_bits) == F.col("_up")) & (F.col(KEY[0]) == F.col(f"{KEY[0]}_up"))
    for k in KEY[1:]:
        same &= F.col(k) == F.col(f"{k}_up")
    return below.join(above, same).drop("_up", *[f"{k}_up" for k in KEY])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, keep_id (of the row that stays), group_size, kept, text_sha256; and the columns of keep."""
    rows = digested(docs, id_col, text_col, keep)
    best = F.struct((-F.col("_chars")).alias("short"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    runs = rows.select("_run", *KEY, best.alias("_best"), F.lit(1).cast("long").alias("_n"))
    last = rows.agg(F.max("_run").alias("last")).first()["last"] or 0
    levels = [merged(runs, fan_bits)]
    while last >> fan_bits:
        last >>= fan_bits
        levels.append(merged(levels[-1], fan_bits))
    answers = levels.pop()
    while levels:
        answers = stored(told(levels.pop().select("_run", *KEY), answers, fan_bits), "exact-answers")
    out = told(rows, answers, fan_bits)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_best.row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS) -> DataFrame:
    """docs without the rows that equal another which stays; ids need not be unique. The rows that go are joined by a stored row number."""
    rows, named = set_aside(docs, (id_col, text_col))
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "exact-docs")
    gone = duplicates(rows, id_col, text_col, fan_bits, keep=("__row",)).where(~F.col("kept")).select("__row")
    return named(rows.join(gone, "__row", "left_anti"))
