"""Mixing sources to target weights by Sainte-Lague apportionment.

The plan has three levels, all of them DataFrame operations. Sources get word
targets by weight (water-filling below a repeat cap). Equal-word blocks go to
sources by highest quotients, then to the shards of a source by the same rule.
Inside a shard the documents stand in a seeded order as one stream of words; a
shard takes whole passes over its stream and then the run of blocks that
starts at a seeded block.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, last in order; repeated rows are rows like any
other; an empty table gives an empty plan; further columns of the input travel
along untouched (in plan_mix with keep_text the names in RESERVED must be free;
apply_mix takes any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, set_aside, stored

RESERVED = ("size", "source_size", "target", "taken", "full_copies", "part_from", "part_to", "wrap_from", "wrap_to")
#: Blocks that a small mix is divided into, and the words that a block has at most: a shard of thousands of documents holds many.
BLOCKS, BLOCK_WORDS = 1 << 20, 4096


def seats(frame: DataFrame, votes: str, total: Column, n: Column, parties: Column, order: list[Column], group: list[str], most: Column, out: str) -> DataFrame:
    """Sainte-Lague: column out has each row's seats of the n that its group gives out.

    Any divisor that gives at most n seats in sum yields a prefix of the order by
    quotient, so only about two candidates a party are ever ranked: the seats up
    to the divisor total/(n - parties/2) are certain, those beyond
    total/(n + parties/2) are out of reach. Ties go by ``order``.
    """
    share = lambda shift: F.when(total > 0, F.col(votes) * (n + shift) / total).otherwise(0.0)
    low = F.least(most, F.greatest(F.lit(0), F.ceil(share(-parties / 2) - 0.5))).cast("long")
    high = F.least(most, F.greatest(F.lit(0), F.ceil(share(parties / 2) + 0.5))).cast("long")
    w = Window.partitionBy(*group)
    base = frame.withColumn("_base", low).withColumn("_high", high).withColumn("_left", (n - F.sum("_base").over(w)).cast("long"))
    tries = base.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_base"), F.sequence(F.col("_base") + 1, F.col("_high")))))
    tries = tries.withColumn("_rank", F.row_number().over(w.orderBy((F.col(votes) / (2 * F.col("_seat") - 1)).desc_nulls_last(), *order, F.col("_seat"))))
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left"))).cast("long")
    keys = frame.columns
    return tries.groupBy(*keys).agg((F.first("_base") + F.sum(won)).alias(out))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row a source: source, source_size, source_docs, target, and the order rank _no.

    Windows without a key run over this table only: one row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    whole = Window.partitionBy()
    out = by.withColumn("_no", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(w) for w in weights])
    out = out.withColumn("_w", F.element_at(cycle, ((F.col("_no") - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", cap * F.col("source_size")).withColumn("_all", F.sum("source_size").over(whole))
    # Sources that fill first stand first; the water level is the highest that any prefix of full sources leaves.
    filling = whole.orderBy(F.col("_cap") / F.col("_w"), F.col("_no"))
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", (F.col("_all") * share - before) / rest).withColumn("_level", F.max("_level").over(whole))
    return out.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level"))).drop("_w", "_level")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: int = 17, shard_docs: int = 10_000, keep_text: bool = False) -> DataFrame:
    """Per row: size, source_size, target, taken, and what to take: full copies and word ranges [from, to).

    With keep_text all input columns stay; else only the id and the source. Sizes
    are counted once and stored, as three aggregates read them.
    """
    # Rows without an id are dealt by their texts: they can be many, and would else be one shard.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\0"), F.xxhash64(text_col).cast("string")))).cast("binary"))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    if keep_text:
        sized = docs.withColumn("size", size)
        light = stored(sized.select(F.col(source_col).alias("source"), "size", key.alias("_key")), "mix-sizes")
    else:
        sized = light = stored(docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), key.alias("_key"), F.xxhash64(text_col).alias("_hash")), "mix-sizes")
    by_source = targets(light, weights, share, cap)
    whole = Window.partitionBy()
    by_source = by_source.withColumn("_block", F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.col("_all") * share / BLOCKS)))).withColumn("_sources", F.count(F.lit(1)).over(whole)).withColumn("_total", F.sum("target").over(whole))
    n = F.floor(F.col("_all") * share / F.col("_block"))
    by_source = seats(by_source, "target", F.col("_total"), n, F.col("_sources"), [F.col("_no")], [], F.floor(F.col("_cap") / F.col("_block")), "_blocks")
    by_source = by_source.withColumn("_shards", F.floor((F.col("source_docs") - 1) / shard_docs) + 1)
    by_source = stored(by_source.select("source", "source_size", "target", "_block", "_blocks", "_shards"), "mix-sources")

    shard = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards")
    s = by_source.withColumnRenamed("source", "_source")

    def sharded(rows: DataFrame, source: str) -> DataFrame:
        return rows.join(s, rows[source].eqNullSafe(s["_source"])).withColumn("_shard", shard)

    shards = sharded(light, "source").groupBy("_source", "_shard", "source_size", "_block", "_blocks").agg(F.sum("size").alias("_shard_size"))
    w = Window.partitionBy("_source")
    shards = shards.withColumn("_in_source", F.count(F.lit(1)).over(w))
    shards = seats(shards, "_shard_size", F.col("source_size"), F.col("_blocks"), F.col("_in_source"), [F.col("_shard")], ["_source"], F.floor(cap * F.col("_shard_size") / F.col("_block")) + 1, "_quota")
    quota = F.least(F.col("_quota") * F.col("_block"), cap * F.col("_shard_size"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")), F.lit(":"), F.col("_shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    shards = stored(shards.select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_shard_size", quota.alias("_words"), (start % F.greatest(F.lit(1), F.floor(F.col("_shard_size") / F.col("_block"))) * F.col("_block")).alias("_start")), "mix-shards")

    rows = sharded(sized.withColumns({"_key": key, "_hash": F.xxhash64(text_col)}) if keep_text else sized, source_col if keep_text else "source")
    rows = rows.join(shards, rows["_source"].eqNullSafe(shards["_s"]) & (rows["_shard"] == shards["_h"]))
    stream = Window.partitionBy("_source", "_shard").orderBy("_key", id_col, "size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum("size").over(stream)).withColumn("_from", F.col("_to") - F.col("size"))
    passes = F.when(F.col("_shard_size") > 0, F.expr("_words div _shard_size")).otherwise(0)
    rest = F.when(F.col("_shard_size") > 0, F.col("_words") % F.col("_shard_size")).otherwise(0)

    def within(shift: Column | int) -> tuple[Column, Column]:
        low = F.least(F.greatest(F.col("_start") - shift - F.col("_from"), F.lit(0)), F.col("size"))
        high = F.least(F.greatest(F.col("_start") - shift + rest - F.col("_from"), F.lit(0)), F.col("size"))
        return low, F.greatest(low, high)

    (part_from, part_to), (wrap_from, wrap_to) = within(F.lit(0)), within(F.col("_shard_size"))
    rows = rows.withColumn("full_copies", passes.cast("long")).withColumns({"part_from": part_from, "part_to": part_to, "wrap_from": wrap_from, "wrap_to": wrap_to})
    taken = F.col("full_copies") * F.col("size") + F.col("part_to") - F.col("part_from") + F.col("wrap_to") - F.col("wrap_from")
    kept = docs.columns if keep_text else [id_col, "source"]
    return rows.withColumn("taken", taken.cast("long")).select(*kept, *RESERVED)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows themselves, with the columns of docs: each full copy, then each partly taken copy cut to its word range.

    n_chars follows the cut text; columns that are not read may have any name.
    """
    docs, named = set_aside(docs, (id_col, text_col, source_col, "n_chars"))
    plan = plan_mix(docs, id_col, text_col, source_col, keep_text=True, **options)
    text = text_col
    ranges = F.concat(
        F.when(F.col("full_copies") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b"), F.lit(True).alias("whole")), F.col("full_copies").cast("int"))).otherwise(F.array()),
        F.filter(F.array(F.struct(F.col("part_from").alias("a"), F.col("part_to").alias("b"), F.lit(False).alias("whole")), F.struct(F.col("wrap_from").alias("a"), F.col("wrap_to").alias("b"), F.lit(False).alias("whole"))), lambda r: r["b"] > r["a"]),
    )
    # Each piece is a word with the white space before it, so a slice of pieces is a literal passage.
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D]++[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, (F.col("_r.a") + 1).cast("int"), (F.col("_r.b") - F.col("_r.a")).cast("int")), "")
    out = plan.withColumn("_r", F.explode(ranges))
    whole = F.col("_r.whole") | (F.col("_r.b") - F.col("_r.a") == F.col("size"))
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.col(text)).cast(docs.schema["n_chars"].dataType))
    return named(out)
