"""Registered queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, exact, html, lm, media, mixing, quality_rules, ranked, repair, simhash, urls
from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("int").alias("turn"), F.lit(r).alias("role"), F.lit(control).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = chat.format_records(chat.records(rows.unionByName(probe)))
    t = F.col("turns")
    loss = F.array_join(F.transform(F.filter(t, lambda x: x["loss"]), lambda x: x["text"]), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return chats.select(
        "conv_id",
        F.size(t).cast("long").alias("n_turns"),
        digest(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    # A member that stays unreadable is no result.
    return found.withColumn("payload_bytes", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("long")).otherwise(F.col("payload_bytes")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.filled("conv_id", rows, repair.repair(repair.damaged(rows)))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_format": op4_chat_format,
    "op5_bpe": op5_bpe,
    "op6_media": op6_media,
    "op7_lm_score": op7_lm_score,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_structure_repair": op11_structure_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_ranked_search": op13_ranked_search,
}


def repair_sql() -> str:
    """Damage, faults and the four-state program row by row: a state is its cost in nine digits, then its audit, so the least text is the best."""
    add = lambda x, cost, edit: f"(printf('%09d', CAST({x}[1:9] AS INTEGER) + {cost}) || {x}[10:] || '{edit}')"
    u = f"least(u, {add('z', 5, 'I')}, {add('s', 5, 'I')}, {add('a', 5, 'I')})"
    a = f"least(a, {add('u', 5, 'I')}, {add('z', 10, 'II')}, {add('s', 10, 'II')})"
    step = lambda at, role: f"CASE WHEN x = '-' THEN NULL WHEN lower(x) = '{role}' THEN {add(at, 'cut', 'K')} ELSE {add(at, '1 + cut', 'R')} END"
    return rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, t
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS is_cut,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS previous
  FROM placed
), symbols AS (
  SELECT *, CASE WHEN is_blank OR again THEN '-' WHEN is_cut THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END) WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS symbol FROM faults
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate,
    count(*) FILTER (is_cut AND NOT again AND NOT is_blank) AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(symbol, '' ORDER BY pos) AS line
  FROM symbols GROUP BY conv_id
), walk AS (
  SELECT conv_id, line, 1 AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM convs
  UNION ALL
  SELECT conv_id, line, i + 1, {add('z', 2, 'D')}, least({add('s', 2, 'D')}, CASE WHEN lower(x) = 's' THEN {add('z', 'cut', 'K')} END),
    least({add('u', 2, 'D')}, {step('z', 'u')}, {step('s', 'u')}, {step('a', 'u')}), least({add('a', 2, 'D')}, {step('u', 'a')})
  FROM (SELECT conv_id, line, i, z, s, {u} AS u, {a} AS a, line[i] AS x, CASE WHEN line[i] IN ('S', 'U', 'A', 'X') THEN 5 ELSE 0 END AS cut FROM walk WHERE i <= length(line))
), best AS (
  SELECT conv_id, least(z, {a}) AS b FROM walk WHERE i = length(line) + 1
), edits AS (
  SELECT conv_id, j, b[9 + j] AS edit, length(replace(b[10:9 + j], 'I', '')) AS pos, length(replace(b[10:9 + j], 'D', '')) AS o FROM (SELECT conv_id, b, unnest(range(1, length(b) - 8)) AS j FROM best)
), turns AS (
  SELECT e.*, y.role, y.text, coalesce(max(CASE WHEN e.o = 1 AND e.edit = 'K' AND y.initial = 's' THEN 1 END) OVER (PARTITION BY e.conv_id), 0) AS has_s
  FROM edits e LEFT JOIN symbols y ON e.conv_id IS NOT DISTINCT FROM y.conv_id AND e.pos = y.pos WHERE e.edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM turns GROUP BY conv_id
)
SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(CAST(b.b[1:9] AS BIGINT), 0) AS cost, coalesce(b.b[10:], '') AS audit, sha256(coalesce(w.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN convs c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON k.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts w ON k.conv_id IS NOT DISTINCT FROM w.conv_id
"""

ORACLES: dict[str, str] = {
    "op4_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(9 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g'))) AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""",
    "op11_structure_repair": repair_sql(),
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(bare) AS text_sha256 FROM g
""",
    "op13_ranked_search": r"""
WITH cut AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM documents),
terms AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM cut GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM terms, whole GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM benchmark),
items AS (SELECT item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times FROM asked GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
""",
}
