"""Lexical vectors of names, and queries over JSON documents about packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents, embedding
from .registry import Tables, query

FEATURES = """
  SELECT id, 0.25 AS w, 'txt:' || s AS f FROM low
  UNION ALL SELECT id, 1.0, 'tok:' || t FROM word
  UNION ALL SELECT id, 0.15, 'pre:' || left(t, n) FROM word, range(3, 7) r(n) WHERE length(t) >= n
  UNION ALL SELECT id, 0.15, 'suf:' || right(t, n) FROM word, range(3, 7) r(n) WHERE length(t) >= n
  UNION ALL SELECT id, 0.2, 'tri:' || substr(t, k, 3) FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS k FROM word)
  UNION ALL SELECT id, 0.3, 'bi:' || ts[k] || '_' || ts[k + 1] FROM (SELECT id, ts, unnest(range(1, len(ts))) AS k FROM low)
"""
HASH = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(f, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(
    "lexical_embed",
    f"""WITH low AS (SELECT id, lower(name) AS s, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM fx_package),
word AS (SELECT id, unnest(ts) AS t FROM low), feature AS ({FEATURES}),
hashed AS (SELECT id, w, {HASH} AS h FROM feature),
slots AS (SELECT id, CAST(h % {embedding.DIMENSION} AS INT) AS slot, sum(CAST(w AS DOUBLE) * CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v FROM hashed GROUP BY 1, 2),
sized AS (SELECT id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM slots)
SELECT id, slot, value FROM sized WHERE value <> 0""",
)
def _(t: Tables) -> DataFrame:
    """The slots of each package name's vector that are not zero."""
    each = embedding.lexical_slots(t.fx_package, "id", "name")
    return each.withColumn("value", F.round("value", 6)).where("value <> 0")


def field(path: str) -> str:
    return f"json_extract_string(p, '$.{path}')"


@query(
    "slsa_provenance",
    f"""SELECT package_id, coalesce({field('_type')}, {field('statementType')}, '{documents.STATEMENT_TYPE}') AS statement_type,
coalesce({field('predicateType')}, '{documents.PREDICATE_TYPE}') AS predicate_type,
coalesce(array_to_string(list_transform(list_filter(json_extract(p, '$.subject[*]'), lambda x: json_extract_string(x, '$.name') IS NOT NULL), lambda x: json_extract_string(x, '$.name') || '=' || coalesce(json_extract_string(x, '$.digest.sha256'), '')), ','), '') AS subjects,
coalesce({field('predicate.builder.id')}, '{documents.BUILDER}') AS builder_id, {field('predicate.builder.version')} AS builder_version,
coalesce({field('predicate.invocation.configSource.uri')}, source_repo, package_id) AS repository, {field('predicate.invocation.configSource.ref')} AS git_ref,
{field('predicate.buildType')} AS workflow, {field('predicate.metadata.buildInvocationId')} AS invocation_id,
{field('predicate.metadata.buildStartedOn')} AS started_on, {field('predicate.metadata.buildFinishedOn')} AS finished_on
FROM (SELECT package_id, source_repo, CASE WHEN json_valid(payload) THEN payload END AS p FROM fx_provenance) WHERE p IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    """The fields of each provenance statement, with defaults."""
    return documents.provenance(t.fx_provenance, "package_id", "source_repo", "payload")


def one_of(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "scorecard_external",
    f"""SELECT id, check_name, score, reason, CASE WHEN check_name IN ({one_of(documents.SOURCE)}) THEN 'source' WHEN check_name IN ({one_of(documents.BUILD)}) THEN 'build' ELSE 'holistic' END AS category,
CASE WHEN score >= 8 THEN 'low' WHEN score >= 5 THEN 'medium' WHEN score >= 3 THEN 'high' ELSE 'critical' END AS risk
FROM (SELECT id, coalesce(json_extract_string(c, '$.name'), 'Unknown') AS check_name, CAST(round(coalesce(CAST(json_extract_string(c, '$.score') AS DOUBLE), 0)) AS INT) AS score, coalesce(json_extract_string(c, '$.reason'), '') AS reason
FROM (SELECT id, unnest(json_extract(CASE WHEN json_valid(payload) THEN payload END, '$.checks[*]')) AS c FROM fx_scorecard_doc))""",
)
def _(t: Tables) -> DataFrame:
    """The checks of external scorecards."""
    return documents.scorecard(t.fx_scorecard_doc, "id", "payload")
