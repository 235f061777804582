"""Readers of JSON documents about packages: provenance statements and scorecards.

A document that is no JSON gives no row; fields of another shape count as
absent, and numbers where text is due are read as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENT = "_type string, statementType string, predicateType string, subject array<struct<name string, digest struct<sha256 string>>>, predicate struct<builder struct<id string, version string>, buildType string, invocation struct<configSource struct<uri string, ref string>>, metadata struct<buildInvocationId string, buildStartedOn string, buildFinishedOn string>>"
SCORECARD = "checks array<struct<name string, score double, reason string>>"
# Defaults of a statement, and the risk category of the checks of an external scorecard (checks of other names: holistic).
STATEMENT_TYPE, PREDICATE_TYPE, BUILDER = "https://in-toto.io/Statement/v1", "https://slsa.dev/provenance/v1", "unknown"
HOLISTIC = ("Vulnerabilities", "Security-Policy", "License", "SAST")
SOURCE = ("Code-Review", "Maintained", "Contributors", "Branch-Protection", "Webhooks")
BUILD = ("Binary-Artifacts", "CI-Tests", "CII-Best-Practices", "Dangerous-Workflow", "Dependency-Update-Tool", "Fuzzing", "Packaging", "Pinned-Dependencies", "Signed-Releases", "Token-Permissions")


def parsed(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    return rows.where(F.get_json_object(payload, "$").isNotNull()).withColumn("_d", F.from_json(payload, schema))


def provenance(rows: DataFrame, package: str, repository: str, payload: str) -> DataFrame:
    """One row a statement; the repository falls back to the package's own, then to its id."""
    d = parsed(rows, payload, STATEMENT)
    named = F.filter(F.col("_d.subject"), lambda s: s["name"].isNotNull())
    subjects = F.transform(named, lambda s: F.concat(s["name"], F.lit("="), F.coalesce(s["digest"]["sha256"], F.lit(""))))
    of = lambda path: F.col(f"_d.predicate.{path}")
    return d.select(
        package,
        F.coalesce("_d._type", "_d.statementType", F.lit(STATEMENT_TYPE)).alias("statement_type"),
        F.coalesce("_d.predicateType", F.lit(PREDICATE_TYPE)).alias("predicate_type"),
        F.coalesce(F.array_join(subjects, ","), F.lit("")).alias("subjects"),
        F.coalesce(of("builder.id"), F.lit(BUILDER)).alias("builder_id"),
        of("builder.version").alias("builder_version"),
        F.coalesce(of("invocation.configSource.uri"), F.col(repository), F.col(package)).alias("repository"),
        of("invocation.configSource.ref").alias("git_ref"),
        of("buildType").alias("workflow"),
        of("metadata.buildInvocationId").alias("invocation_id"),
        of("metadata.buildStartedOn").alias("started_on"),
        of("metadata.buildFinishedOn").alias("finished_on"),
    )


def verified(rows: DataFrame, package: str, payload: str, trusted: tuple[str, ...] = (), required: int = 2) -> DataFrame:
    """The six checks of each statement, the build level they bear out (2, or 0 where any fails) and whether that is enough; trusted: builders, any if empty."""
    d = parsed(rows, payload, STATEMENT)
    builder = F.coalesce("_d.predicate.builder.id", F.lit(BUILDER))
    subjects = F.coalesce("_d.subject", F.array().cast("array<struct<name string, digest struct<sha256 string>>>"))
    tests = {
        "statement": F.coalesce("_d._type", "_d.statementType", F.lit(STATEMENT_TYPE)) == STATEMENT_TYPE,
        "predicate": F.coalesce("_d.predicateType", F.lit(PREDICATE_TYPE)) == PREDICATE_TYPE,
        "subjects": F.size(subjects) > 0,
        "digests": F.forall(subjects, lambda s: F.coalesce(s["digest"]["sha256"].isNotNull(), F.lit(False))),
        "builder": builder.isin(*trusted) if trusted else F.lit(True),
        "timestamps": F.col("_d.predicate.metadata.buildStartedOn").isNotNull(),
    }
    rows = d.select(package, *[t.alias(n) for n, t in tests.items()])
    passed = sum((F.col(n).cast("int") for n in tests), F.lit(0))
    level = F.when(passed == len(tests), 2).otherwise(0)
    return rows.withColumns({"passed": passed.cast("long"), "level": level, "valid": (passed == len(tests)) & (level >= required)})


def scorecard(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a check: its name, rounded score, category and risk; a check of unknown name is of the holistic kind."""
    each = parsed(rows, payload, SCORECARD).select(key, F.explode("_d.checks").alias("c"))
    name, score = F.coalesce("c.name", F.lit("Unknown")), F.round(F.coalesce("c.score", F.lit(0.0))).cast("int")
    category = F.when(name.isin(*SOURCE), "source").when(name.isin(*BUILD), "build").otherwise("holistic")
    risk = F.when(score >= 8, "low").when(score >= 5, "medium").when(score >= 3, "high").otherwise("critical")
    return each.select(key, name.alias("check_name"), score.alias("score"), F.coalesce("c.reason", F.lit("")).alias("reason"), category.alias("category"), risk.alias("risk"))
