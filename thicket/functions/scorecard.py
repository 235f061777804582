"""Repository scorecards: eighteen checks as column expressions over facts of a repository, their weights and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Check, risk category and weight.
CHECKS = (
    ("Binary-Artifacts", "source", 10.0),
    ("Branch-Protection", "source", 7.5),
    ("CI-Tests", "build", 5.0),
    ("CII-Best-Practices", "holistic", 2.5),
    ("Code-Review", "source", 7.5),
    ("Contributors", "source", 2.5),
    ("Dangerous-Workflow", "source", 10.0),
    ("Dependency-Update-Tool", "build", 5.0),
    ("Fuzzing", "build", 2.5),
    ("License", "holistic", 5.0),
    ("Maintained", "source", 7.5),
    ("Packaging", "build", 2.5),
    ("Pinned-Dependencies", "build", 7.5),
    ("SAST", "build", 5.0),
    ("Security-Policy", "holistic", 5.0),
    ("Signed-Releases", "build", 5.0),
    ("Token-Permissions", "build", 7.5),
    ("Vulnerabilities", "holistic", 10.0),
)


def full(flag: str) -> Column:
    """All ten points or none."""
    return F.when(F.col(flag), 10).otherwise(0)


def ladder(value: str, *steps: tuple[int, int], default: int = 0) -> Column:
    """The points of the first step (upper bound, points) that value does not exceed; default beyond and for null."""
    out = F.lit(default)
    for bound, points in reversed(steps):
        out = F.when(F.col(value) <= bound, points).otherwise(out)
    return out


def tenths(ratio: str) -> Column:
    return F.least(F.floor(F.col(ratio) * 10), F.lit(10)).cast("int")


def scores() -> dict[str, Column]:
    """The points of each check over the columns of a repository."""
    guard = sum((F.when(F.col(flag), points).otherwise(0) for flag, points in (("needs_pull", 3), ("needs_review", 3), ("needs_status", 2), ("binds_admins", 2))), F.lit(0))
    badge = F.coalesce(F.create_map(*[F.lit(x) for x in ("gold", 10, "silver", 7, "passing", 5, "in_progress", 2)])[F.col("badge")], F.lit(0))
    return {
        "Binary-Artifacts": 10 - full("has_binaries"),
        "Branch-Protection": F.when(F.col("is_protected"), guard).otherwise(0),
        "CI-Tests": full("has_ci"),
        "CII-Best-Practices": badge,
        "Code-Review": full("is_reviewed"),
        "Contributors": ladder("organisations", (0, 0), (1, 3), (2, 7), default=10),
        "Dangerous-Workflow": 10 - full("has_danger"),
        "Dependency-Update-Tool": F.when(F.col("has_updater") | F.col("has_other_updater"), 10).otherwise(0),
        "Fuzzing": full("has_fuzzing"),
        "License": F.when(F.col("licence").isNotNull(), 10).otherwise(0),
        "Maintained": ladder("idle_days", (30, 10), (90, 7), (180, 5), (365, 3)),
        "Packaging": full("is_published"),
        "Pinned-Dependencies": tenths("pinned_ratio"),
        "SAST": full("has_sast"),
        "Security-Policy": full("has_policy"),
        "Signed-Releases": tenths("signed_ratio"),
        "Token-Permissions": full("least_tokens"),
        "Vulnerabilities": ladder("vulnerabilities", (0, 10), (2, 7), (5, 5), (10, 3)),
    }


def checks(repos: DataFrame, key: str = "id") -> DataFrame:
    """One row a repository and check: key, check_name, category, weight, score."""
    points = scores()
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(category).alias("category"), F.lit(weight).alias("weight"), points[name].alias("score")) for name, category, weight in CHECKS])
    return repos.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def risk(score: Column) -> Column:
    return F.when(score <= 2, "critical").when(score <= 4, "high").when(score <= 7, "medium").otherwise("low")


def total() -> Column:
    """The weighted mean of the scores of a group of checks."""
    return F.sum(F.col("score") * F.col("weight")) / F.sum("weight")


def overall_risk(total: Column) -> Column:
    return F.when(total < 3, "critical").when(total < 5, "high").when(total < 7, "medium").otherwise("low")


def grade(total: Column) -> Column:
    return F.when(total >= 9, "A+").when(total >= 8, "A").when(total >= 7, "B").when(total >= 6, "C").when(total >= 5, "D").otherwise("F")


def build_level(score: dict[str, Column]) -> Column:
    """The build level 0 to 3 that the scores of a repository bear out."""
    at_least = lambda name, n: F.coalesce(score[name] >= n, F.lit(False))
    provenance = at_least("Packaging", 5) | at_least("Signed-Releases", 5) | at_least("Binary-Artifacts", 5)
    signed = at_least("Signed-Releases", 7)
    hosted = signed & at_least("Branch-Protection", 5) & at_least("Token-Permissions", 5) & at_least("CI-Tests", 5)
    hardened = at_least("Dangerous-Workflow", 7) & at_least("Pinned-Dependencies", 5)
    return F.when(~provenance, 0).when(hosted & hardened, 3).when(hosted, 2).otherwise(1)


#: What is recommended where a repository falls short.
ADVICE = {
    "provenance": ("Generate SLSA provenance in CI/CD (e.g., GitHub Actions + provenance attestation)", "Publish provenance alongside release artifacts"),
    "signed": "Sign provenance using Sigstore keyless signing",
    "Branch-Protection": "Enable branch protection for release branches",
    "Token-Permissions": "Restrict GitHub Action token permissions",
    "CI-Tests": "Add CI tests to strengthen build integrity",
    "Dangerous-Workflow": "Audit workflows for dangerous patterns",
    "Pinned-Dependencies": "Pin CI/CD workflow dependencies",
}


def build_advice(score: dict[str, Column]) -> Column:
    """What would raise the build level, in a fixed order; a score that is not known falls short."""
    at_least = lambda name, n: F.coalesce(score[name] >= n, F.lit(False))
    provenance = at_least("Packaging", 5) | at_least("Signed-Releases", 5) | at_least("Binary-Artifacts", 5)
    short = [(~provenance, text) for text in ADVICE["provenance"]] + [(provenance & ~at_least("Signed-Releases", 7), ADVICE["signed"])]
    short += [(~at_least(name, 7 if name == "Dangerous-Workflow" else 5), ADVICE[name]) for name in ("Branch-Protection", "Token-Permissions", "CI-Tests", "Dangerous-Workflow", "Pinned-Dependencies")]
    return F.filter(F.array(*[F.when(test, text) for test, text in short]), lambda x: x.isNotNull())
