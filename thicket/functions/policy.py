"""Policies: trees of conditions that compile to one column of results and messages.

A condition is a tuple: its kind, then its parameters. Results are pass, fail,
warn and skip; all, any and not combine them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities, the gravest first.
SEVERITIES = ("critical", "high", "medium", "low")


def outcome(result: str, *message: Any) -> Column:
    return F.struct(F.lit(result).alias("result"), F.concat(*[m if isinstance(m, Column) else F.lit(str(m)) for m in message]).alias("message"))


def decided(test: Column, good: Column, bad: Column) -> Column:
    return F.when(test, good).otherwise(bad)


def text(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def condition(tree: tuple) -> Column:
    """The struct (result, message) of a condition over the columns of a package's context.

    Columns read: licence, osi_approved, n_critical to n_low (vulnerabilities by
    severity), assessments, slsa_level, has_sbom, has_provenance, score, checks
    (map of name to score), age_days, depth. The messages are fixed values: results are compared by them.
    """
    kind, *args = tree
    licence = F.col("licence")
    unknown = lambda what, column, known: F.when(F.col(column).isNull(), outcome("skip", what)).otherwise(known)
    no_licence = "No license information available"
    if kind == "licence_allowed":
        found = F.lower(licence).isin(*[x.lower() for x in args[0]])
        return unknown(no_licence, "licence", decided(found, outcome("pass", "License ", licence, " is allowed"), outcome("fail", "License ", licence, " is not in allowed list")))
    if kind == "licence_denied":
        found = F.lower(licence).isin(*[x.lower() for x in args[0]])
        return unknown(no_licence, "licence", decided(found, outcome("fail", "License ", licence, " is denied"), outcome("pass", "License ", licence, " is not denied")))
    if kind == "licence_osi":
        return unknown(no_licence, "licence", decided(F.coalesce("osi_approved", F.lit(False)), outcome("pass", "License is OSI approved"), outcome("fail", "License ", licence, " is not OSI approved")))
    if kind == "max_severity":
        beyond = SEVERITIES[: SEVERITIES.index(args[0])]  # by rank: the graver ones
        above = F.lit(False)
        for s in beyond:
            above = above | (F.col(f"n_{s}") > 0)
        return decided(above, outcome("fail", f"Has vulnerabilities above {args[0]} severity"), outcome("pass", "No high-severity vulnerabilities"))
    if kind == "assessed":
        n = sum((F.col(f"n_{s}") for s in SEVERITIES), F.lit(0))
        return F.when(n == 0, outcome("pass", "No vulnerabilities to assess")).when(F.col("assessments") >= n, outcome("pass", "All vulnerabilities have VEX assessments")).otherwise(outcome("fail", "Missing VEX assessments: ", text("assessments"), " of ", text(n), " vulnerabilities assessed"))
    if kind == "min_slsa":
        level = F.col("slsa_level")
        return F.when(level.isNull(), outcome("fail", "No SLSA level information available")).when(level >= args[0], outcome("pass", "SLSA level L", text(level), f" meets minimum L{args[0]}")).otherwise(outcome("fail", "SLSA level L", text(level), f" below minimum L{args[0]}"))
    if kind == "has_sbom":
        return decided(F.col("has_sbom"), outcome("pass", "SBOM is available"), outcome("fail", "No SBOM available"))
    if kind == "has_provenance":
        return decided(F.col("has_provenance"), outcome("pass", "Provenance is available"), outcome("fail", "No provenance available"))
    if kind == "min_score":
        shown = F.expr("format_number(score, '0.0')")
        return unknown("No scorecard score available", "score", decided(F.col("score") >= args[0], outcome("pass", "Scorecard score ", shown, f" meets minimum {args[0]:.1f}"), outcome("fail", "Scorecard score ", shown, f" below minimum {args[0]:.1f}")))
    if kind == "min_check":
        name, least = args
        got = F.col("checks")[name]
        return F.when(got.isNull(), outcome("skip", f"Scorecard check {name} not available")).when(got >= least, outcome("pass", f"{name} check score ", text(got), f" meets minimum {least}")).otherwise(outcome("fail", f"{name} check score ", text(got), f" below minimum {least}"))
    if kind == "max_age":
        return unknown("No update date available", "age_days", decided(F.col("age_days") <= args[0], outcome("pass", "Package updated ", text("age_days"), " days ago"), outcome("warn", "Package not updated in ", text("age_days"), f" days (max: {args[0]})")))
    if kind == "max_depth":
        return unknown("Dependency depth unknown", "depth", decided(F.col("depth") <= args[0], outcome("pass", "Dependency depth ", text("depth"), f" within limit {args[0]}"), outcome("warn", "Dependency depth ", text("depth"), f" exceeds limit {args[0]}")))
    if kind == "custom":
        return outcome("skip", f"Custom expression not evaluated: {args[0]}")
    if kind == "all":
        parts = F.array(*[condition(x) for x in args[0]])
        failed = F.transform(F.filter(parts, lambda p: p["result"] == "fail"), lambda p: p["message"])
        return decided(F.size(failed) == 0, outcome("pass", "All conditions passed"), outcome("fail", F.array_join(failed, "; ")))
    if kind == "any":
        passed = F.filter(F.array(*[condition(x) for x in args[0]]), lambda p: p["result"] == "pass")
        return F.coalesce(F.get(passed, F.lit(0)), outcome("fail", "No conditions passed"))
    if kind == "not":
        inner = condition(args[0])
        turned = F.concat(F.lit("NOT("), inner["message"], F.lit(")"))
        return F.when(inner["result"] == "pass", outcome("fail", turned)).when(inner["result"] == "fail", outcome("pass", turned)).otherwise(inner)
    raise ValueError(f"no such condition: {kind}")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    tree: tuple
    blocking: bool


#: The licences that the default policy denies.
COPYLEFT = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0")
#: The default policy of an enterprise.
ENTERPRISE = (
    Rule("license-osi", "license", "high", ("licence_osi",), True),
    Rule("license-deny-gpl", "license", "high", ("licence_denied", COPYLEFT), True),
    Rule("vuln-critical", "security", "critical", ("max_severity", "high"), True),
    Rule("slsa-l1", "supply_chain", "medium", ("min_slsa", 1), False),
    Rule("scorecard-min", "supply_chain", "low", ("min_score", 5.0), False),
    Rule("unmaintained", "quality", "low", ("max_age", 730), False),
)


def checks_of(tree: tuple) -> set[str]:
    """The names of the checks that a condition reads."""
    kind, *args = tree
    if kind == "min_check":
        return {args[0]}
    inner = args[0] if kind in ("all", "any") else args if kind == "not" else ()
    return {name for x in inner for name in checks_of(x)}


def evaluated(rules: tuple[Rule, ...]) -> Column:
    """All rules in one pass: an array of rule, severity, blocking, result, message."""
    one = lambda r: F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.blocking).alias("blocking"), condition(r.tree).alias("o"))
    return F.transform(F.array(*[one(r) for r in rules]), lambda x: F.struct(x["rule"].alias("rule"), x["severity"].alias("severity"), x["blocking"].alias("blocking"), x["o"]["result"].alias("result"), x["o"]["message"].alias("message")))


def overall(results: Column) -> Column:
    """Counts by result, blocking failures, and the verdict on the package."""
    count = lambda test: F.size(F.filter(results, test)).cast("long")
    stopped = count(lambda r: (r["result"] == "fail") & r["blocking"])
    of = lambda result: count(lambda r: r["result"] == result)
    passed, failed, warned = of("pass"), of("fail"), of("warn")
    verdict = F.when(stopped > 0, "fail").when((warned > 0) | (failed > 0), "warn").otherwise("pass")
    return F.struct(passed.alias("passed"), failed.alias("failed"), warned.alias("warned"), stopped.alias("blocking_failures"), verdict.alias("overall"))
