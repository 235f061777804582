"""Release notes and version pairs: how likely a release breaks its dependents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of release notes and their weights; all are looked for in lower case, so the first two both count.
PHRASES = (
    ("BREAKING CHANGE", 1.0),
    ("breaking change", 0.9),
    ("breaking:", 0.9),
    ("⚠️ BREAKING", 0.95),
    ("backwards-incompatible", 0.9),
    ("incompatible change", 0.85),
    ("removed", 0.6),
    ("deleted", 0.5),
    ("dropped", 0.5),
    ("no longer supports", 0.7),
    ("deprecated", 0.3),
    ("deprecating", 0.3),
    ("will be removed", 0.4),
    ("migration required", 0.8),
    ("upgrade guide", 0.6),
    ("migrate from", 0.5),
    ("action required", 0.7),
)
#: Words of release notes that tell of a break, and of one to come.
BREAKING = ("breaking", "breaking change", "breaking-change", "incompatible", "backwards-incompatible", "migration required", "migrate", "upgrade guide", "removed", "deprecated and removed", "no longer supports", "dropped support", "renamed", "moved to", "changed signature", "new api", "api change", "must update", "action required")
DEPRECATING = ("deprecated", "deprecating", "will be removed", "scheduled for removal", "legacy", "obsolete")
#: Weights of the signals.
MAJOR, KEYWORDS, DEPS_REMOVED, DEPS_MAJOR, API_REDUCED, HISTORY, RAPID, PRERELEASE, LARGE = 0.40, 0.30, 0.15, 0.10, 0.25, 0.10, 0.05, 0.15, 0.08
#: Marks of a pre-release version.
PRE = ("alpha", "beta", "rc", "pre", "dev", "snapshot", "-")


def occurrences(text: Column, phrase: str) -> Column:
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase))


def changelog_score(notes: Column) -> Column:
    """0 to 1: the weights of the phrases, each counted at most three times, over five."""
    low, total = F.lower(notes), F.lit(0.0)
    for phrase, weight in PHRASES:
        total = total + F.lit(weight) * F.least(F.lit(3), occurrences(low, phrase.lower()))
    return F.least(F.lit(1.0), total / 5)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def leading_number(version: Column) -> Column:
    """The major number of a version with or without v before it; null where it is none."""
    return F.split_part(F.regexp_replace(version, "^[v]*[V]*", ""), F.lit("."), F.lit(1)).try_cast("int")


def prediction(old: Column, new: Column, notes: Column, deps_removed: Column, deps_major: Column, api_removed: Column, author_rate: Column, days: Column, lines: Column) -> Column:
    """probability, risk, confidence and signals (number) of a release; null facts give no signal."""
    low = F.lower(notes)
    major = F.coalesce(leading_number(new) > leading_number(old), F.lit(False))
    breaking = F.coalesce(has_any(low, BREAKING), F.lit(False))
    signals = (
        (major, F.lit(MAJOR)),
        (breaking, F.lit(KEYWORDS)),
        (has_any(low, DEPRECATING), F.lit(KEYWORDS * 0.5)),
        (deps_removed > 0, F.least(deps_removed * 0.1, F.lit(DEPS_REMOVED))),
        (deps_major > 0, F.least(deps_major * 0.05, F.lit(DEPS_MAJOR))),
        (api_removed > 0, F.least(api_removed * 0.05, F.lit(API_REDUCED))),
        (author_rate > 0.3, author_rate * HISTORY),
        (days < 7, F.lit(RAPID)),
        (has_any(F.lower(new), PRE), F.lit(PRERELEASE)),
        (lines > 1000, F.least(lines / 5000.0, F.lit(1.0)) * LARGE),
    )
    total, n = F.lit(0.0), F.lit(0)
    for test, weight in signals:
        total, n = total + F.when(test, weight).otherwise(0.0), n + F.when(test, 1).otherwise(0)
    p = F.least(total, F.lit(0.99))
    confidence = 0.5 + F.when(major, 0.2).otherwise(0.0) + F.when(breaking, 0.15).otherwise(0.0) + F.when(api_removed > 0, 0.1).otherwise(0.0) + n * 0.05
    risk = F.when(p < 0.2, "low").when(p < 0.5, "medium").when(p < 0.8, "high").otherwise("critical")
    return F.struct(p.alias("probability"), risk.alias("risk"), F.least(confidence, F.lit(0.95)).alias("confidence"), n.alias("signals"))
