"""Registry documents: metadata of npm, PyPI and crates packages, changelogs, dependency lists, and where events go.

All readers are column expressions over documents that a table holds; a field
that is absent or of another shape is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: Fields of the three kinds of documents; values that may be objects are kept as their JSON text.
DOCUMENT = (
    "`dist-tags` struct<latest string>, versions map<string, struct<license string, repository string>>, license string, repository string, "
    "info struct<license string, classifiers array<string>, project_urls map<string, string>, home_page string, version string>, "
    "crate struct<license string, repository string, max_version string>"
)
CLASSIFIER = "License :: "


def inner(value: Column, field: str) -> Column:
    """The value, or that field of it where it is an object."""
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{field}")).otherwise(value)


def clean_url(url: Column) -> Column:
    """A repository's address without the marks of version control around it."""
    return F.regexp_replace(F.regexp_replace(url, r"^git\+", ""), r"\.git$", "")


def metadata(rows: DataFrame, registry: str, document: str) -> DataFrame:
    """Adds license, latest and repository of each document by its registry (npm, pypi, else crates)."""
    d, kind = F.col("_d"), F.col(registry)
    latest = d["dist-tags"]["latest"]
    newest = F.try_element_at(d["versions"], latest)
    npm = (inner(F.coalesce(newest["license"], d["license"]), "type"), latest, clean_url(inner(F.coalesce(newest["repository"], d["repository"]), "url")))
    info = d["info"]
    classifier = F.get(F.filter(info["classifiers"], lambda c: c.startswith(CLASSIFIER)), F.lit(0))
    pypi = (
        F.coalesce(F.when(F.trim(info["license"]) != "", info["license"]), F.replace(classifier, F.lit(CLASSIFIER), F.lit(""))),
        info["version"],
        F.coalesce(F.try_element_at(info["project_urls"], F.lit("Source")), F.when(info["home_page"] != "", info["home_page"])),
    )
    crate = d["crate"]
    crates = (crate["license"], crate["max_version"], crate["repository"])
    pick = lambda k: F.when(kind == "npm", npm[k]).when(kind == "pypi", pypi[k]).otherwise(crates[k])
    out = rows.withColumn("_d", F.from_json(document, DOCUMENT))
    return out.withColumns({"license": pick(0), "latest": pick(1), "repository": pick(2)}).drop("_d")


def packument_versions(document: Column) -> Column:
    """The version numbers of an npm document, sorted."""
    return F.array_sort(F.map_keys(F.from_json(document, "versions map<string, string>")["versions"]))


def normal_dependencies(document: Column) -> Column:
    """name and req of a crate's dependencies that are needed to build and run it."""
    found = F.from_json(document, "deps array<struct<name string, req string, kind string>>")["deps"]
    return F.transform(F.filter(found, lambda d: d["kind"] == "normal"), lambda d: F.struct(d["name"].alias("name"), d["req"].alias("req")))


def changelog(rows: DataFrame, xml: str) -> DataFrame:
    """One row an entry of a changelog response: project, version (null if empty), at, action, serial; entries of fewer values go."""
    entry = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<data>(.*?)</data>"), F.lit(1)))
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    values = F.transform(F.regexp_extract_all("_e", F.lit(r"(?s)<value>\s*(?:<\w+>)?([^<]*)(?:</\w+>)?\s*</value>"), F.lit(1)), lambda x: plain(F.trim(x)))
    number = lambda k: F.coalesce(F.col("_v")[k].try_cast("long"), F.lit(0))
    found = rows.withColumn("_e", entry).withColumn("_v", values).where(F.size("_v") >= 5)
    v = F.col("_v")
    return found.select(*[c for c in rows.columns if c != xml], v[0].alias("project"), F.when(v[1] != "", v[1]).alias("version"), number(2).alias("at"), v[3].alias("action"), number(4).alias("serial"))


def stream_of(event_type: Column, topic: Column) -> Column:
    """Which stream an event goes to by its type, else by its topic; null for those that go to none."""
    by_type = F.when(event_type.isin("version.upserted", "domain.version.upsert.v1"), "version").when(event_type == "breaking_change.detected", "breaking").when(event_type == "dependency.impact", "impact")
    ignored = event_type.isin("version.yanked", "domain.version.yanked.v1", "package.deleted", "domain.package.deleted.v1")
    by_topic = F.when(topic.contains("breaking"), "breaking").when(topic.contains("impact"), "impact")
    return F.coalesce(by_type, F.when(~F.coalesce(ignored, F.lit(False)), by_topic))


#: The names under which advisories list ecosystems.
ADVISORY_NAMES = {"npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "crates": "crates.io", "crates.io": "crates.io", "maven": "Maven", "nuget": "NuGet", "go": "Go", "golang": "Go"}


def advisory_ecosystem(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ADVISORY_NAMES.items() for x in pair])
    return names[F.lower(name)]


def breaking_event(rows: DataFrame, payload: str) -> DataFrame:
    """The fields of breaking-change events with their defaults; events without a name, or that are no JSON, go."""
    schema = "ecosystem string, name string, old_version string, new_version string, severity string, affected_dependents int, changes array<struct<type string, description string>>"
    e = F.col("_e")
    severity = F.lower(F.coalesce(e["severity"], F.lit("low")))
    found = rows.withColumn("_e", F.from_json(payload, schema)).where(F.coalesce(e["name"], F.lit("")) != "")
    return found.select(
        *[c for c in rows.columns if c != payload],
        F.concat_ws(":", F.coalesce(e["ecosystem"], F.lit("npm")), e["name"]).alias("package_id"),
        F.coalesce(e["old_version"], F.lit("")).alias("old_version"),
        F.coalesce(e["new_version"], F.lit("")).alias("new_version"),
        F.when(severity.isin("critical", "high", "medium"), severity).otherwise("low").alias("severity"),
        F.coalesce(e["affected_dependents"], F.lit(0)).alias("affected_dependents"),
        F.coalesce(F.size(F.filter(e["changes"], lambda c: c["type"].isNotNull())), F.lit(0)).cast("long").alias("changes"),
    )


@F.pandas_udf(ArrayType(FloatType()))
def floats_of(raw: pd.Series) -> pd.Series:
    """Vectors from little-endian 32-bit floats."""
    return pd.Series([None if x is None else np.frombuffer(x, "<f4") for x in raw], dtype=object)


@F.pandas_udf(BinaryType())
def bytes_of(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in vectors], dtype=object)


def yanked_file(value: Column) -> Column:
    """Whether a file is withdrawn, by its data-yanked of any JSON type: true, or a reason that is not empty."""
    kind = F.schema_of_variant(value)
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", F.try_variant_get(value, "$", "string") != ""), F.lit(False))


def yanked_release(document: Column) -> Column:
    """Whether any file of a release's document (files with data-yanked) is withdrawn; false without files."""
    files = F.from_json(document, "files array<struct<`data-yanked` variant>>")["files"]
    return F.coalesce(F.exists(files, lambda f: yanked_file(f["data-yanked"])), F.lit(False))
