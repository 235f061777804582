"""Column expressions over names, versions and requirement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crate_index_path(name: Column) -> Column:
    """Path of a crate in a sparse index: by the length of its lower-cased name."""
    k = F.lower(name)
    n = F.length(k)
    return F.when(n == 1, F.concat(F.lit("1/"), k)).when(n == 2, F.concat(F.lit("2/"), k)).when(n == 3, F.concat(F.lit("3/"), F.substring(k, 1, 1), F.lit("/"), k)).otherwise(F.concat_ws("/", F.substring(k, 1, 2), F.substring(k, 3, 2), k))


def npm_dependencies(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a dependency of a JSON object name -> range."""
    return rows.select(key, F.explode(F.from_json(payload, "map<string,string>")).alias("name", "range"))


def parse_pep508(rows: DataFrame, line: str) -> DataFrame:
    """Adds name, version_req (@ and the address for direct references; brackets around it go), marker (null if none), has_extra and is_optional (the marker asks for an extra)."""
    c = F.col(line)
    head = F.trim(F.split_part(c, F.lit(";"), F.lit(1)))
    marker = F.trim(F.split_part(c, F.lit(";"), F.lit(2)))
    need = F.trim(F.regexp_replace(head, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?", ""))
    return rows.withColumns({
        "name": F.regexp_extract(head, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1),
        "version_req": F.regexp_replace(need, r"^\((.*)\)$", "$1"),
        "marker": F.when(marker != "", marker),
        "has_extra": F.regexp_replace(head, "@.*$", "").contains("["),
        "is_optional": marker.rlike(r"\bextra\s*=="),
    })


def semver(version: Column) -> dict[str, Column]:
    """major, minor, patch (0 where not a number), pre and build of a version, with or without a leading v."""
    core = F.regexp_replace(version, r"^v", "")
    build = F.when(core.contains("+"), F.split_part(core, F.lit("+"), F.lit(2)))
    rest = F.split_part(core, F.lit("+"), F.lit(1))
    pre = F.when(rest.contains("-"), F.regexp_extract(rest, r"-(.*)$", 1))
    numbers = F.split(F.split_part(rest, F.lit("-"), F.lit(1)), r"\.")
    part = lambda k: F.coalesce(F.try_element_at(numbers, F.lit(k)).try_cast("long"), F.lit(0))
    return {"major": part(1), "minor": part(2), "patch": part(3), "pre": pre, "build": build}


def semver_key(version: Column) -> Column:
    """Sorts versions; a release stands above its pre-releases."""
    v = semver(version)
    return F.struct(v["major"], v["minor"], v["patch"], v["pre"].isNull(), F.coalesce(v["pre"], F.lit("")))


def bump(old: Column, new: Column) -> Column:
    a, b = semver(old), semver(new)
    return F.when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], "minor").when(a["patch"] != b["patch"], "patch").otherwise("none")


def package_id(line: Column) -> dict[str, Column]:
    """ecosystem, name and version of ecosystem/name/version, ecosystem/name or ecosystem:name; null for what is none of them."""
    parts, pair = F.split(line, "/"), F.split(line, ":", 2)
    long, short = F.size(parts) >= 2, F.size(pair) == 2
    pick = lambda k: F.when(long, F.get(parts, F.lit(k))).when(short, F.get(pair, F.lit(k)))
    return {"ecosystem": pick(0), "name": pick(1), "version": F.when(long, F.get(parts, F.lit(2)))}


def normal_signature(raw: Column) -> Column:
    """A signature with one blank for each run of white space, none inside brackets or before a comma."""
    s = F.trim(F.regexp_replace(raw, r"[ \t\n\r\f\x0b]+", " "))
    for pattern, by in ((r"\( ", "("), (r" \)", ")"), (r" ,", ",")):
        s = F.regexp_replace(s, pattern, by)
    return s


#: Languages by the extension of a file.
EXTENSIONS = {"rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "java": "java"}


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return names[F.regexp_extract(path, r"\.([a-z]+)$", 1)]
