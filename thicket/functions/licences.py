"""SPDX expressions, each distinct one parsed once, and the reference table of licences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Id, OSI approved, FSF libre, copyleft, category.
LICENCES = (
    ("MIT", True, True, "none", "permissive"),
    ("Apache-2.0", True, True, "none", "permissive"),
    ("BSD-2-Clause", True, True, "none", "permissive"),
    ("BSD-3-Clause", True, True, "none", "permissive"),
    ("ISC", True, True, "none", "permissive"),
    ("Unlicense", True, True, "none", "public-domain"),
    ("CC0-1.0", False, True, "none", "public-domain"),
    ("LGPL-2.1-only", True, True, "weak", "copyleft"),
    ("LGPL-3.0-only", True, True, "weak", "copyleft"),
    ("MPL-2.0", True, True, "weak", "copyleft"),
    ("EPL-2.0", True, True, "weak", "copyleft"),
    ("GPL-2.0-only", True, True, "strong", "copyleft"),
    ("GPL-3.0-only", True, True, "strong", "copyleft"),
    ("AGPL-3.0-only", True, True, "network", "copyleft"),
    ("SSPL-1.0", False, False, "network", "proprietary"),
    ("BSL-1.0", False, False, "none", "proprietary"),
)


def table(spark: SparkSession) -> DataFrame:
    """The reference table: 16 rows."""
    return spark.createDataFrame(LICENCES, "licence string, osi boolean, fsf boolean, copyleft string, category string")


def postfix(expression: str | None) -> list[str] | None:
    """Operands and operators of an expression in postfix order: WITH binds before AND, AND before OR; what follows a whole expression is ignored. None if it has no operand."""
    order = {"OR": 1, "AND": 2, "WITH": 3}
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in re.findall(r"[()]|[^\s()]+", expression or ""):
        if token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
            operand = False
        elif token.upper() in order:
            if operand:
                return None
            while held and held[-1] != "(" and order[held[-1]] >= order[token.upper()]:
                out.append(held.pop())
            held.append(token.upper())
            operand = True
        elif operand:
            out.append(token)
            operand = False
        else:
            break
    if operand:
        return None
    return out + [x for x in reversed(held) if x != "("]


def satisfied(program: list[str] | None, allowed: frozenset[str]) -> bool:
    """Whether some choice of an expression's alternatives holds allowed licences only."""
    if not program:
        return False
    stack: list[bool] = []
    for x in program:
        if x in ("OR", "AND", "WITH"):
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if x == "OR" else a and b if x == "AND" else a)
        else:
            stack.append(x in allowed)
    return stack[-1]


def choice(program: list[str] | None, allowed: frozenset[str]) -> list[str] | None:
    """The licences of the first choice that holds allowed ones only, left alternatives first; None if there is none."""
    stack: list[tuple[str, list[str] | None]] = []
    for x in program or ():
        if x not in ("OR", "AND", "WITH"):
            stack.append((x, [x] if x in allowed else None))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if x == "WITH":
            stack.append((left, None if a is None else [f"{a[0]} WITH {right}"]))
        elif x == "AND":
            stack.append((left, None if a is None or b is None else a + b))
        else:
            stack.append((left, b if a is None else a))
    return stack[-1][1] if stack else None


def with_choice(rows: DataFrame, expression: str, allowed: tuple[str, ...], out: str = "choice") -> DataFrame:
    """rows with the satisfying choice of an expression, an array, null where none is. Each distinct expression is parsed once."""
    known = frozenset(allowed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_e": frame["_e"], out: [choice(postfix(x), known) for x in frame["_e"]]})

    distinct = rows.where(F.col(expression).isNotNull()).select(F.col(expression).alias("_e")).distinct()
    found = stored(distinct.mapInPandas(run, f"_e string, `{out}` array<string>"), "choices")
    return rows.join(found, F.col(expression) == F.col("_e"), "left").drop("_e")


def spdx_ids(line: Column | str) -> Column:
    """Distinct licence ids of an expression, in order; exceptions after WITH are not ids."""
    plain = F.regexp_replace(line, r"\bWITH\s+[^\s()]+", "")
    names = F.regexp_extract_all(plain, F.lit(r"([A-Za-z0-9.+:-]+)"), F.lit(1))
    return F.array_distinct(F.filter(names, lambda x: ~x.isin("AND", "OR", "WITH")))


@dataclass(frozen=True)
class Policy:
    name: str
    denied: tuple[str, ...] = ()
    denied_categories: tuple[str, ...] = ()
    copyleft: bool = True
    network: bool = False
    osi: bool = False
    unknown: bool = False


#: The licences that the enterprise policy denies by name.
DENIED = ("AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "SSPL-1.0", "Commons-Clause")
POLICIES = (Policy("default"), Policy("permissive-only", copyleft=False), Policy("enterprise", denied=DENIED, osi=True))


def violations(policy: Policy) -> Column:
    """The violations of one licence id, over the columns of the reference table (null where it is not listed): a denied one has no others."""
    known = F.col("category").isNotNull()
    rules = F.array(
        F.when(known & F.col("category").isin(*policy.denied_categories), "denied_category") if policy.denied_categories else F.lit(None).cast("string"),
        F.when(known & F.col("copyleft").isin("strong", "weak"), "copyleft_not_allowed") if not policy.copyleft else F.lit(None).cast("string"),
        F.when(known & (F.col("copyleft") == "network"), "network_copyleft_not_allowed") if not policy.network else F.lit(None).cast("string"),
        F.when(known & ~F.col("osi"), "not_osi_approved") if policy.osi else F.lit(None).cast("string"),
        F.when(~known, "unknown_license") if not policy.unknown else F.lit(None).cast("string"),
    )
    found = F.filter(rules, lambda x: x.isNotNull())
    return F.when(F.col("licence").isin(*policy.denied), F.array(F.lit("denied_license"))).otherwise(found) if policy.denied else found


def warnings(policy: Policy, deprecated: tuple[str, ...] = ()) -> Column:
    """What a policy lets pass but reports of one licence id, over the columns of the reference table; a denied one has violations only."""
    known = F.col("category").isNotNull()
    rules = F.array(
        F.when(known & F.col("licence").isin(*deprecated), F.concat(F.lit("License '"), "licence", F.lit("' is deprecated"))) if deprecated else F.lit(None).cast("string"),
        F.when(~known, F.concat(F.lit("Unknown license '"), "licence", F.lit("' - manual review recommended"))) if policy.unknown else F.lit(None).cast("string"),
    )
    found = F.filter(rules, lambda x: x.isNotNull())
    return F.when(~F.col("licence").isin(*policy.denied), found).otherwise(F.array().cast("array<string>")) if policy.denied else found
