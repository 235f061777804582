"""Bills of materials and policies: what their plans carry, and rows that meet several partners."""

import json
import re

from pyspark.sql import functions as F

from thicket.functions import policy
from thicket.plans import governance_queries, registry

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bills_read_the_lines_once_and_gather_numbers(spark):
    """Texts and digests are made behind the shuffle, and findings come with the packages."""
    for name in ("sbom_spdx", "sbom_cyclonedx"):
        found = plan(registry.QUERIES[name](spark, FOLDER))
        assert len(re.findall(r"Relation \[l_orderkey", found)) == 1
        assert re.search(r"collect_list\((?:named_)?struct\(p_partkey", found)


def test_bills_of_odd_rows(spark):
    """A part that is there twice is listed twice with its findings, repeated lines once, lines of no part not at all."""
    t = registry.Tables(spark, FOLDER).with_tables(
        lineitem=spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 7, 3), (1, 99, 1), (2, None, 1)], "l_orderkey long, l_partkey long, l_linenumber int"),
        part=spark.createDataFrame([(5, "Ab"), (7, None), (7, "c")], "p_partkey long, p_name string"),
    )
    rows = governance_queries.needs(t).collect()
    assert [(r["project"], [(p["id"], p["name"], p["version"], p["purl"], p["is_direct"]) for p in r["packages"]]) for r in rows] == [("order:1", [("part:5", "Ab", "1.0.0", "pkg:part/ab", True), ("part:7", None, "3.0.0", None, False), ("part:7", "c", "3.0.0", "pkg:part/c", False)])]
    vulns = t.part.select("p_partkey", "p_name", F.when(F.col("p_partkey") == 7, F.array(F.lit("v"))).alias("vulns"))
    assert governance_queries.needs(t, "vulns", parts=vulns).select(F.flatten("vulns").alias("v")).first()["v"] == ["v", "v"]


def test_cyclonedx_without_findings(spark):
    documents = registry.QUERIES["sbom_cyclonedx"](spark, FOLDER).limit(200).collect()
    assert all(isinstance(json.loads(r["document"])["vulnerabilities"], list) for r in documents)


def test_policies_carry_what_their_rules_ask_for(spark):
    """No map of all checks crosses the join: the one that the rules read is made behind it."""
    for name in ("policy_rules", "policy_overall"):
        found = plan(registry.QUERIES[name](spark, FOLDER))
        assert "Fuzzing" not in found and "_check Maintained" in found
    assert policy.checks_of(("all", (("not", ("min_check", "A", 1)), ("any", (("min_check", "B", 2), ("has_sbom",)))))) == {"A", "B"}
