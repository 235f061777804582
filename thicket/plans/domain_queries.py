"""Vectors, licences, risk, policy, provenance, bills of materials, API diffs and change prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import changes, documents, licences, text, vectors
from ..operators import symbols as symbols_of
from ..operators import renames, vector_index
from .registry import Tables, query



def rows_n() -> Column:
    return F.count(F.lit(1)).alias("n")
COSINE = "list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))"
PROBE = "(SELECT vector FROM fx_vector WHERE vec_id = 7)"


def scored(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Rows with their cosine to vector 7; the probe is one row."""
    probe = F.broadcast(t.fx_vector.where("vec_id = 7").select(F.col("vector").alias("q")))
    return (t.fx_vector if rows is None else rows).crossJoin(probe).withColumn("score", F.round(vectors.cosine(F.col("vector"), F.col("q")), 6))


@query("vector_topk", f"SELECT v.vec_id, round({COSINE}, 6) AS score FROM fx_vector v, {PROBE} q ORDER BY score DESC, v.vec_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return scored(t).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("vector_topk_filtered", f"SELECT v.vec_id, round({COSINE}, 6) AS score FROM fx_vector v, {PROBE} q WHERE v.ecosystem = '1' ORDER BY score DESC, v.vec_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return scored(t, t.fx_vector.where("ecosystem = '1'")).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("semantic_search", f"SELECT v.package_id, max(round({COSINE}, 6)) AS score FROM fx_vector v, {PROBE} q WHERE v.ecosystem <> '2' GROUP BY v.package_id ORDER BY score DESC, v.package_id LIMIT 3 OFFSET 1")
def _(t: Tables) -> DataFrame:
    """A page of packages by their best symbol, in some ecosystems."""
    return scored(t, t.fx_vector.where("ecosystem <> '2'")).groupBy("package_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "package_id").offset(1).limit(3)


@query("cosine_pairs", f"SELECT v.vec_id AS a, q.vec_id AS b, round({COSINE}, 6) AS score FROM fx_vector v JOIN fx_vector q ON q.vec_id = v.vec_id + 1")
def _(t: Tables) -> DataFrame:
    nxt = t.fx_vector.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("w"))
    return t.fx_vector.join(nxt, F.col("vec_id") == F.col("a")).select("a", "b", F.round(vectors.cosine(F.col("vector"), F.col("w")), 6).alias("score"))


@query("l2_normalize", "SELECT vec_id, i - 1 AS position, round(CAST(vector[i] AS DOUBLE) / sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS x FROM fx_vector, range(1, 65) r(i)")
def _(t: Tables) -> DataFrame:
    each = t.fx_vector.select("vec_id", F.posexplode(vectors.normalized(F.col("vector"))).alias("position", "v"))
    return each.select("vec_id", F.col("position").cast("long").alias("position"), F.round("v", 6).alias("x"))


@query("pool_embeddings", "SELECT package_id, i - 1 AS position, round(avg(CAST(vector[i] AS DOUBLE)), 6) AS mean, round(max(CAST(vector[i] AS DOUBLE)), 6) AS top FROM fx_vector, range(1, 65) r(i) GROUP BY package_id, i")
def _(t: Tables) -> DataFrame:
    each = t.fx_vector.select("package_id", F.posexplode("vector").alias("position", "x"))
    return each.groupBy("package_id", F.col("position").cast("long").alias("position")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.max(F.col("x").cast("double")), 6).alias("top"))


@query("embedding_points", "SELECT vec_id, package_id || ':1.0.0:' || CAST(vec_id AS VARCHAR) AS point_id, CASE ecosystem WHEN '0' THEN 'npm' WHEN '1' THEN 'pypi' ELSE 'cargo' END AS ecosystem FROM fx_vector")
def _(t: Tables) -> DataFrame:
    alias = t.spark.sql("SELECT * FROM VALUES ('0', 'npm'), ('1', 'pypi'), ('2', 'cargo') AS a(ecosystem, name)")
    return t.fx_vector.join(alias, "ecosystem").select("vec_id", F.concat_ws(":", "package_id", F.lit("1.0.0"), F.col("vec_id").cast("string")).alias("point_id"), F.col("name").alias("ecosystem"))


@query("vector_upsert", "SELECT package_id, max(vec_id) AS vec_id FROM fx_vector GROUP BY package_id")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("package_id").orderBy(F.desc("vec_id"))
    return t.fx_vector.withColumn("n", F.row_number().over(w)).where("n = 1").select("package_id", "vec_id")


@query("vector_delete", "SELECT vec_id FROM fx_vector WHERE vec_id NOT IN (SELECT vec_id FROM fx_vector WHERE ecosystem = '2')")
def _(t: Tables) -> DataFrame:
    return t.fx_vector.join(t.fx_vector.where("ecosystem = '2'").select("vec_id"), "vec_id", "left_anti").select("vec_id")


def vector_table(t: Tables) -> tuple[vector_index.Index, DataFrame]:
    """The index of all vectors, and the queries: every row whose id is divisible by 50."""
    return vector_index.build(t.fx_vector, "vec_id", "vector", keep=("ecosystem",)), t.fx_vector.where("vec_id % 50 = 0")


def nearest_sql(condition: str) -> str:
    return f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS rank FROM fx_vector v JOIN fx_vector q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND {condition}) WHERE rank <= 10"


@query("vector_index_topk", nearest_sql("true"))
def _(t: Tables) -> DataFrame:
    """The ten nearest rows by the index, cells followed as far as their bounds call for."""
    index, asked = vector_table(t)
    return vector_index.search(index, asked, "vec_id", "vector", exact=True)


@query("vector_index_filtered", nearest_sql("v.ecosystem = '1'"))
def _(t: Tables) -> DataFrame:
    """The same among the rows of one ecosystem, a column that the index keeps."""
    index, asked = vector_table(t)
    return vector_index.search(index, asked, "vec_id", "vector", exact=True, where=F.col("ecosystem") == "1")


@query("vector_index_recall")
def _(t: Tables) -> DataFrame:
    """Per query, the share of its ten nearest rows of all that a search of some cells finds."""
    index, asked = vector_table(t)
    return vector_index.recall(index, asked, "vec_id", "vector")


RANKED = f"(SELECT v.package_id, q.package_id AS want, q.vec_id AS qid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS rank FROM fx_vector v JOIN fx_vector q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)"
BEST = f"b AS (SELECT qid, min(rank) FILTER (package_id = want) AS best, count(*) FILTER (package_id = want) AS hits FROM {RANKED} WHERE rank <= 20 GROUP BY qid)"


def best_hits(t: Tables) -> DataFrame:
    """Per query of the set that grows with the table: the best rank of its own package among its 20 nearest rows, and how many of them are its own."""
    index, asked = vector_table(t)
    found = vector_index.search(index, asked, "vec_id", "vector", k=20, exact=True)
    hits = found.join(t.fx_vector.select(F.col("vec_id").alias("id"), "package_id"), "id").join(asked.select(F.col("vec_id").alias("qid"), F.col("package_id").alias("want")), "qid")
    same = F.col("package_id") == F.col("want")
    return hits.groupBy("qid").agg(F.min(F.when(same, F.col("rank"))).alias("best"), F.count_if(same).alias("hits"))


MRR, RECALL = "round(avg(coalesce(1.0 / best, 0)), 6) AS mrr", "round(avg(CASE WHEN best IS NULL THEN 0 ELSE 1 END), 6) AS recall"


def rank_means() -> tuple[Column, Column]:
    """Mean reciprocal rank and recall over best."""
    return F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("best").isNull(), 0).otherwise(1)), 6).alias("recall")


@query("search_quality", f"WITH {BEST} SELECT {MRR}, {RECALL} FROM b")
def _(t: Tables) -> DataFrame:
    """MRR and recall at 20 of every row whose id is divisible by 50, against all rows."""
    return best_hits(t).agg(*rank_means())


@query("retrieval_quality", f"WITH {BEST} SELECT count(*) AS queries, {MRR}, {RECALL}, round(avg(hits / 20.0), 6) AS precision FROM b")
def _(t: Tables) -> DataFrame:
    """The same with the precision at 20 and the number of queries."""
    return best_hits(t).agg(rows_n().alias("queries"), *rank_means(), F.round(F.avg(F.col("hits") / 20), 6).alias("precision"))


# Licences: every part has an expression of one or two licences.

PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")
ID_ROWS = "(SELECT DISTINCT id, unnest(CASE WHEN expression IS NULL THEN [] WHEN id % 4 = 0 THEN [l1] ELSE [l1, l2] END) AS licence FROM fx_licence)"
LICENCE_ROWS = "(VALUES " + ", ".join(f"({a!r}, {str(b).lower()}, {d!r}, {e!r})" for a, b, _, d, e in licences.LICENCES) + ") l(licence, osi, copyleft, category)"
LISTED = "(" + ", ".join(repr(x) for x in PERMISSIVE) + ")"


def licence_ids(t: Tables) -> DataFrame:
    return t.fx_licence.select("id", F.explode(licences.spdx_ids("expression")).alias("licence"))


@query("spdx_parse", f"SELECT id, licence FROM {ID_ROWS}")
def _(t: Tables) -> DataFrame:
    return licence_ids(t)


@query("spdx_satisfied", f"SELECT id, CASE WHEN expression IS NULL THEN false WHEN id % 4 = 0 THEN l1 IN {LISTED} WHEN id % 4 = 2 THEN l1 IN {LISTED} AND l2 IN {LISTED} ELSE l1 IN {LISTED} OR l2 IN {LISTED} END AS satisfied FROM fx_licence")
def _(t: Tables) -> DataFrame:
    rows = licences.with_choice(t.fx_licence.select("id", "expression"), "expression", PERMISSIVE)
    return rows.select("id", F.col("choice").isNotNull().alias("satisfied"))


@query("spdx_choice", f"SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN l1 IN {LISTED} THEN l1 END WHEN id % 4 = 2 THEN CASE WHEN l1 IN {LISTED} AND l2 IN {LISTED} THEN l1 || ',' || l2 END WHEN l1 IN {LISTED} THEN l1 || CASE WHEN id % 4 = 3 THEN ' WITH Classpath-exception-2.0' ELSE '' END WHEN l2 IN {LISTED} THEN l2 END AS choice FROM fx_licence WHERE expression IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """The licences that an expression is used under: the first alternative from the left that is allowed as a whole."""
    rows = licences.with_choice(t.fx_licence.where("expression IS NOT NULL").select("id", "expression"), "expression", PERMISSIVE)
    return rows.select("id", F.array_join("choice", ",").alias("choice"))


HOUSE = licences.Policy("house", denied=("GPL-3.0-only",), denied_categories=("proprietary",), network=True, unknown=True)
OLD_NAMES = ("GPL-2.0-only", "LGPL-2.1-only")


@query("license_findings", f"WITH r AS (SELECT r.id, r.licence, l.category FROM {ID_ROWS} r LEFT JOIN {LICENCE_ROWS} ON l.licence = r.licence) SELECT id, licence, 'violation' AS kind, CASE WHEN licence = 'GPL-3.0-only' THEN 'denied_license' ELSE 'denied_category' END AS finding FROM r WHERE licence = 'GPL-3.0-only' OR category = 'proprietary' UNION ALL SELECT id, licence, 'warning', CASE WHEN category IS NULL THEN 'Unknown license ''' || licence || ''' - manual review recommended' ELSE 'License ''' || licence || ''' is deprecated' END FROM r WHERE category IS NULL OR licence IN ('GPL-2.0-only', 'LGPL-2.1-only')")
def _(t: Tables) -> DataFrame:
    """Violations and warnings under a policy that denies a category, lets unknown licences pass and reports old names."""
    rows = licence_ids(t).join(F.broadcast(licences.table(t.spark)), "licence", "left")  # 16 rows
    found = F.concat(F.transform(licences.violations(HOUSE), lambda v: F.struct(F.lit("violation").alias("kind"), v.alias("finding"))), F.transform(licences.warnings(HOUSE, OLD_NAMES), lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("finding"))))
    return rows.select("id", "licence", F.explode(found).alias("f")).select("id", "licence", "f.kind", "f.finding")


DENIED = "(" + ", ".join(repr(x) for x in licences.DENIED) + ")"


@query("license_policy", f"WITH r AS (SELECT r.id, r.licence, l.osi, l.copyleft, l.category FROM {ID_ROWS} r LEFT JOIN {LICENCE_ROWS} ON l.licence = r.licence) SELECT id, policy, licence, violation FROM (SELECT id, licence, 'default' AS policy, CASE WHEN category IS NULL THEN ['unknown_license'] WHEN copyleft = 'network' THEN ['network_copyleft_not_allowed'] ELSE [] END AS v FROM r UNION ALL SELECT id, licence, 'permissive-only', CASE WHEN category IS NULL THEN ['unknown_license'] WHEN copyleft = 'network' THEN ['network_copyleft_not_allowed'] WHEN copyleft <> 'none' THEN ['copyleft_not_allowed'] ELSE [] END FROM r UNION ALL SELECT id, licence, 'enterprise', CASE WHEN licence IN {DENIED} THEN ['denied_license'] WHEN category IS NULL THEN ['unknown_license'] ELSE list_concat(CASE WHEN copyleft = 'network' THEN ['network_copyleft_not_allowed'] ELSE [] END, CASE WHEN NOT osi THEN ['not_osi_approved'] ELSE [] END) END FROM r) x, unnest(v) u(violation)")
def _(t: Tables) -> DataFrame:
    """The violations of three policies, each licence met with the reference table once."""
    rows = licence_ids(t).join(F.broadcast(licences.table(t.spark)), "licence", "left")  # 16 rows
    found = F.array(*[F.struct(F.lit(p.name).alias("policy"), licences.violations(p).alias("v")) for p in licences.POLICIES])
    return rows.select("id", "licence", F.explode(found).alias("p")).select("id", "licence", "p.policy", F.explode("p.v").alias("violation"))


@query("license_validate_simple", "SELECT id, CASE WHEN expression LIKE '%AGPL%' THEN 'network' WHEN expression LIKE '%GPL-3%' THEN 'gpl3' WHEN expression LIKE '%GPL%' THEN 'gpl' ELSE 'ok' END AS verdict FROM fx_licence")
def _(t: Tables) -> DataFrame:
    e = F.col("expression")
    return t.fx_licence.select("id", F.when(e.contains("AGPL"), "network").when(e.contains("GPL-3"), "gpl3").when(e.contains("GPL"), "gpl").otherwise("ok").alias("verdict"))


@query("license_scan", "WITH d AS (SELECT d.version_id, l.expression FROM fx_depends_on d JOIN fx_licence l ON d.package_id = 'part:' || l.id) SELECT version_id AS id, count(*) AS total, count(*) FILTER (contains(expression, 'GPL')) AS copyleft, count(*) FILTER (NOT contains(expression, 'GPL')) AS permissive, count(*) FILTER (expression IS NULL) AS unknown, coalesce(string_agg(DISTINCT expression, ';' ORDER BY expression), '') AS licences, count(*) FILTER (contains(expression, 'AGPL')) AS violations FROM d GROUP BY version_id")
def _(t: Tables) -> DataFrame:
    """The licences of each version's dependencies: counts, the distinct ones in order, and what an enterprise policy forbids."""
    own = t.fx_licence.select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("package_id"), "expression")
    e = F.col("expression")
    by = t.fx_depends_on.join(own, "package_id").groupBy(F.col("version_id").alias("id"))
    return by.agg(F.count(F.lit(1)).alias("total"), F.count_if(e.contains("GPL")).alias("copyleft"), F.count_if(~e.contains("GPL")).alias("permissive"), F.count_if(e.isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_set(e)), ";").alias("licences"), F.count_if(e.contains("AGPL")).alias("violations"))


# Vulnerabilities, risk and policy.

COUNTS = "(SELECT package_id, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l FROM fx_vuln GROUP BY package_id)"


def severity_counts(t: Tables) -> DataFrame:
    s = F.col("severity")
    return t.fx_vuln.groupBy("package_id").agg(*[F.count_if(s == name).alias(k) for k, name in (("c", "CRITICAL"), ("h", "HIGH"), ("m", "MEDIUM"), ("l", "LOW"))])


query("vuln_severity_counts", f"SELECT * FROM {COUNTS}")(severity_counts)


@query("cvss_severity", "SELECT id, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss > 0 THEN 'low' ELSE 'unknown' END AS label FROM fx_vuln")
def _(t: Tables) -> DataFrame:
    c = F.col("cvss")
    return t.fx_vuln.select("id", F.when(c >= 9, "critical").when(c >= 7, "high").when(c >= 4, "medium").when(c > 0, "low").otherwise("unknown").alias("label"))


RISK = "least(100, CASE WHEN exploit THEN 40 * greatest(epss, 0.5) ELSE 0 END + least(epss * 15 + CASE WHEN exploit THEN 10 ELSE 0 END, 25) + 12 + 8 + cvss * 1.5)"


def risk(reachable: Column, confidence: Column, epss: Column, exploit: Column, prod: Column, public: Column, cvss: Column) -> Column:
    """0 to 100: reachability, exploit likelihood, exposure and CVSS."""
    flag = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    parts = F.when(reachable, 40 * F.greatest(confidence, F.lit(0.5))).otherwise(0.0) + F.least(epss * 15 + flag(exploit, 10), F.lit(25.0)) + flag(prod, 12) + flag(public, 8) + cvss * 1.5
    return F.least(F.lit(100.0), parts)


@query("risk_score", f"SELECT id, round({RISK}, 4) AS score, CASE WHEN floor({RISK}) >= 75 THEN 'Critical' WHEN floor({RISK}) >= 50 THEN 'High' WHEN floor({RISK}) >= 25 THEN 'Medium' ELSE 'Low' END AS label FROM fx_vuln")
def _(t: Tables) -> DataFrame:
    epss = F.col("epss").cast("double")
    s = risk(F.col("exploit"), epss, epss, F.col("exploit"), F.lit(True), F.lit(True), F.col("cvss"))
    k = F.floor(s)
    return t.fx_vuln.select("id", F.round(s, 4).alias("score"), F.when(k >= 75, "Critical").when(k >= 50, "High").when(k >= 25, "Medium").otherwise("Low").alias("label"))


OSV = "affected array<struct<ecosystem_specific struct<severity string>>>, database_specific struct<severity string>, severity array<struct<type string, score string>>, aliases array<string>, id string"


@query("osv_severity", """SELECT id, coalesce(lower(list_filter(json_extract_string(doc, '$.affected[*].ecosystem_specific.severity'), lambda x: x IS NOT NULL)[1]), lower(json_extract_string(doc, '$.database_specific.severity')), CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss > 0 THEN 'low' END, 'unknown') AS severity FROM (SELECT id, doc, list_filter(list_transform(list_filter(json_extract(doc, '$.severity[*]'), lambda s: contains(json_extract_string(s, '$.type'), 'CVSS')), lambda s: TRY_CAST(json_extract_string(s, '$.score') AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS cvss FROM fx_osv)""")
def _(t: Tables) -> DataFrame:
    """In lower case, the first of: the severity of an affected entry that has one, the database's, the first CVSS score that is a number."""
    d = t.fx_osv.select("id", F.from_json("doc", OSV).alias("d"))
    given = F.filter(F.transform("d.affected", lambda a: a["ecosystem_specific"]["severity"]), lambda x: x.isNotNull())
    scores = F.transform(F.filter("d.severity", lambda s: s["type"].contains("CVSS")), lambda s: s["score"].try_cast("double"))
    cvss = F.get(F.filter(scores, lambda x: x.isNotNull()), F.lit(0))
    label = F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").when(cvss > 0, "low").otherwise("unknown")
    return d.select("id", F.coalesce(F.lower(F.get(given, F.lit(0))), F.lower("d.database_specific.severity"), label).alias("severity"))


@query("osv_primary_id", "SELECT id, coalesce(list_filter(aliases, lambda a: starts_with(a, 'CVE-'))[1], aliases[1], json_extract_string(doc, '$.id')) AS primary_id FROM (SELECT id, doc, json_extract_string(doc, '$.aliases[*]') AS aliases FROM fx_osv)")
def _(t: Tables) -> DataFrame:
    d = t.fx_osv.select("id", F.from_json("doc", OSV).alias("d"))
    cve = F.filter("d.aliases", lambda a: a.startswith("CVE-"))
    return d.select("id", F.coalesce(F.get(cve, F.lit(0)), F.get("d.aliases", F.lit(0)), "d.id").alias("primary_id"))


@query("vuln_list", "SELECT id, cvss FROM fx_vuln WHERE severity IN ('CRITICAL', 'HIGH') AND exploit AND 10 * cvss + 5 * epss >= 72 ORDER BY cvss DESC, id LIMIT 50 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return t.fx_vuln.where(F.col("severity").isin("CRITICAL", "HIGH") & F.col("exploit") & (10 * F.col("cvss") + 5 * F.col("epss") >= 72)).orderBy(F.desc("cvss"), "id").offset(5).limit(50).select("id", "cvss")


@query("parse_package_id", "SELECT id, split_part(id, ':', 1) AS ecosystem, split_part(id, ':', 2) AS name FROM fx_package")
def _(t: Tables) -> DataFrame:
    at = F.instr("id", ":")
    return t.fx_package.select("id", F.substr("id", F.lit(1), at - 1).alias("ecosystem"), F.substr("id", at + 1).alias("name"))


@query("compliance_score", f"SELECT package_id, 100 - least(100, 20 * c + 10 * h + 5 * m + l) AS score, c > 0 OR h > 5 AS violates FROM {COUNTS}")
def _(t: Tables) -> DataFrame:
    return severity_counts(t).select("package_id", (100 - F.least(F.lit(100), F.expr("20 * c + 10 * h + 5 * m + l"))).alias("score"), F.expr("c > 0 OR h > 5").alias("violates"))


@query("policy_ui_score", f"SELECT package_id, CAST(greatest(0, floor(100.0 * m / (m + h + 1) - 50.0 * h / (m + h + 1) + 0.5)) AS BIGINT) AS score FROM {COUNTS}")
def _(t: Tables) -> DataFrame:
    return severity_counts(t).select("package_id", F.greatest(F.lit(0), F.floor(F.expr("100.0D * m / (m + h + 1) - 50.0D * h / (m + h + 1) + 0.5D"))).cast("long").alias("score"))


# VEX.

VEX = "(SELECT event_id AS id, 'CVE-' || CAST(event_id % 40 AS VARCHAR) AS vuln, 'user:' || CAST(user_id AS VARCHAR) AS product, CASE event_type WHEN 'purchase' THEN 'affected' WHEN 'signup' THEN 'fixed' WHEN 'error' THEN 'under_investigation' ELSE 'not_affected' END AS status, ts FROM events)"


def vex(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM {VEX.replace('VARCHAR', 'STRING').replace('FROM events', 'FROM {events}')}", events=t.events)


JUSTIFIED = "CASE WHEN status = 'not_affected' THEN CASE id % 3 WHEN 0 THEN 'component_not_present' WHEN 1 THEN 'vulnerable_code_not_present' ELSE 'vulnerable_code_not_in_execute_path' END END"


@query("vex_statistics", f"SELECT status, {JUSTIFIED} AS justification, count(*) AS n FROM {VEX} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("component_not_present", "vulnerable_code_not_present", "vulnerable_code_not_in_execute_path")])
    why = F.when(F.col("status") == "not_affected", F.element_at(names, (F.col("id") % 3 + 1).cast("int")))
    return vex(t).groupBy("status", why.alias("justification")).agg(rows_n())


LAST_VEX = f"(SELECT vuln, product, max_by(status, (ts, id)) AS status FROM {VEX} GROUP BY vuln, product)"


def last_vex(t: Tables) -> DataFrame:
    return vex(t).groupBy("vuln", "product").agg(F.max_by("status", F.struct("ts", "id")).alias("status"))


@query("vex_lookup", f"SELECT vuln, product, status, 'VEX-' || vuln || '-' || product AS statement_id, CASE status WHEN 'not_affected' THEN 'not_exploitable' WHEN 'affected' THEN 'exploitable' WHEN 'fixed' THEN 'fixed' ELSE 'unknown' END AS exploitability FROM {LAST_VEX}")
def _(t: Tables) -> DataFrame:
    s = F.col("status")
    verdict = F.when(s == "not_affected", "not_exploitable").when(s == "affected", "exploitable").when(s == "fixed", "fixed").otherwise("unknown")
    return last_vex(t).select("vuln", "product", "status", F.concat_ws("-", F.lit("VEX"), "vuln", "product").alias("statement_id"), verdict.alias("exploitability"))


@query("vex_coverage", f"SELECT vuln, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (status IN ('not_affected', 'fixed')) / count(*) + 0.5) AS BIGINT) AS coverage FROM {LAST_VEX} GROUP BY vuln")
def _(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return last_vex(t).groupBy("vuln").agg(n.alias("n"), F.floor(100.0 * F.count_if(F.col("status").isin("not_affected", "fixed")) / n + 0.5).cast("long").alias("coverage"))


@query("vex_exploitability", "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'under_investigation' WHEN event_id % 2 = 0 AND (event_id % 7 = 0 OR event_id % 3 = 0 OR event_id % 4 IN (1, 2) OR event_id % 4 = event_id % 5) THEN 'affected' ELSE 'not_affected' END AS status FROM events")
def _(t: Tables) -> DataFrame:
    """Whether an advisory hits a product: some affected entry has its ecosystem and name in any case, and its version or no list of versions; a product without a version is hit by the name."""
    k = F.col("event_id")
    version = F.when(k % 7 != 0, (k % 4).cast("string"))
    versions = F.when(k % 3 != 0, F.array(F.lit("1"), F.lit("2"), (k % 5).cast("string")))
    entry = F.struct(F.upper("event_type").alias("ecosystem"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("name"), versions.alias("versions"))
    other = F.struct(F.lit("npm").alias("ecosystem"), F.lit("other").alias("name"), F.lit(None).cast("array<string>").alias("versions"))
    rows = t.events.select(k.alias("id"), F.col("event_type").alias("ecosystem"), F.concat(F.lit("user"), (F.col("user_id") + k % 2).cast("string")).alias("name"), version.alias("version"), F.when(k % 11 != 0, F.array(other, entry)).alias("affected"))

    def hit(a: Column) -> Column:
        same = (F.lower(a["ecosystem"]) == F.lower("ecosystem")) & (F.lower(a["name"]) == F.lower("name"))
        return same & (F.col("version").isNull() | a["versions"].isNull() | F.coalesce(F.array_contains(a["versions"], F.col("version")), F.lit(False)))

    status = F.when(F.col("affected").isNull(), "under_investigation").when(F.exists("affected", hit), "affected").otherwise("not_affected")
    return rows.select("id", status.alias("status"))


@query("slsa_verify", "WITH d AS (SELECT package_id, payload AS p, json_extract(payload, '$.subject[*]') AS s FROM fx_provenance WHERE json_valid(payload)), c AS (SELECT package_id, coalesce(json_extract_string(p, '$._type'), json_extract_string(p, '$.statementType'), 'https://in-toto.io/Statement/v1') = 'https://in-toto.io/Statement/v1' AS a, coalesce(json_extract_string(p, '$.predicateType'), 'https://slsa.dev/provenance/v1') = 'https://slsa.dev/provenance/v1' AS b, len(s) > 0 AS c, len(list_filter(s, lambda x: json_extract_string(x, '$.digest.sha256') IS NULL)) = 0 AS d, coalesce(json_extract_string(p, '$.predicate.builder.id'), 'unknown') = 'https://ci.test/runner' AS e, json_extract_string(p, '$.predicate.metadata.buildStartedOn') IS NOT NULL AS f FROM d) SELECT package_id AS id, CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) + CAST(d AS BIGINT) + CAST(e AS BIGINT) + CAST(f AS BIGINT) AS passed, CASE WHEN a AND b AND c AND d AND e AND f THEN 2 ELSE 0 END AS level, a AND b AND c AND d AND e AND f AS valid FROM c")
def _(t: Tables) -> DataFrame:
    found = documents.verified(t.fx_provenance, "package_id", "payload", trusted=("https://ci.test/runner",))
    return found.select(F.col("package_id").alias("id"), "passed", "level", "valid")


# Bills of materials.


@query("purl", "SELECT id, 'pkg:' || CASE ecosystem WHEN 'part' THEN 'cargo' WHEN 'customer' THEN 'npm' ELSE 'pypi' END || '/' || regexp_replace(name_lc, '[^a-z0-9.-]+', '-', 'g') AS purl FROM fx_package")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("ecosystem") == "part", "cargo").when(F.col("ecosystem") == "customer", "npm").otherwise("pypi")
    return t.fx_package.select("id", F.concat(F.lit("pkg:"), kind, F.lit("/"), F.regexp_replace("name_lc", "[^a-z0-9.-]+", "-")).alias("purl"))


@query("sbom_counts", "SELECT version_id AS id, count(*) + 1 AS components FROM fx_depends_on GROUP BY version_id")
def _(t: Tables) -> DataFrame:
    return t.fx_depends_on.groupBy(F.col("version_id").alias("id")).agg((F.count(F.lit(1)) + 1).alias("components"))


# Updates.

#: Every part has an installed release k % 4 and a newest one of major number 2.
UPDATES = f"(SELECT 'part:' || p_partkey AS package_id, coalesce(c + h + m + l, 0) AS vulns, p_partkey % 4 < 2 AS is_major FROM part LEFT JOIN {COUNTS} v ON v.package_id = 'part:' || p_partkey)"
URGENCY = "CASE WHEN vulns > 0 AND is_major THEN 'critical' WHEN vulns > 0 THEN 'high' WHEN is_major THEN 'medium' ELSE 'low' END"


def urgency(t: Tables) -> DataFrame:
    """Vulnerabilities and a higher major number together are critical, the one alone high, the other medium."""
    key = F.col("p_partkey")
    parts = t.part.select(F.concat(F.lit("part:"), key.cast("string")).alias("package_id"), F.concat_ws(".", (key % 4).cast("string"), (key % 3).cast("string"), F.lit("0")).alias("old"))
    rows = parts.join(t.fx_vuln.groupBy("package_id").agg(rows_n()), "package_id", "left")
    vulns, major = F.coalesce("n", F.lit(0)), text.semver(F.lit("2.1.0"))["major"] > text.semver(F.col("old"))["major"]
    level = F.when((vulns > 0) & major, "critical").when(vulns > 0, "high").when(major, "medium").otherwise("low")
    return rows.select("package_id", vulns.alias("vulns"), major.alias("is_major"), level.alias("urgency"))


@query("update_urgency", f"SELECT package_id, {URGENCY} AS urgency, CASE WHEN vulns > 0 THEN 'security,' ELSE '' END || CASE WHEN is_major THEN 'end_of_life' ELSE 'major_bug_fix' END AS reasons FROM {UPDATES}")
def _(t: Tables) -> DataFrame:
    reasons = F.concat_ws(",", F.when(F.col("vulns") > 0, "security"), F.when(F.col("is_major"), "end_of_life").otherwise("major_bug_fix"))
    return urgency(t).select("package_id", "urgency", reasons.alias("reasons"))


@query("update_ranked", f"SELECT package_id FROM (SELECT package_id, vulns, {URGENCY} AS urgency FROM {UPDATES}) ORDER BY CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, vulns > 0 DESC, vulns DESC, package_id LIMIT 25")
def _(t: Tables) -> DataFrame:
    u = F.col("urgency")
    rank = F.when(u == "critical", 0).when(u == "high", 1).when(u == "medium", 2).otherwise(3)
    return urgency(t).orderBy(rank, (F.col("vulns") > 0).desc(), F.desc("vulns"), "package_id").limit(25).select("package_id")


@query("update_totals", f"SELECT count(*) AS total, count(*) FILTER (vulns > 0) AS security, count(*) FILTER (is_major) AS breaking, count(*) FILTER (vulns > 0 AND is_major) AS critical FROM {UPDATES}")
def _(t: Tables) -> DataFrame:
    return urgency(t).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("vulns") > 0).alias("security"), F.count_if("is_major").alias("breaking"), F.count_if(F.col("urgency") == "critical").alias("critical"))


@query("impact_label", "SELECT dst AS id, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'critical' WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' WHEN count(*) >= 5 THEN 'low' ELSE 'minimal' END AS label FROM fx_depends_on_pkg GROUP BY dst")
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.fx_depends_on_pkg.groupBy(F.col("dst").alias("id")).agg(rows_n()).withColumn("label", F.when(n >= 100, "critical").when(n >= 50, "high").when(n >= 20, "medium").when(n >= 5, "low").otherwise("minimal"))


@query("ecosystem_share", "SELECT ecosystem, count(*) AS n, CAST(floor(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * (SELECT count(*) FROM fx_version) + 0.5) AS BIGINT) AS versions FROM fx_package GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    by = t.fx_package.groupBy("ecosystem").agg(rows_n())
    total = by.agg(F.sum("n").alias("total")).crossJoin(t.fx_version.agg(F.count(F.lit(1)).alias("v")))  # one row each
    return by.crossJoin(F.broadcast(total)).select("ecosystem", "n", F.floor(F.col("n") / F.col("total") * F.col("v") + 0.5).cast("long").alias("versions"))


# API snapshots: the lines of about a hundred orders are the symbols of a package, before and after.

SYMBOL = "SELECT DISTINCT 'pkg' || CAST(CAST(floor(l_orderkey / 100) AS BIGINT) AS VARCHAR) AS pkg, 'mod' || CAST(l_orderkey % 5 AS VARCHAR) || '.fn_' || CAST({key} AS VARCHAR) AS path, 'fn_' || CAST({key} AS VARCHAR) AS name, l_returnflag AS kind, 'fn(a: T' || CAST({key} % 6 AS VARCHAR) || ', b: ' || CASE l_linestatus WHEN 'O' THEN 'String' ELSE 'Bytes' END || ')' AS signature FROM lineitem"
SYMBOLS_OLD = f"({SYMBOL.format(key='l_partkey')})"
SYMBOLS_NEW = f"({SYMBOL.format(key='(l_partkey + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END)')} WHERE l_partkey % 17 <> 0)"
GONE = f"(SELECT * FROM {SYMBOLS_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {SYMBOLS_NEW} n WHERE n.pkg = o.pkg AND n.path = o.path))"


def symbols(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM {sql.replace('VARCHAR', 'STRING').replace('FROM lineitem', 'FROM {lineitem}')}", lineitem=t.lineitem)


def removed(t: Tables) -> DataFrame:
    """Symbols of paths that the new snapshot does not have."""
    return symbols(t, SYMBOLS_OLD).join(symbols(t, SYMBOLS_NEW), ["pkg", "path"], "left_anti")


@query("api_removed", f"SELECT pkg, path, kind, signature FROM {GONE}")
def _(t: Tables) -> DataFrame:
    return removed(t).select("pkg", "path", "kind", "signature")


LIKE = "CASE WHEN g.{0} = n.{0} THEN 1.0::DOUBLE ELSE 1 - levenshtein(g.{0}, n.{0})::DOUBLE / greatest(strlen(g.{0}), strlen(n.{0})) END"


def renamed(t: Tables) -> DataFrame:
    """The best match of each removed symbol among all new symbols of its package and kind: 0.4 by name, 0.6 by signature, 0.7 at least.

    Lines are dealt by package once, as numbers; what both snapshots hold is told
    apart in the tasks, and only then symbols become text.
    """
    kept = F.col("key") % 17 != 0
    moved = F.col("key") + F.when(F.col("key") % 10 == 0, 1).otherwise(0)
    lines = t.lineitem.select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("p"), (F.col("l_orderkey") % 5).cast("int").alias("m"), F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("o"))
    pkg = F.concat(F.lit("pkg"), F.col("p").cast("string")).alias("pkg")
    sizes = lines.groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n")).select(pkg, "kind", "n")
    both = F.explode(F.array(F.struct("key", F.lit(True).alias("old"), F.lit(False).alias("new")), F.struct(F.when(kept, moved).alias("key"), F.lit(False).alias("old"), kept.alias("new")))).alias("x")
    each = lines.repartition(8 * lines.rdd.getNumPartitions(), "p").select("p", "m", "kind", F.coalesce("o", F.lit(False)).alias("o"), both).select("p", "m", "kind", "o", "x.*").where("key IS NOT NULL")
    # One sort serves all three; no table of the symbols is held.
    same = Window.partitionBy("p", "m", "key", "kind", "o")
    each = each.withColumn("again", F.lag(F.lit(1)).over(same.orderBy("old"))).withColumns({"old": F.max("old").over(same), "new": F.max("new").over(same)})
    each = each.withColumn("gone", F.col("old") & ~F.max("new").over(Window.partitionBy("p", "m", "key"))).where("again IS NULL")
    name = F.concat(F.lit("fn_"), F.col("key").cast("string"))
    return renames.best(each.select(
        pkg, F.concat(F.lit("mod"), F.col("m").cast("string"), F.lit("."), name).alias("path"), name.alias("name"), "kind",
        F.concat(F.lit("fn(a: T"), (F.col("key") % 6).cast("string"), F.lit(", b: "), F.when(F.col("o"), "String").otherwise("Bytes"), F.lit(")")).alias("signature"), "gone", "new",
    ), sizes)


def best_of(gone: DataFrame, new: DataFrame) -> DataFrame:
    """The same of two tables of symbols."""
    tagged = lambda rows, is_new: rows.select("pkg", "kind", "path", "name", "signature", F.lit(not is_new).alias("gone"), F.lit(is_new).alias("new")).distinct()
    return renames.best(tagged(gone, False).unionByName(tagged(new, True)))


query("api_renamed", f"WITH gone AS (SELECT * FROM {GONE}), m AS (SELECT g.pkg, g.path, g.kind, g.signature, n.path AS new_path, round(0.4 * {LIKE.format('name')} + 0.6 * {LIKE.format('signature')}, 9) AS sim FROM gone g JOIN {SYMBOLS_NEW} n ON n.pkg = g.pkg AND n.kind = g.kind) SELECT pkg, path, kind, signature, arg_min(new_path, (-sim, new_path)) AS new_path FROM m WHERE sim >= 0.7 GROUP BY pkg, path, kind, signature")(renamed)


@query("string_similarity", "SELECT a.s_suppkey AS id, round(1 - levenshtein(a.s_name, b.s_name)::DOUBLE / greatest(strlen(a.s_name), strlen(b.s_name)), 6) AS sim FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def _(t: Tables) -> DataFrame:
    b = t.supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("other"))
    return t.supplier.join(b, "s_suppkey").select(F.col("s_suppkey").alias("id"), F.round(1 - F.levenshtein("s_name", "other") / F.greatest(F.octet_length("s_name"), F.octet_length("other")), 6).alias("sim"))


# Parameters: an order's lines are those of its function; the old one has lines 1 to 4, the new one those from 2.

PARAMS = "(SELECT l_orderkey AS id, l_linenumber AS name, min(l_returnflag) AS old_type, max(l_returnflag) AS new_type, bool_or(l_quantity > 40) AS is_optional, bool_or(l_discount > 0.08) AS has_default FROM lineitem GROUP BY 1, 2)"
PARAM_CHANGES = f"(SELECT id, name, CASE WHEN name >= 5 THEN CASE WHEN is_optional OR has_default THEN 'signature_changed' ELSE 'required_parameter_added' END WHEN name < 2 THEN 'parameter_removed' ELSE 'parameter_type_changed' END AS change, CASE WHEN name >= 5 AND (is_optional OR has_default) THEN 'info' ELSE 'breaking' END AS severity FROM {PARAMS} WHERE name >= 5 OR name < 2 OR old_type <> new_type)"


def param_changes(t: Tables) -> DataFrame:
    """Old and new parameters meet by name; a type that is null on both sides has not changed."""
    by = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("name")).agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"), F.bool_or(F.col("l_quantity") > 40).alias("is_optional"), F.bool_or(F.col("l_discount") > 0.08).alias("has_default"))
    old = by.where("name <= 4").select("id", "name", F.struct(F.col("a").alias("type")).alias("o"))
    new = by.where("name >= 2").select("id", "name", F.struct(F.col("b").alias("type"), "is_optional", "has_default").alias("n"))
    o, n = F.col("o"), F.col("n")
    free = n["is_optional"] | n["has_default"]
    change = F.when(o.isNull(), F.when(free, "signature_changed").otherwise("required_parameter_added")).when(n.isNull(), "parameter_removed").when(~o["type"].eqNullSafe(n["type"]), "parameter_type_changed")
    severity = F.when(o.isNull() & free, "info").otherwise("breaking")
    return old.join(new, ["id", "name"], "full_outer").select("id", "name", change.alias("change"), severity.alias("severity")).where("change IS NOT NULL")


query("param_diff", f"SELECT * FROM {PARAM_CHANGES}")(param_changes)

RETURNS = "(SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderstatus ELSE 'O' END AS old_type, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderstatus ELSE 'F' END AS new_type, 'T: ' || o_orderstatus AS old_generics, 'T: ' || CASE WHEN o_orderkey % 5 = 0 THEN 'Copy' ELSE o_orderstatus END AS new_generics FROM orders)"
RETURN_CHANGES = f"(SELECT id, 'return_type_changed' AS change, CASE WHEN old_type IS NULL THEN 'warning' ELSE 'breaking' END AS severity FROM {RETURNS} WHERE old_type IS DISTINCT FROM new_type UNION ALL SELECT id, 'generic_constraints_changed', 'warning' FROM {RETURNS} WHERE old_generics <> new_generics)"


def return_changes(t: Tables) -> DataFrame:
    """A return type where there was none is a warning, any other change breaks; changed generics are a warning."""
    rows = t.spark.sql(f"SELECT * FROM {RETURNS.replace('FROM orders', 'FROM {orders}')}", orders=t.orders)
    a, b = F.col("old_type"), F.col("new_type")
    kinds = F.array(
        F.when(~a.eqNullSafe(b), F.struct(F.lit("return_type_changed").alias("change"), F.when(a.isNull(), "warning").otherwise("breaking").alias("severity"))),
        F.when(~F.col("old_generics").eqNullSafe(F.col("new_generics")), F.struct(F.lit("generic_constraints_changed").alias("change"), F.lit("warning").alias("severity"))),
    )
    return rows.select("id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("id", "k.*")


query("return_type_changes", f"SELECT * FROM {RETURN_CHANGES}")(return_changes)


@query("visibility_reduced", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 1 END AS old_level, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 5 END AS new_level FROM orders WHERE CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 5 END < CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 1 END")
def _(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(s == "F", 5).when(s == "O", 3).otherwise(1).alias("old_level"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(5).alias("new_level"))
    return rows.where("new_level < old_level")


@query("api_hash", "SELECT l_orderkey AS id, sha256(string_agg(path || '|' || flag, ';' ORDER BY path)) AS api_hash FROM (SELECT l_orderkey, 'fn_' || CAST(l_partkey AS VARCHAR) AS path, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_partkey) GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy("l_orderkey", F.concat(F.lit("fn_"), F.col("l_partkey").cast("string")).alias("path")).agg(F.max("l_returnflag").alias("flag"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "flag"))), lambda s: F.concat_ws("|", s["path"], s["flag"])), ";")
    return last.groupBy(F.col("l_orderkey").alias("id")).agg(F.sha2(joined.cast("binary"), 256).alias("api_hash"))


@query("change_summary", f"SELECT severity, count(*) AS n FROM (SELECT severity FROM {PARAM_CHANGES} UNION ALL SELECT severity FROM {RETURN_CHANGES} UNION ALL SELECT 'breaking' FROM {GONE}) GROUP BY severity")
def _(t: Tables) -> DataFrame:
    """All changes by severity; a removed symbol breaks, renamed or not."""
    gone = removed(t).select(F.lit("breaking").alias("severity"))
    return param_changes(t).select("severity").unionByName(return_changes(t).select("severity")).unionByName(gone).groupBy("severity").agg(rows_n())


RAW_SIGNATURE = "'fn  t(  ' || text || '  ,  b:' || chr(9) || coalesce(source, '') || '  )  '"


@query("normalize_signature", f"SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({RAW_SIGNATURE}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '[(] ', '(', 'g'), ' [)]', ')', 'g'), ' ,', ',', 'g') AS signature FROM documents")
def _(t: Tables) -> DataFrame:
    """White space runs are one blank, none inside brackets or before commas; the texts are the parameters."""
    raw = F.concat(F.lit("fn  t(  "), "text", F.lit("  ,  b:\t"), F.coalesce("source", F.lit("")), F.lit("  )  "))
    return t.documents.select(F.col("doc_id").alias("id"), text.normal_signature(raw).alias("signature"))


@query("lang_by_ext", "SELECT doc_id AS id, CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END AS language FROM (SELECT doc_id, 'src/' || source || CASE n_chars % 11 WHEN 0 THEN '.rs' WHEN 1 THEN '.d.ts' WHEN 2 THEN '.py.txt' WHEN 3 THEN '.jsx' WHEN 4 THEN '.tsx' WHEN 5 THEN '.py' WHEN 6 THEN '.go' WHEN 7 THEN '/java' WHEN 8 THEN '.java' WHEN 9 THEN '.js' ELSE '' END AS path FROM documents)")
def _(t: Tables) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".rs", ".d.ts", ".py.txt", ".jsx", ".tsx", ".py", ".go", "/java", ".java", ".js", "")])
    path = F.concat(F.lit("src/"), "source", F.element_at(ends, (F.col("n_chars") % 11 + 1).cast("int")))
    return t.documents.select(F.col("doc_id").alias("id"), text.language(path).alias("language"))


@query("dependency_diff", "WITH o AS (SELECT l_partkey AS name, min(l_suppkey % 4) AS major FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), n AS (SELECT l_partkey AS name, min(l_suppkey % 4) AS major FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'major' END AS change FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.major <> n.major")
def _(t: Tables) -> DataFrame:
    v = lambda line, c: t.lineitem.where(F.col("l_linenumber") == line).groupBy(F.col("l_partkey").alias("name")).agg(F.concat_ws(".", F.min(F.col("l_suppkey") % 4).cast("string"), F.lit("0.0")).alias(c))
    both = v(1, "o").join(v(2, "n"), "name", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise(text.bump(F.col("o"), F.col("n")))
    return both.select("name", change.alias("change")).where("change <> 'none'")


@query("semver_bump", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'major' WHEN o_orderkey % 13 <> 0 THEN 'minor' WHEN o_orderkey % 7 <> 0 THEN 'patch' ELSE 'none' END AS bump FROM orders")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), text.bump(F.lit("v0.0.0+b1"), F.concat_ws(".", (k % 5).cast("string"), (k % 13).cast("string"), (k % 7).cast("string"))).alias("bump"))


@query("is_prerelease", "SELECT version AS id, regexp_matches(lower(new_number || '.0' || new_tag || CASE n_lines % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN '+SNAPSHOT' ELSE '' END), 'alpha|beta|rc|pre|dev|snapshot|-') AS pre FROM fx_changelog")
def _(t: Tables) -> DataFrame:
    version = F.concat(F.col("new_number").cast("string"), F.lit(".0"), "new_tag", F.when(F.col("n_lines") % 5 == 0, "Alpha").when(F.col("n_lines") % 5 == 1, "+SNAPSHOT").otherwise(""))
    return t.fx_changelog.select(F.col("version").alias("id"), changes.has_any(F.lower(version), changes.PRE).alias("pre"))


@query("previous_version", "SELECT id, lag(version) OVER (PARTITION BY package_id ORDER BY published_at, id) AS previous FROM fx_version")
def _(t: Tables) -> DataFrame:
    return t.fx_version.select("id", F.lag("version").over(Window.partitionBy("package_id").orderBy("published_at", "id")).alias("previous"))


@query("extract_symbols_py", "SELECT doc_id AS id, unnest(['f' || CAST(doc_id AS VARCHAR), 'C' || CAST(doc_id AS VARCHAR)]) AS symbol FROM documents WHERE doc_id % 4 <> 0")
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 4 == 0, "def broken(").otherwise(F.concat(F.lit("def f"), k, F.lit("(a, b=1):\n    return a\n\nclass C"), k, F.lit(":\n    pass\n\ndef _hidden():\n    pass\n")))
    found = symbols_of.extract(t.documents.select(F.col("doc_id").alias("id"), F.lit("python").alias("language"), source.alias("source")), keep_broken=False)
    return found.where((F.col("path") == F.col("name")) & (F.col("visibility") == "public") & F.col("kind").isin("function", "class")).select("id", F.col("name").alias("symbol"))


@query("split_name_version", "SELECT id, name, CAST(id AS VARCHAR) || '.0' AS version FROM (SELECT p_partkey AS id, '@scope/' || CAST(p_partkey AS VARCHAR) AS name FROM part)")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("@scope/"), k, F.lit("@"), k, F.lit(".0"))
    return t.part.select(F.col("p_partkey").alias("id"), F.regexp_extract(line, r"^(@?[^@]+)@(.+)$", 1).alias("name"), F.regexp_extract(line, r"^(@?[^@]+)@(.+)$", 2).alias("version"))


@query("normalize_repo_url", "SELECT p_partkey AS id, 'example.org/team/repo' || CAST(p_partkey AS VARCHAR) AS repo FROM part")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("git+https://example.org/team/repo"), F.col("p_partkey").cast("string"), F.lit(".git#main"))
    return t.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.regexp_replace(raw, r"^(git\+)?(https?|ssh|git)://(git@)?(www\.)?", ""), r"(\.git)?(#.*)?/?$", "").alias("repo"))
