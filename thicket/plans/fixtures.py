"""Package-registry views over the relational tables.

Each view is one SELECT that Spark and the oracle read alike; queries build on
the views with DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LICENCE_NAMES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "SSPL-1.0", "BSL-1.0", "Unknown-1.0")


def chosen(index: str, names: tuple[str, ...]) -> str:
    """SQL: the name at an index."""
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


#: Kinds of audit events by category.
AUDIT_TYPES = {
    "security": "vulnerability_detected vulnerability_resolved vex_assessment_created vex_assessment_updated security_scan_initiated security_scan_completed",
    "access": "package_accessed sbom_generated sbom_exported report_generated",
    "data_change": "package_created package_updated package_deleted dependency_added dependency_removed",
    "configuration": "policy_created policy_updated policy_deleted policy_activated policy_deactivated setting_changed",
    "policy": "policy_evaluated policy_violation policy_exception",
    "authentication": "user_login user_logout user_login_failed token_issued token_revoked api_key_created api_key_revoked",
    "authorization": "permission_granted permission_revoked access_denied",
    "system": "system_startup system_shutdown service_health_check backup_created backup_restored",
    "compliance": "compliance_check_run compliance_violation compliance_report_generated license_scan_completed scorecard_assessment provenance_verified",
}
AUDIT_CATEGORY = {name: category for category, names in AUDIT_TYPES.items() for name in names.split()}
KINDS = (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
VIEWS = {
    "fx_package": " UNION ALL ".join(
        f"SELECT '{t}:' || CAST({k} AS STRING) AS id, '{t}' AS ecosystem, {n} AS name, lower({n}) AS name_lc, 'public' AS tenant_id, "
        + (f"CASE WHEN {k} % 97 = 0 THEN 1 END" if t in ("part", "customer") else "CAST(NULL AS INT)")
        + f" AS deleted_at FROM {t}"
        for t, k, n in KINDS
    ),
    "fx_version": "SELECT 'order:' || CAST(o_orderkey AS STRING) AS id, 'customer:' || CAST(o_custkey AS STRING) AS package_id, CAST(o_orderkey AS STRING) AS version, o_orderdate AS published_at, o_orderstatus = 'P' AS yanked FROM orders",
    "fx_depends_on": "SELECT 'order:' || CAST(l_orderkey AS STRING) AS version_id, 'part:' || CAST(l_partkey AS STRING) AS package_id, '>=' || CAST(min(l_linenumber) AS STRING) AS version_req FROM lineitem GROUP BY l_orderkey, l_partkey",
    "fx_depends_on_pkg": "SELECT DISTINCT 'customer:' || CAST(o_custkey AS STRING) AS src, 'part:' || CAST(l_partkey AS STRING) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " UNION ALL SELECT DISTINCT 'part:' || CAST(l_partkey AS STRING), 'supplier:' || CAST(l_suppkey AS STRING) FROM lineitem"
    " UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'nation:' || CAST(s_nationkey AS STRING) FROM supplier"
    " UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'region:' || CAST(n_regionkey AS STRING) FROM nation",
    "fx_cooc_pkg": "SELECT DISTINCT 'part:' || CAST(a.l_partkey AS STRING) AS src, 'part:' || CAST(b.l_partkey AS STRING) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey",
    "fx_package_event": "SELECT event_id, CASE WHEN value >= 50 THEN 'new_version' ELSE 'metadata' END AS event_type, 'user:' || CAST(user_id AS STRING) AS package_id, 'user ' || CAST(user_id AS STRING) AS package_name, event_type AS ecosystem, CAST(event_id AS STRING) AS version, ts AS published_at FROM events",
    "fx_analysis_result": "SELECT event_id, 'user:' || CAST(user_id AS STRING) AS package_id, CAST(event_id AS STRING) AS version, CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[1]' WHEN 2 THEN '[1,2]' ELSE '[1,2,3]' END AS breaking_changes, ts AS analyzed_at FROM events",
    "fx_audit_log": "SELECT event_id AS id, 'tenant' || CAST(user_id % 3 AS STRING) AS tenant_id, user_id, CASE event_type WHEN 'purchase' THEN 'POLICY_EVALUATION' WHEN 'error' THEN 'SECURITY_SCAN' WHEN 'signup' THEN 'COMPLIANCE_CHECK' ELSE upper(event_type) || '_EVENT' END AS action, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 404 WHEN 'click' THEN NULL ELSE 200 END AS status_code, ts AS created_at FROM events",
    "fx_vector": "SELECT vec_id, 'label:' || CAST(label AS STRING) AS package_id, CAST(label % 3 AS STRING) AS ecosystem, embedding AS vector FROM embeddings",
    "fx_changelog": "SELECT doc_id AS version, source AS package, lower(text) || CASE doc_id % 11 WHEN 1 THEN ' BREAKING CHANGE: removed x' WHEN 2 THEN ' Deprecated' WHEN 3 THEN ' Migration required' WHEN 4 THEN ' dropped; no longer supports' WHEN 5 THEN ' ⚠️ BREAKING: deleted, deleted, deleted, deleted' WHEN 6 THEN ' an incompatible change; see the Upgrade Guide' WHEN 7 THEN ' backwards-incompatible, migrate from v1' WHEN 8 THEN ' will be removed; action required' WHEN 9 THEN ' legacy api renamed' ELSE '' END AS changelog, CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id % 4 AS INT) END AS old_number, CAST(doc_id % 7 AS INT) AS new_number, CASE doc_id % 6 WHEN 1 THEN '-rc.1' WHEN 2 THEN 'beta2' WHEN 3 THEN '.dev3' ELSE '' END AS new_tag, CAST(doc_id % 3 AS INT) AS deps_removed, CAST(n_chars % 4 AS INT) AS deps_major, CAST(n_chars % 8 AS INT) AS api_removed, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS author_rate, CAST(n_chars % 15 AS INT) AS idle_days, n_chars AS n_lines FROM documents",
    "fx_repo": "SELECT 'part:' || CAST(p_partkey AS STRING) AS id, p_partkey % 11 = 0 AS has_binaries, p_partkey % 4 <> 0 AS is_protected, p_partkey % 2 = 0 OR p_size > 20 AS needs_pull, p_partkey % 3 = 0 AS needs_review, p_partkey % 5 < 3 AS needs_status, p_partkey % 7 = 1 AS binds_admins, p_size % 3 <> 0 AS has_ci, CASE p_size % 6 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'passing' WHEN 3 THEN 'in_progress' END AS badge, p_partkey % 5 <> 2 AS is_reviewed, p_size % 5 AS organisations, p_partkey % 13 = 0 AS has_danger, p_partkey % 8 = 0 AS has_updater, p_partkey % 9 = 0 AS has_other_updater, p_size % 10 = 0 AS has_fuzzing, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS licence, CASE WHEN p_partkey % 10 <> 9 THEN p_partkey % 500 END AS idle_days, p_size % 2 = 0 AS is_published, CAST(p_partkey % 12 AS DOUBLE) / 10 AS pinned_ratio, p_size % 7 < 2 AS has_sast, p_partkey % 3 <> 1 AS has_policy, CAST(p_size % 11 AS DOUBLE) / 10 AS signed_ratio, p_partkey % 4 <= 1 AS least_tokens, p_size % 13 AS vulnerabilities FROM part",
    "fx_context": "SELECT 'part:' || CAST(p_partkey AS STRING) AS id, p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'MIT' WHEN 1 THEN 'apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'LGPL-2.1' WHEN 4 THEN 'Proprietary' WHEN 5 THEN 'ISC' WHEN 6 THEN 'BSD-3-Clause' WHEN 7 THEN 'AGPL-3.0' END AS licence, p_partkey % 9 <> 4 AS osi_approved, p_partkey % 4 AS assessments, p_partkey % 2 = 0 AS has_sbom, p_partkey % 3 = 0 AS has_provenance, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 13 % 1500 END AS age_days, CASE WHEN p_partkey % 19 <> 0 THEN p_size % 15 END AS depth FROM part",
    "fx_osv": """SELECT event_id AS id, '{"id":"OSV-' || CAST(event_id AS STRING) || '",' || CASE event_type WHEN 'error' THEN '"affected":[{},{"ecosystem_specific":{"severity":"HIGH"}},{"ecosystem_specific":{"severity":"LOW"}}],' WHEN 'signup' THEN '"affected":[{"ecosystem_specific":{}}],' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '"database_specific":{"severity":"Moderate"},' ELSE '' END || CASE WHEN event_id % 4 = 1 THEN '"aliases":["GHSA-' || CAST(user_id AS STRING) || '","CVE-' || CAST(event_id AS STRING) || '"],' WHEN event_id % 4 = 2 THEN '"aliases":["GHSA-' || CAST(user_id AS STRING) || '"],' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN '"severity":[]}' ELSE '"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"},{"type":"OTHER","score":"9.9"},{"type":"CVSS_V2","score":"' || CAST(event_id % 11 AS STRING) || '.' || CAST(user_id % 10 AS STRING) || '"},{"type":"CVSS_V2","score":"1.0"}]}' END AS doc FROM events""",
    "fx_registry": """SELECT 'part:' || CAST(p_partkey AS STRING) AS id, CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'crates' END AS registry, CASE p_partkey % 3 WHEN 0 THEN '{' || CASE WHEN p_size % 5 <> 0 THEN '"dist-tags":{"latest":"1.' || CAST(p_size AS STRING) || '.0"},' ELSE '' END || '"versions":{"0.9.0":{"license":"ISC"},"1.' || CAST(p_size AS STRING) || '.0":{' || CASE p_size % 3 WHEN 0 THEN '"license":"MIT"' WHEN 1 THEN '"license":{"type":"Apache-2.0","url":"x"},"repository":{"type":"git","url":"git+https://git.test/r' || CAST(p_size AS STRING) || '.git"}' ELSE '"repository":"https://git.test/s.git"' END || '}},"license":{"type":"BSD-3-Clause"},"repository":"git+https://git.test/top"}' WHEN 1 THEN '{"info":{"license":"' || CASE p_size % 3 WHEN 0 THEN 'MIT License' WHEN 1 THEN ' ' ELSE '' END || '","classifiers":["Topic :: X"' || CASE WHEN p_size % 2 = 0 THEN ',"License :: OSI Approved","License :: Other"' ELSE '' END || '],' || CASE WHEN p_size % 4 = 0 THEN '"project_urls":{"Source":"https://git.test/' || p_brand || '"},' ELSE '' END || '"home_page":"' || CASE WHEN p_size % 4 = 1 THEN 'https://home.test' ELSE '' END || '","version":"3.' || CAST(p_size AS STRING) || '"}}' ELSE '{"crate":{"license":' || CASE WHEN p_size % 2 = 0 THEN '"MIT OR Apache-2.0"' ELSE 'null' END || ',"max_version":"' || CAST(p_size AS STRING) || '.0.1"}}' END AS doc FROM part""",
    "fx_licence": f"SELECT k AS id, l1, l2, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 THEN l1 WHEN k % 4 = 1 THEN l1 || ' OR ' || l2 WHEN k % 4 = 2 THEN '(' || l1 || ' AND ' || l2 || ')' ELSE l1 || ' WITH Classpath-exception-2.0 OR ' || l2 END AS expression FROM (SELECT p_partkey AS k, {chosen('p_partkey % 17', LICENCE_NAMES)} AS l1, {chosen('p_size % 17', LICENCE_NAMES)} AS l2 FROM part) x",
    "fx_audit_type": f"SELECT event_id AS id, {chosen('event_id % 48', (*AUDIT_CATEGORY, 'custom_export'))} AS kind FROM events",
    "fx_state_old": "SELECT 'customer:' || CAST(o_custkey AS STRING) AS package, CAST(o_orderkey AS STRING) AS version, o_orderstatus = 'P' AS yanked, md5(CAST(o_orderkey AS STRING) || o_orderpriority) AS cksum FROM orders WHERE o_orderkey % 10 < 8",
    "fx_state_new": "SELECT 'customer:' || CAST(o_custkey AS STRING) AS package, CAST(o_orderkey AS STRING) AS version, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus <> 'P' ELSE o_orderstatus = 'P' END AS yanked, md5(CAST(o_orderkey AS STRING) || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END) AS cksum FROM orders WHERE o_orderkey % 10 >= 2",
    "fx_provenance": "SELECT 'order:' || CAST(o_orderkey AS STRING) AS package_id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://git.test/' || o_orderpriority END AS source_repo, CASE o_orderkey % 4"
    """ WHEN 0 THEN '{"_type":"https://in-toto.io/Statement/' || CASE WHEN o_orderkey % 3 = 0 THEN 'v0.1' ELSE 'v1' END || '","predicateType":"https://slsa.dev/provenance/' || CASE WHEN o_orderkey % 5 = 0 THEN 'v0.2' ELSE 'v1' END || '","subject":[{"name":"pkg","digest":{"sha256":"' || md5(CAST(o_orderkey AS STRING)) || '"}}' || CASE WHEN o_orderkey % 7 = 0 THEN ',{"digest":{}},{"name":"src"}' ELSE '' END || '],"predicate":{"builder":{"id":"https://ci.test/runner","version":"2"},"buildType":"release.yml","invocation":{"configSource":{"uri":"git+https://git.test/' || CAST(o_custkey AS STRING) || '","ref":"refs/tags/v1"}},"metadata":{"buildInvocationId":"run-' || CAST(o_orderkey AS STRING) || '","buildStartedOn":"2024-01-01T00:00:00Z","buildFinishedOn":"2024-01-01T00:05:00Z"}}}'"""
    """ WHEN 1 THEN '{"statementType":"custom","subject":[],"predicate":{"builder":{}}}' WHEN 2 THEN '{"subject":[{"name":"only"}],"predicate":null}' ELSE 'no json' END AS payload FROM orders""",
    "fx_scorecard_doc": """SELECT 'part:' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 10 = 9 THEN '{"checks":' ELSE '{"score":' || CAST(p_size % 10 AS STRING) || '.5,"checks":[{"name":"Vulnerabilities","score":' || CAST(p_size % 11 AS STRING) || ',"reason":"' || p_brand || '"},{"name":"Code-Review","score":' || CAST(p_size % 9 AS STRING) || '.5},{"name":"Fuzzing"},{"score":9,"reason":"odd"}]}' END AS payload FROM part""",
    "fx_vuln": "SELECT 'VULN-' || CAST(event_id AS STRING) AS id, 'part:' || CAST(CAST(floor(event_id / 5) AS BIGINT) AS STRING) AS package_id, value / 10 AS cvss, CASE WHEN value >= 90 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_id % 3 = 0 AS exploit, (event_id % 100) / 100.0 AS epss FROM events WHERE event_type = 'error'",
}
#: Node codes: the key times eight and the number of the kind in KINDS.
CODE = "CAST({key} AS BIGINT) * 8 + {kind}"


def edge_types(tables) -> dict[tuple[str, str], DataFrame]:
    """The package edges by the kinds of their ends, as pairs of node codes (src, dst), repeats included: no text is built, and nothing is shuffled but the join of lines and orders."""
    c = {name: CODE.replace("{kind}", str(k)) for k, (name, _, _) in enumerate(KINDS)}
    sql = {
        ("customer", "part"): f"SELECT {c['customer'].format(key='o_custkey')} AS src, {c['part'].format(key='l_partkey')} AS dst FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey",
        ("part", "supplier"): f"SELECT {c['part'].format(key='l_partkey')} AS src, {c['supplier'].format(key='l_suppkey')} AS dst FROM {{lineitem}}",
        ("supplier", "nation"): f"SELECT {c['supplier'].format(key='s_suppkey')} AS src, {c['nation'].format(key='s_nationkey')} AS dst FROM {{supplier}}",
        ("nation", "region"): f"SELECT {c['nation'].format(key='n_nationkey')} AS src, {c['region'].format(key='n_regionkey')} AS dst FROM {{nation}}",
    }
    return {kinds: tables.spark.sql(text, **{t: getattr(tables, t) for t in ("lineitem", "orders", "supplier", "nation") if f"{{{t}}}" in text}) for kinds, text in sql.items()}


def version_pairs(tables) -> DataFrame:
    """What versions depend on, as pairs of codes of their package and of the other, repeats included: fx_version and fx_depends_on without texts."""
    src, dst = CODE.format(key="o_custkey", kind=0), CODE.format(key="l_partkey", kind=1)
    return tables.spark.sql(f"SELECT {src} AS src, {dst} AS dst FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey", lineitem=tables.lineitem, orders=tables.orders)


def coded_edges(tables) -> DataFrame:
    """All of them as one table."""
    first, *rest = edge_types(tables).values()
    for other in rest:
        first = first.unionByName(other)
    return first


def code_of(node: str) -> int:
    """The code of a node by its name, like part:10; -1 for names of no kind."""
    kind, _, key = node.partition(":")
    names = [name for name, _, _ in KINDS]
    return int(key) * 8 + names.index(kind) if kind in names and key.isdigit() else -1


def name_of(code: Column) -> Column:
    kinds = F.array(*[F.lit(name) for name, _, _ in KINDS])
    return F.concat(F.element_at(kinds, (code % 8 + 1).cast("int")), F.lit(":"), F.shiftright(code, 3).cast("string"))


def packages_of(tables, ids: tuple[str, ...]) -> DataFrame:
    """The packages of these ids: each table is asked for its keys, which reach its scan; tables without any are left out."""
    found = None
    for name, key, _ in KINDS:
        keys = [x.partition(":")[2] for x in ids if x.partition(":")[0] == name]
        keys = [int(x) for x in keys if x.isdigit()]
        if keys:
            view = next(part for part in VIEWS["fx_package"].split(" UNION ALL ") if part.endswith(f"FROM {name}"))
            rows = tables.spark.sql(view.replace(f"FROM {name}", "FROM {t} WHERE " + f"{key} IN ({', '.join(map(str, keys))})"), t=getattr(tables, name))
            found = rows if found is None else found.unionByName(rows)
    return tables.fx_package.where("false") if found is None else found


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def view(tables, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return tables.spark.sql(sql, **{t: getattr(tables, t) for t in used})


def with_views(sql: str) -> str:
    """sql with the views that it names as CTEs before its own."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].replace('AS STRING', 'AS VARCHAR')})" for v in used)
    if not ctes:
        return sql
    body = sql.strip()
    m = re.match(r"WITH( RECURSIVE)?\s", body)
    return f"WITH RECURSIVE {ctes}, {body[m.end():]}" if m else f"WITH {ctes} {body}"
