"""Registry documents, event routing and decoding, dead letters, and the smaller reads around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import changes, text
from ..sources import registries
from ..streaming import views
from .event_queries import OUTBOX, outbox
from .registry import Tables, query


def rows_n():
    return F.count(F.lit(1)).alias("n")


LATEST = "json_extract_string(doc, '$.\"dist-tags\".latest')"
OF_LATEST = "json_extract_string(doc, '$.versions.\"' || coalesce(" + LATEST + ", '-') || '\".{0}')"
FIELD = lambda value, field: f"CASE WHEN starts_with({value}, '{{') THEN json_extract_string({value}, '$.{field}') ELSE {value} END"
NPM_LICENCE = f"coalesce({OF_LATEST.format('license')}, json_extract_string(doc, '$.license'))"
NPM_URL = f"coalesce({OF_LATEST.format('repository')}, json_extract_string(doc, '$.repository'))"


@query(
    "registry_metadata",
    f"""SELECT id, CASE registry WHEN 'npm' THEN {FIELD(NPM_LICENCE, 'type')} WHEN 'pypi' THEN coalesce(CASE WHEN trim(json_extract_string(doc, '$.info.license')) <> '' THEN json_extract_string(doc, '$.info.license') END, replace(list_filter(json_extract_string(doc, '$.info.classifiers[*]'), lambda c: starts_with(c, 'License :: '))[1], 'License :: ', '')) ELSE json_extract_string(doc, '$.crate.license') END AS license,
 CASE registry WHEN 'npm' THEN {LATEST} WHEN 'pypi' THEN json_extract_string(doc, '$.info.version') ELSE json_extract_string(doc, '$.crate.max_version') END AS latest,
 CASE registry WHEN 'npm' THEN regexp_replace(regexp_replace({FIELD(NPM_URL, 'url')}, '^git\\+', ''), '\\.git$', '') WHEN 'pypi' THEN coalesce(json_extract_string(doc, '$.info.project_urls.Source'), nullif(json_extract_string(doc, '$.info.home_page'), '')) ELSE json_extract_string(doc, '$.crate.repository') END AS repository FROM fx_registry""",
)
def _(t: Tables) -> DataFrame:
    return registries.metadata(t.fx_registry, "registry", "doc").select("id", "license", "latest", "repository")


@query("packument_versions", "SELECT id, unnest(json_keys(doc, '$.versions')) AS version FROM fx_registry WHERE registry = 'npm'")
def _(t: Tables) -> DataFrame:
    return t.fx_registry.where("registry = 'npm'").select("id", F.explode(registries.packument_versions(F.col("doc"))).alias("version"))


@query("cargo_dependencies", "SELECT l_orderkey AS id, 'crate' || l_partkey AS name, '^' || l_linenumber AS req FROM lineitem WHERE l_returnflag = 'N'")
def _(t: Tables) -> DataFrame:
    one = F.struct(F.concat(F.lit("crate"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("^"), F.col("l_linenumber").cast("string")).alias("req"), F.when(F.col("l_returnflag") == "N", "normal").when(F.col("l_returnflag") == "R", "dev").alias("kind"))
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(one).alias("deps"))).alias("doc"))
    return docs.select("id", F.explode(registries.normal_dependencies(F.col("doc"))).alias("d")).select("id", "d.*")


@query("pypi_changelog", "SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'a&b<' || user_id ELSE 'pkg' || user_id END AS project, CASE WHEN event_id % 4 <> 0 THEN '1.' || event_id END AS version, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 10 END AS at, event_type AS action, event_id + 7 AS serial FROM events WHERE event_id % 6 <> 0")
def _(t: Tables) -> DataFrame:
    """Each event as a response of one entry; some lack values, have an empty version or a time that is no number."""
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("a&amp;b&lt;"), u)).otherwise(F.concat(F.lit("pkg"), u))
    value = lambda x, kind="string": F.concat(F.lit(f"<value><{kind}>"), x, F.lit(f"</{kind}></value>\n"))
    parts = [value(name), value(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("1."), k)).otherwise("")), value(F.when(F.col("event_id") % 5 == 0, "soon").otherwise((F.col("event_id") * 10).cast("string")), "int"), value(F.col("event_type"))]
    last = F.when(F.col("event_id") % 6 != 0, value((F.col("event_id") + 7).cast("string"), "int")).otherwise("")
    xml = F.concat(F.lit("<?xml version='1.0'?><methodResponse><params><array><data>"), *parts, last, F.lit("</data></array></params></methodResponse>"))
    return registries.changelog(t.events.select(F.col("event_id").alias("id"), xml.alias("xml")), "xml")


ROUTED = "(SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'version.upserted' WHEN 'signup' THEN 'dependency.impact' WHEN 'error' THEN 'package.deleted' WHEN 'view' THEN 'other' END AS kind, CASE event_id % 3 WHEN 0 THEN 'x.breaking.y' WHEN 1 THEN 'impact' ELSE 'misc' END AS topic FROM events)"


@query("route_by_topic", f"SELECT id, CASE WHEN kind = 'version.upserted' THEN 'version' WHEN kind = 'dependency.impact' THEN 'impact' WHEN kind = 'package.deleted' THEN NULL WHEN topic LIKE '%breaking%' THEN 'breaking' WHEN topic LIKE '%impact%' THEN 'impact' END AS stream FROM {ROUTED}")
def _(t: Tables) -> DataFrame:
    rows = t.spark.sql(f"SELECT * FROM {ROUTED.replace('FROM events', 'FROM {events}')}", events=t.events)
    return rows.select("id", registries.stream_of(F.col("kind"), F.col("topic")).alias("stream"))


@query("dead_letters", "SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'not json' ELSE 'no package_id' END AS reason FROM events WHERE event_id % 10 < 2")
def _(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, '{"version":"1"}').otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("package_id"))))
    rows = t.events.select(F.col("event_id").alias("id"), value.alias("value"))
    return views.split_letters(rows, "value", "package_id string, version string", "package_id")[1].select("id", "reason")


@query("decode_breaking", "SELECT event_id AS id, CASE event_id % 4 WHEN 1 THEN 'cargo' ELSE 'npm' END || ':p' || user_id AS package_id, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '' END AS old_version, '2' AS new_version, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'medium' ELSE 'low' END AS severity, CAST(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS INT) AS affected_dependents, event_id % 3 AS changes FROM events WHERE event_id % 4 <> 0")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id")
    change = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.struct(F.when(i > 0, "removed").alias("type"), F.lit("x").alias("description")))
    name = F.when(k % 8 == 0, "").when(k % 4 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string")))
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "view", "Medium").when(F.col("event_type") == "click", "odd")
    doc = F.to_json(F.struct(F.when(k % 4 == 1, "cargo").alias("ecosystem"), name.alias("name"), F.when(k % 2 == 0, "1").alias("old_version"), F.lit("2").alias("new_version"), severity.alias("severity"), F.when(k % 3 == 0, k).alias("affected_dependents"), change.alias("changes")))
    return registries.breaking_event(t.events.select(k.alias("id"), doc.alias("payload")), "payload")


@query("osv_lookup", "SELECT p.id AS package_id, CASE p.ecosystem WHEN 'part' THEN 'crates.io' WHEN 'customer' THEN 'npm' WHEN 'supplier' THEN 'PyPI' END AS ecosystem, count(v.id) AS n, min(v.id) AS first_id FROM fx_package p JOIN fx_vuln v ON v.package_id = p.id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """Advisories of every package, under the name its ecosystem has there."""
    alias = F.when(F.col("ecosystem") == "part", "Cargo").when(F.col("ecosystem") == "customer", "npm").when(F.col("ecosystem") == "supplier", "pypi")
    p = t.fx_package.select(F.col("id").alias("package_id"), registries.advisory_ecosystem(alias).alias("ecosystem"))
    return t.fx_vuln.join(p, "package_id").groupBy("package_id", "ecosystem").agg(F.count("id").alias("n"), F.min("id").alias("first_id"))


@query("embedding_bytes", "SELECT vec_id, round(list_sum(CAST(vector AS DOUBLE[])), 4) AS total, len(vector) AS size FROM fx_vector")
def _(t: Tables) -> DataFrame:
    rows = t.fx_vector.select("vec_id", registries.bytes_of("vector").alias("raw")).select("vec_id", registries.floats_of("raw").alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size("v").cast("long").alias("size"))


@query("embedding_texts", "SELECT doc_id AS id, 'fn_' || doc_id || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 4")
def _(t: Tables) -> DataFrame:
    """Name and documentation of each public symbol."""
    symbols = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("doc"), (F.col("doc_id") % 5 != 4).alias("is_public"))
    return symbols.where("is_public").select("id", F.concat(F.col("name"), F.lit(" "), F.coalesce("doc", F.lit(""))).alias("text"))


@query("collection_stats", "SELECT count(*) AS points, count(DISTINCT package_id) AS packages, max(len(vector)) AS dimensions FROM fx_vector")
def _(t: Tables) -> DataFrame:
    return t.fx_vector.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("package_id").alias("packages"), F.max(F.size("vector")).cast("long").alias("dimensions"))


@query("pool_tokens", "WITH e AS (SELECT package_id, vec_id, row_number() OVER (PARTITION BY package_id ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY package_id) AS n, vec_id % 4 <> 0 AS kept, i - 1 AS position, CAST(vector[i] AS DOUBLE) AS x FROM fx_vector, range(1, 65) r(i)) SELECT package_id, position, round(coalesce(avg(x) FILTER (kept), 0), 6) AS masked_mean, round(coalesce(max(x) FILTER (kept), 0), 6) AS masked_max, round(max(x) FILTER (k = 1), 6) AS first, round(avg(x) FILTER (k > n - 4), 6) AS last_mean FROM (SELECT e.package_id, e.vec_id, e.position, e.x, e.kept, d.k, d.n FROM e JOIN (SELECT vec_id, row_number() OVER (PARTITION BY package_id ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY package_id) AS n FROM fx_vector) d USING (vec_id)) GROUP BY package_id, position")
def _(t: Tables) -> DataFrame:
    """The vectors of a package as its tokens: mean and maximum under a mask, the first token, and the mean of the last four."""
    w = Window.partitionBy("package_id")
    rows = t.fx_vector.select("package_id", "vector", (F.col("vec_id") % 4 != 0).alias("kept"), F.row_number().over(w.orderBy("vec_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    each = rows.select("package_id", "kept", "k", "n", F.posexplode("vector").alias("position", "_x")).withColumn("x", F.col("_x").cast("double"))
    of = lambda test: F.when(test, F.col("x"))
    by = each.groupBy("package_id", F.col("position").cast("long").alias("position"))
    return by.agg(F.round(F.coalesce(F.avg(of(F.col("kept"))), F.lit(0.0)), 6).alias("masked_mean"), F.round(F.coalesce(F.max(of(F.col("kept"))), F.lit(0.0)), 6).alias("masked_max"), F.round(F.max(of(F.col("k") == 1)), 6).alias("first"), F.round(F.avg(of(F.col("k") > F.col("n") - 4)), 6).alias("last_mean"))


@query("name_lc_backfill", "SELECT p_partkey AS id, lower(p_name) AS name_lc FROM part")
def _(t: Tables) -> DataFrame:
    """Names in lower case where a row has none yet."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_name")).alias("name_lc"))
    return rows.select("id", F.coalesce("name_lc", F.lower("name")).alias("name_lc"))


@query("outbox_pivot", f"SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'publishing') AS publishing, count(*) FILTER (status IN ('failed', 'deadletter')) AS failed FROM {OUTBOX}")
def _(t: Tables) -> DataFrame:
    s = F.col("status")
    return outbox(t).agg(F.count_if(s == "pending").alias("pending"), F.count_if(s == "publishing").alias("publishing"), F.count_if(s.isin("failed", "deadletter")).alias("failed"))


@query("outbox_cleanup", f"SELECT event_id FROM {OUTBOX} WHERE NOT (status = 'published' AND created_at < (SELECT max(ts) FROM events) - INTERVAL 7 DAY)")
def _(t: Tables) -> DataFrame:
    """What is left once published rows of over seven days are gone."""
    last = F.broadcast(t.events.agg(F.max("ts").alias("as_of")))  # one row
    old = (F.col("status") == "published") & (F.col("created_at") < F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    return outbox(t).crossJoin(last).where(~old).select("event_id")


@query("vuln_groups", "SELECT severity, CASE WHEN exploit THEN 'direct' ELSE 'transitive' END AS relationship, count(*) AS n, count(*) FILTER (epss >= 0.5) AS reachable FROM fx_vuln GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("exploit"), "direct").otherwise("transitive")
    return t.fx_vuln.groupBy("severity", kind.alias("relationship")).agg(rows_n(), F.count_if(F.col("epss") >= 0.5).alias("reachable"))


@query("release_features", f"SELECT version AS id, coalesce(new_number > old_number, false) AS is_major, new_tag <> '' AS is_pre, length(changelog) AS n_chars, contains(lower(changelog), 'deprecated') AS has_deprecation, deps_removed + deps_major AS dependency_changes FROM fx_changelog")
def _(t: Tables) -> DataFrame:
    """What is known of a release, side by side."""
    number = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("x")), F.lit(".0.0"))
    major = changes.leading_number(number("new_number")) > changes.leading_number(number("old_number"))
    version = F.concat(number("new_number"), F.col("new_tag"))
    return t.fx_changelog.select(F.col("version").alias("id"), F.coalesce(major, F.lit(False)).alias("is_major"), changes.has_any(F.lower(version), changes.PRE).alias("is_pre"), F.char_length("changelog").cast("long").alias("n_chars"), F.lower("changelog").contains("deprecated").alias("has_deprecation"), (F.col("deps_removed") + F.col("deps_major")).alias("dependency_changes"))


@query("graph_view_stats", "SELECT ecosystem, count(*) AS nodes, coalesce(sum(n), 0)::BIGINT AS edges FROM fx_package p LEFT JOIN (SELECT src, count(*) AS n FROM fx_depends_on_pkg GROUP BY src) e ON e.src = p.id GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    out = t.fx_depends_on_pkg.groupBy(F.col("src").alias("id")).agg(rows_n())
    return t.fx_package.join(out, "id", "left").groupBy("ecosystem").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


@query("audit_filtered", "SELECT id, action FROM fx_audit_log WHERE (action LIKE '%SECURITY%' OR action LIKE '%POLICY%') AND coalesce(status_code, 0) >= 200 AND user_id % 2 = 0 ORDER BY created_at DESC, id LIMIT 10000")
def _(t: Tables) -> DataFrame:
    """The last ten thousand events of two categories by some actors."""
    from .event_queries import category

    rows = t.fx_audit_log.where(category(F.col("action")).isin("security", "policy") & (F.coalesce("status_code", F.lit(0)) >= 200) & (F.col("user_id") % 2 == 0))
    return rows.orderBy(F.desc("created_at"), "id").limit(10_000).select("id", "action")


@query("hit_ratio", "SELECT date_trunc('hour', ts) AS hour, round(count(*) FILTER (event_type = 'view')::DOUBLE / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0), 6) AS ratio FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Hits to hits and misses; null where there were neither."""
    kind = F.col("event_type")
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.count_if(kind == "view") / F.nullif(F.count_if(kind.isin("view", "click")), F.lit(0)), 6).alias("ratio"))


@query("rate_5m", "SELECT event_type, bucket AS \"at\", round(sum(inc) / 300, 6) AS rate, round(sum(inc), 6) AS increase FROM (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY event_type, bucket")
def _(t: Tables) -> DataFrame:
    from ..operators import timeseries

    e = t.events.withColumn("_at", F.struct("ts", "event_id"))
    grown = timeseries.increase(e, ["event_type", "user_id"], "_at", "value").groupBy("event_type", F.window("ts", "5 minutes").alias("w"))
    return grown.agg(F.round(F.sum("_inc") / 300, 6).alias("rate"), F.round(F.sum("_inc"), 6).alias("increase")).select("event_type", F.col("w.start").alias("at"), "rate", "increase")


#: Requests a minute of the tiers, and by how much a burst may exceed them, scaled to the events of the tables.
TIERS = (("free", 1, 1.0), ("pro", 2, 1.5), ("enterprise", 4, 2.0))


@query("rate_limit_tiers", "SELECT tier, count(*) AS requests, count(*) FILTER (n > bound) AS denied FROM (SELECT e.tier, t.bound, count(*) OVER (PARTITION BY e.user_id ORDER BY e.ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier FROM events) e JOIN (VALUES " + ", ".join(f"('{a}', floor({b} * {c}))" for a, b, c in TIERS) + ") t(tier, bound) ON t.tier = e.tier) GROUP BY tier")
def _(t: Tables) -> DataFrame:
    """Who would be denied by a sliding window whose bound is the tier's limit with its burst."""
    k = F.col("user_id") % 3
    tier = F.when(k == 0, "free").when(k == 1, "pro").otherwise("enterprise")
    bounds = F.create_map(*[F.lit(x) for name, limit, burst in TIERS for x in (name, int(limit * burst))])
    rows = t.events.select(tier.alias("tier"), F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)").alias("n"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("n") > bounds[F.col("tier")]).alias("denied"))


@query("split_package_id", "SELECT id, CASE WHEN slashes THEN split_part(line, '/', 1) ELSE split_part(line, ':', 1) END AS ecosystem, CASE WHEN slashes THEN split_part(line, '/', 2) ELSE split_part(line, ':', 2) END AS name, CASE WHEN slashes AND id % 3 <> 2 THEN split_part(line, '/', 3) END AS version FROM (SELECT p_partkey AS id, p_partkey % 3 <> 1 AS slashes, CASE p_partkey % 3 WHEN 0 THEN 'npm/' || p_size || '/1.' || p_partkey WHEN 1 THEN 'cargo:' || p_size ELSE 'pypi/' || p_size END AS line FROM part)")
def _(t: Tables) -> DataFrame:
    """Ids like ecosystem/name, with or without a version, else like ecosystem:name."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.when(k % 3 == 0, F.concat(F.lit("npm/"), size, F.lit("/1."), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("cargo:"), size)).otherwise(F.concat(F.lit("pypi/"), size))
    return t.part.select(k.alias("id"), line.alias("line")).select("id", *[c.alias(n) for n, c in text.package_id(F.col("line")).items()])
