"""Subscriptions, live figures, recommendations, retrieval quality and other reads that complete the queries of their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scorecard
from ..operators import graph
from ..sources import registries
from ..streaming import views
from . import fixtures
from .event_queries import SEVERITY, severity
from .governance_queries import WIDE
from .registry import Tables, query


def rows_n() -> Column:
    return F.count(F.lit(1)).alias("n")


# Subscriptions: what each of their filters lets pass.

CHANGES = "(SELECT event_id, package_id, ecosystem, CASE WHEN event_id % 6 = 0 THEN 'critical' WHEN event_id % 6 = 1 THEN 'HIGH' WHEN event_id % 6 = 2 THEN 'Medium' WHEN event_id % 6 = 3 THEN 'low' WHEN event_id % 6 = 4 THEN 'other' END AS severity, CAST(event_id % 100 AS DOUBLE) / 100 AS impact_score FROM fx_package_event)"


def changes(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    names = F.when(k == 0, "critical").when(k == 1, "HIGH").when(k == 2, "Medium").when(k == 3, "low").when(k == 4, "other")
    return t.fx_package_event.select("event_id", "package_id", "ecosystem", names.alias("severity"), ((F.col("event_id") % 100).cast("double") / 100).alias("impact_score"))


@query("sub_new_version", "SELECT event_id FROM fx_package_event WHERE event_type = 'new_version' AND ecosystem = 'view' AND package_id = 'user:7'")
def _(t: Tables) -> DataFrame:
    return views.subscribed(t.fx_package_event.where("event_type = 'new_version'"), ecosystem="view", package_id="user:7").select("event_id")


@query("sub_breaking_min_severity", f"SELECT event_id, severity FROM {CHANGES} WHERE ecosystem = 'click' AND upper(severity) IN ('MEDIUM', 'HIGH', 'CRITICAL')")
def _(t: Tables) -> DataFrame:
    """Severities compare by rank, whatever their letters; what is no severity does not pass."""
    return views.subscribed(changes(t), ecosystem="click", min_severity="medium").select("event_id", "severity")


@query("sub_dependency_impact", f"SELECT event_id FROM {CHANGES} WHERE ecosystem = 'error' AND impact_score >= 0.5")
def _(t: Tables) -> DataFrame:
    return views.subscribed(changes(t), ecosystem="error", min_impact=0.5).select("event_id")


@query("sub_package_events", "SELECT event_id, event_type FROM fx_package_event WHERE package_id = 'user:11'")
def _(t: Tables) -> DataFrame:
    return views.subscribed(t.fx_package_event, package_id="user:11").select("event_id", "event_type")


@query("stream_dedupe_versions", "SELECT DISTINCT package_id, version FROM (SELECT package_id, CAST(event_id % 50 AS VARCHAR) AS version FROM fx_package_event)")
def _(t: Tables) -> DataFrame:
    """One event of each package and version, as the stream's operator keeps them."""
    events = t.fx_package_event.select("package_id", (F.col("event_id") % 50).cast("string").alias("version"), "published_at")
    return views.deduped(events, ["package_id", "version"], "published_at").select("package_id", "version")


# Live figures.

HOURS = "count(*) FILTER (published_at > a - INTERVAL {0} HOUR) AS last, count(*) FILTER (published_at <= a - INTERVAL {0} HOUR AND published_at > a - INTERVAL {1} HOUR) AS prior"


@query("live_stats_hour", f"WITH m AS (SELECT max(published_at) AS a FROM fx_package_event) SELECT ecosystem, last, prior, round(coalesce(100.0 * (last - prior) / nullif(prior, 0), 0), 6) AS change_percent FROM (SELECT ecosystem, {HOURS.format(1, 2)} FROM fx_package_event, m GROUP BY ecosystem)")
def _(t: Tables) -> DataFrame:
    """Events of the last hour, those of the hour before, and the change (0 where there were none)."""
    found = views.recent_activity(t.fx_package_event, "published_at", "1 HOUR", "ecosystem")
    return found.select("ecosystem", F.col("now").alias("last"), F.col("before").alias("prior"), F.round(F.coalesce("change_percent", F.lit(0.0)), 6).alias("change_percent"))


@query("live_totals", "SELECT 'ecosystem' AS kind, ecosystem AS name, count(*) AS n FROM fx_package_event GROUP BY ecosystem UNION ALL SELECT 'type', event_type, count(*) FROM fx_package_event GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    """Counts by ecosystem and by type in one pass."""
    kinds = F.explode(F.array(F.struct(F.lit("ecosystem").alias("kind"), F.col("ecosystem").alias("name")), F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("name"))))
    # The pairs are few: counted before they come apart.
    return t.fx_package_event.groupBy("ecosystem", "event_type").agg(rows_n()).select(kinds.alias("k"), "n").groupBy("k.kind", "k.name").agg(F.sum("n").alias("n"))


@query("live_last_events", "SELECT event_id, ecosystem FROM fx_package_event ORDER BY published_at DESC, event_id DESC LIMIT 100")
def _(t: Tables) -> DataFrame:
    """The last hundred events, as many as a client keeps."""
    return t.fx_package_event.orderBy(F.desc("published_at"), F.desc("event_id")).limit(100).select("event_id", "ecosystem")


# Withdrawn releases: an order's lines are its files, whose mark is a truth value, a reason, or nothing.

MARK = "CASE l_orderkey % 5 WHEN 0 THEN CASE l_returnflag WHEN 'R' THEN 'true' ELSE 'false' END WHEN 1 THEN CASE l_returnflag WHEN 'A' THEN '\"broken\"' ELSE '\"\"' END WHEN 2 THEN CASE l_returnflag WHEN 'N' THEN '\"false\"' ELSE 'null' END WHEN 3 THEN CASE l_returnflag WHEN 'R' THEN '1' ELSE '{}' END END"


@query("release_yanked_marks", "SELECT l_orderkey AS id, bool_or(CASE l_orderkey % 5 WHEN 0 THEN l_returnflag = 'R' WHEN 1 THEN l_returnflag = 'A' WHEN 2 THEN l_returnflag = 'N' ELSE false END) AS yanked FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    file = F.concat(F.lit('{"filename":"f'), F.col("l_linenumber").cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(',"data-yanked":'), F.expr(MARK)), F.lit("")), F.lit("}"))
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit('{"files":['), F.array_join(F.collect_list(file), ","), F.lit("]}")).alias("doc"))
    return docs.select("id", registries.yanked_release(F.col("doc")).alias("yanked"))


# Build levels: what would raise them.

SHORT = {
    "Generate SLSA provenance in CI/CD (e.g., GitHub Actions + provenance attestation)": 'greatest("Packaging", "Signed-Releases", "Binary-Artifacts") < 5',
    "Publish provenance alongside release artifacts": 'greatest("Packaging", "Signed-Releases", "Binary-Artifacts") < 5',
    "Sign provenance using Sigstore keyless signing": 'greatest("Packaging", "Signed-Releases", "Binary-Artifacts") >= 5 AND "Signed-Releases" < 7',
    "Enable branch protection for release branches": '"Branch-Protection" < 5',
    "Restrict GitHub Action token permissions": '"Token-Permissions" < 5',
    "Add CI tests to strengthen build integrity": '"CI-Tests" < 5',
    "Audit workflows for dangerous patterns": '"Dangerous-Workflow" < 7',
    "Pin CI/CD workflow dependencies": '"Pinned-Dependencies" < 5',
}


@query("slsa_recommendations", "SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{text}' END" for text, test in SHORT.items()) + f"], lambda x: x IS NOT NULL)) AS recommendation FROM {WIDE}")
def _(t: Tables) -> DataFrame:
    return t.fx_repo.select("id", F.explode(scorecard.build_advice(scorecard.scores())).alias("recommendation"))


# The graph around a package: how deep it goes, and how many nodes and edges each depth has.

VIEW_ROOT, VIEW_DEPTH = "customer:7", 4
WALK = f"walk(id, depth) AS (SELECT '{VIEW_ROOT}', 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN fx_depends_on_pkg e ON e.src = w.id WHERE w.depth < {VIEW_DEPTH}), r AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"


@query("graph_view_depths", f"WITH RECURSIVE {WALK} SELECT r.depth, count(DISTINCT r.id) AS nodes, count(e.dst) AS edges, max(max(r.depth)) OVER () AS max_depth FROM r LEFT JOIN (SELECT DISTINCT src, dst FROM fx_depends_on_pkg WHERE dst IN (SELECT id FROM r)) e ON e.src = r.id GROUP BY r.depth")
def _(t: Tables) -> DataFrame:
    """Dependencies of a package by depth: nodes, edges from them inside the view, and the greatest depth."""
    edges = fixtures.coded_edges(t)
    root = fixtures.code_of(VIEW_ROOT)
    found = graph.typed_reach(fixtures.edge_types(t), VIEW_ROOT.partition(":")[0], root, VIEW_DEPTH, forward=True)
    nodes = found.unionByName(t.spark.range(1).select(F.lit(root).cast("long").alias("id"), F.lit(0).alias("depth")))
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    by = nodes.join(inside.groupBy(F.col("src").alias("id")).agg(rows_n()), "id", "left").groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return by.withColumn("max_depth", F.max("depth").over(Window.partitionBy()))  # a row a depth


# Audit severities in the order of syslog, where the gravest has the least number.

SYSLOG = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
SYSLOG_SQL = "list_position([" + ", ".join(f"'{x}'" for x in SYSLOG) + f"], {SEVERITY}) - 1"


@query("audit_by_syslog", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(min(s) AS BIGINT) AS gravest, count(*) FILTER (s <= 4) AS at_least_warning, count(*) AS n FROM (SELECT created_at, {SYSLOG_SQL} AS s FROM fx_audit_log) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """By day: the gravest level, and events of level warning or graver."""
    level = (F.array_position(F.array(*[F.lit(x) for x in SYSLOG]), severity(F.col("status_code"))) - 1).cast("long")
    rows = t.fx_audit_log.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), level.alias("s"))
    return rows.groupBy("day").agg(F.min("s").alias("gravest"), F.count_if(F.col("s") <= 4).alias("at_least_warning"), rows_n())
