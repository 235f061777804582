"""Sources, snapshot diffs, event folds, outbox queries, materialised views, audit and time series."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cdc, timeseries
from ..storage import shared_dir, stored
from ..streaming import published, views
from . import fixtures
from .registry import Tables, query



def rows_n() -> Column:
    return F.count(F.lit(1)).alias("n")

PAYLOAD = """'{"event_type":"' || event_type || '","package_id":"' || package_id || '","version":"' || version || '"}'"""


@query("src_package_events", "SELECT event_id, event_type, package_id, version FROM fx_package_event")
def _(t: Tables) -> DataFrame:
    raw = t.fx_package_event.select("event_id", F.expr(PAYLOAD).alias("value"))
    return views.decoded(raw, "value", "event_type string, package_id string, version string").select("event_id", "event_type", "package_id", "version")


@query("src_analysis_results", "SELECT event_id, package_id, json_array_length(breaking_changes) AS changes FROM fx_analysis_result")
def _(t: Tables) -> DataFrame:
    return t.fx_analysis_result.select("event_id", "package_id", F.json_array_length("breaking_changes").cast("long").alias("changes"))


@query("sink_breaking_changes", "SELECT package_id, version, arg_max(json_array_length(breaking_changes), (analyzed_at, event_id)) AS changes FROM (SELECT event_id, package_id, CAST(event_id % 4 AS VARCHAR) AS version, breaking_changes, analyzed_at FROM fx_analysis_result) WHERE json_array_length(breaking_changes) > 0 GROUP BY package_id, version")
def _(t: Tables) -> DataFrame:
    """The last result of each package and version, the key of the sink."""
    rows = t.fx_analysis_result.where(F.json_array_length("breaking_changes") > 0).withColumn("version", (F.col("event_id") % 4).cast("string"))
    last = cdc.latest(rows, ["package_id", "version"], F.desc("analyzed_at"), F.desc("event_id"))
    return last.select("package_id", "version", F.json_array_length("breaking_changes").cast("long").alias("changes"))


@query("decode_version_event", "SELECT event_id, package_id, version, event_id % 10 = 0 AS malformed FROM fx_package_event WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, NULL, true FROM fx_package_event WHERE event_id % 10 = 0")
def _(t: Tables) -> DataFrame:
    raw = t.fx_package_event.select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.expr(PAYLOAD)).alias("value"))
    got = views.decoded(raw, "value", "package_id string, version string")
    return got.select("event_id", "package_id", "version", F.col("package_id").isNull().alias("malformed"))


@query("route_events", "SELECT CASE event_type WHEN 'purchase' THEN 'graph' WHEN 'signup' THEN 'vector' WHEN 'error' THEN 'dlq' ELSE 'analysis' END AS route, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    route = F.when(kind == "purchase", "graph").when(kind == "signup", "vector").when(kind.isin("view", "click"), "analysis")
    return t.events.select(F.coalesce(route, F.lit("dlq")).alias("route")).groupBy("route").agg(rows_n())


@query("parse_crate_index", "SELECT doc_id AS id, 'crate' || CAST(doc_id AS VARCHAR) AS name, lang AS vers FROM documents WHERE doc_id % 7 <> 0")
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "not json").otherwise(F.to_json(F.struct(F.concat(F.lit("crate"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("vers")))).alias("line"))
    return views.decoded(lines, "line", "name string, vers string").where("name IS NOT NULL").select(F.col("doc_id").alias("id"), "name", "vers")


@query("crate_index_path", "SELECT id, CASE WHEN length(k) = 1 THEN '1/' || k WHEN length(k) = 2 THEN '2/' || k WHEN length(k) = 3 THEN '3/' || k[1] || '/' || k ELSE k[1:2] || '/' || k[3:4] || '/' || k END AS path FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS k FROM orders)")
def _(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), text.crate_index_path(F.col("o_orderkey").cast("string")).alias("path"))


@query("npm_dependencies", "SELECT l_orderkey AS id, 'part' || CAST(l_partkey AS VARCHAR) AS name, '^' || CAST(min(l_linenumber) AS VARCHAR) AS range FROM lineitem GROUP BY l_orderkey, l_partkey")
def _(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("m"))
    packument = pairs.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("part"), F.col("l_partkey").cast("string")), F.concat(F.lit("^"), F.col("m").cast("string")))))).alias("dependencies"))
    return text.npm_dependencies(packument, "l_orderkey", "dependencies").withColumnRenamed("l_orderkey", "id")


@query("parse_pep508", "SELECT p_partkey AS id, 'pkg' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '@ https://x.test/' || p_size ELSE '>=' || p_size || ',<99' END AS version_req, CASE WHEN p_partkey % 4 = 1 THEN 'python_version < ' || chr(39) || '3' || chr(39) WHEN p_partkey % 4 = 2 THEN 'extra == ' || chr(39) || 'dev' || chr(39) END AS marker, p_partkey % 3 = 0 AS has_extra, p_partkey % 4 = 2 AS is_optional FROM part")
def _(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    need = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(" @ https://x.test/"), size, F.lit(" "))).when(k % 5 == 2, F.concat(F.lit(" (>="), size, F.lit(",<99)"))).otherwise(F.concat(F.lit(">="), size, F.lit(",<99")))
    mark = F.when(k % 4 == 1, "; python_version < '3'").when(k % 4 == 2, " ; extra == 'dev'").otherwise("")
    line = F.concat(F.lit("pkg"), k.cast("string"), F.when(k % 3 == 0, "[tls,x]").otherwise(""), need, mark)
    return text.parse_pep508(t.part.select(k.alias("id"), line.alias("line")), "line").select("id", "name", "version_req", "marker", "has_extra", "is_optional")


FILE_BYTES, FILES, SOURCE_BYTES = 1_000_000, 1_000, 200_000_000
TEXTUAL = "CASE WHEN doc_id % 7 = 3 THEN 'png' WHEN doc_id % 2 = 0 THEN 'rs' ELSE 'py' END"


@query("budgeted_file_scan", f"SELECT doc_id, source FROM (SELECT doc_id, source, sum(strlen(text)) OVER w AS total, row_number() OVER w AS files FROM documents WHERE strlen(text) <= {FILE_BYTES} AND NOT contains(text, chr(0)) AND {TEXTUAL} <> 'png' WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE total <= {SOURCE_BYTES} AND files <= {FILES}")
def _(t: Tables) -> DataFrame:
    """The first files of each source within its budgets; only source files without a NUL byte count.

    Running sums have two levels: over ranges of ids, then inside a range, so a
    large source is never one task's. Ranges past the budget are never ordered.
    """
    extension = F.expr(TEXTUAL)
    d = t.documents.where((F.octet_length("text") <= FILE_BYTES) & ~F.contains("text", F.lit("\0")) & extension.isin("rs", "py")).select("doc_id", "source", F.octet_length("text").cast("long").alias("b"), F.expr("doc_id div 1000").alias("range"))
    ranges = d.groupBy("source", "range").agg(F.sum("b").alias("sum_b"), F.count(F.lit(1)).alias("sum_n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"b0": F.coalesce(F.sum("sum_b").over(before), F.lit(0)), "n0": F.coalesce(F.sum("sum_n").over(before), F.lit(0))}).where(f"b0 <= {SOURCE_BYTES} AND n0 < {FILES}")
    inside = Window.partitionBy("source", "range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = d.join(ranges.select("source", "range", "b0", "n0"), ["source", "range"])
    return rows.withColumns({"total": F.col("b0") + F.sum("b").over(inside), "files": F.col("n0") + F.count(F.lit(1)).over(inside)}).where(f"total <= {SOURCE_BYTES} AND files <= {FILES}").select("doc_id", "source")


@query("sync_incremental", "SELECT event_id, package_id FROM fx_package_event WHERE (published_at, event_id) > (SELECT (min(published_at), min(event_id)) FROM fx_package_event) ORDER BY published_at, event_id LIMIT 1000")
def _(t: Tables) -> DataFrame:
    """The next page after a (time, id) mark, so rows that tie with the last one are not lost."""
    e = t.fx_package_event
    mark = F.broadcast(e.agg(F.struct(F.min("published_at").alias("a"), F.min("event_id").alias("b")).alias("mark")))  # one row
    after = e.join(mark, F.struct(F.col("published_at").alias("a"), F.col("event_id").alias("b")) > F.col("mark"))
    return after.orderBy("published_at", "event_id").limit(1000).select("event_id", "package_id")


@query("snapshot_retention", "SELECT event_id FROM (SELECT event_id, row_number() OVER w AS n, sum(event_id % 1000) OVER w AS total FROM fx_package_event WINDOW w AS (PARTITION BY package_id ORDER BY published_at DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE n <= 20 AND total <= 8000")
def _(t: Tables) -> DataFrame:
    """The newest twenty snapshots of each package, as far as their sizes fit the budget."""
    w = Window.partitionBy("package_id").orderBy(F.desc("published_at"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.fx_package_event.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.sum(F.col("event_id") % 1000).over(w).alias("total"))
    return rows.where("n <= 20 AND total <= 8000").select("event_id")


# Snapshot diffs.

OLD_NEW = "fx_state_old o FULL JOIN fx_state_new n ON o.package = n.package AND o.version = n.version"
KEYS = ["package", "version"]


@query("npm_diff", f"SELECT coalesce(o.package, n.package) AS package, coalesce(o.version, n.version) AS version, CASE WHEN o.version IS NULL THEN 'new' ELSE 'yanked' END AS change FROM {OLD_NEW} WHERE o.version IS NULL OR n.version IS NULL")
def _(t: Tables) -> DataFrame:
    d = cdc.both_sides(t.fx_state_old, t.fx_state_new, KEYS)
    return d.where("o IS NULL OR n IS NULL").select(*KEYS, F.when(F.col("o").isNull(), "new").otherwise("yanked").alias("change"))


FLAGS = "CASE WHEN o.version IS NULL THEN 'added' WHEN n.version IS NULL THEN 'removed' WHEN NOT o.yanked AND n.yanked THEN 'yanked' WHEN o.yanked AND NOT n.yanked THEN 'unyanked'"


def flags() -> Column:
    o, n = F.col("o"), F.col("n")
    return F.when(o.isNull(), "added").when(n.isNull(), "removed").when(~o["yanked"] & n["yanked"], "yanked").when(o["yanked"] & ~n["yanked"], "unyanked")


@query("pypi_diff", f"SELECT * FROM (SELECT coalesce(o.package, n.package) AS package, coalesce(o.version, n.version) AS version, {FLAGS} END AS change FROM {OLD_NEW}) WHERE change IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = cdc.both_sides(t.fx_state_old, t.fx_state_new, KEYS)
    return d.select(*KEYS, flags().alias("change")).where("change IS NOT NULL")


CARGO = f"SELECT coalesce(o.package, n.package) AS package, coalesce(o.version, n.version) AS version, {FLAGS} WHEN o.cksum <> n.cksum THEN 'modified' END AS change FROM {OLD_NEW}"


def cargo_diff(t: Tables) -> DataFrame:
    d = cdc.both_sides(t.fx_state_old, t.fx_state_new, KEYS)
    return d.select(*KEYS, flags().when(F.col("o.cksum") != F.col("n.cksum"), "modified").alias("change")).where("change IS NOT NULL")


query("cargo_diff", f"SELECT * FROM ({CARGO}) WHERE change IS NOT NULL")(cargo_diff)


@query("diff_events", f"SELECT sha256(change || '|cargo|' || package || ':' || version || '|' || md5(change)) AS event_id, change AS kind, package, version FROM ({CARGO}) WHERE change IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = cargo_diff(t)
    key = cdc.event_id(F.col("change"), F.lit("cargo"), F.concat_ws(":", "package", "version"), F.md5(F.col("change").cast("binary")))
    return d.select(key.alias("event_id"), F.col("change").alias("kind"), *KEYS)


@query("release_yanked", "SELECT l_orderkey AS release, bool_or(l_returnflag = 'R') AS yanked FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("release")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("yanked"))


SEMVER = "CAST(o_orderkey % 5 AS {0}) || '.' || CAST(o_orderkey % 13 AS {0}) || '.' || CAST(o_orderkey % 7 AS {0})"


@query("latest_semver", f"SELECT o_custkey AS crate, max_by({SEMVER.format('VARCHAR')}, (o_orderkey % 5, o_orderkey % 13, o_orderkey % 7)) FILTER (o_orderstatus <> 'P') AS latest FROM orders GROUP BY o_custkey")
def _(t: Tables) -> DataFrame:
    v = t.orders.select(F.col("o_custkey").alias("crate"), F.when(F.col("o_orderstatus") != "P", F.expr(SEMVER.format("STRING"))).alias("v"))
    return v.groupBy("crate").agg(F.max_by("v", F.when(F.col("v").isNotNull(), text.semver_key(F.col("v")))).alias("latest"))


@query("state_hash", "SELECT package, sha256(string_agg(version || ':' || CAST(yanked AS VARCHAR), ',' ORDER BY version || ':' || CAST(yanked AS VARCHAR))) AS state_hash FROM fx_state_old GROUP BY package")
def _(t: Tables) -> DataFrame:
    return cdc.state_hash(t.fx_state_old, "package", F.concat_ws(":", "version", F.col("yanked").cast("string")))


@query("event_ids", "SELECT event_id AS id, sha256(event_type || '|' || ecosystem || '|' || package_id || ':' || version || '|' || md5(version)) AS event_id FROM fx_package_event")
def _(t: Tables) -> DataFrame:
    return t.fx_package_event.select(F.col("event_id").alias("id"), cdc.event_id(F.col("event_type"), F.col("ecosystem"), F.concat_ws(":", "package_id", "version"), F.md5(F.col("version").cast("binary"))).alias("event_id"))


# Event folds.


@query("fold_packages", "SELECT package_id AS id, min(published_at) AS created_at, max(published_at) AS updated_at, max(published_at) FILTER (ecosystem = 'error') AS deleted_at FROM fx_package_event GROUP BY package_id")
def _(t: Tables) -> DataFrame:
    p = F.col("published_at")
    return t.fx_package_event.groupBy(F.col("package_id").alias("id")).agg(F.min(p).alias("created_at"), F.max(p).alias("updated_at"), F.max(F.when(F.col("ecosystem") == "error", p)).alias("deleted_at"))


@query("fold_versions", "SELECT package_id || '@' || CAST(event_id % 50 AS VARCHAR) AS id, min(published_at) AS created_at, bool_or(ecosystem = 'error') AS yanked, min(published_at) FILTER (ecosystem = 'error') AS yanked_at FROM fx_package_event GROUP BY 1")
def _(t: Tables) -> DataFrame:
    err = F.col("ecosystem") == "error"
    return t.fx_package_event.groupBy(F.concat_ws("@", "package_id", (F.col("event_id") % 50).cast("string")).alias("id")).agg(F.min("published_at").alias("created_at"), F.bool_or(err).alias("yanked"), F.min(F.when(err, F.col("published_at"))).alias("yanked_at"))


@query("fold_depends_on", "WITH last AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey) SELECT DISTINCT 'customer:' || CAST(o_custkey AS VARCHAR) AS src, 'part:' || CAST(l_partkey AS VARCHAR) AS dst FROM last JOIN lineitem ON l_orderkey = k")
def _(t: Tables) -> DataFrame:
    """The dependencies of each package's last event replace those of earlier ones."""
    last = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    return t.lineitem.join(last, "l_orderkey").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


# The graph's sink: an order is an event on one of its customer's versions, its lines are the dependencies; three batches, the newest first.

GRAPH_EVENTS = "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'deleted' WHEN o_orderkey % 7 = 0 THEN 'yanked' ELSE 'published' END AS kind, 'customer:' || CAST(o_custkey AS STRING) AS package_id, o_orderpriority AS ecosystem, 'c' || CAST(o_custkey AS STRING) AS name, CAST(o_orderkey % 3 AS STRING) AS version, o_orderdate AS seen, o_orderkey AS event_id FROM orders"


def graph_store(t: Tables) -> published.Store:
    """A new store that has taken all events, in three batches whose order is not that of their times."""
    events = t.spark.sql(GRAPH_EVENTS.replace("FROM orders", "FROM {orders}"), orders=t.orders).withColumn("at", F.col("seen").cast("timestamp"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set(F.struct(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dependency"), F.concat(F.lit(">="), F.col("l_linenumber").cast("string")).alias("requirement"))).alias("dependencies"))
    events = stored(events.join(lists, "event_id", "left").select("kind", "package_id", "ecosystem", "name", "version", "dependencies", "at", "event_id"), "graph-events")
    store = published.Store(t.spark, f"{shared_dir(t.spark)}/graph-{uuid.uuid4().hex}", published.GRAPH, buckets=8)
    for number in range(3):
        store.commit(number, published.graph_changes(events.where(f"event_id % 3 = {2 - number}")))
    return store


GRAPH_SQL = f"e AS ({GRAPH_EVENTS.replace('STRING', 'VARCHAR')})"


@query("graph_sink_packages", f"WITH {GRAPH_SQL} SELECT package_id, arg_max(ecosystem, (seen, event_id)) AS ecosystem, arg_max(kind = 'deleted', (seen, event_id)) AS deleted, max(event_id) FILTER (event_id = le) AS last_event FROM (SELECT *, first_value(event_id) OVER (PARTITION BY package_id ORDER BY seen DESC, event_id DESC) AS le FROM e) GROUP BY package_id")
def _(t: Tables) -> DataFrame:
    return graph_store(t).read("packages").select("package_id", "ecosystem", "deleted", "last_event")


@query("graph_sink_edges", f"WITH {GRAPH_SQL}, l AS (SELECT package_id, version, event_id FROM e WHERE kind = 'published' QUALIFY row_number() OVER (PARTITION BY package_id, version ORDER BY seen DESC, event_id DESC) = 1), v AS (SELECT package_id, version, min(seen) AS published_at, arg_max(kind = 'yanked', (seen, event_id)) AS yanked FROM e WHERE kind <> 'deleted' GROUP BY 1, 2) SELECT DISTINCT package_id, version, yanked, CAST(published_at AS TIMESTAMP) AS published_at, 'part:' || l_partkey AS dependency, '>=' || l_linenumber AS requirement FROM l JOIN v USING (package_id, version) JOIN lineitem ON l_orderkey = event_id")
def _(t: Tables) -> DataFrame:
    """The edges of each version's last published list, with what its yanks and first event made of the version: three tables of one manifest."""
    store = graph_store(t)
    manifest = store.manifest()
    versions = store.read("versions", manifest).select("package_id", "version", "yanked", F.col("published_at").cast("timestamp_ntz").alias("published_at"))
    return published.edges(store.read("dependencies", manifest)).join(versions, ["package_id", "version"])


@query("hard_delete", "SELECT (SELECT count(*) FROM fx_package WHERE deleted_at IS NULL) AS packages, (SELECT count(*) FROM fx_depends_on d WHERE d.package_id NOT IN (SELECT id FROM fx_package WHERE deleted_at IS NOT NULL)) AS depends_on, (SELECT count(*) FROM fx_depends_on_pkg e WHERE e.src NOT IN (SELECT id FROM fx_package WHERE deleted_at IS NOT NULL) AND e.dst NOT IN (SELECT id FROM fx_package WHERE deleted_at IS NOT NULL)) AS edges")
def _(t: Tables) -> DataFrame:
    gone = t.fx_package.where("deleted_at IS NOT NULL").select("id")
    p = t.fx_package.join(gone, "id", "left_anti").agg(F.count(F.lit(1)).alias("packages"))
    d = t.fx_depends_on.join(gone.withColumnRenamed("id", "package_id"), "package_id", "left_anti").agg(F.count(F.lit(1)).alias("depends_on"))
    e = t.fx_depends_on_pkg.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").agg(F.count(F.lit(1)).alias("edges"))
    return p.crossJoin(d).crossJoin(e)  # tables of one row


@query("dedupe_latest", "SELECT package_id, event_id FROM (SELECT package_id, event_id, row_number() OVER (PARTITION BY package_id ORDER BY event_id % 100 DESC, event_id) AS n FROM fx_package_event) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    return cdc.latest(t.fx_package_event, ["package_id"], F.desc(F.col("event_id") % 100), F.asc("event_id")).select("package_id", "event_id")


# Outbox.

OUTBOX = "(SELECT event_id, event_type AS kind, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'deadletter' WHEN 'click' THEN 'publishing' ELSE 'pending' END AS status, CAST(event_id % 11 AS INT) AS attempts FROM events)"


def outbox(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM {OUTBOX.replace('FROM events', 'FROM {events}')}", events=t.events)


@query("outbox_dedupe", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return cdc.latest(t.events, ["user_id"], F.asc("event_id")).select("user_id", "event_id")


DUE = "created_at + to_days(CAST(event_id % 5 AS INT))"


@query("outbox_claim", f"SELECT event_id, 'publishing' AS status, attempts + 1 AS attempts FROM {OUTBOX} WHERE status = 'pending' AND {DUE} <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY ORDER BY created_at, event_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    """The oldest hundred that are due; each is marked and counted."""
    as_of = F.broadcast(t.events.agg(F.max("ts").alias("as_of")))  # one row
    due = F.col("created_at") + F.make_dt_interval((F.col("event_id") % 5).cast("int")) <= F.col("as_of") - F.expr("INTERVAL 2 DAYS")
    page = outbox(t).where("status = 'pending'").crossJoin(as_of).where(due).orderBy("created_at", "event_id").limit(100)
    return page.select("event_id", F.lit("publishing").alias("status"), (F.col("attempts") + 1).alias("attempts"))


@query("outbox_backoff", f"SELECT event_id, CASE WHEN attempts >= 10 THEN 0 WHEN attempts <= 1 THEN 1 WHEN attempts = 2 THEN 2 WHEN attempts = 3 THEN 5 WHEN attempts = 4 THEN 10 WHEN attempts = 5 THEN 30 ELSE 60 END AS retry_minutes, CASE WHEN attempts >= 10 THEN 'deadletter' ELSE 'pending' END AS next_status FROM {OUTBOX} WHERE status = 'publishing'")
def _(t: Tables) -> DataFrame:
    a = F.col("attempts")
    wait = F.when(a >= 10, 0).when(a <= 1, 1).when(a == 2, 2).when(a == 3, 5).when(a == 4, 10).when(a == 5, 30).otherwise(60)
    return outbox(t).where("status = 'publishing'").select("event_id", wait.alias("retry_minutes"), F.when(a >= 10, "deadletter").otherwise("pending").alias("next_status"))


@query("outbox_stuck", f"SELECT event_id, CASE WHEN status = 'publishing' AND created_at < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'pending' ELSE status END AS status FROM {OUTBOX}")
def _(t: Tables) -> DataFrame:
    """Rows that have been publishing for over seven days are released."""
    last = F.broadcast(t.events.agg(F.max("ts").alias("as_of")))  # one row
    stuck = (F.col("status") == "publishing") & (F.col("created_at") < F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    return outbox(t).crossJoin(last).select("event_id", F.when(stuck, "pending").otherwise(F.col("status")).alias("status"))


@query("outbox_stats", f"SELECT status, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest, round(avg(attempts), 6) AS avg_attempts, max(attempts) AS max_attempts FROM {OUTBOX} GROUP BY status")
def _(t: Tables) -> DataFrame:
    return outbox(t).groupBy("status").agg(rows_n(), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.round(F.avg("attempts"), 6).alias("avg_attempts"), F.max("attempts").alias("max_attempts"))


@query("outbox_backlog", f"SELECT kind, count(*) AS n FROM {OUTBOX} WHERE status = 'pending' GROUP BY kind")
def _(t: Tables) -> DataFrame:
    return outbox(t).where("status = 'pending'").groupBy("kind").agg(rows_n()).orderBy(F.desc("n"), "kind")


@query("outbox_failures", f"SELECT event_id, status, attempts FROM {OUTBOX} WHERE status = 'deadletter' OR attempts >= 5 ORDER BY created_at DESC, event_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return outbox(t).where("status = 'deadletter' OR attempts >= 5").orderBy(F.desc("created_at"), "event_id").limit(100).select("event_id", "status", "attempts")


@query("stream_dedupe", "SELECT DISTINCT package_id, event_type FROM fx_package_event")
def _(t: Tables) -> DataFrame:
    return t.fx_package_event.dropDuplicates(["package_id", "event_type"]).select("package_id", "event_type")


# Materialised views: the builders serve batch and streams alike.


@query("mv_ecosystem_stats", "SELECT ecosystem, count(DISTINCT package_id) AS packages, count(*) AS versions, max(published_at) AS last_published FROM fx_package_event WHERE event_type = 'new_version' GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    return views.ecosystem_stats(t.fx_package_event)


@query("mv_hourly_activity", "SELECT date_trunc('hour', published_at) AS hour, ecosystem, count(*) AS n FROM fx_package_event WHERE published_at > (SELECT max(published_at) FROM fx_package_event) - INTERVAL 7 DAY GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    as_of = F.broadcast(t.fx_package_event.agg(F.max("published_at").alias("as_of")))  # one row
    return views.hourly_activity(t.fx_package_event.join(as_of, F.col("published_at") > F.col("as_of") - F.expr("INTERVAL 7 DAYS")))


@query("mv_breaking_changes", "SELECT package_id, version, json_array_length(breaking_changes) AS changes FROM fx_analysis_result WHERE json_array_length(breaking_changes) > 0")
def _(t: Tables) -> DataFrame:
    return views.breaking_changes(t.fx_analysis_result)


@query("mv_popular_packages", "SELECT package_id, count(*) AS n, max(published_at) AS last FROM fx_package_event WHERE published_at > (SELECT max(published_at) FROM fx_package_event) - INTERVAL 30 DAY GROUP BY package_id ORDER BY n DESC, package_id LIMIT 1000")
def _(t: Tables) -> DataFrame:
    as_of = F.broadcast(t.fx_package_event.agg(F.max("published_at").alias("as_of")))  # one row
    recent = t.fx_package_event.join(as_of, F.col("published_at") > F.col("as_of") - F.expr("INTERVAL 30 DAYS"))
    return recent.groupBy("package_id").agg(rows_n(), F.max("published_at").alias("last")).orderBy(F.desc("n"), "package_id").limit(1000)


@query("package_stats", "SELECT ecosystem, count(*) AS n, count(DISTINCT name) AS names FROM fx_package GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    return t.fx_package.groupBy("ecosystem").agg(rows_n(), F.count_distinct("name").alias("names"))


@query("dependency_stats", "SELECT dst AS id, count(*) AS n FROM fx_depends_on_pkg GROUP BY dst ORDER BY n DESC, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return t.fx_depends_on_pkg.groupBy(F.col("dst").alias("id")).agg(rows_n()).orderBy(F.desc("n"), "id").limit(100)


@query("trending_packages", "SELECT package_id, count(*) AS n FROM fx_package_event WHERE published_at > (SELECT max(published_at) FROM fx_package_event) - INTERVAL 1 DAY GROUP BY package_id ORDER BY n DESC, package_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    as_of = F.broadcast(t.fx_package_event.agg(F.max("published_at").alias("as_of")))  # one row
    return t.fx_package_event.join(as_of, F.col("published_at") > F.col("as_of") - F.expr("INTERVAL 1 DAY")).groupBy("package_id").agg(rows_n()).orderBy(F.desc("n"), "package_id").limit(50)


@query("latest_packages", "SELECT package_id, max_by(version, (published_at, event_id)) AS version, max(published_at) AS updated_at FROM fx_package_event GROUP BY package_id")
def _(t: Tables) -> DataFrame:
    rows = cdc.latest(t.fx_package_event, ["package_id"], F.desc("published_at"), F.desc("event_id"))
    return rows.select("package_id", "version", F.col("published_at").alias("updated_at"))


@query("sub_breaking_changes", "SELECT package_id, version FROM fx_analysis_result WHERE json_array_length(breaking_changes) >= 2")
def _(t: Tables) -> DataFrame:
    return views.breaking_changes(t.fx_analysis_result).where("changes >= 2").select("package_id", "version")


@query("live_stats", "WITH m AS (SELECT max(published_at) AS a FROM fx_package_event) SELECT ecosystem, count(*) FILTER (published_at > a - INTERVAL 1 DAY) AS last_day, round(100.0 * (count(*) FILTER (published_at > a - INTERVAL 1 DAY) - count(*) FILTER (published_at <= a - INTERVAL 1 DAY AND published_at > a - INTERVAL 2 DAY)) / nullif(count(*) FILTER (published_at <= a - INTERVAL 1 DAY AND published_at > a - INTERVAL 2 DAY), 0), 6) AS change_rate_percent FROM fx_package_event, m GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    as_of = F.broadcast(t.fx_package_event.agg(F.max("published_at").alias("a")))  # one row
    age = F.col("a") - F.col("published_at")
    now, before = F.count_if(age < F.expr("INTERVAL 1 DAY")), F.count_if((age >= F.expr("INTERVAL 1 DAY")) & (age < F.expr("INTERVAL 2 DAYS")))
    return t.fx_package_event.crossJoin(as_of).groupBy("ecosystem").agg(now.alias("last_day"), F.round(100.0 * (now - before) / F.nullif(before, F.lit(0)), 6).alias("change_rate_percent"))


@query("live_event_rate", "SELECT event_type, count(*) AS n, round(count(*) / greatest(1, epoch(max(published_at) - min(published_at)) / 60), 1) AS per_minute FROM fx_package_event GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    minutes = (F.max("published_at").cast("timestamp").cast("double") - F.min("published_at").cast("timestamp").cast("double")) / 60
    return t.fx_package_event.groupBy("event_type").agg(rows_n(), F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), minutes), 1).alias("per_minute"))


# Audit.

CATEGORY = "CASE WHEN lower(action) LIKE '%auth%' THEN 'authentication' WHEN lower(action) LIKE '%policy%' THEN 'policy' WHEN lower(action) LIKE '%security%' THEN 'security' WHEN lower(action) LIKE '%access%' THEN 'access' WHEN lower(action) LIKE '%config%' THEN 'configuration' WHEN lower(action) LIKE '%compliance%' THEN 'compliance' ELSE 'system' END"
SEVERITY = "CASE WHEN status_code IS NULL THEN 'notice' WHEN status_code < 400 THEN 'info' WHEN status_code < 500 THEN 'warning' ELSE 'error' END"


def category(action: Column) -> Column:
    """By the first of these words that an action holds, in this order."""
    low = F.lower(action)
    return F.when(low.contains("auth"), "authentication").when(low.contains("policy"), "policy").when(low.contains("security"), "security").when(low.contains("access"), "access").when(low.contains("config"), "configuration").when(low.contains("compliance"), "compliance").otherwise("system")


def severity(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").when(status.isNotNull(), "info").otherwise("notice")


SELECTED = "tenant_id = 'tenant1' AND action = 'SECURITY_SCAN' AND created_at >= TIMESTAMP '2020-01-01'"


@query("audit_events", f"SELECT id, action, user_id, (SELECT count(*) FROM fx_audit_log WHERE {SELECTED}) AS total FROM fx_audit_log WHERE {SELECTED} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def _(t: Tables) -> DataFrame:
    """A page of events with the number of all that fit."""
    hits = t.fx_audit_log.where(SELECTED)
    page = hits.orderBy(F.desc("created_at"), "id").offset(20).limit(20)
    return page.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))).select("id", "action", "user_id", "total")  # one row


@query("audit_classified", f"SELECT id, {CATEGORY} AS category, {SEVERITY} AS severity, CASE WHEN status_code IS NULL THEN 'unknown' WHEN status_code BETWEEN 200 AND 299 THEN 'success' ELSE 'failure' END AS outcome, CASE WHEN user_id IS NULL THEN 'system' ELSE 'user' END AS actor_type FROM fx_audit_log")
def _(t: Tables) -> DataFrame:
    s = F.col("status_code")
    outcome = F.when((s >= 200) & (s < 300), "success").when(s.isNotNull(), "failure").otherwise("unknown")
    actor = F.when(F.col("user_id").isNotNull(), "user").otherwise("system")
    return t.fx_audit_log.select("id", category(F.col("action")).alias("category"), severity(s).alias("severity"), outcome.alias("outcome"), actor.alias("actor_type"))


@query("compliance_report", "SELECT count(*) AS total, coalesce(sum(CASE WHEN action ILIKE '%security%' THEN 1 ELSE 0 END), 0)::BIGINT AS security, coalesce(sum(CASE WHEN action ILIKE '%policy%' THEN 1 ELSE 0 END), 0)::BIGINT AS policy, coalesce(sum(CASE WHEN action ILIKE '%compliance%' THEN 1 ELSE 0 END), 0)::BIGINT AS compliance, coalesce(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END), 0)::BIGINT AS violations FROM fx_audit_log WHERE tenant_id = 'tenant1' AND created_at BETWEEN (SELECT max(created_at) FROM fx_audit_log) - INTERVAL 30 DAY AND (SELECT max(created_at) FROM fx_audit_log)")
def _(t: Tables) -> DataFrame:
    a = F.col("action")
    as_of = F.broadcast(t.fx_audit_log.agg(F.max("created_at").alias("as_of")))  # one row
    rows = t.fx_audit_log.where("tenant_id = 'tenant1'").join(as_of, F.col("created_at").between(F.col("as_of") - F.expr("INTERVAL 30 DAYS"), F.col("as_of")))
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(a.ilike(f"%{x}%")).alias(x) for x in ("security", "policy", "compliance")], F.count_if(F.col("status_code") >= 400).alias("violations"))


@query("audit_retention", "SELECT l.id FROM fx_audit_log l LEFT JOIN (SELECT 'tenant1' AS tenant_id, 10 AS days UNION ALL SELECT 'tenant2', 20) s ON s.tenant_id = l.tenant_id WHERE l.created_at < (SELECT max(created_at) FROM fx_audit_log) - to_days(CAST(coalesce(s.days, 90) AS INT))")
def _(t: Tables) -> DataFrame:
    settings = t.spark.sql("SELECT 'tenant1' AS tenant_id, 10 AS days UNION ALL SELECT 'tenant2', 20")
    as_of = F.broadcast(t.fx_audit_log.agg(F.max("created_at").alias("a")))  # one row
    rows = t.fx_audit_log.join(settings, "tenant_id", "left").crossJoin(as_of)
    return rows.where(F.col("created_at") < F.col("a") - F.make_dt_interval(F.coalesce("days", F.lit(90)))).select("id")


@query("audit_monthly", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM fx_audit_log GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.fx_audit_log.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(rows_n())


@query("audit_category", "SELECT kind, CASE " + " ".join(f"WHEN kind IN ({', '.join(repr(n) for n in names.split())}) THEN '{category}'" for category, names in fixtures.AUDIT_TYPES.items()) + " ELSE 'system' END AS category, count(*) AS n FROM fx_audit_type GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in fixtures.AUDIT_CATEGORY.items() for x in pair])
    return t.fx_audit_type.groupBy("kind").agg(rows_n()).select("kind", F.coalesce(names[F.col("kind")], F.lit("system")).alias("category"), "n")


@query("audit_by_category", f"SELECT {CATEGORY} AS category, {SEVERITY} AS severity, count(*) AS n FROM fx_audit_log GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.fx_audit_log.select(category(F.col("action")).alias("category"), severity(F.col("status_code")).alias("severity")).groupBy("category", "severity").agg(rows_n())


@query("audit_daily", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(100.0 * count(*) FILTER (status_code >= 400) / count(*), 6) AS violation_rate FROM fx_audit_log GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.fx_audit_log.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(rows_n(), F.round(100.0 * F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1)), 6).alias("violation_rate"))


# Time series over events: value as a counter of each type and user.


@query("ts_rate", "SELECT event_type, hour, round(sum(inc) / 3600, 6) AS rate FROM (SELECT event_type, date_trunc('hour', ts) AS hour, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY event_type, hour")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return timeseries.increase(e, ["event_type", "user_id"], "at", "value").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.sum("_inc") / 3600, 6).alias("rate"))


@query("error_ratio_5m", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS at, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("ratio")).select(F.col("w.start").alias("at"), "ratio")


BOUNDS = (5, 10, 25, 50, 75, 90, 99)
BUCKETS = "(SELECT event_type, b.le, count(*) FILTER (value <= b.le) / 300.0 AS rate FROM events, (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in BOUNDS) + ", ('infinity'::DOUBLE)) b(le) GROUP BY event_type, b.le)"


def quantile_sql(q: float) -> str:
    """Of the first bucket that holds the rank: its lower bound, and the share of its width that the rank is in; beyond the last bound, that bound."""
    return f"(SELECT event_type, CASE WHEN le = 'infinity' THEN below ELSE below + (le - below) * (rank - under) / (rate - under) END AS x FROM (SELECT event_type, le, rate, coalesce(lag(le) OVER w, 0) AS below, coalesce(lag(rate) OVER w, 0) AS under, {q} * max(rate) OVER (PARTITION BY event_type) AS rank FROM {BUCKETS} WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE rate >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1)"


@query("latency_quantiles", "SELECT a.event_type, round(a.x, 6) AS p50, round(b.x, 6) AS p95, round(c.x, 6) AS p99 FROM " + f"{quantile_sql(0.5)} a JOIN {quantile_sql(0.95)} b USING (event_type) JOIN {quantile_sql(0.99)} c USING (event_type)")
def _(t: Tables) -> DataFrame:
    """Quantiles from cumulative buckets of five-minute rates: one row of counts a type, however many values there are."""
    rates = t.events.groupBy("event_type").agg(F.array(*[F.count_if(F.col("value") <= b) / 300 for b in BOUNDS], F.count("value") / 300).alias("rates"))
    return rates.select("event_type", *[F.round(timeseries.histogram_quantile(F.col("rates"), BOUNDS, q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


@query("availability_1h", "SELECT date_trunc('hour', ts) AS hour, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END), 6) AS availability FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg(F.when(F.col("event_type") == "error", 0).otherwise(1)), 6).alias("availability"))


@query("alert_sustained", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) > 55 AS fires FROM events GROUP BY 1, 2), g AS (SELECT *, sum(CASE WHEN fires THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM h) SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS n FROM g WHERE fires GROUP BY event_type, island HAVING count(*) >= 3")
def _(t: Tables) -> DataFrame:
    hours = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    return timeseries.sustained(hours, ["event_type"], "hour", F.col("v") > 55).where("n >= 3")


@query("rate_limit_audit", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1")
def _(t: Tables) -> DataFrame:
    return t.events.withColumn("n", F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)")).where("n > 1").select("event_id")
