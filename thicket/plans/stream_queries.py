"""Queries of stream jobs with state, of range vectors and of partitioned tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import timeseries
from ..sources import keyset, protobuf
from ..storage import shared_dir, stored
from ..streaming import partitions, published, state, views
from .registry import Tables, query


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("ecosystem_stats_stream", "SELECT ecosystem, count(DISTINCT package_id) AS packages, count(*) AS versions, CAST(max(published_at) AS TIMESTAMP) AS last_published FROM fx_package_event WHERE event_type = 'new_version' GROUP BY ecosystem")
def _(t: Tables) -> DataFrame:
    """Exact distinct packages by a stream over the events' files, batch by batch."""
    place = folder(t, "ecosystems")
    events = t.fx_package_event.select("event_type", "package_id", "ecosystem", F.col("published_at").cast("timestamp").alias("published_at"))
    events.repartition(3).write.parquet(f"{place}/in")
    store = published.Store(t.spark, f"{place}/store", state.TOTALS, buckets=4)
    stream = views.file_source(t.spark, f"{place}/in", "event_type string, package_id string, ecosystem string, published_at timestamp", 1)
    state.ecosystem_totals(stream, store, f"{place}/checkpoint").awaitTermination()
    return store.read("ecosystems").withColumn("last_published", F.col("last_published").cast("timestamp_ntz"))


# The limiter over events at 600 times their pace, an event type and every fourth user group a key, with tiers that this traffic reaches.

PACE, RATES = 600, {"free": (4, 1.0), "pro": (4, 1.5), "enterprise": (4, 2.0), "unlimited": None}
REQUESTS = f"SELECT event_id, event_type || ':' || CAST(user_id % 4 AS STRING) AS client, CASE event_type WHEN 'click' THEN 'pro' WHEN 'view' THEN 'enterprise' WHEN 'signup' THEN 'unlimited' WHEN 'error' THEN NULL ELSE 'free' END AS tier, {{second}} AS s FROM events"
LIMITER = (
    "WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY s, event_id) AS i, CASE tier WHEN 'pro' THEN 6 WHEN 'enterprise' THEN 8 WHEN 'unlimited' THEN NULL ELSE 4 END AS bound FROM ("
    + REQUESTS.replace("STRING", "VARCHAR").format(second=f"CAST(floor(epoch(ts) / {PACE}) AS BIGINT)")
    + ")), w AS (SELECT client, 0::BIGINT AS i, []::BIGINT[] AS log, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::BIGINT AS wait FROM q GROUP BY client"
    " UNION ALL SELECT client, i, CASE WHEN bound IS NULL THEN recent WHEN len(recent) < bound THEN list_append(recent, s) ELSE recent END, event_id, bound IS NULL OR len(recent) < bound, CASE WHEN len(recent) >= bound THEN recent[1] + 60 - s ELSE 0 END"
    " FROM (SELECT q.client, q.i, q.s, q.bound, q.event_id, list_filter(w.log, lambda x: x > q.s - 60) AS recent FROM w JOIN q ON q.client = w.client AND q.i = w.i + 1))"
)


def requests(t: Tables) -> DataFrame:
    rows = t.spark.sql(REQUESTS.replace("FROM events", "FROM {events}").format(second=f"CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / {PACE}000000) AS BIGINT)", events="{events}"), events=t.events)
    return rows.withColumn("at", F.timestamp_seconds("s")).drop("s")


@query("rate_limiter", f"{LIMITER} SELECT event_id, client, allowed, wait AS reset_after FROM w WHERE i > 0")
def _(t: Tables) -> DataFrame:
    """Which requests a sliding log of 60 seconds lets pass, and how long the others had to wait."""
    return state.limited(requests(t), "client", "at", "event_id", tiers=RATES).select("event_id", "client", "allowed", "reset_after")


@query("rate_limiter_tiers", f"{LIMITER} SELECT coalesce(q.tier, 'none') AS plan, count(*) AS requests, count(*) FILTER (NOT allowed) AS denied, max(wait) AS longest_wait FROM w JOIN q USING (event_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The same by tier, through the stream: three batches in the order of time, logs kept in between."""
    place = folder(t, "limiter")
    rows = stored(requests(t), "requests")
    cuts = [r for r in rows.agg(F.percentile_approx("at", [0.3, 0.7])).first()[0]]
    for k, part in enumerate((rows.where(F.col("at") < F.lit(cuts[0])), rows.where((F.col("at") >= F.lit(cuts[0])) & (F.col("at") < F.lit(cuts[1]))), rows.where(F.col("at") >= F.lit(cuts[1])))):
        part.write.parquet(f"{place}/in/{k}")
        stream = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        views.run_available(state.limited(stream, "client", "at", "event_id", tiers=RATES, late="0 seconds"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return state.denied_by(t.spark.read.parquet(f"{place}/out"), F.coalesce("tier", F.lit("none")).alias("plan"))


# Polling by (time, id): pages of 2,500 events, whose times are cut to hours so that many tie.

PAGE = 2500
#: Pages in a micro-batch.
BATCH = 200


@query("keyset_pages", f"SELECT CAST(floor((n - 1) / {PAGE}) AS BIGINT) AS page, count(*) AS n, min(event_id) AS least, max(hour) AS latest FROM (SELECT event_id, date_trunc('hour', published_at) AS hour, row_number() OVER (ORDER BY date_trunc('hour', published_at), event_id) AS n FROM fx_package_event) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """What each page of the stream holds; the stream stops after its first batch of pages and goes on from its checkpoint.

    The polled table lies in the order of its key, as under an index. Its hours are numbers, as Spark's Parquet keeps no least and greatest timestamps.
    """
    place = folder(t, "polled")
    rows = t.fx_package_event.select("event_id", F.unix_micros(F.date_trunc("hour", F.col("published_at").cast("timestamp"))).alias("hour"))
    rows.repartitionByRange("hour", "event_id").sortWithinPartitions("hour", "event_id").write.parquet(f"{place}/in")
    t.spark.dataSource.register(keyset.KeysetSource)

    def page(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/page-{number:06d}")

    def poll(pages: int | None) -> None:
        source = t.spark.readStream.format("keyset").schema("event_id long, hour long").options(path=f"{place}/in", time="hour", id="event_id", page=PAGE, pages=BATCH).load()
        running = source.writeStream.foreachBatch(page).option("checkpointLocation", f"{place}/checkpoint").trigger(**({"availableNow": True} if pages else {"processingTime": "0 seconds"})).start()
        if pages:
            running.awaitTermination()
        else:
            running.processAllAvailable()
            running.stop()

    poll(1)
    poll(None)
    got = t.spark.read.schema("event_id long, hour long, batch long").option("recursiveFileLookup", "true").parquet(f"{place}/out")
    inside = F.floor((F.row_number().over(Window.partitionBy("batch").orderBy("hour", "event_id")) - 1) / PAGE)  # a batch is a bounded number of rows
    pages = got.withColumn("inside", inside).groupBy("batch", "inside").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), F.max(F.timestamp_micros("hour")).cast("timestamp_ntz").alias("latest"))
    # Batches without rows have numbers too.
    ranked = pages.withColumn("page", F.row_number().over(Window.orderBy("batch", "inside")).cast("long") - 1)  # a row a page
    return ranked.select("page", "n", "least", "latest")


# Protobuf: orders as published versions, a part of them yanked, without an archive, cut off, or as JSON.

PROTOBUF = """SELECT o_orderkey AS id, CASE WHEN k = 1 THEN 'malformed' WHEN k = 2 THEN 'yanked' WHEN k = 3 THEN 'no archive' END AS error, CASE WHEN k NOT IN (1, 2, 3) THEN 'npm:customer' || o_custkey END AS package_id, CASE WHEN k NOT IN (1, 2, 3) THEN '1.0.' || o_orderkey END AS version,
  CASE WHEN k NOT IN (1, 2, 3) THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 0 END AS seconds, CASE WHEN k IN (0, 1, 2, 3) THEN 0 ELSE coalesce(n, 0) END AS dependencies, CASE WHEN k IN (0, 1, 2, 3) THEN '' ELSE coalesce(names, '') END AS names
FROM (SELECT *, o_orderkey % 9 AS k FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg('part' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""


def records(t: Tables) -> DataFrame:
    """id, value: a binary record of each order."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(F.concat(F.lit("part"), x["l_partkey"].cast("string")).alias("name"), F.lit("^1").alias("version_range"), (x["l_linenumber"] % 2 == 1).alias("is_peer"))).alias("dependencies"))
    o = t.orders.withColumn("id", F.col("o_orderkey")).join(lines, "id", "left")
    k, name = F.col("id") % 9, F.concat(F.lit("customer"), F.col("o_custkey").cast("string"))
    version, archive = F.concat(F.lit("1.0."), F.col("id").cast("string")), F.lit("https://archive.test/p.tgz")
    stamp = F.struct(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.lit(5000).alias("nanos"))
    meta = F.struct(F.col("id").cast("string").alias("event_id"), F.lit("orders").alias("source"))
    message = F.struct(meta.alias("meta"), F.lit("npm").alias("ecosystem"), name.alias("package_name"), version.alias("version"), (k == 2).alias("yanked"), F.when(k != 3, archive).otherwise(" ").alias("tarball_url"), (F.col("id") * 1000).alias("size_bytes"), stamp.alias("published_at"), F.coalesce("dependencies", F.array().cast("array<struct<name:string,version_range:string,is_peer:boolean>>")).alias("dependencies"))
    wired = protobuf.encoded(o.select("id", "o_custkey", "o_orderdate", message.alias("m")), "m", protobuf.VERSION_UPSERTED)
    json = F.to_json(F.struct(F.concat(F.lit("npm:"), name).alias("package_id"), version.alias("version"), F.lit("npm").alias("ecosystem"), archive.alias("tarball_url"), F.col("o_orderdate").cast("timestamp").alias("published_at")))
    cut = F.substring("value", F.lit(1), F.octet_length("value") - 1)
    return wired.select("id", F.when(k == 0, json.cast("binary")).when(k == 1, cut).otherwise(F.col("value")).alias("value"))


@query("decode_protobuf", PROTOBUF)
def _(t: Tables) -> DataFrame:
    """Versions from records of both forms, JSON first, with what is wrong about the others."""
    got = protobuf.version_events(records(t), "value")
    n = F.coalesce(F.size("dependencies"), F.lit(0))
    return got.select(
        "id", F.regexp_replace("error", ":.*", "").alias("error"), "package_id", "version", F.coalesce(F.unix_seconds("published_at"), F.lit(0)).alias("seconds"),
        F.when(n > 0, n).otherwise(0).cast("long").alias("dependencies"), F.coalesce(F.array_join(F.transform("dependencies", lambda d: d["name"]), ","), F.lit("")).alias("names"),
    )


# The life of packages as records of three topics: orders by their number, some of a topic that the graph does not know.

LIFE = """SELECT event_id, CASE WHEN k = 3 THEN 'no such topic: other' END AS error, CASE k WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'yanked' ELSE 'published' END WHEN 1 THEN 'yanked' WHEN 2 THEN 'deleted' END AS kind, CASE WHEN k < 3 THEN 'cargo:c' || o_custkey END AS package_id, CASE WHEN k < 2 THEN 'v' || event_id WHEN k = 2 AND event_id % 3 = 0 THEN 'v' || event_id END AS version, CASE WHEN k < 3 THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 0 END AS seconds, CASE WHEN k = 0 THEN 'cargo:d' || event_id % 10 || '=^' || event_id % 4 ELSE '' END AS needs FROM (SELECT o_orderkey AS event_id, o_orderkey % 4 AS k, o_custkey, o_orderdate FROM orders)"""


@query("decode_life", LIFE)
def _(t: Tables) -> DataFrame:
    """Publications, yanks and deletions as events of the package graph; deletions take the time of their envelope where they have none."""
    o, e = t.orders, F.col("event_id")
    o = o.withColumns({"event_id": F.col("o_orderkey"), "k": F.col("o_orderkey") % 4})
    stamp = F.struct(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.lit(0).alias("nanos"))
    meta = F.struct(e.cast("string").alias("event_id"), stamp.alias("occurred_at")).alias("meta")
    named = [meta, F.lit("cargo").alias("ecosystem"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("package_name")]
    version = F.concat(F.lit("v"), e.cast("string"))
    need = F.struct(F.concat(F.lit("d"), (e % 10).cast("string")).alias("name"), F.concat(F.lit("^"), (e % 4).cast("string")).alias("version_range"))
    upserted = F.struct(*named, version.alias("version"), (e % 5 == 0).alias("yanked"), stamp.alias("published_at"), F.array(need).alias("dependencies"))
    yanked = F.struct(*named, version.alias("version"), stamp.alias("yanked_at"))
    deleted = F.struct(*named, F.when(e % 3 == 0, version).alias("last_version"))
    found = None
    for k, (topic, message, fields) in enumerate((("version_upserted", upserted, protobuf.VERSION_UPSERTED), ("version_yanked", yanked, protobuf.VERSION_YANKED), ("package_deleted", deleted, protobuf.PACKAGE_DELETED), ("other", yanked, protobuf.VERSION_YANKED))):
        part = protobuf.encoded(o.where(F.col("k") == k).select("event_id", message.alias("m")), "m", fields).withColumn("topic", F.lit(topic))
        found = part if found is None else found.unionByName(part)
    got = protobuf.graph_events(found, "value", "topic", "event_id")
    needs = F.coalesce(F.array_join(F.transform("dependencies", lambda d: F.concat_ws("=", d["dependency"], d["requirement"])), ","), F.lit(""))
    return got.select("event_id", "error", "kind", "package_id", "version", F.coalesce(F.unix_seconds("at"), F.lit(0)).alias("seconds"), needs.alias("needs"))


# Records of a topic: analysis results as JSON bytes, of which some are cut off or lack their package.

RESULTS = "(SELECT event_id, package_id, version, breaking_changes, analyzed_at, event_id % 11 AS k FROM fx_analysis_result)"


@query("analysis_records", f"SELECT event_id, CASE WHEN k = 0 THEN 'not json' WHEN k = 1 THEN 'no package_id' END AS reason, CASE WHEN k > 1 THEN package_id || '@' || version END AS release, CASE WHEN k > 1 THEN json_array_length(breaking_changes) ELSE 0 END AS changes FROM {RESULTS}")
def _(t: Tables) -> DataFrame:
    """Records decoded as they come from their source, and the dead letters with their reasons."""
    k = F.col("event_id") % 11
    body = F.to_json(F.struct(F.when(k != 1, F.col("package_id")).alias("package_id"), "version", "breaking_changes", "analyzed_at"))
    records = t.fx_analysis_result.select("event_id", F.when(k == 0, F.left(body, F.char_length(body) - 1)).otherwise(body).alias("value"))
    good, letters = views.split_letters(records, "value", "package_id string, version string, breaking_changes string", "package_id")
    kept = good.select("event_id", F.lit(None).cast("string").alias("reason"), F.concat_ws("@", "package_id", "version").alias("release"), F.json_array_length("breaking_changes").cast("long").alias("changes"))
    return kept.unionByName(letters.select("event_id", "reason", F.lit(None).cast("string").alias("release"), F.lit(0).cast("long").alias("changes")))


# Range vectors: evaluations each hour, over ranges of six hours and of a day.

GROWN = "(SELECT event_type, ts, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events))"


def steps(seconds: int, width: int, source: str) -> str:
    """Each evaluation that sees a row, by a join of the rows with all evaluations between the first and the last."""
    grid = f"(SELECT unnest(range(CAST(ceil(epoch(min(ts)) / {seconds}) AS BIGINT), CAST(ceil(epoch(max(ts)) / {seconds}) AS BIGINT) + {width // seconds})) AS g FROM events)"
    return f"{grid} x JOIN {source} e ON epoch(e.ts) > x.g * {seconds} - {width} AND epoch(e.ts) <= x.g * {seconds}"


@query("error_rate_ratio", f"SELECT make_timestamp(g * 3600000000) AS evaluated, round(sum(inc) FILTER (event_type = 'error') / sum(inc), 6) AS ratio FROM {steps(3600, 21600, GROWN)} GROUP BY g HAVING sum(inc) > 0 AND coalesce(sum(inc) FILTER (event_type = 'error'), 0) > 0.05 * sum(inc)")
def _(t: Tables) -> DataFrame:
    """Where the rate of errors is over a twentieth of all rates, both over six hours."""
    series = t.events.withColumn("order", F.struct("ts", "event_id"))
    found = timeseries.rate_ratio(series, ["event_type", "user_id"], "ts", "order", "value", F.col("event_type") == "error", 3600, 21600)
    return found.where("ratio > 0.05").select(F.col("at").cast("timestamp_ntz").alias("evaluated"), F.round("ratio", 6).alias("ratio"))


@query("availability_over_time", f"SELECT make_timestamp(g * 3600000000) AS evaluated, user_id % 3 AS job, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END), 6) AS availability, count(*) AS n FROM {steps(3600, 86400, 'events')} GROUP BY ALL HAVING avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) < 0.8")
def _(t: Tables) -> DataFrame:
    """Hours whose last day's average of up samples, by job, is below the target."""
    up = F.when(F.col("event_type") == "error", 0).otherwise(1)
    found = timeseries.avg_over_time(t.events.withColumn("job", F.col("user_id") % 3), ["job"], "ts", up, 3600, 86400)
    return found.where("average < 0.8").select(F.col("at").cast("timestamp_ntz").alias("evaluated"), "job", F.round("average", 6).alias("availability"), "n")


# The audit log by month.

AUDIT = "id long, tenant_id string, user_id long, action string, status_code int, created_at timestamp"


@query("audit_partitioned", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT tenant_id) AS tenants FROM fx_audit_log WHERE created_at >= TIMESTAMP '2024-01-10 12:00:00' AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Days of a range, from the log's monthly partitions, written in two batches of which one runs twice."""
    place = folder(t, "audit")
    rows = t.fx_audit_log.select("id", "tenant_id", F.col("user_id").cast("long").alias("user_id"), "action", F.col("status_code").cast("int").alias("status_code"), F.col("created_at").cast("timestamp").alias("created_at"))
    for batch in (0, 1, 1):
        partitions.write(rows.where(F.col("id") % 2 == batch), place, "created_at", batch)
    partitions.create_ahead(t.spark, place, dt.date(2024, 2, 1))
    found = partitions.read(t.spark, place, AUDIT, "created_at", dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20))
    return found.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tenant_id").alias("tenants"))
