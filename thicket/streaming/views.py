"""Builders of the materialised views, one for batch and stream, and the stream jobs around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def decoded(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """rows with the fields of their JSON value; a malformed value has null fields."""
    return rows.withColumn("_v", F.from_json(value, schema)).select("*", "_v.*").drop("_v")


def kafka_source(spark: SparkSession, brokers: str, topic: str, schema: str) -> DataFrame:
    """A JSON topic from its earliest offset (needs the Kafka connector)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return decoded(raw.select(F.col("value").cast("string").alias("value")), "value", schema).drop("value")


def file_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ecosystem_stats(events: DataFrame) -> DataFrame:
    """Distinct packages are exact in a batch; a stream counts them by a sketch of bounded state (relative error about 0.05)."""
    new = events.where("event_type = 'new_version'")
    distinct = F.approx_count_distinct("package_id") if events.isStreaming else F.count_distinct("package_id")
    return new.groupBy("ecosystem").agg(distinct.alias("packages"), F.count(F.lit(1)).alias("versions"), F.max("published_at").alias("last_published"))


def hourly_activity(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by hour and ecosystem; the watermark bounds a stream's state to the hours that can still change."""
    if events.isStreaming:
        events = events.withWatermark("published_at", late)
    by = events.groupBy(F.window("published_at", "1 hour").alias("w"), "ecosystem").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("hour"), "ecosystem", "n")


def breaking_changes(results: DataFrame) -> DataFrame:
    counted = results.withColumn("changes", F.json_array_length("breaking_changes").cast("long"))
    return counted.where("changes > 0").select("package_id", "version", "changes")


#: Severities of breaking changes, the slightest first.
RANKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    """0 for the slightest; null for names that are no severity."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in RANKS]), F.upper(severity)), F.lit(0)) - 1


def subscribed(events: DataFrame, ecosystem: str | None = None, package_id: str | None = None, min_severity: str | None = None, min_impact: float | None = None) -> DataFrame:
    """The events that a subscription is for, of a batch or a stream; a filter that is not given lets all pass."""
    tests = []
    if ecosystem is not None:
        tests.append(F.col("ecosystem") == ecosystem)
    if package_id is not None:
        tests.append(F.col("package_id") == package_id)
    if min_severity is not None:
        tests.append(severity_rank(F.col("severity")) >= RANKS.index(min_severity.upper()))
    if min_impact is not None:
        tests.append(F.col("impact_score") >= min_impact)
    for test in tests:
        events = events.where(test)
    return events


def recent_activity(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """By keys: events of the last width (an SQL interval) up to the latest in the table, those of the one before, and the change in percent."""
    as_of = F.broadcast(events.agg(F.max(at).alias("_a")))  # one row
    age = F.col("_a") - F.col(at)
    now, before = F.count_if(age < F.expr(f"INTERVAL {width}")), F.count_if((age >= F.expr(f"INTERVAL {width}")) & (age < F.expr(f"2 * INTERVAL {width}")))
    return events.crossJoin(as_of).groupBy(*keys).agg(now.alias("now"), before.alias("before"), (100.0 * (now - before) / F.nullif(before, F.lit(0))).alias("change_percent"))


def deduped(events: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """The first event of each key; a stream forgets keys behind its watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that a stream has now and ends."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def split_letters(rows: DataFrame, value: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """The decoded rows, and the dead letters: rows as they came whose value lacks the required field or is no JSON, with the reason."""
    got = decoded(rows, value, schema)
    good = got.where(F.col(required).isNotNull()).drop(value)
    reason = F.when(F.get_json_object(value, "$").isNull(), "not json").otherwise(f"no {required}")
    return good, got.where(F.col(required).isNull()).select(*rows.columns, reason.alias("reason"))


def upsert_sink(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merges each micro-batch last-wins by keys into a table of hash buckets under path; read it with upserted.

    Only the buckets that a batch touches are written anew, each as a new file
    group under its bucket and the batch's number; a batch that runs again after
    a failure writes the same groups again. A bucket keeps its last two groups.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        old = live_groups(spark, path, before=number)
        parts = [old[b] for b in touched if b in old]
        rows = batch.withColumn("_new", F.lit(1))
        if parts:
            rows = spark.read.schema(batch.schema).parquet(*parts).withColumn("_new", F.lit(0)).unionByName(rows)
        # Equal orders: the newer batch wins.
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("_r")).select("_r.*")
        last.withColumns({"bucket": bucket, "batch": F.lit(number)}).write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for b in touched:
            for group in old_groups(spark, path, b)[:-2]:
                remove(spark, group)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The folders below path, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in files.listStatus(place) if s.isDirectory()) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def old_groups(spark: SparkSession, path: str, bucket: int) -> list[str]:
    """The file groups of a bucket, oldest batch first."""
    return sorted(_listed(spark, f"{path}/bucket={bucket}"), key=lambda x: int(x.rpartition("=")[2]))


def live_groups(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest file group of each bucket, of batches before the given one."""
    out = {}
    for folder in _listed(spark, path):
        bucket = int(folder.rpartition("=")[2])
        groups = [g for g in old_groups(spark, path, bucket) if before is None or int(g.rpartition("=")[2]) < before]
        if groups:
            out[bucket] = groups[-1]
    return out


def upserted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that upsert_sink keeps under path."""
    groups = [*live_groups(spark, path).values()]
    return spark.read.schema(schema).parquet(*groups) if groups else spark.createDataFrame([], schema)
