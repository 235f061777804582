"""Analysis of package releases, from sources to events, with snapshots that outlive a run.

A batch of releases goes through: symbols of their files, a hash of their public
interface, vectors of their public symbols, a diff against the snapshot of the
previous version, events. Snapshots, vectors and events are tables of one
published store, so a batch shows all of its results at once or none, and one
that runs again after it was published changes nothing. The previous version can
be of an earlier batch or of the same.

Defined cases: releases larger than ``most_bytes`` are passed over; a release
without files has an empty interface; files of unknown languages count nowhere;
files whose brackets do not close count as errors, with what could be read of
them; symbols of one path in a release (overloads) are one, with all signatures;
a previous version without a snapshot gives no diff. A vector belongs to the
snapshot of its event_id; those of earlier snapshots of a version can stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import embedding, text
from ..operators import cdc, symbols
from ..storage import stored
from .published import Change, Store, Table, sink

SYMBOL = "struct<path:string,kind:string,public:boolean,signature:string>"
CHANGE = "struct<path:string,change:string,severity:string>"
TABLES = {
    # Digests are kept as bytes, and of vectors the few slots that are not zero; a reader sees digits and whole vectors.
    "snapshots": Table(
        f"package_id string, version string, hash binary, files long, errors long, symbols array<{SYMBOL}>, at timestamp, event_id long",
        ("package_id", "version"),
        ("package_id", "version"),
        ("package_id", "version", "lower(hex(hash)) AS api_hash", "files", "errors", "symbols", "at", "event_id"),
    ),
    "vectors": Table(
        "package_id string, version string, path string, slots array<int>, values array<double>, at timestamp, event_id long",
        ("package_id", "version", "path"),
        ("package_id", "version"),
        ("package_id", "version", "path", f"{embedding.WHOLE.format(embedding.DIMENSION)} AS vector", "at", "event_id"),
    ),
    "events": Table(
        f"digest binary, kind string, package_id string, version string, previous_version string, symbols long, public_symbols long, hash binary, breaking long, changes array<{CHANGE}>, at timestamp",
        ("package_id", "version", "kind"),
        ("package_id", "version"),
        ("lower(hex(digest)) AS id", "kind", "package_id", "version", "previous_version", "symbols", "public_symbols", "lower(hex(hash)) AS api_hash", "breaking", "changes", "at"),
    ),
}
#: Fixed value: releases beyond it are not unpacked.
MOST_BYTES = 200 << 20
KEY = ["package_id", "version"]


def known(files: DataFrame) -> DataFrame:
    """The files of known languages."""
    return files.withColumn("language", text.language(F.col("path"))).where("language IS NOT NULL").select(*KEY, F.col("path").alias("file"), "language", "source")


def digest() -> Column:
    """SHA-256 of a file's language and source."""
    return F.unhex(F.sha2(F.concat_ws("\n", "language", "source").cast("binary"), 256))


def held(releases: DataFrame, files: DataFrame) -> DataFrame:
    """The releases with held, the names and digests of their files; no source is shuffled for it."""
    each = known(files).select(*KEY, F.struct("file", digest().alias("digest")).alias("f"))
    rest = [c for c in releases.columns if c not in KEY]
    return releases.join(each, KEY, "left").groupBy(*KEY).agg(*[F.first(c).alias(c) for c in rest], F.collect_list("f").alias("held"))


def api_hash(listed: Column) -> Column:
    """Of a release's symbols, those that are public."""
    public = F.transform(F.filter(listed, lambda s: s["public"]), lambda s: F.concat_ws("|", s["path"], s["kind"], s["signature"]))
    return F.unhex(F.sha2(F.array_join(public, ";").cast("binary"), 256))


def sources(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """digest, found (symbols by path with all of their signatures), broken, and the symbols and hash of a release that holds only this: a row each source with symbols, of the digests in wanted.

    Releases of a package hold mostly the same files, so equal sources are scanned once.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = known(files).select("language", "source", digest().alias("digest"))
    if wanted is not None:
        each = each.join(wanted, "digest", "left_semi")
    # A fixed number of tasks, as a scan takes long for the bytes that it reads.
    each = each.distinct().repartition(parts, "digest")
    found = symbols.extract(each).select("digest", "path", "kind", "visibility", "signature", "balanced").repartition("digest")
    by_path = found.groupBy("digest", "path").agg(
        F.min("kind").alias("kind"), F.max(F.col("visibility") == "public").alias("public"), F.sort_array(F.collect_set("signature")).alias("signatures"), F.max(~F.col("balanced")).alias("broken")
    )
    lists = by_path.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("path", "kind", "public", "signatures"))).alias("found"), F.max("broken").alias("broken"))
    alone = F.transform("found", lambda s: F.struct(s["path"].alias("path"), s["kind"].alias("kind"), s["public"].alias("public"), F.array_join(s["signatures"], " | ").alias("signature")))
    return lists.withColumn("symbols", alone).withColumn("hash", api_hash(F.col("symbols")))


def united(found: Column, firsts: Column) -> Column:
    """The symbols of a release, from those of its files sorted by path: those of one path are one. firsts: where a path begins."""

    def one(several: Column) -> Column:
        signatures = F.sort_array(F.array_distinct(F.flatten(several["signatures"])))
        return F.struct(several[0]["path"].alias("path"), F.array_min(several["kind"]).alias("kind"), F.array_max(several["public"]).alias("public"), F.array_join(signatures, " | ").alias("signature"))

    n = F.size(found)
    ends = F.concat(F.slice(firsts, F.lit(2), n), F.array(n))
    return F.transform(F.zip_with(firsts, ends, lambda a, b: F.slice(found, a + 1, b - a)), one)


def of_one(releases: DataFrame, read: DataFrame) -> DataFrame:
    """Snapshots of releases that hold one file or none: what was read of it, as it is."""
    out = releases.withColumn("digest", F.get("held", F.lit(0))["digest"]).join(read, "digest", "left").withColumn("symbols", F.coalesce("symbols", no_symbols()))
    return snapshot_rows(out, F.coalesce("hash", api_hash(no_symbols())), F.size("held"), F.coalesce(F.col("broken"), F.lit(False)).cast("long"))


def of_several(releases: DataFrame, read: DataFrame) -> DataFrame:
    """Snapshots of any releases: the symbols of their files put together."""
    rest = [c for c in releases.columns if c not in (*KEY, "held")]
    each = releases.select(*KEY, *rest, F.size("held").alias("files"), F.explode_outer("held").alias("f")).select(*KEY, *rest, "files", "f.*").join(read.select("digest", "found", "broken"), "digest", "left")
    lists = each.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in (*rest, "files")], F.size(F.collect_set(F.when(F.col("broken"), F.col("file")))).alias("errors"), F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    f = F.col("found")
    lists = lists.withColumn("firsts", F.when(F.size(f) > 0, F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda k: (k == 0) | (F.get(f, k)["path"] != F.get(f, k - 1)["path"]))))
    lists = lists.withColumn("symbols", F.when(F.size(f) > 0, united(f, F.col("firsts"))).otherwise(no_symbols()))
    return snapshot_rows(lists, api_hash(F.col("symbols")), F.col("files"), F.col("errors"))


def no_symbols() -> Column:
    return F.array().cast(f"array<{SYMBOL}>")


def snapshot_rows(rows: DataFrame, hash_: Column, files: Column, errors: Column) -> DataFrame:
    return rows.select(*KEY, hash_.alias("hash"), files.cast("long").alias("files"), errors.cast("long").alias("errors"), "symbols", "at", "event_id", "previous_version")


def snapshots(releases: DataFrame, files: DataFrame) -> DataFrame:
    """A row a release: its symbols by path, hash of the public ones, and how many files were read."""
    return of_several(held(releases, files), sources(files))


def change(old: Column, new: Column) -> Column:
    """What became of a public symbol; null where nothing did."""
    was, is_ = F.coalesce(old["public"], F.lit(False)), F.coalesce(new["public"], F.lit(False))
    kept = F.when(new.isNull(), "removed").when(~is_, "visibility_reduced").when(old["kind"] != new["kind"], "kind_changed").when(old["signature"] != new["signature"], "signature_changed")
    return F.when(was, kept).when(is_, "added")


def changes(old: Column, new: Column) -> Column:
    """What became of the symbols of a release, by path, and how grave that is; null where one of the lists is."""
    by_path = lambda symbols: F.map_from_arrays(symbols["path"], symbols)
    met = F.map_entries(F.map_zip_with(by_path(old), by_path(new), lambda path, o, n: change(o, n)))
    met = F.sort_array(F.filter(met, lambda c: c["value"].isNotNull()))
    return F.transform(met, lambda c: F.struct(c["key"].alias("path"), c["value"].alias("change"), F.when(c["value"] == "added", "info").otherwise("breaking").alias("severity")))


def made_events() -> Column:
    """The events of a release: what was read, and vectors and changes where it has any."""
    none = F.lit(None)

    def event(kind: str, previous: Column, breaking: Column, found: Column) -> Column:
        return F.struct(
            F.unhex(cdc.event_id(F.lit(kind), F.col("package_id"), F.col("version"))).alias("digest"), F.lit(kind).alias("kind"), *KEY, previous.cast("string").alias("previous_version"), "symbols", "public_symbols",
            "hash", breaking.cast("long").alias("breaking"), found.cast(f"array<{CHANGE}>").alias("changes"), "at",
        )

    breaking = F.size(F.filter("changes", lambda c: c["severity"] == "breaking"))
    kinds = F.array(
        F.when(F.col("public_symbols") > 0, event("embeddings_generated", none, none, none)),
        F.when(F.size("changes") > 0, event("breaking_changes_detected", F.col("previous_version"), breaking, F.col("changes"))),
        event("api_parsed", none, none, none),
    )
    return F.filter(kinds, lambda e: e.isNotNull())


def analysed(releases: DataFrame, files: DataFrame, store: Store, most_bytes: int = MOST_BYTES) -> dict[str, Change]:
    """A batch of releases (package_id, version, previous_version, size_bytes, at, event_id) and their files (package_id, version, path, source)."""
    fit = releases.where(F.col("size_bytes").isNull() | (F.col("size_bytes") <= most_bytes))
    newer = F.lag(F.lit(1)).over(Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("event_id")))
    fit = fit.withColumn("newer", newer).where("newer IS NULL").select(*KEY, "previous_version", "at", "event_id")
    mine = stored(held(fit, files), "held")
    read = stored(sources(files, stored(mine.select(F.explode(F.col("held")["digest"]).alias("digest")).distinct(), "wanted")), "sources")
    now = stored(of_one(mine.where(F.size("held") <= 1), read).unionByName(of_several(mine.where(F.size("held") > 1), read)), "snapshots")
    # A snapshot of this batch takes the place of a stored one.
    past = lambda rows, name: rows.select("package_id", F.col("version").alias("previous_version"), F.col("symbols").alias(name))
    to_past = ["package_id", "previous_version"]
    met = now.join(past(now, "here"), to_past, "left").join(past(store.read("snapshots"), "stored"), to_past, "left")
    public = F.filter("symbols", lambda s: s["public"])
    events = met.select(*KEY, "previous_version", F.size("symbols").cast("long").alias("symbols"), F.size(public).cast("long").alias("public_symbols"), "hash", changes(F.coalesce("here", "stored"), F.col("symbols")).alias("changes"), "at")
    # Versions share most of their paths, whose vectors are computed once.
    paths = read.select(F.explode(F.filter("found", lambda s: s["public"])["path"]).alias("path")).distinct()
    known_paths = embedding.lexical_sparse(paths.withColumn("t", F.regexp_replace("path", "[^A-Za-z0-9]+", " ")), "path", "t")
    vectors = now.select(*KEY, F.explode_outer(public["path"]).alias("path"), "at", "event_id").join(stored(known_paths, "paths"), "path")
    return {
        "snapshots": Change(now, ("at", "event_id"), owners=now.select(*KEY), unique=True),
        "vectors": Change(vectors, ("at", "event_id"), owners=now.select(*KEY), unique=True),
        "events": Change(events, ("at",), owners=now.select(*KEY), unique=True, late=made_events()),
    }


def analyse(releases: DataFrame, files: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of releases; files is the table of all sources."""
    return sink(releases, store, lambda batch: analysed(batch, files, store), checkpoint)
