"""Every registered query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from thicket import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    def norm(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(tuple(norm(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) & set(catalog.oracle_sql())))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in cols)  # quoted: a column may bear a keyword's name
    want = duck.sql(f"SELECT {listed} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert rows(tuple(r[c] for c in cols) for r in got.collect()) == rows(want)


def test_graph_by_hand(spark):
    """A diamond on a cycle with a tail: least depths, one shortest path of two, and what the cycle holds."""
    from thicket.operators import graph

    edges = spark.createDataFrame([("w", "x"), ("w", "y"), ("x", "z"), ("y", "z"), ("z", "w"), ("v", "w"), ("u", "v"), ("w", "x"), ("z", "end")], "src string, dst string")
    found = {r["id"]: r["depth"] for r in graph.reach(edges, "z", 10).collect()}
    assert found == {"x": 1, "y": 1, "w": 2, "v": 3, "u": 4}
    assert {r["id"]: r["depth"] for r in graph.reach(edges, "u", 2, forward=True).collect()} == {"v": 1, "w": 2}
    assert graph.shortest_path(edges, "u", "z", 6).collect()[0]["path"] == "u>v>w>x>z"
    assert graph.shortest_path(edges, "end", "u", 6).count() == 0
    assert {tuple(r) for r in graph.core(edges).collect()} == {("w", "x"), ("w", "y"), ("x", "z"), ("y", "z"), ("z", "w")}
    assert graph.core(edges.where("src <> 'z'")).count() == 0


def test_typed_edges_reach_the_same(spark):
    """Edges apart by kind give what one table of them gives, with a cycle between two kinds and a kind without edges."""
    from thicket.operators import graph

    a, b, c = (lambda k: k * 8), (lambda k: k * 8 + 1), (lambda k: k * 8 + 2)
    frame = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    types = {("a", "b"): frame([(a(1), b(1)), (a(1), b(2)), (a(2), b(3)), (a(1), b(1))]), ("b", "a"): frame([(b(1), a(2)), (b(3), a(1))]), ("b", "c"): frame([(b(2), c(1))]), ("c", "c"): frame([(c(1), c(2)), (c(2), c(1))]), ("x", "y"): frame([])}
    whole = frame([]).unionByName(types["a", "b"]).unionByName(types["b", "a"]).unionByName(types["b", "c"]).unionByName(types["c", "c"])
    for forward in (True, False):
        for kind, root in (("a", a(1)), ("c", c(2)), ("b", b(3)), ("y", 77)):
            for depth in (1, 2, 9):
                got = sorted(map(tuple, graph.typed_reach(types, kind, root, depth, forward).collect()))
                assert got == sorted(map(tuple, graph.reach(whole, root, depth, forward).collect()))


def test_lookups_push_their_keys(spark):
    plan = catalog.queries()["package_lookup"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(p_partkey,10)" in plan and "c_custkey" not in plan
    assert "EqualTo(o_orderkey,42)" in catalog.queries()["version_lookup"](spark, SF)._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    from thicket.streaming import views

    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) published_at", "event_type ecosystem")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = views.file_source(spark, str(tmp_path / "in"), "event_id long, published_at timestamp, ecosystem string")
    views.hourly_activity(stream, "0 seconds").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start().awaitTermination()
    assert rows(map(tuple, spark.table("hours").collect())) == rows(map(tuple, views.hourly_activity(e).collect()))


@pytest.mark.parametrize("line,allowed,want", [("MIT OR Apache-2.0", {"MIT"}, True), ("MIT OR Apache-2.0", {"GPL-3.0-only"}, False), ("(MIT OR Apache-2.0) AND BSD-3-Clause", {"MIT"}, False), ("", {"MIT"}, False), ("MIT AND", {"MIT"}, False)])
def test_licences(line, allowed, want):
    from thicket.functions import licences

    assert licences.satisfied(licences.postfix(line), frozenset(allowed)) is want


def test_upsert_sink(spark, tmp_path):
    """Last wins by key over several batches, a late older row does not, and untouched buckets are not written again."""
    from thicket.streaming import views

    schema = "package string, version string, changes int, at int"
    place, source = str(tmp_path / "table"), tmp_path / "in"
    batches = [[("a", "1", 1, 10), ("b", "1", 2, 10), ("a", "2", 3, 10)], [("a", "1", 5, 11), ("c", "1", 6, 1), ("a", "1", 9, 7)], [("b", "1", 0, 9), ("c", "1", 7, 2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / str(k)))
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        views.upsert_sink(stream, ["package", "version"], "at", place, str(tmp_path / "state"), buckets=8).awaitTermination()
    want = {}
    for p, v, n, at in (r for rows in batches for r in rows):
        if (p, v) not in want or at >= want[p, v][1]:
            want[p, v] = (n, at)
    assert {(r["package"], r["version"]): (r["changes"], r["at"]) for r in views.upserted(spark, place, schema).collect()} == want
    groups = views.live_groups(spark, place)
    assert len(groups) > 1 and {g.rpartition("=")[2] for g in groups.values()} >= {"0", "2"}


def test_stream_dedupe_and_dead_letters(spark, tmp_path):
    from thicket.streaming import views

    lines = [(1, '{"package": "a", "version": "1"}'), (2, '{"package": "a", "version": "1"}'), (3, "{broken"), (4, '{"version": "2"}'), (5, '{"package": "b", "version": "1"}')]
    spark.createDataFrame(lines, "id long, value string").selectExpr("*", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id) at").write.parquet(str(tmp_path / "in"))
    stream = views.file_source(spark, str(tmp_path / "in"), "id long, value string, at timestamp")
    good, bad = views.split_letters(stream, "value", "package string, version string", "package")
    views.run_available(views.deduped(good, ["package", "version"], "at"), str(tmp_path / "good"), str(tmp_path / "c1")).awaitTermination()
    views.run_available(bad, str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["package"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a", "b"]
    assert {r["id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {3: "not json", 4: "no package"}


def test_rules_by_hand(spark):
    """Rules of severities, risks, policies and grades on single inputs."""
    from pyspark.sql import functions as F

    from thicket.functions import changes, policy, scorecard

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(changes.changelog_score(F.lit("BREAKING CHANGE: the old API was removed. Migration required."))) == pytest.approx((1.0 + 0.9 + 0.6 + 0.8) / 5)
    assert value(changes.changelog_score(F.lit("small fixes"))) == 0
    none = F.lit(None)
    of = lambda old, new, notes, lines=0: value(changes.prediction(F.lit(old), F.lit(new), F.lit(notes), F.lit(0), F.lit(0), F.lit(0), none.cast("double"), none.cast("int"), F.lit(lines)))
    assert of("1.5.3", "2.0.0", "")["probability"] == pytest.approx(0.4) and of("1.5.3", "2.0.0", "")["confidence"] == pytest.approx(0.75)
    assert of("1.0.0", "1.0.1", "typo")["risk"] == "low" and of("v1.0", "v2.0-rc1", "renamed", 5000)["probability"] == pytest.approx(0.4 + 0.3 + 0.15 + 0.08)
    assert [value(scorecard.grade(F.lit(x))) for x in (9.5, 8.0, 7.0, 6.9, 5.0, 4.9)] == ["A+", "A", "B", "C", "D", "F"]
    rows = one.select(F.lit("MIT").alias("licence"), F.lit(True).alias("has_sbom"), F.lit(9).alias("depth"))
    got = lambda tree: rows.select(policy.condition(tree).alias("x")).first()["x"]["result"]
    assert [got(x) for x in (("licence_allowed", ("mit",)), ("licence_denied", ("mit",)), ("max_depth", 8), ("not", ("max_depth", 8)), ("all", (("has_sbom",), ("max_depth", 8))), ("any", (("max_depth", 8), ("has_sbom",))), ("custom", "x"))] == ["pass", "fail", "warn", "warn", "pass", "pass", "skip"]


def test_histogram_quantile(spark):
    from pyspark.sql import functions as F

    from thicket.operators import timeseries

    rates = F.array(*[F.lit(float(x)) for x in (10, 30, 30, 40)])
    row = spark.range(1).select(*[timeseries.histogram_quantile(rates, (1, 2, 4), q).alias(f"q{k}") for k, q in enumerate((0.125, 0.25, 0.5, 0.75, 0.99))]).first()
    assert tuple(row) == pytest.approx((0.5, 1.0, 1.5, 2.0, 4.0))


def test_policy_severities(spark):
    """By rank: a limit lets its own severity and lesser ones pass. (An order of the names that puts the gravest first would turn this round.)"""
    from thicket.functions import policy

    rows = spark.createDataFrame([(1, 5, 0, 0, 0), (2, 0, 3, 0, 0), (3, 0, 0, 2, 1), (4, 0, 0, 0, 0)], "id int, n_critical int, n_high int, n_medium int, n_low int")
    got = {limit: {r["id"]: r["o"]["result"] for r in rows.select("id", policy.condition(("max_severity", limit)).alias("o")).collect()} for limit in ("critical", "high", "low")}
    assert got == {"critical": dict.fromkeys((1, 2, 3, 4), "pass"), "high": {1: "fail", 2: "pass", 3: "pass", 4: "pass"}, "low": {1: "fail", 2: "fail", 3: "fail", 4: "pass"}}


def test_package_edges_are_compared_as_numbers(spark, tmp_path):
    """Texts of edges were shuffled, repeated rows of suppliers came twice out of a union; rows without a key equal nothing."""
    sql = {
        "orders": "SELECT * FROM VALUES (1L, 7L), (2L, 8L), (3L, NULL) t(o_orderkey, o_custkey)",
        "lineitem": "SELECT * FROM VALUES (1L, 4L, 5L), (1L, 4L, 5L), (2L, 4L, 6L), (3L, 9L, 6L) t(l_orderkey, l_partkey, l_suppkey)",
        "supplier": "SELECT * FROM VALUES (5L, 1), (5L, 1), (6L, 2) t(s_suppkey, s_nationkey)",
        "nation": "SELECT * FROM VALUES (1, 0), (2, 0) t(n_nationkey, n_regionkey)",
    }
    for name, text in sql.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    queries = catalog.queries()
    got = sorted((str(r["src"]), r["dst"]) for r in queries["backfill_pkg_edges"](spark, str(tmp_path)).collect())
    assert got == sorted([("customer:7", "part:4"), ("customer:8", "part:4"), ("None", "part:9"), ("part:4", "supplier:5"), ("part:4", "supplier:6"), ("part:9", "supplier:6"), ("supplier:5", "nation:1"), ("supplier:6", "nation:2"), ("nation:1", "region:0"), ("nation:2", "region:0")])
    # Three edges of parts, three rows of suppliers, two of nations, and the edge without a customer.
    assert queries["check_orphaned_pkg_deps"](spark, str(tmp_path)).first()["n"] == 9
    assert queries["check_missing_pkg_deps"](spark, str(tmp_path)).first()["n"] == 1


def test_renames_are_not_sorted(spark, tmp_path):
    """All pairs of a package were sorted by symbol, as their best match was kept as text."""
    from thicket.plans import domain_queries

    kinds = "pkg string, path string, name string, kind string, signature string"
    gone = spark.createDataFrame([("p", "m.fn_12", "fn_12", "f", "fn(a)"), ("p", "m.zzz", "zzz", "f", "other(x, y)")], kinds)
    new = spark.createDataFrame([("p", "b.fn_13", "fn_13", "f", "fn(a)"), ("p", "a.fn_11", "fn_11", "f", "fn(a)"), ("p", "a.fn_12", "fn_12", "g", "fn(a)")], kinds)
    found = domain_queries.best_of(gone, new)
    assert [tuple(r) for r in found.collect()] == [("p", "m.fn_12", "f", "fn(a)", "a.fn_11")]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_lexical_slots_are_those_of_the_vectors(spark):
    """Whole vectors, most of them zeros, left Python."""
    from pyspark.sql import functions as F

    from thicket.functions import embedding

    rows = spark.createDataFrame([(1, "left-pad core"), (2, ""), (3, None)], "id long, name string")
    want = embedding.lexical_vectors(rows, "id", "name").select("id", F.posexplode("vector").alias("slot", "value")).where("value <> 0")
    assert sorted(embedding.lexical_slots(rows, "id", "name").collect()) == sorted(want.collect())


def test_renames_in_blocks_equal_brute_force(spark, monkeypatch):
    """A large package comes apart in blocks, whose symbols reach their task in several Arrow batches; symbols are not shuffled for every step."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from thicket.operators import renames
    from thicket.plans import domain_queries, registry

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, line = line, [i]
            for j, y in enumerate(b, 1):
                line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
        return line[-1]

    def like(a, b):
        return 1.0 if a == b else 1 - edits(a, b) / max(len(a.encode()), len(b.encode()))

    rng = random.Random(4)
    some = lambda n: {(p, f"m{rng.randrange(3)}.{x}", x, rng.choice("fg"), rng.choice(["fn(a)", "fn(a: T)", "fn()", "ü"])) for p in ("p", "q") for x in ["".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(n)]}
    gone, new = some(40), some(60) | {("only new", "x", "x", "f", "fn()")}
    want = []
    for p, path, name, kind, signature in gone:
        found = [(-Decimal(repr(0.4 * like(name, n) + 0.6 * like(signature, s))).quantize(Decimal("1e-9"), ROUND_HALF_UP), other) for q, other, n, k, s in new if (q, k) == (p, kind)]
        found = min((f for f in found if -f[0] >= Decimal("0.7")), key=lambda f: (f[0], f[1].encode()), default=None)
        if found:
            want.append((p, path, kind, signature, found[1]))
    kinds = "pkg string, path string, name string, kind string, signature string"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(renames, "BLOCK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = domain_queries.best_of(spark.createDataFrame(list(gone), kinds), spark.createDataFrame(list(new), kinds)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(want) > 40 and sorted(map(tuple, got)) == sorted(want)
    assert domain_queries.renamed(registry.Tables(spark, SF))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def test_similarities_round_half_up():
    """The ninth digit is rounded by the decimal digits of a number, as Spark's round does."""
    import numpy as np

    from thicket.operators import renames

    assert renames.billionths(np.array([0.7000000005, 0.70000000049, 0.6 + 0.4 * (1 - 1 / 3), 1.0])).tolist() == [700000001, 700000000, 866666667, 10**9]
