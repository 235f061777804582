"""Symbols of source files, made from orders: a file an order, a type in it, and a function for each line."""

from __future__ import annotations

import uuid
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import symbols
from ..storage import shared_dir, stored
from ..streaming import analysis, published
from .registry import Tables, query

#: By language: the file around the functions, a function with its modifier, and the parameters that it can have. Strings and comments hold what looks like code.
FILES = {
    "rust": ("//! pub fn no() {{\npub struct C{id};\nimpl<T: Into<Vec<u8>>> C{id} {{\n{body}}}\n", '    {mod}fn {name}(&self{params}) -> i64 {{ let s = "}} fn no() {{"; /* {{ /* */ */ if s.len() > 1 {{ 1 }} else {{ 2 }} }}\n', ("", ", a: i32", ", a: i32, b: Vec<(u8, u8)>"), ("pub ", "")),
    "typescript": ("/* class No {{ */\nexport class C{id}<T> {{\n{body}}}\n", "  {mod}{name}({params}): Promise<void> {{ const r = /[{{]/g; return `}}${{r}} {{`; }} // {{\n", ("", "a: number", "a: number, b = [1, 2]"), ("", "private ")),
    "go": ("package p\n\ntype C{id} struct {{ x int }}\n{body}", 'func (c *C{id}) {name}({params}) error {{\n\tif c.x > 1 {{ return nil }} // }}\n\treturn errors.New("{{ func no() {{")\n}}\n', ("", "a int", "a int, b map[string][]int"), ("", "")),
    "java": ("package p;\n@Named(\"{{\")\npublic class C{id} {{\n{body}}}\n", '  {mod}java.util.List<String> {name}({params}) throws E {{ String s = "{{"; new Thread(() -> {{ no(1); }}); return null; }}\n', ("", "final int a", "int a, Map<String, List<Integer>> b"), ("public ", "private ")),
    "python": ("# class No:\nclass C{id}(B):\n{body}", '    def {name}(self{params}):\n        """def no(): """\n        if self.x:\n            return "}}"\n', ("", ", a", ", a, b=(1, 2)"), ("", "")),
}


def filled(template: str, **values: Column) -> Column:
    """The template with columns in its places."""
    parts = []
    for before, name, _, _ in Formatter().parse(template):
        parts += [F.lit(before)] + ([values[name]] if name else [])
    return F.concat(*parts)


def by_file(of: dict[str, Column]) -> Column:
    """The value of an order's language."""
    out = F.lit(None).cast("string")
    for k, name in enumerate(FILES):
        out = F.when(F.col("id") % len(FILES) == k, of[name]).otherwise(out)
    return out


def sources(t: Tables) -> DataFrame:
    """id, language, source: each order's file."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", (F.col("l_quantity").cast("int") % 3).alias("n"), (F.col("l_returnflag") == "R").alias("open"))
    base = F.concat_ws("_", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    name = {x: F.concat(F.lit("f"), base) for x in FILES}
    name["go"] = F.concat(F.when(F.col("open"), "F").otherwise("f"), base)
    name["python"] = F.concat(F.when(F.col("open"), "f").otherwise("_f"), base)
    code = by_file({x: filled(f, id=F.col("id").cast("string"), name=name[x], mod=F.when(F.col("open"), mods[0]).otherwise(mods[1]), params=F.element_at(F.array(*[F.lit(p) for p in params]), F.col("n") + 1)) for x, (_, f, params, mods) in FILES.items()})
    by = lines.select("id", F.struct("l_linenumber", "l_partkey", code.alias("code")).alias("r")).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["code"]), "").alias("body"))
    whole = by_file({x: filled(f, id=F.col("id").cast("string"), body=F.col("body")) for x, (f, *_) in FILES.items()})
    return by.select("id", by_file({x: F.lit(x) for x in FILES}).alias("language"), whole.alias("source"))


LINES = "(SELECT l_orderkey AS id, l_orderkey % 5 AS g, 'C' || l_orderkey AS own, CASE WHEN l_orderkey % 5 = 2 AND l_returnflag = 'R' THEN 'F' WHEN l_orderkey % 5 = 4 AND l_returnflag <> 'R' THEN '_f' ELSE 'f' END || l_linenumber || '_' || l_partkey AS name, CAST(l_quantity AS INT) % 3 AS n, l_returnflag = 'R' AS open FROM lineitem)"
SYMBOLS = f"""
SELECT id, name, CASE g WHEN 0 THEN own || '::' WHEN 2 THEN '(c*' || own || ').' ELSE own || '.' END || name AS path, CASE g WHEN 2 THEN 'function' ELSE 'method' END AS kind, CASE WHEN open THEN 'public' ELSE 'private' END AS visibility,
  array_to_string(list_concat(CASE WHEN g IN (0, 4) THEN ['self'] ELSE [] END, ['a', 'b'][1:n]), ',') AS parameters, CASE g WHEN 0 THEN 'i64' WHEN 1 THEN 'Promise' WHEN 2 THEN 'error' WHEN 3 THEN 'java.util.List' END AS return_type
FROM {LINES}
UNION ALL SELECT DISTINCT id, own, own, CASE WHEN g IN (0, 2) THEN 'struct' ELSE 'class' END, 'public', '', NULL FROM {LINES}
"""


@query("source_symbols", SYMBOLS)
def _(t: Tables) -> DataFrame:
    """What the files declare: types, methods and functions, with their paths, visibility, parameters and results."""
    found = symbols.extract(sources(t))
    return found.select("id", "name", "path", "kind", "visibility", F.array_join("parameters", ",").alias("parameters"), "return_type")


@query("source_symbols_by_language", f"SELECT CASE g WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'java' ELSE 'python' END AS lang, kind, count(*) AS n, count(*) FILTER (visibility = 'public') AS n_public FROM (SELECT *, id % 5 AS g FROM ({SYMBOLS})) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    files = sources(t).withColumn("lang", F.col("language"))
    return symbols.extract(files).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("visibility") == "public").alias("n_public"))


# Releases: an order is a release of its customer's package, with a source of a function for each of the parts' groups.

RELEASES = """
WITH f AS (SELECT l_orderkey AS v, 'f' || l_partkey % 7 AS path, max(l_returnflag) = 'R' AS pub, 'f' || l_partkey % 7 || '(a : T' || min(l_suppkey % 2) || ')' AS sig FROM lineitem GROUP BY l_orderkey, l_partkey % 7),
r AS (SELECT o_orderkey AS v, 'customer:' || o_custkey AS package_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
a AS (SELECT r.v, r.package_id, r.prev, count(path) AS n, count(path) FILTER (pub) AS p, sha256(coalesce(string_agg(path || '|function|' || sig, ';' ORDER BY path) FILTER (pub), '')) AS api_hash FROM r LEFT JOIN f ON f.v = r.v GROUP BY ALL),
o AS (SELECT r.v, f.path, f.pub, f.sig FROM r JOIN f ON f.v = r.prev), n AS (SELECT r.v, f.path, f.pub, f.sig FROM r JOIN f ON f.v = r.v WHERE r.prev IS NOT NULL),
c AS (SELECT v, path, CASE WHEN o.pub AND n.pub IS NULL THEN 'removed' WHEN o.pub AND NOT n.pub THEN 'visibility_reduced' WHEN o.pub AND o.sig <> n.sig THEN 'signature_changed' WHEN n.pub AND NOT coalesce(o.pub, false) THEN 'added' END AS change FROM o FULL JOIN n USING (v, path)),
d AS (SELECT v, count(*) FILTER (change <> 'added') AS breaking, string_agg(path || ':' || change, ',' ORDER BY path) AS changes FROM c WHERE change IS NOT NULL GROUP BY v)
SELECT k.kind, package_id, CAST(a.v AS VARCHAR) AS version, CASE WHEN k.kind = 'breaking_changes_detected' THEN CAST(prev AS VARCHAR) END AS previous_version, n AS symbols, p AS public_symbols, api_hash, CASE WHEN k.kind = 'breaking_changes_detected' THEN breaking ELSE 0 END AS breaking, CASE WHEN k.kind = 'breaking_changes_detected' THEN changes END AS changes
FROM a LEFT JOIN d ON d.v = a.v, (VALUES ('api_parsed'), ('embeddings_generated'), ('breaking_changes_detected')) k(kind)
WHERE k.kind = 'api_parsed' OR k.kind = 'embeddings_generated' AND p > 0 OR k.kind = 'breaking_changes_detected' AND d.v IS NOT NULL
"""


def releases(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Releases and their files: a source, and a text that is none."""
    own = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("package_id")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    found = t.orders.select(own, F.col("o_orderkey").cast("string").alias("version"), before.cast("string").alias("previous_version"), F.lit(None).cast("long").alias("size_bytes"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("event_id"))
    # Numbers of each function are aggregated: R is the greatest flag if there is one and none beyond.
    flag = F.when(F.col("l_returnflag") > "R", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    lines = t.lineitem.select(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") % 7).cast("int").alias("p"), flag.alias("flag"), (F.col("l_suppkey") % 2).cast("int").alias("s"))
    of = lambda k, c: F.when(F.col("p") == k, F.col(c))
    lines = lines.groupBy("event_id").agg(*[x for k in range(7) for x in (F.max(of(k, "flag")).alias(f"flag{k}"), F.min(of(k, "s")).alias(f"s{k}"))])
    code = lambda k: F.when(F.col(f"flag{k}").isNotNull(), filled("{mod}fn f{p}(a: T{s}) {{ let x = \"{{\"; }}\n", mod=F.when(F.col(f"flag{k}") == 1, "pub ").otherwise(""), p=F.lit(str(k)), s=F.col(f"s{k}").cast("string")))
    files = lines.select("event_id", F.concat_ws("", *[code(k) for k in range(7)]).alias("code"))
    both = F.explode(F.array(F.struct(F.lit("src/lib.rs").alias("path"), F.col("code").alias("source")), F.struct(F.lit("README.md").alias("path"), F.lit("pub fn no() {}").alias("source"))))
    return found, files.join(found.select("package_id", "version", "event_id"), "event_id").select("package_id", "version", both.alias("x")).select("package_id", "version", "x.*")


@query("release_analysis", RELEASES)
def _(t: Tables) -> DataFrame:
    """The events of all releases, analysed in two batches by time, the second of which runs twice."""
    found, files = releases(t)
    found, files = stored(found, "releases"), stored(files, "files")
    middle = found.agg(F.percentile_approx("at", 0.5)).first()[0]
    store = published.Store(t.spark, f"{shared_dir(t.spark)}/analysis-{uuid.uuid4().hex}", analysis.TABLES, buckets=8)
    for number, part in ((0, found.where(F.col("at") < F.lit(middle))), (1, found.where(F.col("at") >= F.lit(middle))), (1, found)):
        if number not in store.batches():
            store.commit(number, analysis.analysed(part, files, store))
    listed = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["path"], c["change"])), ",")
    return store.read("events").select("kind", "package_id", "version", "previous_version", "symbols", "public_symbols", "api_hash", F.coalesce("breaking", F.lit(0)).alias("breaking"), listed.alias("changes"))
