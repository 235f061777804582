"""Exact dedup, ranked search and structure repair against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("thicket.llm.queries")
from thicket.llm import exact, queries, ranked, repair  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")
ODD = [(1, None, "x"), (2, "", "x"), (None, " \n", None), (3, "one two", "a"), (3, "one two", "a"), (None, "o n e two", "b"), (5, "w " * 50_000, "b"), (6, "w" * 50_000, "c"), (7, "中 文", "c"), (8, "中  文", "c"), (None, "lone", "d"), (9, "one\ttwo!", "d")]


def by_hand(rows):
    """(id, text) rows -> id, keep_id, size, digest; and which rows stay."""
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i, k))
    out, stay = [], set()
    for bare, members in groups.items():
        least = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        stay.add(least[3])
        out += [(m[2], least[2], len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), stay


@pytest.mark.parametrize("parts,bits", [(1, 4), (7, 1), (12, 2)])
def test_exact_equals_brute_force(spark, parts, bits):
    rng = random.Random(parts)
    rows = ODD + [(100 + k, rng.choice(("hot text", "hot  text", "a b", "ab", f"own {k}", f"pair {k // 2}")), "y") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _run string").repartition(parts)
    got = exact.duplicates(frame, fan_bits=bits).collect()
    want, stay = by_hand(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(stay)
    assert sum(r["kept"] and r["doc_id"] == 3 for r in got) == 0 and all(r["kept"] for r in got if r["doc_id"] == 9)


def test_exact_keep_one(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, __row string")
    kept = exact.keep_one(frame.repartition(5), fan_bits=1)
    _, stay = by_hand(ODD)
    assert kept.columns == frame.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(ODD[k]) for k in stay)
    assert exact.keep_one(frame.where("false")).count() == 0 == exact.duplicates(frame.where("false")).count()


def test_exact_verifies_digests(spark, monkeypatch):
    """Texts whose digests agree are told apart by their length and second hash."""
    whole = exact.digested

    def colliding(*args):
        return whole(*args).drop("_digest").selectExpr("*", "unhex('00') AS _digest")

    monkeypatch.setattr(exact, "digested", colliding)
    rows = [(1, "a", None), (2, "a ", None), (3, "b", None), (4, "ab", None)]
    got = exact.duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string"), fan_bits=1).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)]


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked_by_hand(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, length in held:
            m = 25 + 75 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,window", [(1 << 23, 1 << 22), (2000, 64)])
def test_ranked_equals_brute_force(spark, monkeypatch, block, window):
    monkeypatch.setattr(ranked, "WINDOW", window)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs += [(None, docs[3][1]), (docs[3][0], docs[3][1]), (10_001, None), (10_002, "... !?")]
    items += [(None, "The THE the é"), (7, "Ünïcode the"), (7, ""), (8, None), (9, "notaterm0")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS rank")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS _no", "2 AS score")
    got = ranked.search(a.repartition(5), b, block_bytes=block).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked_by_hand(docs, items)


def test_ranked_ties_and_empty(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(500)] + [(900, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert sorted((r["rank"], r["doc_id"]) for r in ranked.search(docs.repartition(8), items).collect()) == [(k + 1, k) for k in range(10)]
    for a, b in ((docs.where("false"), items), (docs, items.where("false"))):
        found = ranked.search(a, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_ranked_shares_sums():
    """The DAG gives plain sums, and adds up less than queries for themselves would."""
    rng = random.Random(4)
    phrases = [[rng.randrange(300) for _ in range(6)] for _ in range(20)]
    asked = [[t for _ in range(4) for t in rng.choice(phrases)] + [rng.randrange(300) for _ in range(3)] for _ in range(60)]
    leaves, nodes, sums = ranked.mine(asked)
    plan = {"leaves": leaves, "a": [x for x, _ in nodes], "b": [x for _, x in nodes], "nodes": [n for s in sums for n in s], "counts": [len(s) for s in sums], "queries": list(range(60))}
    values = np.array([[rng.randrange(10**12) for _ in range(3)] for _ in range(300)], np.int64)
    assert (ranked.Dag(plan).evaluate(values) == np.array([values[q].sum(axis=0) for q in asked])).all()
    alone = sum(len(q) - 1 for q in asked)
    assert len(nodes) + sum(len(s) - 1 for s in sums) < 0.6 * alone


def repairs(symbols):
    """All audits with their costs, by plain recursion: (cost, audit)."""
    lead = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    out = []

    def go(k, state, cost, audit, inserted):
        if k == len(symbols) and state in ("", "a"):
            out.append((cost, audit))
        if inserted < 3:
            for role in "ua":
                if (state, role) in lead:
                    go(k, role, cost + 5, audit + "I", inserted + 1)
        if k == len(symbols):
            return
        x = symbols[k]
        go(k + 1, state, cost + 2, audit + "D", 0)
        if x != "-":
            cut = 5 * x.isupper()
            if (state, x.lower()) in lead:
                go(k + 1, x.lower(), cost + cut, audit + "K", 0)
            for role in "ua":
                if (state, role) in lead:
                    go(k + 1, role, cost + 1 + cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


def path(line, of):
    p = repair.Path()
    for x in line:
        p.step(of[x])
    return p.end(of[repair.END])


def test_repair_paths_equal_brute_force():
    """With and without rules: least cost, ties by the least audit."""
    rng = random.Random(6)
    plain = repair.matrices([])
    rules = ["ua", "xx", "", "x", "AU", "-", ""]
    of = repair.matrices(rules)
    for _ in range(250):
        line = "".join(rng.choices(rng.choice(("suaxSUAX-", "ua", "x", "uaUA-", "xu")), k=rng.randrange(6)))
        want = repairs(line)
        assert path(line, plain) == want == path(repair.compressed(line, rules), of)
    for line in ("x" * 5001, "ua" * 3000 + "uu" + "au" * 2000, "".join(rng.choices("suaxSUAX-", k=4000))):
        assert path(line, plain) == path(repair.compressed(line, rules), of)


def fault_rows(n, seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "so it is.", "end\t.", "a. b"]
    rows = [(c, t, rng.choice(("user", "assistant", "system", "tool", "", "unit", "assistant", "user")), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(10**6)}{rng.choice(('.', '', '? '))}") for c in range(n) for t in rng.sample(range(20), rng.randrange(1, 9))]
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None), (None, None, "user", "Hi."), (0, 3, "user", "Hi."), (0, 3, "user", "Hi.")]


def by_rows(rows):
    """Each conversation by hand: sorted rows, faults, brute-force repair."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), t, text or ""))
    out = {}
    for c, lines in convs.items():
        lines.sort(key=lambda x: x[:4])
        seen, symbols, counts = set(), "", Counter()
        for _, _, role, _, _, text in lines:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else x.upper() if fault else x
        initials = [x[2][:1] for x in lines]
        turns = [x[4] for x in lines if x[4] is not None]
        cost, audit = (path(symbols, repair.matrices([])) if len(symbols) > 4 else repairs(symbols))
        made, k = [], 0
        for edit in audit:
            due = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if edit == "I":
                made.append((due, "", "I"))
                continue
            role, text = lines[k][2], lines[k][5]
            k += 1
            if edit != "D":
                made.append((role if edit == "K" else due, text, edit))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in made).encode()).hexdigest()), made
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_repair_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repair.segments, "__defaults__", (most,))
    rows = fault_rows(60)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS gaps", "2 AS _kind").repartition(5)
    want = by_rows(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert got == {c: x[0] for c, x in want.items()}
    turns = {}
    for r in repair.repaired_turns(frame).collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["edit"]))
    assert {c: [t[1:] for t in sorted(x)] for c, x in turns.items()} == {c: x[1] for c, x in want.items() if x[1]}


def test_repair_long_conversation(spark):
    """One conversation of many segments over several partitions, most of whose rows are one text."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(9000)] + [(1, 9000 + k, "user", "again and again.") for k in range(6000)] + [(2, 0, "tool", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = by_rows(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame).collect()} == {c: x[0] for c, x in want.items()}


def test_repair_of_empty_tables(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(frame).count() == 0 == repair.repaired_turns(frame).count()
    assert repair.filled("conv_id", frame, repair.repair(repair.damaged(frame))).count() == 0


def test_repair_query_keeps_every_conversation(spark, tmp_path):
    """A conversation whose rows are all dropped is a row of zeros."""
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 1, "user", "Hi."), (gone + 1, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op11_structure_repair(spark, str(tmp_path)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {gone, gone + 1}


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_exact_dedup", "op13_ranked_search"])
def test_new_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
