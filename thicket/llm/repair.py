"""Conversation structure repair by a dynamic program over a grammar.

A conversation is a sequence of symbols, one a row: the initial of its role and
its fault. The cheapest edits that make the roles read (s?(ua)+)? are a shortest
path through four states (nothing yet, after s, after u, after a); a symbol is a
min-plus matrix over them whose entries are a cost and the audit of its edits.

1. Rows are sorted by range over the whole table and cut into segments of at
   most SEGMENT rows, so a conversation of any length is many segments.
2. Re-Pair: the pairs of neighbours that are most frequent in all segments
   become rules, and again over what they leave; counts are Spark aggregates, and
   at most ROUNDS * PAIRS rules come out, which bounds what tasks are sent.
3. Each rule gets one transfer matrix, made bottom-up from those of its two
   sides, with audits as ropes; all conversations share them.
4. A conversation's segments, in order, pass a vector of four (cost, audit)
   through the matrices of their symbols and rules.
5. Its rows, sorted behind their audit, stream once through a task that repairs
   them one at a time; the hash of the repaired text is a chain over
   all of it, so this pass is the one that can't be cut.

Ties go to the audit that is least by ASCII. Of two audits of one cost between
the same states neither is a prefix of the other (what follows could only be inserts,
each of which costs), so the least whole audit is made of least parts.

Defined cases: null roles and texts are empty (op11's damage makes them one
space before); rows sort by turn (nulls first), then role, then SHA-256 of the
text; a null conversation id is a conversation; repeated rows are duplicates;
an empty table gives an empty result; other columns are ignored. Turns are whole
numbers; others are cut to them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, slices, stored, text_batches

SEGMENT, ROUNDS, PAIRS = 4096, 8, 64
SPACE = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")
#: States: nothing yet, after s, after u, after a. Where a role's initial leads from each.
STATES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: What it may cost more to go on from a state (row) than from another (column): beyond that, the other is never best.
SLACK = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
MUST_GO = "-"
END = "."
#: Symbols: role initial or x for any other, upper case if truncated; rows that must go; the end of a conversation.
SYMBOLS = "suaxSUAX" + MUST_GO + END
FIRST_RULE = 0xE000

SUMMARY = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}


class Rope:
    """An audit as two parts; its text is made when first asked for."""

    __slots__ = ("left", "right", "made")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, made: str | None = None):
        self.left, self.right, self.made = left, right, made

    @property
    def text(self) -> str:
        if self.made is None:
            self.made = self.left.text + self.right.text
        return self.made


#: An entry (cost, audit) for each pair of states that edits connect.
Matrix = list[list[tuple[int, Rope] | None]]


def better(x: tuple[int, Rope], y: tuple[int, Rope] | None) -> bool:
    return y is None or x[0] < y[0] or x[0] == y[0] and x[1].text < y[1].text


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        for e in STATES:
            for m in STATES:
                a, b = x[s][m], y[m][e]
                if a and b and better(found := (a[0] + b[0], Rope(a[1], b[1])), out[s][e]):
                    out[s][e] = found
    return out


def single(edits: list[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for s, e, cost, audit in edits:
        if better(found := (cost, Rope(made=audit)), out[s][e]):
            out[s][e] = found
    return out


def inserts() -> Matrix:
    """Up to two inserted turns: more would come back to where they began."""
    none = [(s, s, 0, "") for s in STATES]
    one = single(none + [(s, e, INSERT, "I") for role in "ua" for s, e in STEPS[role].items()])
    return product(one, one)


def symbol(x: str) -> Matrix:
    """Inserts, then what can happen to the row."""
    if x == END:
        return inserts()
    cut, role = CUT * x.isupper(), x.lower()
    edits = [(s, s, DELETE, "D") for s in STATES]
    if x != MUST_GO:
        edits += [(s, e, KEEP + cut, "K") for s, e in STEPS.get(role, {}).items()]
        edits += [(s, e, REROLE + cut, "R") for to in "ua" for s, e in STEPS[to].items()]
    return product(inserts(), single(edits))


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """Of all symbols, and of all rules, each made of its two sides."""
    out = {x: symbol(x) for x in SYMBOLS}
    for k, (a, b) in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[a], out[b])
    return out


def compressed(lines: str, rules: list[str]) -> str:
    """Lines with every rule in place of its pair, in the order of the rules."""
    for k, pair in enumerate(rules):
        lines = lines.replace(pair, chr(FIRST_RULE + k))
    return lines


class Path:
    """The best edits that lead to each state, as symbols come.

    Audits are chains of parts. How the audits of two states compare is kept: as a
    sign where they part, else as what the longer has more; so a step looks at
    new parts only, however long the audits are.
    """

    def __init__(self) -> None:
        self.at: dict[int, tuple[int, Any]] = {0: (0, None)}
        self.order: dict[tuple[int, int], int | tuple[str, str]] = {(0, 0): ("", "")}

    def compare(self, s: int, x: str, t: int, y: str) -> int | tuple[str, str]:
        """How the audit of s with x after it compares to that of t with y: a sign, or what either has beyond the other."""
        known = self.order[s, t]
        if isinstance(known, int):
            return known
        x, y = known[0] + x, known[1] + y
        if x.startswith(y) or y.startswith(x):
            return x[len(y) :], y[len(x) :]
        return -1 if x < y else 1

    def step(self, m: Matrix) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        for s, (cost, _) in self.at.items():
            for e in STATES:
                if entry := m[s][e]:
                    whole, text = cost + entry[0], entry[1].text
                    now = best.get(e)
                    if now is None or whole < now[0] or whole == now[0] and self.before(s, text, now[1], now[2]):
                        best[e] = (whole, s, text)
        best = {e: x for e, x in best.items() if not any(x[0] > y[0] + SLACK[t][e] for t, y in best.items() if t != e)}
        self.order = {(e, t): self.compare(x[1], x[2], y[1], y[2]) for e, x in best.items() for t, y in best.items()}
        self.at = {e: (cost, (self.at[s][1], text)) for e, (cost, s, text) in best.items()}

    def before(self, s: int, x: str, t: int, y: str) -> bool:
        how = self.compare(s, x, t, y)
        return how < 0 if isinstance(how, int) else how[1] > how[0]

    def end(self, m: Matrix) -> tuple[int, str]:
        """Cost and audit of the whole."""
        self.step(m)
        cost, e = None, None
        for t in ENDS:
            if t in self.at and (cost is None or self.at[t][0] < cost or self.at[t][0] == cost and self.before(t, "", e, "")):
                cost, e = self.at[t][0], t
        parts, chain = [], self.at[e][1]
        while chain:
            chain, text = chain
            parts.append(text)
        return cost, "".join(reversed(parts))


def faulty(rows: DataFrame, conv_col: str, order_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows (_conv, _turn, _role, _text) with _digest, a row number, and their faults; stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = rows.select(F.col(conv_col).alias("_conv"), F.col(order_col).cast("long").alias("_turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), text.alias("_text"))
    return stored(named.withColumns({"_digest": F.sha2(F.col("_text").cast("binary"), 256), "_row": F.monotonically_increasing_id()}), "repair-rows")


def marked(rows: DataFrame) -> DataFrame:
    """Without texts, with blank, duplicate (all but the first row of a role and text in a conversation) and truncated."""
    bare = F.rtrim(F.col("_text"), F.lit(SPACE))
    light = rows.select("_conv", "_turn", "_role", "_digest", "_row", (bare == "").alias("_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    first = light.groupBy("_conv", "_role", "_digest").agg(F.min(F.struct("_turn", "_row")).alias("_first"))
    first = first.select(F.col("_first._row").alias("_row"), F.lit(True).alias("_new"))
    return light.join(first, "_row", "left").withColumn("_again", F.col("_new").isNull()).drop("_new")


def segments(light: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Runs of at most ``most`` rows of a conversation, in order of _seq; what of it is counted, and its symbols. Stored."""
    kind = dict(light.dtypes)["_conv"]
    order = ("_conv", "_turn", "_role", "_digest", "_row")
    fields = {"seq": "long", "low": "long", "high": "long", "turns": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string", "last": "string", "symbols": "string"}
    rows = light.repartitionByRange(*order).sortWithinPartitions(*order).select("_conv", "_turn", F.substring("_role", 1, 1).alias("_initial"), "_blank", "_again", "_cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, out, now, conv, before, types = TaskContext.get().partitionId(), 0, [], None, None, None, None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r["conv"] for r in out], types)]
            columns += [pa.array(["".join(r[f]) if f == "symbols" else r[f] for r in out], pa.string() if t == "string" else pa.int64()) for f, t in fields.items()]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", *fields])

        for b in slices(batches, 10_000):
            types = b.column(0).type
            for c, turn, initial, blank, again, cut in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if now is None or c != conv or len(now["symbols"]) >= most:
                    now = dict.fromkeys(fields, 0) | {"conv": c, "seq": (task << 40) + made, "low": None, "high": None, "first": initial, "last": None, "symbols": []}
                    out.append(now)
                    made, conv = made + 1, c
                if turn is not None:
                    now["turns"] += turn != now["high"]
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                now["illegal"] += now["last"] is not None and now["last"] + initial not in LEGAL
                now["last"] = initial
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                if fault:
                    now[fault] += 1
                letter = initial if initial in ("s", "u", "a") else "x"
                now["symbols"].append(MUST_GO if blank or again else letter.upper() if cut else letter)
            last, rest = (out.pop(), out) if out else (None, out)
            if rest:
                yield batch()
            if last is not None:
                out.append(last)
        if out:
            yield batch()

    return stored(rows.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{f} {t}" for f, t in fields.items())), "repair-segments")


def grammar(found: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[str]:
    """Re-Pair over the symbols of all segments: each rule a pair of symbols or earlier rules, most frequent first, a round at a time."""
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch], known: list[str] = known) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for b in batches:
                for line, times in Counter(compressed("\n".join(b.column(0).to_pylist()), known).split("\n")).items():
                    for x, y in zip(line, line[1:], strict=False):
                        seen[x + y] += times
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

        by = found.select("symbols").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        new = [r["pair"] for r in by.where("n > 1").orderBy(F.col("n").desc(), "pair").limit(pairs).collect()]
        if not new:
            break
        rules += new
    return rules


def audits(found: DataFrame, rules: list[str]) -> DataFrame:
    """One row a conversation: conv and the columns of SUMMARY. Its segments meet in order in one task, which keeps only what they add up to."""
    kind = dict(found.dtypes)["conv"]
    rows = found.repartition("conv").sortWithinPartitions("conv", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = once("repair-" + "".join(rules), lambda: matrices(rules))
        memo: dict[str, tuple[int, str]] = {}
        types = None
        out: list[dict] = []
        parts: list[dict] = []

        def summary() -> dict:
            first, last = parts[0], parts[-1]
            total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
            total["illegal"] += sum(p["last"] + q["first"] not in LEGAL for p, q in zip(parts, parts[1:], strict=False))
            low, high, turns = None, None, 0
            for p in parts:
                if p["low"] is not None:
                    turns += p["turns"] - (high == p["low"])
                    low, high = p["low"] if low is None else low, p["high"]
            line = "".join(p["symbols"] for p in parts)
            if len(parts) == 1 and line in memo:
                cost, audit = memo[line]
            else:
                path = Path()
                for x in line:
                    path.step(of[x])
                cost, audit = path.end(of[END])
                if len(memo) > 100_000:
                    memo.clear()
                if len(line) < 100:
                    memo[line] = cost, audit
            assert first["conv"] == last["conv"]
            return {"conv": first["conv"], "gaps": 0 if low is None else high - low + 1 - turns, **total, "cost": cost, "audit": audit}

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r["conv"] for r in out], types)] + [pa.array([r[f] for r in out], pa.string() if t == "string" else pa.int64()) for f, t in SUMMARY.items()]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", *SUMMARY])

        for b in slices(batches):
            types = b.schema.field("conv").type
            lines = compressed("\n".join(b.column("symbols").to_pylist()), rules).split("\n")
            for row, line in zip(b.to_pylist(), lines, strict=True):
                if parts and parts[0]["conv"] != row["conv"]:
                    out.append(summary())
                    parts.clear()
                parts.append(row | {"symbols": line})
            if out:
                yield batch()
        if parts:
            out.append(summary())
            yield batch()

    return rows.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{f} {t}" for f, t in SUMMARY.items()))


class Repairer:
    """Takes a conversation's rows in order and gives its repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def turn(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.last = role[:1]
        return role, text, edit

    def due(self) -> str:
        """The role that comes next."""
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.turn(self.due(), "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.turn(role if edit == "K" else self.due(), text, edit)


def repaired(rows: DataFrame, heads: DataFrame, turns: bool) -> DataFrame:
    """Per conversation its summary and repaired_sha256; with turns, a row a repaired turn instead: conv, no, role, text, edit."""
    kind = dict(rows.dtypes)["_conv"]
    head = heads.select(F.col("conv").alias("_conv"), *SUMMARY, F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit(None).cast("string").alias("_text"), F.lit("").alias("_digest"), F.lit(-1).cast("long").alias("_row"))
    body = rows.select("_conv", *[F.lit(None).cast(t).alias(f) for f, t in SUMMARY.items()], "_turn", "_role", "_text", "_digest", "_row")
    both = head.unionByName(body).withColumn("_kind", F.col("cost").isNull())
    both = text_batches(both).repartition("_conv").sortWithinPartitions("_conv", "_kind", "_turn", "_role", "_digest", "_row").drop("_digest", "_row", "_turn")
    schema = f"conv {kind}, no long, role string, text string, edit string" if turns else f"conv {kind}, " + ", ".join(f"{f} {t}" for f, t in SUMMARY.items()) + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repairer, digest, no, out, types = None, None, None, 0, [], None
        names = ["conv", "no", "role", "text", "edit"] if turns else ["conv", *SUMMARY, "repaired_sha256"]
        kinds = {"no": pa.int64(), **{f: pa.int64() for f, t in SUMMARY.items() if t == "long"}}

        def take(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal no
            for role, text, edit in found:
                if turns:
                    out.append((now["_conv"], no, role, text, edit))
                else:
                    digest.update(("\n" * (no > 0) + role + ":" + text).encode())
                no += 1

        def close() -> None:
            if now is not None:
                take(repairer.inserted())
                if not turns:
                    out.append((now["_conv"], *[now[f] for f in SUMMARY], digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], types if k == 0 else kinds.get(n, pa.string())) for k, n in enumerate(names)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in slices(batches):
            types = b.schema.field("_conv").type
            for row in b.to_pylist():
                if not row["_kind"]:
                    close()
                    now, repairer, digest, no = row, Repairer(row["audit"]), hashlib.sha256(), 0
                else:
                    take(repairer.row(row["_role"], row["_text"]))
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return both.mapInArrow(run, schema)


def _through(rows: DataFrame, conv_col: str, order_col: str, role_col: str, text_col: str, turns: bool) -> DataFrame:
    kept = faulty(rows, conv_col, order_col, role_col, text_col)
    found = segments(marked(kept))
    return repaired(kept, audits(found, grammar(found)), turns)


def repair(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: its id, gaps, faults, cost and audit of its cheapest repair, and the hash of the repaired text."""
    return _through(rows, conv_col, order_col, role_col, text_col, False).withColumnRenamed("conv", conv_col)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: a row a turn, with its number from 0 and the edit that made it."""
    return _through(rows, conv_col, order_col, role_col, text_col, True).select(F.col("conv").alias(conv_col), F.col("no").alias(order_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults planted by a hash of conv_id and turn: rows that are dropped, emptied, cut, repeated or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").otherwise(spaced("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("_fate")).where("_fate <> 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1)))).drop("_fate", "_copy")


def filled(ids: Column | str, rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with the conversations of rows that it lacks: those that have no rows left."""
    known = rows.select(F.col(ids).alias("_known")).distinct()
    out = known.join(found, known["_known"].eqNullSafe(found[ids]), "left")
    rest = {f: F.coalesce(F.col(f), F.lit("" if t == "string" else 0).cast(t)) for f, t in SUMMARY.items()}
    return out.select(F.col("_known").alias(ids), *[c.alias(f) for f, c in rest.items()], F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
