"""Chat formatting by schema fingerprints.

A record's layout is recognised by hashes of its nested field paths: one for each
layout, over those of the paths that the layout names. The hash that agrees
selects a declarative mapping (LAYOUTS), which turns prompt, instruction and
message layouts into canonical turns (role, text); where several agree, the one
of most paths. A template then writes a
conversation as one string, in which control strings inside texts are escaped
reversibly, and reads it back.

Defined cases: a null text or role is empty text; turns sort by number, then
role, then text (null numbers first), so repeated rows and ties have one order;
an unknown layout gives no turns and keeps its fingerprint, a null record too; a
record that is no JSON object raises; fields that no layout names are ignored;
texts have any length that a string can have; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout name -> field paths, and how they map to turns: rows (one turn a record), list (path of the list, role, text) or fields (role and path of each turn).
LAYOUTS = {
    "turn_rows": {"paths": ("conv_id", "turn", "role", "text"), "rows": ("role", "text")},
    "messages": {"paths": ("messages[].content", "messages[].role"), "list": ("messages", "role", "content")},
    "message_texts": {"paths": ("messages[].role", "messages[].text"), "list": ("messages", "role", "text")},
    "from_value": {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "prompt": {"paths": ("completion", "prompt"), "fields": (("user", "prompt"), ("assistant", "completion"))},
    "response": {"paths": ("prompt", "response"), "fields": (("user", "prompt"), ("assistant", "response"))},
    "instruction": {"paths": ("instruction", "output"), "fields": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input": {"paths": ("input", "instruction", "output"), "fields": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "system_prompt": {"paths": ("prompt", "response", "system"), "fields": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
}
#: Other names of the same role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = sorted({p for x in LAYOUTS.values() for p in x["paths"]})
#: Escape codes inside texts and roles: each backslash starts a code of two characters, so no control string can appear there.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


def paths_of(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; [] marks a list."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    """Hash of the sorted paths."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_PRINT = {fingerprint(list(x["paths"])): name for name, x in LAYOUTS.items()}
#: Layouts with most paths first: of several that fit a record, the one that explains most of it is meant.
BY_SIZE = sorted(LAYOUTS, key=lambda name: -len(LAYOUTS[name]["paths"]))


def layout_of(paths: list[str]) -> str | None:
    """The layout whose fingerprint those of the paths that it names have; other fields play no part."""
    for name in BY_SIZE:
        if BY_PRINT.get(fingerprint([p for p in paths if p in LAYOUTS[name]["paths"]])) == name:
            return name
    return None


def _role(role: Column) -> Column:
    named = F.coalesce(role, F.lit(""))
    for old, new in ROLES.items():
        named = F.when(named == old, new).otherwise(named)
    return named


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: dict, field) -> Column:
    """The turns of one record; field(path) gives a column."""
    if "rows" in layout:
        return F.array(_turn(*[field(p) for p in layout["rows"]]))
    if "list" in layout:
        path, role, text = layout["list"]
        return F.transform(field(path), lambda m: _turn(m[role], m[text]))
    return F.array(*[_turn(F.lit(role), field(p)) for role, p in layout["fields"]])


def typed_turns(df: DataFrame, out: str = "turns") -> DataFrame:
    """df with its turns (array of role, text) in column out; its own schema is fingerprinted."""
    name = layout_of(paths_of(df.schema))
    if name is None:
        return df.withColumn(out, F.array().cast("array<struct<role:string,text:string>>"))
    return df.withColumn(out, _mapped(LAYOUTS[name], lambda p: df[p]))


#: A text of a record can be as long as a string can be: the reader's own bound of 20 million characters would lose it.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def json_turns(df: DataFrame, payload: str, out: str = "turns") -> DataFrame:
    """The same for JSON records whose layouts differ from row to row; also gives columns fingerprint and layout.

    A record is read as a map of its fields, its lists as lists of maps, so the
    paths of any layout come from what is read once. A record that is no JSON
    object stops the query: it must not turn into empty texts.
    """
    lists = sorted({p.partition("[]")[0] for p in KNOWN if "[]" in p})
    none = F.array().cast("array<string>")
    read = F.from_json(payload, "map<string,string>", ANY_LENGTH)
    rows = df.withColumn("_top", F.when(F.col(payload).isNotNull(), F.coalesce(read, F.raise_error(F.concat(F.lit("a record is no JSON object: "), F.substr(payload, F.lit(1), F.lit(80)))).cast("map<string,string>"))))
    rows = rows.withColumns({f"_list_{x}": F.from_json(F.col("_top")[x], "array<map<string,string>>", ANY_LENGTH) for x in lists})

    def inside(name: str) -> Column:
        return F.coalesce(F.transform(F.map_keys(F.get(f"_list_{name}", F.lit(0))), lambda k: F.concat(F.lit(f"{name}[]."), k)), none)

    rows = rows.withColumn("_paths", F.array_sort(F.array_distinct(F.concat(F.coalesce(F.map_keys("_top"), none), *[inside(x) for x in lists]))))
    # Of each layout: the hash of those of the record's paths that it names.
    prints = {name: F.md5(F.array_join(F.array_intersect("_paths", F.array(*[F.lit(p) for p in LAYOUTS[name]["paths"]])), "\n").cast("binary")) for name in BY_SIZE}
    name, print_ = F.lit(None).cast("string"), F.md5(F.array_join("_paths", "\n").cast("binary"))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    key_of = {layout: key for key, layout in BY_PRINT.items()}
    for layout in reversed(BY_SIZE):
        name = F.when(prints[layout] == key_of[layout], layout).otherwise(name)
        print_ = F.when(prints[layout] == key_of[layout], key_of[layout]).otherwise(print_)
    rows = rows.withColumns({"fingerprint": print_, "layout": name})
    for layout in BY_SIZE:
        turns = F.when(F.col("layout") == layout, _mapped(LAYOUTS[layout], lambda p: F.col(f"_list_{p}") if p in lists else F.col("_top")[p])).otherwise(turns)
    return rows.withColumn(out, F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))).drop("_paths", "_top", *[f"_list_{x}" for x in lists])


def records(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record a conversation (conv_id, record), in the layout that public sets of its kind have.

    A question and its answer become a prompt and a completion (with a system turn
    before them, a system prompt); longer ones are lists of messages, by turns of
    the two layouts that name a role and its text apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Sorted by the role as it will be read, so that names of one role tie.
    turn = F.struct(F.col(order_col).alias("no"), _role(F.col(role_col)).alias("role"), text.alias("text"), F.coalesce(F.col(role_col), F.lit("")).alias("own"))
    by = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    roles = F.transform("_t", lambda t: t["role"])
    texts = lambda k: F.col("_t")[k]["text"]
    as_list = lambda path, role, content: F.to_json(F.struct(F.transform("_t", lambda t: F.struct(t["own"].alias(role), t["text"].alias(content))).alias(path)))
    is_roles = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    record = (
        F.when(is_roles("user", "assistant"), F.to_json(F.struct(texts(0).alias("prompt"), texts(1).alias("completion"))))
        .when(is_roles("system", "user", "assistant"), F.to_json(F.struct(texts(0).alias("system"), texts(1).alias("prompt"), texts(2).alias("response"))))
        .when(F.pmod(F.xxhash64(conv_col), F.lit(2)) == 0, as_list("messages", "role", "content"))
        .otherwise(as_list("conversations", "from", "value"))
    )
    return by.select(conv_col, record.alias("record"))


def format_records(df: DataFrame, payload: str = "record", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """JSON records of any layouts: the columns of keep, layout, formatted, and turns as read back from it (role, text, loss)."""
    return json_turns(df, payload, "_turns").select(*keep, "layout", render(F.col("_turns")).alias("formatted")).withColumn("turns", parse(F.col("formatted")))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column) -> Column:
    """The template: <s>[role]text</s> for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<s>["), escape(t["role"]), F.lit("]"), escape(t["text"]), F.lit("</s>"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, texts unescaped; loss is true where the model is trained on the text."""
    parts = F.filter(F.split(formatted, "</s>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(5))
        role = F.substring_index(body, "]", 1)
        text = F.substr(body, F.char_length(role) + 2)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), (role == "assistant").alias("loss"))

    return F.transform(parts, turn)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """One row a conversation: conv_id, formatted, and turns as read back from it (role, text, loss)."""
    each = typed_turns(rows, "_turns").select(conv_col, F.col(order_col).alias("_no"), F.posexplode("_turns").alias("_sub", "_t"))
    by = each.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("_no", "_sub", F.col("_t.role").alias("role"), F.col("_t.text").alias("text")))).alias("_all"))
    return by.select(conv_col, render(F.col("_all")).alias("formatted")).withColumn("turns", parse(F.col("formatted")))
