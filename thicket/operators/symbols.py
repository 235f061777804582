"""Symbols of source files: Rust, JavaScript, TypeScript, Go, Java and Python.

Two steps. A small scanner cuts a whole source into statement heads: the text
up to a block or the end of a statement, without strings, comments, attributes
and type parameters, its top-level brackets set apart as lists of parameters, and
with the names of the blocks around it. What a head declares is then decided by
columns, from the patterns below; nothing is shuffled.

Defined cases: a null or unknown language, or a null source, has no symbols; a
bracket, string or comment that never ends takes in the rest of the source, and
the file is marked as not balanced; other columns of the input travel along.
Paths hold the names of all types and modules around a symbol, methods of Go
their receiver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)"
SIGNS = r"(?P<sign>->|=>|::|\.\.\.|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|[^\s\w])"
LINE = r"(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
QUOTED = r'"[^"\\]*(?:\\.[^"\\]*)*"'
#: A regular expression of JavaScript, which stands where no value has just ended.
EXPRESSION = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Blanks before a token are a part of its match.
SPACE = r"[^\S\n]*(?:(?P<end>\n)"
#: How sources of a language fall into tokens.
SCANNERS = {
    "rust": rf"""{SPACE}|{LINE})|(?P<text>b?r(?P<h>\#*)".*?"(?P=h)|b?{QUOTED}|'(?:\\[^\n']+|[^\\'\n])')|(?P<life>'\w+)|{WORDS}|{SIGNS}""",
    "javascript": rf"""{SPACE}|{LINE})|(?P<text>{QUOTED}|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`)|{WORDS}|{SIGNS}""",
    "go": rf"""{SPACE}|{LINE})|(?P<text>{QUOTED}|`[^`]*`|'(?:\\[^\n']+|[^\\'\n])')|{WORDS}|{SIGNS}""",
    "java": rf"""{SPACE}|{LINE})|(?P<text>\"\"\".*?\"\"\"|{QUOTED}|'(?:\\[^\n']+|[^\\'\n])')|{WORDS}|{SIGNS}""",
    "python": rf"""{SPACE}|(?P<comment>\#[^\n]*|\\\n)|(?P<text>[A-Za-z]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'))|{WORDS}|{SIGNS}""",
}
SCANNERS = {name: re.compile(p + ")", re.S) for name, p in (SCANNERS | {"typescript": SCANNERS["javascript"]}).items()}
#: Languages whose statements can end with their line, and what a line that goes on begins with.
BY_LINE = {"go": frozenset(), "javascript": frozenset(". ? : { ( [ , = + - * / % & | < > && || => == !=".split()), "python": frozenset()}
BY_LINE["typescript"] = BY_LINE["javascript"]
#: Blocks whose names are part of a path: keyword, name.
CONTAINERS = {
    "rust": r"\b(mod|trait|struct|enum) (\w+)|^(?:unsafe )?(impl)(?: [^ ].*? for)? (?:& )?(?:mut )?((?:\w+ :: )*\w+)",
    "java": r"(?<![.] )\b(class|interface|enum|record) (\w+)",
    "javascript": r"(?<![.] )\b(class|namespace|module|interface|enum) ([\w$]+)",
    "python": r"^(class) (\w+)",
    "go": r"^type (\w+)(?: \[.*\])? (struct|interface)",
}
CONTAINERS = {name: re.compile(p) for name, p in (CONTAINERS | {"typescript": CONTAINERS["javascript"]}).items()}
STARTS = frozenset("= ( , : [ ! & | ? { } ; + - * % < > => && || == != return typeof case".split())
ANGLES = frozenset(("rust", "java", "typescript"))
ANGLE = re.compile(r" ?<[^<>]*>")
#: Tokens that do more than stand in their head.
STRUCTURE = frozenset("{ } ( ) [ ] ; , < >".split())
HEADS = "ok boolean, heads array<struct<line:int,end_line:int,head:string,groups:array<array<string>>,scope:array<string>,within:string,nested:int,opens:boolean>>"


class Scanner:
    """The heads of one source."""

    def __init__(self, language: str):
        self.language, self.rows, self.may, self.may_in_type = language, [], MAY[language].search, MAY_IN_TYPE.get(language, NEVER).search
        self.blocks: list[dict[str, Any]] = [self.block(None, None, None, -1)]  # open blocks, the file itself first
        self.marks: list[str] = []  # open brackets since the last block
        self.fresh()

    def block(self, row: int | None, keyword: str | None, name: str | None, indent: int) -> dict[str, Any]:
        return {"row": row, "keyword": keyword, "name": name, "indent": indent}

    def fresh(self) -> None:
        self.tokens: list[str] = []
        self.groups: list[list[list[str]]] = []
        self.line = self.angle = self.skip = 0

    def text(self) -> str:
        """The head without type parameters."""
        text = " ".join(self.tokens).replace("->", "→").replace("=>", "⇒")
        while self.language in ANGLES and "<" in text and (less := ANGLE.sub("", text).strip()) != text:
            text = less
        return text

    def emit(self, opens: bool, line: int) -> int | None:
        head = self.text()
        row = None
        if head and (self.may(head) or self.blocks[-1]["keyword"] in HELD and self.may_in_type(head)):
            row, named = len(self.rows), [b for b in self.blocks[1:] if b["name"]]
            groups = [[" ".join(p) for p in g if p] for g in self.groups]
            self.rows.append({"line": self.line, "end_line": line, "head": head, "groups": groups, "scope": [b["name"] for b in named], "within": self.blocks[-1]["keyword"] or "", "nested": len(self.blocks) - 1 - len(named), "opens": opens})
        self.head = head
        self.fresh()
        return row

    def open(self, line: int, indent: int = 0) -> None:
        inside = bool(self.marks)  # a block between brackets belongs to no head
        kept = (self.tokens, self.groups, self.line, self.angle, self.marks)
        if inside:
            self.fresh()
        row = self.emit(True, line)
        found = CONTAINERS[self.language].search(self.head)
        keyword, name = ([x for x in found.groups() if x] if found else (None, None))
        if self.language == "go" and name:
            keyword, name = name, None  # types of Go hold fields alone
        self.blocks.append(self.block(row, keyword, name.replace(" ", "") if name else None, indent) | {"kept": kept if inside else None})
        self.marks = []

    def close(self, line: int) -> None:
        if len(self.blocks) > 1:
            self.emit(False, line)
            block = self.blocks.pop()
            if block["row"] is not None:
                self.rows[block["row"]]["end_line"] = line
            self.marks = []
            if block["kept"]:
                self.tokens, self.groups, self.line, self.angle, self.marks = block["kept"]

    def add(self, token: str, line: int) -> None:
        if not self.tokens:
            self.line = line
        if not self.marks:
            self.tokens.append(token)
        elif self.skip:
            return
        elif self.marks[0] == "(":
            self.groups[-1][-1].append(token)
        else:
            self.tokens.append(token)

    def bracket(self, token: str, line: int) -> None:
        if self.language == "rust" and token == "[" and not self.marks and self.tokens[-1:] in (["#"], ["!"]):
            self.tokens = self.tokens[: -1 if self.tokens[-1] == "#" else -2]
            self.skip = 1
        elif token == "(" and not self.marks:
            self.add(f"({len(self.groups)})", line)
            self.groups.append([[]])
        else:
            self.add(token, line)
        self.marks.append(token)

    def unbracket(self, token: str, line: int) -> None:
        if self.marks:
            self.marks.pop()
            if self.marks or self.tokens and token == "]" and not self.skip:
                self.add(token, line)
            if not self.marks:
                self.skip = self.angle = 0

    def comma(self, token: str) -> None:
        """The parameters of an outermost bracket come apart at commas that are in no other bracket."""
        if self.marks == ["("] and not self.angle and not self.skip:
            self.groups[-1].append([])
        else:
            self.add(token, 0)

    def run(self, source: str) -> tuple[bool, list[dict[str, Any]]]:
        line, last, ended, python = 1, "", False, self.language == "python"
        by_line, good, indent, start = BY_LINE.get(self.language), True, 0, True
        javascript, rust, angles = self.language in ("javascript", "typescript"), self.language == "rust", self.language in ANGLES
        pieces = SCANNERS[self.language]
        following = pieces.scanner(source).match
        while (m := following()) is not None:
            kind, token = m.lastgroup, m[m.lastindex]
            if kind == "end":
                line += 1
                ended = True
                if self.language == "go" and self.marks == ["("] and self.groups[-1][-1]:
                    self.groups[-1].append([])
                if python and not self.marks:
                    self.python_line(line - 1, last)
                    start = True
                continue
            if kind == "comment":
                if rust and token.startswith("/*"):
                    first = m.start(m.lastindex)
                    token = source[first : self.comment_end(source, first)]
                    following = pieces.scanner(source, first + len(token)).match
                line += token.count("\n")
                continue
            if token == "/" and javascript and (last in STARTS or not last) and (found := EXPRESSION.match(source, m.start(m.lastindex))):
                kind, token = "text", found.group()
                following = pieces.scanner(source, found.end()).match
            if python and start:
                first = m.start(m.lastindex)
                indent, start = first - source.rfind("\n", 0, first) - 1, False
                self.dedent(indent, line)
                self.indent = indent
            at = line
            if kind == "text" or kind == "h":
                line += (m["text"] if kind == "h" else token).count("\n")
                token = '""'
            if ended:
                if by_line is not None and not python and self.tokens and not self.marks and (last in (")", "]", "}", '""') or re.match(r"\w", last)) and token not in by_line:
                    self.emit(False, line)
                ended = False
            if token not in STRUCTURE:
                self.add(token, at)
            elif token == "{" and not python:
                self.open(line)
            elif token == "}" and not python:
                good &= len(self.blocks) > 1 and not self.marks
                self.close(line)
            elif token in ("(", "[", "{"):
                self.bracket(token, at)
            elif token in (")", "]", "}"):
                good &= bool(self.marks)
                self.unbracket(token, at)
            elif token == ";" and not self.marks:
                self.emit(False, line)
            elif token == ",":
                self.comma(token) if self.marks else self.add(token, at)
            else:
                if angles and self.marks == ["("] and token != ";":
                    self.angle = max(0, self.angle + (1 if token == "<" else -1))
                self.add(token, at)
            last = token
        good &= not self.marks
        if python and not self.marks:
            self.python_line(line, last)
            self.dedent(-1, line)
        good &= len(self.blocks) == 1
        self.emit(False, line)
        return good, self.rows

    @staticmethod
    def comment_end(source: str, at: int) -> int:
        """Comments of Rust nest."""
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(source, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(source)

    def python_line(self, line: int, last: str) -> None:
        """A logical line of Python ends: one that ends in a colon opens a block."""
        if self.tokens:
            if last == ":":
                self.tokens.pop()
                self.open(line, self.indent)
            else:
                self.emit(False, line)

    def dedent(self, indent: int, line: int) -> None:
        while len(self.blocks) > 1 and self.blocks[-1]["indent"] >= indent:
            self.close(line - 1 if indent >= 0 else line)


#: What a head declares: kind, pattern, and its groups for the name and the bracket of the parameters.
NAME = r"([\w$]+)"
RUST = r"^(?:pub (?:\(\d+\) )?)?(?:default )?"
EXPORT = r"^(?:export )?(?:default )?(?:declare )?(?:abstract )?"
MODIFIERS = r"^(?:@ [\w. ]+? ?(?:\(\d+\) )?)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed) )*+"
NOT = r"(?!(?:if|for|while|switch|catch|return|new|else|do|try|throw|function|super|this)\b)"
PATTERNS: dict[str, tuple[tuple[str, str, int, int], ...]] = {
    "rust": (
        ("function", RUST + r'(?:(?:const|async|unsafe|extern|"") )*fn ' + NAME + r" \((\d+)\)", 1, 2),
        ("struct", RUST + r"(?:unsafe )?struct " + NAME, 1, 0),
        ("enum", RUST + "enum " + NAME, 1, 0),
        ("trait", RUST + r"(?:unsafe )?trait " + NAME, 1, 0),
        ("module", RUST + "mod " + NAME, 1, 0),
        ("constant", RUST + r"(?:const|static)(?: mut)? " + NAME + " :", 1, 0),
        ("type", RUST + "type " + NAME, 1, 0),
    ),
    "javascript": (
        ("function", EXPORT + r"(?:async )?function (?:\* )?" + NAME + r" \((\d+)\)", 1, 2),
        ("class", EXPORT + "class " + NAME, 1, 0),
        ("interface", EXPORT + "interface " + NAME, 1, 0),
        ("enum", EXPORT + "(?:const )?enum " + NAME, 1, 0),
        ("module", EXPORT + "(?:namespace|module) " + NAME, 1, 0),
        ("type", EXPORT + "type " + NAME + " =", 1, 0),
        ("function", EXPORT + "(?:const|let|var) " + NAME + r"(?: :[^=]*)? = (?:async )?\((\d+)\)(?: : .*)? ⇒", 1, 2),
        ("constant", EXPORT + "const " + NAME, 1, 0),
        ("variable", EXPORT + "(?:let|var) " + NAME, 1, 0),
        ("method", r"^(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|\*|#) )*" + NOT + NAME + r" \((\d+)\)(?: : .*)?$", 1, 2),
    ),
    "go": (
        ("function", r"^func (?:\(\d+\) )?" + NAME + r"(?: \[.*?\])? \((\d+)\)", 1, 2),
        ("struct", "^type " + NAME + r"(?: \[.*?\])? struct", 1, 0),
        ("interface", "^type " + NAME + r"(?: \[.*?\])? interface", 1, 0),
        ("type", "^type " + NAME, 1, 0),
        ("constant", "^const " + NAME, 1, 0),
        ("variable", "^var " + NAME, 1, 0),
    ),
    "java": (
        ("class", MODIFIERS + "(?:class|record) " + NAME, 1, 0),
        ("interface", MODIFIERS + "(?:@ )?interface " + NAME, 1, 0),
        ("enum", MODIFIERS + "enum " + NAME, 1, 0),
        ("method", MODIFIERS + NOT + r"(?:[\w$.]+(?: \. [\w$]+)*(?: \[ ?\])* )?" + NAME + r" \((\d+)\)(?: throws .*)?(?: default .*)?$", 1, 2),
    ),
    "python": (
        ("function", r"^(?:async )?def " + NAME + r" \((\d+)\)", 1, 2),
        ("class", "^class " + NAME, 1, 0),
    ),
}
PATTERNS["typescript"] = PATTERNS["javascript"]
#: Where the type that a function returns stands.
RETURNS = {"rust": r"\(\d+\) → (.*?)(?: where .*)?$", "javascript": r"\(\d+\) : (.*?)(?: ⇒)?$", "go": r"^func (?:\(\d+\) )?\w+(?: \[.*?\])? \(\d+\) (.*)$", "java": MODIFIERS + r"([\w$.]+(?: \. [\w$]+)*(?: \[ ?\])*) [\w$]+ \(\d+\)", "python": r"\(\d+\) → (.*)$"}
RETURNS["typescript"] = RETURNS["javascript"]
#: The name inside a parameter.
PARAMETER = {"rust": r"(?:mut )?(\w+)(?: :|$)", "javascript": r"(?:public |private |protected |readonly )*(?:\.\.\. )?([\w$]+)", "go": r"^(\w+)", "java": r"([\w$]+)(?: \[ ?\])*$", "python": r"^(?:\* )*(\w+)"}
PARAMETER["typescript"] = PARAMETER["javascript"]


#: What a head holds that declares something, or something in a type: heads without it match no pattern and stay in the scanner.
NEVER = re.compile(r"(?!)")
MAY = {
    "rust": r"\b(?:fn|struct|enum|trait|mod|const|static|type)\b",
    "javascript": r"\b(?:function|class|interface|enum|namespace|module|type|const|let|var)\b",
    "go": r"^(?:func|type|const|var)\b",
    "java": r"\b(?:class|record|interface|enum)\b",
    "python": r"\b(?:def|class)\b",
}
MAY = {name: re.compile(p) for name, p in (MAY | {"typescript": MAY["javascript"]}).items()}
MAY_IN_TYPE = {name: re.compile(p) for name, patterns in PATTERNS.items() for kind, p, _, _ in patterns if kind == "method"}
HELD = ("impl", "trait", "class", "interface", "enum", "record")


def scanned(files: DataFrame, language: str, source: str) -> DataFrame:
    """files with the heads of each source."""
    columns = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                b = whole.slice(at, 200)
                found = [Scanner(x).run(s) if x in SCANNERS and s is not None else (False, []) for x, s in zip(b.column(language).to_pylist(), b.column(source).to_pylist(), strict=True)]
                row = pa.struct([("line", pa.int32()), ("end_line", pa.int32()), ("head", pa.string()), ("groups", pa.list_(pa.list_(pa.string()))), ("scope", pa.list_(pa.string())), ("within", pa.string()), ("nested", pa.int32()), ("opens", pa.bool_())])
                kept = [k for k, c in enumerate(columns) if c != source]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array([g for g, _ in found], pa.bool_()), pa.array([h for _, h in found], pa.list_(row))], names=[*[columns[k] for k in kept], "ok", "heads"])

    kinds = dict(files.dtypes)
    return files.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns if c != source) + ", " + HEADS)


def by_language(language: Column, of: dict[str, Any]) -> Column:
    out = F.lit(None)
    for name, column in of.items():
        out = F.when(language == name, column).otherwise(out)
    return out


def inside(texts: Column, pattern: str) -> Column:
    return F.transform(texts, lambda x: F.regexp_extract(x, pattern, 1))


def visibility(language: Column, head: Column, groups: Column, name: Column, kind: Column) -> Column:
    """By the modifiers of a head, or by the name where the language says so."""
    inner = F.get(F.get(groups, F.lit(0)), F.lit(0))
    rust = F.when(head.rlike(r"^pub \(\d+\)"), F.when(inner == "crate", "crate").when(inner == "super", "super").otherwise("public")).when(head.startswith("pub "), "public").otherwise("private")
    js = F.when(head.startswith("export "), "public").when(kind == "method", F.when(head.rlike(r"(^|\s)(private |# )"), "private").when(head.contains("protected "), "protected").otherwise("public")).otherwise("private")
    java = F.when(head.rlike(r"\bpublic "), "public").when(head.rlike(r"\bprotected "), "protected").when(head.rlike(r"\bprivate "), "private").otherwise("internal")
    return by_language(language, {"rust": rust, "javascript": js, "typescript": js, "go": F.when(name.rlike("^[A-Z]"), "public").otherwise("private"), "java": java, "python": F.when(name.startswith("_"), "private").otherwise("public")})


def extract(files: DataFrame, language: str = "language", source: str = "source", keep_broken: bool = True) -> DataFrame:
    """A row a symbol: the other columns of files, name, path, kind, visibility, parameters, return_type, signature (tokens apart by one blank), line, end_line, balanced."""
    rest = [c for c in files.columns if c not in (language, source)]
    lang, h = F.col("_language"), F.col("_h")
    named = files.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(rest)], F.col(language).alias("_language"), F.col(source).alias("_source"))
    heads = scanned(named, "_language", "_source")
    if not keep_broken:
        heads = heads.where("ok")
    rows = heads.select(*[f"_k{k}" for k in range(len(rest))], "_language", "ok", F.explode("heads").alias("_h"))
    head = h["head"]
    first = {}
    for name, patterns in PATTERNS.items():
        found = F.lit(None).cast("struct<kind:string,name:string,params:int,returned:string>")
        returned = F.regexp_extract(head, RETURNS[name], 1)
        for kind, pattern, name_at, params_at in reversed(patterns):
            params = F.regexp_extract(head, pattern, params_at).cast("int") if params_at else F.lit(None).cast("int")
            found = F.when(head.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(head, pattern, name_at).alias("name"), params.alias("params"), returned.alias("returned"))).otherwise(found)
        first[name] = found
    # Exploded, as Catalyst would else write the patterns out for each field that is read.
    rows = rows.withColumn("_d", F.explode(F.filter(F.array(by_language(lang, first)), lambda d: d.isNotNull())))
    kind, name, scope, within = F.col("_d.kind"), F.col("_d.name"), h["scope"], h["within"]
    held = within.isin(*HELD)
    kind = F.when((kind == "function") & held, "method").otherwise(kind)
    # Methods stand in types; a constructor bears the name of its type; values are symbols outside of functions only.
    typed = head.rlike(MODIFIERS + r"[\w$.]+(?: \. [\w$]+)*(?: \[ ?\])* [\w$]+ \(\d+\)")
    real = F.when(kind == "method", held & ((lang != "java") | typed | (name == F.element_at(scope, -1)))).when(kind.isin("constant", "variable", "type"), h["nested"] == 0).otherwise(True)
    rows = rows.where(real)
    receiver = F.when((lang == "go") & head.rlike(r"^func \(\d+\) \w+"), F.concat(F.lit("("), F.replace(F.array_join(F.get(h["groups"], F.lit(0)), ","), F.lit(" "), F.lit("")), F.lit(").")))
    sep = F.when(lang == "rust", "::").otherwise(".")
    path = F.concat(F.coalesce(receiver, F.lit("")), F.array_join(F.concat(scope, F.array(name)), "\0"))
    raw = F.coalesce(F.get(h["groups"], F.col("_d.params")), F.array().cast("array<string>"))
    params = by_language(lang, {x: inside(raw, PARAMETER[x]) for x in PATTERNS})
    result = F.when(kind.isin("function", "method"), F.col("_d.returned"))
    tuple_ = F.concat(F.lit("("), F.array_join(F.get(h["groups"], F.regexp_extract(result, r"^\((\d+)\)$", 1).cast("int")), ", "), F.lit(")"))
    plain = F.regexp_replace(result, r" ?(\.|::) ?", "$1")
    returned_type = F.when(result.rlike(r"^\(\d+\)$"), tuple_).when(result != "", plain)
    return rows.select(
        *[F.col(f"_k{k}").alias(c) for k, c in enumerate(rest)],
        name.alias("name"),
        F.replace(path, F.lit("\0"), sep).alias("path"),
        kind.alias("kind"),
        visibility(lang, head, h["groups"], name, kind).alias("visibility"),
        F.filter(params, lambda p: p != "").alias("parameters"),
        returned_type.alias("return_type"),
        F.concat(name, F.when(kind.isin("function", "method"), F.concat(F.lit("("), F.array_join(raw, ", "), F.lit(")"))).otherwise(""), F.coalesce(F.concat(F.lit(" -> "), returned_type), F.lit(""))).alias("signature"),
        h["line"].alias("line"),
        h["end_line"].alias("end_line"),
        F.col("ok").alias("balanced"),
    )
