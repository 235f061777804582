"""Main text of web pages through wrappers inferred by union-free regular expressions.

A page is a nested stream of block tags and text; inline tags are part of the
text. The wrapper of a host starts as its first page and is aligned with each
further one. Blocks that only one side has become optional; equal neighbours
fold into one repeated block; paragraphs, headings and lists between two
containers form one repeated group of optional members; texts that differ
become slots, texts that all pages have stay fixed. Containers align by their
longest common subsequence, and those that moved by their signature, so a
sequence is never longer than its longest page asks for, at any length.

The finished wrapper decides what a page's text is. Its nodes carry how many
pages have them, how much text and how much link text they hold, and the texts
that all of them share. Nodes of links, of fixed texts and of HTML's own page
furniture are labelled out; the main region is where the varying text of the
host gathers, article and main elements (and blocks named so) counting several
times. Names of classes alone never overrule a content name: there the wrapper
says whether the block varies; nor do they label out an article or main element
or the block that holds most of its text. A text that all pages share stays
where it is a heading or quotation of an article, or stands between texts that vary. A page is read by matching it with its host's
wrapper: a block that matches no node has no text.

Partial wrappers form where the pages are read, one a host and task, and merge
by host in rounds of at most FAN, so a host with a third of all pages is never
gathered, whatever the number of tasks.

Defined cases: null or empty html has empty text; a page without a known host
uses the wrapper of the empty host; unclosed or cut-off markup ends where the
page ends; ties and repeated rows are pages like any other; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Generator, Iterator
from typing import Any

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .urls import host_of

#: Names of tags and of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym area b bdi bdo big cite code data del dfn em embed font i img input ins kbd label mark param q ruby rp rt s samp small source span strike strong sub sup time track tt u var wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address center details summary".split())
SKIPPED = frozenset("head nav footer aside form menu dialog button select option iframe object audio video canvas map fieldset datalist script style noscript template textarea svg math title".split())
MAIN = frozenset(("article", "main"))
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: Names that mark furniture whatever stands beside them, and those that a content name beside them outweighs.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing comment comments commentlist reply replies respond disqus pagination pager toolbar hidden".split())
WEAK = frozenset("promotion banner notice notices alert social related recommended recommendations discussion widget search skip legal disclaimer copyright form".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond".split())
HEADINGS, QUOTED = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("blockquote pre figure".split())
HEADER = frozenset("header topbar site-header".split())
CONTENT = frozenset("article content main post entry story body text".split())
LEXICON = STRONG | WEAK | HEADER | CONTENT
#: The signature of a repeated group of optional flow blocks.
GROUP = "()"
#: Pages that a fixed text must stand on before it counts as furniture.
FIXED_PAGES = 3
#: Wrappers of a host that meet in one merge.
FAN = 64
WRAPPER = "host string, part int, wrapper string"
#: Share of a subtree's text inside links from which it is navigation.
LINK_SHARE = 0.6
#: Share of the (weighted) text of a node that one container must hold to be its main region, and the weights of blocks named so and of article and main.
MAIN_SHARE, NAMED, TAGGED = 0.7, 3, 8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def signature(tag: str, attributes: str) -> str:
    """The tag, and the words of LEXICON in its class, id and role."""
    words: set[str] = set()
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words |= {w.lower() for w in PARTS.findall(value)} & LEXICON
            elif name == "hidden" or (name == "style" and NONE_SHOWN.search(value)):
                words.add("hidden")
    return ".".join([tag, *sorted(words)])


class Node:
    """A block: its signature, its texts and blocks in page order, the characters of its own texts and those inside links."""

    __slots__ = ("sig", "tag", "items", "chars", "links")

    def __init__(self, sig: str, tag: str):
        self.sig, self.tag, self.items, self.chars, self.links = sig, tag, [], 0, 0


def parse(page: str) -> Node:
    root = Node("#", "#")
    stack = [root]
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked = False

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                stack[-1].items.append(line)
                stack[-1].chars += len(line)

    for m in TOKEN.finditer(page):
        chars = m[5]
        if chars is not None:
            text.append(chars)
            if linked:
                stack[-1].links += len(chars.strip())
            continue
        if m[3] is None:
            if m[1]:
                flush()
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "a":
                linked = not m[2]
            continue
        flush()
        linked = False  # no link spans blocks here
        if tag in VOID:
            continue
        if m[2]:
            while is_open[tag]:
                last = stack.pop().tag
                is_open[last] -= 1
                if last == tag:
                    break
            continue
        if len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ())):
            is_open[stack.pop().tag] -= 1
            if tag == "tr" and stack[-1].tag == "tr":
                is_open[stack.pop().tag] -= 1
        node = Node(signature(tag, m[4]), tag)
        stack[-1].items.append(node)
        if not m[4].endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    flush()
    return root


def unwound(step: Generator) -> Any:
    """The result of a recursive generator, which yields its calls and is sent their results: blocks can nest to any depth."""
    stack, value = [step], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(call)
            value = None
    return value


class Part:
    """A node of a wrapper.

    pages: how many pages have it (fewer than its parent's: optional); repeated:
    some page has it twice or more; common: hashes of the texts that all those
    pages have in it; varied: some page has others (a slot). cover: the blocks of
    the page that a page's own wrapper was made of.
    """

    __slots__ = ("sig", "repeated", "varied", "pages", "chars", "links", "common", "kids", "cover")

    def __init__(self, sig: str, repeated: bool = False, varied: bool = False, pages: int = 1, chars: int = 0, links: int = 0, common: set[int] | None = None, kids: list[Part] | None = None, cover: list[Node] | None = None):
        self.sig, self.repeated, self.varied, self.pages, self.chars, self.links = sig, repeated, varied, pages, chars, links
        self.common, self.kids, self.cover = common if common is not None else set(), kids or [], cover or []


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass"))


def page_wrapper(page: Node) -> Part:
    return unwound(_of_block(page))


def merge(a: Part, b: Part) -> Part:
    """The wrapper of the pages of both."""
    return unwound(_merge(a, b))


def _of_block(node: Node) -> Generator:
    kids: list[Part] = []
    members: dict[str, Part] = {}  # of the group that is open at the end of kids
    for child in node.items:
        if isinstance(child, str):
            continue
        kid = yield _of_block(child)
        last = kids[-1] if kids else None
        if child.tag in FLOW:
            if last is None or last.sig != GROUP:
                members = {}
                kids.append(last := Part(GROUP))
            if (old := members.get(kid.sig)) is None:
                members[kid.sig] = kid
                last.kids.append(kid)
            else:
                yield _repeat(old, kid)
        elif last is not None and last.sig == kid.sig and [k.sig for k in last.kids] == [k.sig for k in kid.kids]:
            yield _repeat(last, kid)
        else:
            kids.append(kid)
    sig = node.sig
    if node.tag not in FLOW and node.tag != "#":
        # A container of blocks, of links alone, or of text.
        sig += "+" if kids else "~" if node.chars and node.links >= LINK_SHARE * node.chars else ""
    return Part(sig, chars=node.chars, links=min(node.links, node.chars), common={digest(x) for x in node.items if isinstance(x, str)}, kids=kids, cover=[node])


def _repeat(a: Part, b: Part) -> Generator:
    """Adds b to a, of which it is a repeat in the same page."""
    a.repeated = a.repeated or a.sig != GROUP
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    a.common |= b.common
    a.cover += b.cover
    if b.kids:
        kids = pairs(a.kids, b.kids, a.sig == GROUP)
        a.kids = [y if x is None else x for x, y in kids]
        for x, y in kids:
            if x is not None and y is not None:
                yield _repeat(x, y)


def _merge(a: Part, b: Part) -> Generator:
    kids = []
    for x, y in pairs(a.kids, b.kids, a.sig == GROUP) if a.kids or b.kids else ():
        kids.append((yield _merge(x, y)) if x is not None and y is not None else x if y is None else y)
    varied = a.varied or b.varied or a.common != b.common
    return Part(a.sig, a.repeated or b.repeated, varied, a.pages + b.pages, a.chars + b.chars, a.links + b.links, a.common & b.common, kids)


def pairs(a: list[Part], b: list[Part], group: bool) -> list[tuple[Part | None, Part | None]]:
    """Both sequences as one, in order: what matches stands together, what one side lacks beside None."""
    if len(a) == len(b) and all(x.sig == y.sig for x, y in zip(a, b, strict=True)):
        return list(zip(a, b, strict=True))
    if not a or not b:
        return [(x, None) for x in a] or [(None, y) for y in b]
    to_b: dict[int, int] = {}
    if not group:
        to_b = dict(common_subsequence([x.sig for x in a], [y.sig for y in b]))
    # What moved (in a group: all) matches by its signature.
    taken, rest = set(to_b.values()), defaultdict(deque)
    for j, y in enumerate(b):
        if j not in taken:
            rest[y.sig].append(j)
    for i, x in enumerate(a):
        if i not in to_b and rest[x.sig]:
            to_b[i] = rest[x.sig].popleft()
    taken = set(to_b.values())
    after: dict[int, list[int]] = defaultdict(list)  # what only b has follows what it follows there
    from_b, at = {j: i for i, j in to_b.items()}, -1
    for j in range(len(b)):
        at = from_b.get(j, at)
        if j not in taken:
            after[at].append(j)
    out: list[tuple[Part | None, Part | None]] = [(None, b[j]) for j in after[-1]]
    for i, x in enumerate(a):
        out.append((x, b[to_b[i]] if i in to_b else None))
        out += [(None, b[j]) for j in after[i]]
    return out


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest one, as pairs of positions; rows of the table are the bits of one number each."""
    where: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    whole = row = (1 << len(a)) - 1
    rows = []
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def packed(wrapper: Part) -> str:
    """The wrapper as JSON: its nodes in page order, each with its depth."""
    out, stack = [], [(0, wrapper)]
    while stack:
        depth, w = stack.pop()
        out.append([depth, w.sig, w.repeated, w.varied, w.pages, w.chars, w.links, sorted(w.common)])
        stack += [(depth + 1, k) for k in reversed(w.kids)]
    return json.dumps(out, separators=(",", ":"))


def unpacked(line: str) -> Part:
    path: list[Part] = []
    for depth, sig, repeated, varied, pages, chars, links, common in json.loads(line):
        del path[depth:]
        node = Part(sig, repeated, varied, pages, chars, links, set(common))
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def nodes_of(wrapper: Part) -> list[Part]:
    """All nodes, each before its kids."""
    out = [wrapper]
    for w in out:
        out += w.kids
    return out


class Wrapper:
    """A host's wrapper with labels on its nodes: out, main, and what their names say."""

    def __init__(self, wrapper: Part):
        self.root = wrapper
        order = nodes_of(wrapper)
        # Fixed texts say something only where pages differ at all.
        self.varies = wrapper.pages >= FIXED_PAGES and any(w.varied for w in order)
        self.named: set[int] = set()
        self.out: set[int] = set()
        self.main: set[int] = set()
        chars, links, moving, self.mass, self.evidence, self.rank = {}, {}, {}, {}, {}, {}
        #: Flow blocks beside which others vary: what is fixed in them can be the article's own.
        self.flow: dict[int, str] = {}
        self.measure(order)
        for w in reversed(order):
            k = id(w)
            chars[k] = w.chars + sum(chars[id(x)] for x in w.kids)
            links[k] = w.links + sum(links[id(x)] for x in w.kids)
            moving[k] = w.varied or any(moving[id(x)] for x in w.kids)
            tag, *words = w.sig.rstrip("+~").split(".")
            fixed = self.varies and w.pages >= FIXED_PAGES and not moving[k]
            if self.furniture(tag, words, fixed) and not self.spared(w, tag, words):
                self.named.add(k)
            if w.sig == GROUP and moving[k]:
                stack = list(w.kids)
                while stack:
                    x = stack.pop()
                    if (own := x.sig.rstrip("+~").split(".")[0]) in FLOW:
                        self.flow[id(x)] = own
                        stack += x.kids
            self.rank[k] = TAGGED if tag in MAIN else NAMED if CONTENT.intersection(words) and tag in ("div", "section", "td") else 1
            self.evidence[k] = max([self.rank[k], *(self.evidence[id(x)] for x in w.kids if id(x) not in self.named)])
            idle = self.evidence[k] == 1 and (fixed and chars[k] or links[k] > LINK_SHARE * chars[k])
            if k in self.named or tag == "header" or HEADER.intersection(words) or idle:
                self.out.add(k)
            own = (w.chars - w.links) * (0.25 if self.varies and not w.varied else 1)
            self.mass[k] = own + sum(self.mass[id(x)] for x in w.kids if id(x) not in self.named)
        self.find_main()

    def measure(self, order: list[Part]) -> None:
        """The text outside of links below each node, all of it and what differs between pages; the article or main element, or block named so, around each node; and whether other such elements are free of words of furniture."""
        self.told: dict[int, tuple[float, float]] = {}
        self.around: dict[int, Part | None] = {id(order[0]): None}
        free = 0
        for w in order:
            tag, *words = w.sig.rstrip("+~").split(".")
            region = tag in MAIN or bool(CONTENT.intersection(words)) and tag in ("div", "section", "td")
            plain = not (STRONG | WEAK).intersection(words)
            free += region and plain
            for x in w.kids:
                self.around[id(x)] = w if region and plain else self.around[id(w)]
        self.free = free
        for w in reversed(order):
            own = w.chars - w.links
            self.told[id(w)] = own + sum(self.told[id(x)][0] for x in w.kids), own * w.varied + sum(self.told[id(x)][1] for x in w.kids)

    def spared(self, w: Part, tag: str, words: list[str]) -> bool:
        """Whether a word of furniture says nothing here: the element is itself an article, or holds most of the text of what is around it."""
        if tag in SKIPPED or "hidden" in words:
            return False
        around, (text, moving) = self.around[id(w)], self.told[id(w)]
        if COMMENTS.intersection(words) and self.free:
            return False
        if around is not None:
            return 2 * text > self.told[id(around)][0]
        if tag in MAIN:
            return True
        return self.varies and not self.free and 2 * moving > self.told[id(self.root)][1] > 0

    @staticmethod
    def furniture(tag: str, words: list[str], fixed: bool) -> bool:
        """HTML's own furniture, and blocks named so; where a content name stands beside a weak one, a block that varies is content."""
        if tag in SKIPPED or STRONG.intersection(words):
            return True
        return bool(WEAK.intersection(words)) and (fixed or not CONTENT.intersection(words))

    def weight(self, w: Part) -> float:
        """The text of w, with that of blocks that are tagged or named as content counted several times."""
        total, stack = 0.0, [w]
        while stack:
            x = stack.pop()
            k = id(x)
            if self.rank[k] == self.evidence[k] > 1:
                total += self.mass[k] * self.rank[k]
            elif self.evidence[k] == 1:
                total += self.mass[k]
            else:
                total += x.chars - x.links
                stack += [y for y in x.kids if id(y) not in self.named]
        return total

    def find_main(self) -> None:
        """Walks down from the root to where the text gathers."""
        at = self.root
        while True:
            kids = [x for x in at.kids if id(x) not in self.out]
            boxes = [x for x in kids if x.sig != GROUP]
            if not boxes:
                break
            weights = {id(x): self.weight(x) for x in kids}
            best = max(boxes, key=lambda x: weights[id(x)])
            k = id(best)
            alike = [x for x in boxes if x.sig == best.sig and self.evidence[id(x)] > 1] or [best]
            if sum(weights[id(x)] for x in alike) < MAIN_SHARE * (sum(weights.values()) + at.chars - at.links) or not weights[k]:
                break
            if self.evidence[k] == 1 and len(kids) == len(at.kids) > 1:
                break  # nothing here is furniture, so all of it is the article
            if self.rank[k] == self.evidence[k] > 1 or len(alike) > 1:
                self.main = {id(x) for x in alike}
                return
            at = best
        self.main = {id(at)}

    def matched(self, page: Node) -> dict[int, Part]:
        """The wrapper's node of each block of the page."""
        found: dict[int, Part] = {}
        own = page_wrapper(page)
        stack = [(own, self.root)] if own.sig == self.root.sig else []
        while stack:
            x, w = stack.pop()
            for block in x.cover:
                found[id(block)] = w
            stack += [(a, b) for a, b in pairs(x.kids, w.kids, w.sig == GROUP) if a is not None and b is not None]
        return found

    def text(self, page: Node) -> str:
        """The text of the page's main regions; of a page without, that of all nodes that are not out."""
        found = self.matched(page)
        lines: list[str] = []
        for regions, out, drop in ((self.main, self.named, self.varies), (self.main, self.named, False), (None, self.out, self.varies), (None, self.named, False)):
            lines = self.trimmed(self.lines(page, found, regions, out, drop))
            if lines:
                break
        return "\n".join(lines)

    @staticmethod
    def trimmed(lines: Iterator[tuple[str, str]]) -> list[str]:
        """The texts of lines, less the fixed ones at either end: those before the first heading or own line, and those behind the last own one; quotations stay."""
        rows = list(lines)
        own = [k for k, (_, fixed) in enumerate(rows) if not fixed or fixed in QUOTED]
        if not own:
            return []
        first = next(k for k, (_, fixed) in enumerate(rows) if not fixed or fixed in QUOTED or fixed in HEADINGS)
        return [text for text, _ in rows[first : own[-1] + 1]]

    def lines(self, page: Node, found: dict[int, Part], regions: set[int] | None, out: set[int], drop: bool) -> Iterator[tuple[str, str]]:
        """The lines inside regions (None: anywhere), less nodes of out and, with drop, fixed texts. Those of flow blocks beside which others vary come with their tag instead."""
        label: Callable[[Node], Part | None] = lambda block: found.get(id(block))
        stack: list[tuple[Part | None, bool, Iterator]] = [(label(page), regions is None or id(label(page)) in regions, iter(page.items))]
        while stack:
            w, inside, items = stack[-1]
            item = next(items, None)
            if item is None:
                stack.pop()
            elif isinstance(item, str):
                if inside and w is not None:
                    fixed = drop and self.fixed(w, regions is not None) and digest(item) in w.common
                    tag = self.flow.get(id(w), "") if fixed and regions is not None else ""
                    if tag or not fixed:
                        yield item, tag
            else:
                own = label(item)
                # Outside a region, only what cannot lead to one is left out.
                if own is not None and id(own) not in (out if inside else self.out):
                    stack.append((own, inside or id(own) in (regions or ()), iter(item.items)))

    def fixed(self, w: Part, inside: bool) -> bool:
        """Inside a main region a fixed text counts as furniture only where all pages of the host have it."""
        return w.pages == self.root.pages if inside else w.pages >= FIXED_PAGES


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a host: host, wrapper (JSON); stored."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Part] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                w = page_wrapper(parse(page))
                for x in nodes_of(w):
                    x.cover = []  # a wrapper keeps no page
                found[host] = merge(found[host], w) if host in found else w
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"host": [*found], "part": [part] * len(found), "wrapper": [packed(w) for w in found.values()]}).astype({"host": object, "part": "int32", "wrapper": object})

    def both(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for line in sorted(group["wrapper"]):
            total = unpacked(line) if total is None else merge(total, unpacked(line))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [group["part"].iloc[0]], "wrapper": [packed(total)]})

    rows = text_batches(pages).select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    found = stored(rows.mapInPandas(read, WRAPPER), "wrapper-parts")
    last = found.agg(F.max("part").alias("last")).first()["last"] or 0
    while True:
        # Tasks whose numbers agree but for the last digit to the base FAN meet.
        last //= FAN
        found = stored(found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("host", "part").applyInPandas(both, WRAPPER), "wrappers")
        if not last:
            return found.select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars. The wrappers are a stored table of one row a host, which Catalyst broadcasts or shuffles by its size."""
    by_host = wrappers(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html")).join(by_host, "host", "left")
    kind = dict(rows.dtypes)["id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for line, page in zip(batch["wrapper"], batch["html"], strict=True):
                if page is None or line is None:
                    texts.append("")
                    continue
                if line not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[line] = Wrapper(unpacked(line))
                texts.append(known[line].text(parse(page)))
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("id", "url", "wrapper", "html").mapInPandas(read, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
