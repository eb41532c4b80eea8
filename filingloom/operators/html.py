"""HTML to text and to sections, on a small tree built with the standard library.

Tree context (ancestors, preceding siblings, tables with several headings) cannot
be a Column expression, so these run as one Arrow stage each: bytes or text in,
rows out, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("span font a em i b strong u sub sup".split())
#: An open tag of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": frozenset("p div table ul ol h1 h2 h3 h4 h5 h6 hr pre blockquote section article footer header".split()),
    "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "option": frozenset(["option"]),
}
UNRENDERED = frozenset(["script", "style"])
MACHINE_ONLY = frozenset(["ix:header", "ix:hidden"])
ITEM = re.compile(r"\s*Item\s+(\d+[A-Za-z]?)[.—–:]\s*(.*)", re.I)
ITEMS = re.compile(r"\s*Items\s+(\d+[A-Za-z]?)\s+and\s+(\d+[A-Za-z]?)[.—–:]?\s*(.*)", re.I)
#: Text before a heading on its line up to this length is no sentence.
LEAD_CHARS = 10


class Node:
    """An element (tag, attributes, children) or, with tag None, a text."""

    __slots__ = ("tag", "attrs", "kids", "up", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = "", up: Node | None = None) -> None:
        self.tag, self.attrs, self.kids, self.text, self.up = tag, attrs or {}, [], text, up

    def walk(self) -> Iterator[Node]:
        """All nodes below in document order, without recursion."""
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def strings(self) -> Iterator[str]:
        return (n.text for n in self.walk() if n.tag is None)

    def is_leaf(self) -> bool:
        return self.tag is not None and all(k.tag is None for k in self.kids)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.up or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, up=self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.up or self.root

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(Node(None, text=data, up=self.at))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _squeezed(s: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def _rendered(root: Node, drop: frozenset[str], tables: bool, marks: dict[int, tuple[str, str]] | None = None, sink: list[tuple[str, str, list[str]]] | None = None) -> str:
    """Texts joined by line ends; with ``tables`` as tab-separated blocks.

    ``marks`` says at which nodes a section begins; its parts go to ``sink``.
    """
    parts: list[str] = []
    if sink is not None:
        sink.append(("FRONT", "", parts))
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if marks is not None and sink is not None and id(n) in marks:
            parts = []
            sink.append((*marks[id(n)], parts))
            continue
        if n.tag is None:
            parts.append(n.text)
        elif n.tag in drop:
            continue
        elif tables and n.tag == "table":
            inner = [m for m in n.walk() if marks is not None and id(m) in marks]
            if inner:  # a heading laid out in a table: the table is cut there
                parts.append("\n[TABLE]\n")
                stack.append("\n[/TABLE]\n")
                stack.extend(reversed(n.kids))
                continue
            rows = []
            for tr in (m for m in n.walk() if m.tag == "tr"):
                cells = ["".join(s.strip() for s in c.strings()) for c in tr.walk() if c.tag in ("td", "th")]
                if any(cells):
                    rows.append("\t".join(cells))
            parts.append("\n[TABLE]\n" + "\n".join(rows) + "\n[/TABLE]\n")
        else:
            stack.extend(reversed(n.kids))
    return "\n".join(parts)


def text_plain(html: str) -> str:
    """All rendered text, structure lost."""
    return _squeezed(_rendered(parse(html), UNRENDERED, False))


def text_with_tables(html: str) -> str:
    """Rendered text with each table as a block of tab-separated rows."""
    return _squeezed(_rendered(parse(html), UNRENDERED, True))


def text_marked(html: str) -> str:
    """A Markdown-like rendering: headings, bullets and pipe tables; no links, no images."""
    out: list[str] = []

    def put(n: Node) -> None:
        for k in n.kids:
            if k.tag is None:
                out.append(re.sub(r"\s+", " ", k.text))
            elif k.tag in UNRENDERED or k.tag == "img":
                continue
            elif m := re.fullmatch(r"h([1-6])", k.tag):
                out.append("\n\n" + "#" * int(m.group(1)) + " ")
                put(k)
                out.append("\n\n")
            elif k.tag == "li":
                out.append("\n  * ")
                put(k)
            elif k.tag == "br":
                out.append("  \n")
            elif k.tag == "table":
                rows = [[" ".join("".join(c.strings()).split()) for c in tr.walk() if c.tag in ("td", "th")] for tr in k.walk() if tr.tag == "tr"]
                rows = [r for r in rows if r]
                if rows:
                    out.append("\n\n" + "\n".join(" | ".join(r) + ("\n" + "|".join(["---"] * len(r)) if i == 0 else "") for i, r in enumerate(rows)) + "\n\n")
            elif k.tag in ("b", "strong"):
                out.append("**")
                put(k)
                out.append("**")
            elif k.tag in ("i", "em"):
                out.append("_")
                put(k)
                out.append("_")
            else:
                block = k.tag in ("p", "div", "ul", "ol", "tr", "section", "article", "footer", "header", "blockquote", "pre")
                out.append("\n\n" * block)
                put(k)
                out.append("\n\n" * block)

    put(parse(html))
    return _squeezed(re.sub(r"[ \t]*\n[ \t]*(?! \*)", "\n", "".join(out)))


PARSERS: dict[str, Callable[[str], str]] = {"plain": text_plain, "tables": text_with_tables, "marked": text_marked}


# ---------------------------------------------------------------------- headings
def declarations(style: str) -> dict[str, str]:
    """The properties of a style attribute, names and values in lower case."""
    pairs = (part.split(":", 1) for part in style.lower().split(";") if ":" in part)
    return {name.strip(): value.strip() for name, value in pairs}


def _amount(value: str, unit: str = "") -> float:
    """The number of a value in the given unit; -1 if it is none."""
    m = re.match(rf"(\d+(?:\.\d+)?){unit}(?![a-z%])", value)
    return float(m.group(1)) if m else -1.0


#: What sets a text off as a heading (fixed values): properties with the least or the
#: named value, and tags.
LEAST_WEIGHT, NAMED_WEIGHT, LEAST_POINTS, LINE = 600, "bold", 12, "underline"
STRONG_TAGS = frozenset(["b", "strong"])
STYLE_RULES: dict[str, Callable[[str], bool]] = {
    "font-weight": lambda v: re.match(r"\w*", v).group() == NAMED_WEIGHT or _amount(v) >= LEAST_WEIGHT,  # type: ignore[union-attr]
    "font-size": lambda v: _amount(v, "pt") >= LEAST_POINTS,
}


def set_off(n: Node) -> bool:
    """Does the element's own tag or style set its text off?"""
    style = n.attrs.get("style", "")
    own = declarations(style)
    return n.tag in STRONG_TAGS or LINE in style.lower() or any(rule(own[name]) for name, rule in STYLE_RULES.items() if name in own)


class _Lead:
    """What was seen so far within one open element: ``line`` as it stands, and the
    stripped ``words`` its parent takes over when it closes. Both stop growing once
    they are long enough to decide."""

    __slots__ = ("node", "crowded", "linked", "tables", "line", "words")

    def __init__(self, node: Node, outer: _Lead | None) -> None:
        self.node, self.line, self.words = node, "", ""
        self.crowded = outer is not None and (outer.full() or outer.node.tag in INLINE and outer.crowded)
        self.linked = outer is not None and (outer.linked or outer.node.tag == "a" and "href" in outer.node.attrs)
        self.tables: tuple[int, ...] = () if outer is None else (id(outer.node), *outer.tables) if outer.node.tag == "table" else outer.tables

    def full(self) -> bool:
        return len(self.line.strip()) >= LEAD_CHARS

    def add(self, line: str, words: str) -> None:
        if not self.full():
            self.line += line
        if words and len(self.words) < LEAD_CHARS:
            self.words = f"{self.words} {words}" if self.words else words


def leaves(root: Node) -> Iterator[_Lead]:
    """Every element without elements in it, in document order, with what stands before
    it: one forward pass carries the lead of each open element along."""
    open_: list[_Lead] = [_Lead(root, None)]
    todo: list[Iterator[Node]] = [iter(root.kids)]
    while todo:
        n = next(todo[-1], None)
        if n is None:
            todo.pop()
            done = open_.pop()
            if open_:
                open_[-1].add(done.words, done.words)
        elif n.tag is None:
            open_[-1].add(n.text, n.text.strip())
        else:
            lead = _Lead(n, open_[-1])
            if n.is_leaf():
                yield lead
            open_.append(lead)
            todo.append(iter(n.kids))


def item_of(words: str) -> tuple[str, str] | None:
    """(item id, title) of a text that reads like an item heading on one line."""
    for pattern in (ITEM, ITEMS):
        if "\n" not in words and (m := pattern.fullmatch(words)):
            *numbers, title = m.groups()
            return "-".join(numbers).upper(), title.strip()
    return None


def headings(root: Node) -> dict[int, tuple[str, str]]:
    """Heading leaves by node id: set off, in no link, with nothing like a sentence
    before them. Where the innermost table holds two or more it is one of contents."""
    found: list[tuple[_Lead, tuple[str, str]]] = []
    for lead in leaves(root):
        if set_off(lead.node) and not lead.linked and not lead.crowded:
            words = " ".join(w for w in (s.strip() for s in lead.node.strings()) if w)
            if got := item_of(words):
                found.append((lead, got))
    held = Counter(t for lead, _ in found for t in lead.tables)
    return {id(lead.node): got for lead, got in found if not lead.tables or held[lead.tables[0]] < 2}


def sections(html: str) -> list[tuple[str, str, str]]:
    """(item id, title, text); the text before the first heading is ``FRONT``."""
    root = parse(html)
    sink: list[tuple[str, str, list[str]]] = []
    _rendered(root, UNRENDERED | MACHINE_ONLY, True, headings(root), sink)
    return [(item, title, "\n".join(parts)) for item, title, parts in sink]


# ------------------------------------------------------------------------ stages
def _text_of(v: object) -> str | None:
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else v  # type: ignore[return-value]


def parse_html(df: DataFrame, keep: list[str], html: str, parsers: list[str] | None = None) -> DataFrame:
    """keep columns, ``parser``, ``text``: one row per input row and parser.

    ``html`` is text or bytes (UTF-8, damaged bytes replaced). A parser's error is
    its text, as ``[PARSE ERROR] Type: message``. Null gives null.
    """
    names = parsers or list(PARSERS)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("parser", T.StringType()), T.StructField("text", T.StringType())])

    def one(name: str, v: str | None) -> str | None:
        if v is None:
            return None
        try:
            return PARSERS[name](v)
        except Exception as e:  # noqa: BLE001
            return f"[PARSE ERROR] {type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [_text_of(v) for v in b.column(len(keep)).to_pylist()]
            for name in names:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([name] * len(values), pa.string()), pa.array([one(name, v) for v in values], pa.string())], names=schema.names)

    return df.select(*keep, html).mapInArrow(run, schema)


SECTIONS = T.ArrayType(T.StructType([T.StructField("section_pos", T.IntegerType()), T.StructField("item_id", T.StringType()), T.StructField("item_title", T.StringType()), T.StructField("text", T.StringType())]))


def section_lists(df: DataFrame, keep: list[str], html: str) -> DataFrame:
    """keep columns and ``sections``: the sections of each filing in order, as one
    array in the filing's row, so that rules over a filing need no shuffle. A null
    document has none."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("sections", SECTIONS)])
    kind = pa.list_(pa.struct([("section_pos", pa.int32()), ("item_id", pa.string()), ("item_title", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a filing at a time: filings are large
                v = _text_of(b.column(len(keep))[i].as_py())
                made = [(pos, *s) for pos, s in enumerate(sections(v))] if v is not None else []
                rows = pa.array([[dict(zip(("section_pos", "item_id", "item_title", "text"), m)) for m in made]], kind)
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1) for j in range(len(keep))), rows], names=schema.names)

    return df.select(*keep, html).mapInArrow(run, schema)


def split_html(df: DataFrame, keep: list[str], html: str) -> DataFrame:
    """keep columns, ``section_pos``, ``item_id``, ``item_title``, ``text``: one row per
    section of each filing."""
    return section_lists(df, keep, html).select(*keep, F.inline("sections"))
