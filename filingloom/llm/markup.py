"""Markup residue in text documents (problem 4).

HTML, Markdown, wiki and LaTeX become clean text that keeps headings (lines of
their own), lists (bullets), tables (the project's ``[TABLE]`` blocks), code and
formulas.

Method: tag-path ratios. Every element of the four languages is a node under its path
of tags from root to leaf; text length and punctuation are summed per path and fused to
a ratio; the ratios are smoothed over the nodes in the order of the document and
thresholded, which selects the content nodes. The languages of a text are those its
paths name, and the clean text is made of the content nodes.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import keyed, schema_of, unkeyed

LANGUAGES = ("html", "markdown", "wiki", "latex")

# ------------------------------------------------------------------ fixed values
BLOCK_TAGS = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav noscript ol p pre section summary table tbody td tfoot th thead tr title ul".split()
INLINE_TAGS = "a abbr acronym area audio b base bdi bdo big br button canvas cite code col colgroup data datalist del dfn em embed font frame frameset i iframe img input ins kbd label legend link map mark math meta meter object optgroup option output param picture progress q rp rt ruby s samp script select slot small source span strike strong style sub sup svg template textarea time track tt u var video wbr".split()
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style head noscript template ix:header ix:hidden".split())
LATEX_COMMANDS = "begin end section subsection subsubsection paragraph chapter part title author date item emph textbf textit texttt textsc textrm textsf underline footnote label ref cite citep citet caption includegraphics usepackage documentclass newcommand maketitle tableofcontents hline toprule midrule bottomrule centering noindent newline linebreak pagebreak href url frac sqrt sum int prod left right cdot times leq geq neq approx infty partial mathrm mathbf text operatorname alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega it bf em tt sc rm sf tiny small large Large quad qquad ldots dots par bigskip medskip smallskip hspace vspace".split()
SYMBOLS = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈", "cdot": "·", "times": "×", "pm": "±", "infty": "∞", "sum": "∑", "prod": "∏", "int": "∫", "partial": "∂", "ldots": "…", "dots": "…", "quad": " ", "qquad": " ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω"}

_TAG = re.compile(
    rf"<!--.*?-->|<!doctype[^<>]*>|<(?P<close>/?)(?P<name>(?:{'|'.join(sorted(BLOCK_TAGS + INLINE_TAGS, key=len, reverse=True))})|[a-z][\w-]*:[a-z][\w.-]*)(?P<rest>(?:\s[^<>]*)?/?)>", re.I | re.S
)
_REF = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^`\n]*\n(?P<body>.*?)^ {0,3}\1[ \t]*$", re.M | re.S)
_HEADING = re.compile(r"^ {0,3}#{1,6}[ \t]+(?=\S)(?P<t>[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_STRONG = re.compile(r"(?<![*\w\\])(\*{2,3})(?=[^\s*])(?P<t>[^*\n]*?[^\s*])\1(?![*\w])|(?<![\w\\_])(_{2,3})(?=[^\s_])(?P<u>[^\n]*?[^\s_])\3(?![\w_])")
_EMPHASIS = re.compile(r"(?<![*\w\\])\*(?=[^\s*])(?P<t>[^*\n]*?[^\s*])\*(?![*\w])|(?<![\w\\_])_(?=[^\s_])(?P<u>[^_\n]*?[^\s_])_(?![\w_])")
_CODE = re.compile(r"(?<![`\\])`(?=[^`\s])(?P<t>[^`\n]*?)`(?!`)")
_LINK = re.compile(r"!?\[(?P<t>[^\[\]\n]*)\]\((?:#[^()\s]*|(?:https?|ftp|mailto):[^()\s]*|[./][^()\s]*|[\w./-]+\.[A-Za-z]{2,5}[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$", re.M)
_STRIKE = re.compile(r"~~(?=\S)(?P<t>[^~\n]+?)~~")
_DASHES = re.compile(r"^[ \t]*[-+][ \t]+\S[^\n]*\n[ \t]*[-+][ \t]+(?=\S)", re.M)
_QUOTES = re.compile(r"^>[ \t]?(?=\S)[^\n]*\n>[ \t]?(?=\S)", re.M)

_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?(?P<t>[^\[\]|\n]+)\]\]")
_WIKI_FILE = re.compile(r"\[\[(?:file|image|category):[^\[\]\n]*\]\]", re.I)
_WIKI_BOLD = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])(?P<t>[^\n]*?[^'\s])\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*(?P<t>[^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_TEMPLATE = re.compile(r"\{\{[^{}\n]*(?:\n[^{}]*)?\}\}")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|(?P<body>.*?)^[ \t]*\|\}[ \t]*$", re.M | re.S)
_WIKI_TABLE_MARK = re.compile(r"^[ \t]*(?:\{\||\|\}[ \t]*$|\|-+[ \t]*$)", re.M)

_NAMES = "|".join(sorted(LATEX_COMMANDS, key=len, reverse=True))
_COMMAND = re.compile(rf"(?<![A-Za-z0-9:\\])\\(?:(?:{_NAMES})(?![A-Za-z])|[A-Za-z]+\*?(?=[\[{{])|[%&$#](?=[\s\w.,;:)]|$))|\w\\[%&](?!\w)")
_MATH = re.compile(r"\\\((?P<a>.+?)\\\)|\\\[(?P<b>.+?)\\\]|\$\$(?P<c>[^$]+?)\$\$|(?<![\w$\\])\$(?=[^\s$])(?P<d>[^$\n]*?[\\_^={}][^$\n]*?)(?<=[^\s\\])\$(?!\d)", re.S)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{(?P<n>[^{}\n]*)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")


#: Prices are no formulas: "$4 to $6" holds no sign of one that is not plain words.
_FORMULA = re.compile(r"\\[A-Za-z]|[_^]\{|\w[_^]\w|[A-Za-z]\s*=")


#: The elements of each language beside HTML, by the tag that stands for them in a path.
_ELEMENTS: dict[str, tuple[tuple[str, re.Pattern[str]], ...]] = {
    "markdown": (("heading", _HEADING), ("strong", _STRONG), ("emphasis", _EMPHASIS), ("code", _CODE), ("link", _LINK), ("table", _RULE_ROW), ("strike", _STRIKE), ("list", _DASHES), ("quote", _QUOTES)),
    "wiki": (("link", _WIKI_LINK), ("bold", _WIKI_BOLD), ("heading", _WIKI_HEADING), ("template", _TEMPLATE), ("table", _WIKI_TABLE_MARK)),
    "latex": (("command", _COMMAND),),
}
#: A sign without which a pattern cannot match, for the cheap patterns only.
_NEEDS = {_COMMAND: "\\", _TEMPLATE: "{{", _WIKI_LINK: "[[", _LINK: "](", _CODE: "`", _STRIKE: "~~"}

Paths = dict[str, list[float]]


def tag_paths(text: str) -> Paths:
    """Text length, punctuation and number of nodes of each path of the text.

    HTML paths are those of open tags; an element of another language is a leaf under
    the root, as is a character reference. Code blocks hold no elements.
    """
    paths: Paths = {}

    def add(path: str, held: str) -> None:
        row = paths.setdefault(path, [0, 0, 0])
        row[0] += len(held)
        row[1] += sum(map(held.count, ".,;:!?"))
        row[2] += 1

    if "<" in text:
        for path, held, _ in html_nodes(text)[1]:
            add(path, held)
    if "&" in text:
        for m in _REF.finditer(text):
            if m.group()[1] == "#" or m.group()[1:] in html.entities.html5:
                add("html:&", m.group())
    rest = text
    if "```" in text or "~~~" in text:
        for m in _FENCE.finditer(text):
            add("markdown:fence", m.group("body"))
        rest = _FENCE.sub("", text)
    for language, elements in _ELEMENTS.items():
        for tag, pattern in elements:
            if _NEEDS.get(pattern, "") in rest:
                for m in pattern.finditer(rest):
                    add(f"{language}:{tag}", m.group())
    if "$" in rest or "\\" in rest:
        for m in _MATH.finditer(rest):
            d = m.group("d")
            if d is None or _FORMULA.search(d):
                add("latex:formula", m.group())
    return paths


def languages_of(paths: Paths) -> list[str]:
    """The languages that the paths name."""
    named = {part.split(":", 1)[0] for path in paths for part in path.split("/") if part}
    return [x for x in LANGUAGES if x in named]


def detect(text: str) -> list[str]:
    """Markup languages of which the text holds an element or character reference."""
    return languages_of(tag_paths(text))


# ------------------------------------------------------------------------- HTML
#: Content whatever the ratio of their paths: headings, list items, cells and code.
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption pre title".split())
#: The smoothing reaches over that many nodes on either side.
REACH = 2
_KERNEL = [math.exp(-(d * d) / 2) for d in range(-REACH, REACH + 1)]


def content_nodes(nodes: list[tuple[str, str, bool]]) -> list[bool]:
    """Which nodes (path, text, within a link) are content, by tag-path ratios.

    The ratio of a path is its mean length of text outside of links times its mean
    punctuation. Every node
    takes its path's ratio; the ratios are smoothed with a Gaussian over the nodes in
    order, so a short node between long ones is content as they are, and a run of short
    ones without punctuation is none. The threshold is a share of the ratios' spread: a
    text of like nodes has none to drop. Structure with text of its own is content
    whatever its ratio.
    """
    stats: Paths = {}
    inked = [i for i, (_, t, _) in enumerate(nodes) if t.strip()]
    for i in inked:
        path, text, linked = nodes[i]
        row = stats.setdefault(path, [0, 0, 0])
        row[0] += 0 if linked else len(text.strip())
        row[1] += sum(map(text.count, ".,;:!?"))
        row[2] += 1
    ratio = {p: (n / k) * ((q + 0.5) / k) for p, (n, q, k) in stats.items()}
    own = [math.log1p(ratio[nodes[i][0]]) for i in inked]
    smooth = []
    for j in range(len(own)):
        near = [(own[j + d], _KERNEL[d + REACH]) for d in range(-REACH, REACH + 1) if 0 <= j + d < len(own)]
        smooth.append(sum(x * w for x, w in near) / sum(w for _, w in near))
    out = [True] * len(nodes)
    if smooth:
        mean = sum(smooth) / len(smooth)
        bar = min(mean, 2 * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))) if max(smooth) > 2 * min(smooth) else 0.0
        for j, i in enumerate(inked):
            path = nodes[i][0]
            leaf = path.rsplit(":", 1)[-1]
            out[i] = smooth[j] >= bar or path == "" or leaf in STRUCTURE and stats[path][0] > 0
    return out


def html_nodes(text: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, bool]]]:
    """(tokens: kind, value, node number; nodes: path of block tags, text, within a link)
    of a text's HTML. A tag, comment or declaration is a node of its own path; text in an inline
    element belongs to the block around it. Text outside of any tag has the path ''."""
    tokens: list[tuple[str, str, int]] = []
    nodes: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    last = 0

    def path(tag: str = "") -> str:
        return "/".join(f"html:{t}" for t in (*(x for x in stack if x in _BLOCK), tag) if t)

    def text_node(s: str) -> None:
        if s and not any(t in HIDDEN_TAGS for t in stack):
            tokens.append(("text", s if "pre" in stack else s.replace("\r", ""), len(nodes)))
            nodes.append((path(), s, "a" in stack))

    for m in _TAG.finditer(text):
        text_node(text[last : m.start()])
        last = m.end()
        name = (m.group("name") or "").lower()
        nodes.append((path(name or "!"), "", False))
        if not name:
            continue
        closing = bool(m.group("close"))
        if not closing:
            if name not in VOID_TAGS and not (m.group("rest") or "").endswith("/"):
                if name in ("p", "li", "tr", "td", "th", "option") and stack and stack[-1] == name:
                    stack.pop()
                stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
        tokens.append(("close" if closing else "open", name, -1))
    text_node(text[last:])
    return tokens, nodes


def _html(text: str, whole: bool = False) -> str:
    """The content nodes of a text's HTML as plain text; with ``whole`` all its nodes."""
    tokens, nodes = html_nodes(text)
    content = [True] * len(nodes) if whole else content_nodes(nodes)
    out: list[str] = []
    row: list[str] | None = None
    cell: list[str] | None = None

    def put(s: str) -> None:
        (cell if cell is not None else out).append(s)

    def line() -> None:
        target = cell if cell is not None else out
        if target and not "".join(target[-3:]).endswith("\n"):
            target.append("\n")

    for kind, value, where in tokens:
        if kind == "text":
            if content[where]:
                put(html.unescape(value) if cell is None else html.unescape(value).replace("\n", " "))
            continue
        opening = kind == "open"
        if value == "table":
            line()
            if not opening and row:
                out.append("\t".join(row) + "\n")
            row = cell = None
            out.append("[TABLE]\n" if opening else "[/TABLE]\n")
        elif value == "tr":
            if row is not None and any(x for x in row):
                out.append("\t".join(row) + "\n")
            row, cell = ([] if opening else None), None
        elif value in ("td", "th"):
            if opening:
                cell = []
            elif cell is not None:
                if row is None:
                    row = []
                row.append(" ".join("".join(cell).split()))
                cell = None
        elif value == "li":
            line()
            if opening:
                put("• ")
        elif value in ("br", "hr"):
            if opening and cell is None:
                line()
        elif value in _BLOCK:
            line()
    if cell:
        out.append("".join(cell))
    made = "".join(out)
    made = re.sub(r"(?<=\[TABLE\])\n(?:[ \t]*\n)+", "\n", made)
    return made


_BLOCK = frozenset(BLOCK_TAGS)


# ------------------------------------------------------------------------ others
def _formula(s: str) -> str:
    """A formula in plain signs, nothing of it lost."""
    s = re.sub(r"\\(?:left|right)\b", "", s)
    for _ in range(4):
        s = re.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", s)
        s = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"√(\1)", s)
        s = re.sub(r"\\(?:text|mathrm|mathbf|operatorname|mathit)\s*\{([^{}]*)\}", r"\1", s)
        s = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m.group(1) + (m.group(2) if re.fullmatch(r"\w*", m.group(2)) else f"({m.group(2)})"), s)
    s = re.sub(r"\\([A-Za-z]+)[ \t]?", lambda m: SYMBOLS.get(m.group(1), m.group(1)) + (" " if m.group(1) in ("leq", "le", "geq", "ge", "neq", "approx", "cdot", "times", "pm") and m.group().endswith(" ") else ""), s)
    s = re.sub(r"\\[,;:! ]", " ", s)
    return s.replace("\\", "").replace("{", "").replace("}", "").strip()


def _latex(text: str) -> str:
    def math_of(m: re.Match[str]) -> str:
        d = m.group("d")
        if d is not None and not _FORMULA.search(d):
            return m.group()
        return _formula(next(g for g in m.groups() if g is not None))

    if "$" in text or "\\" in text:
        text = _MATH.sub(math_of, text)
    if "\\" not in text:
        return text
    text = re.sub(r"^[ \t]*\\begin\{tabular\*?\}[^\n]*\n(?P<b>.*?)^[ \t]*\\end\{tabular\*?\}[ \t]*$", _tabular, text, flags=re.M | re.S)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}(?:\[[^\]\n]*\])?\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: m.group(1), text, flags=re.S)
    text = re.sub(rf"^[ \t]*{_ENVIRONMENT.pattern}[ \t]*\n", "", text, flags=re.M)
    text = _ENVIRONMENT.sub("", text)
    text = re.sub(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "• " + (m.group(1) + " " if m.group(1) else ""), text, flags=re.M)
    text = re.sub(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", text)
    text = re.sub(r"\\(?:label|ref|cite[pt]?|usepackage|documentclass|includegraphics|hspace|vspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    for _ in range(3):
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", text)
        text = re.sub(r"\{\\(?:it|bf|em|tt|sc|rm|sf|tiny|small|large|Large)\b[ \t]*([^{}\n]*)\}", r"\1", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    text = re.sub(rf"(?<![A-Za-z0-9:\\])\\({_NAMES})(?![A-Za-z])[ \t]?", lambda m: SYMBOLS.get(m.group(1), ""), text)
    return re.sub(r"\\\\[ \t]*$", "", text, flags=re.M)


def _tabular(m: re.Match[str]) -> str:
    rows = []
    for r in re.split(r"\\\\", m.group("b")):
        r = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", r).strip()
        if r:
            rows.append("\t".join(c.strip() for c in re.split(r"(?<!\\)&", r)))
    return "[TABLE]\n" + "\n".join(rows) + "\n[/TABLE]"


def _wiki(text: str) -> str:
    def table(m: re.Match[str]) -> str:
        rows: list[list[str]] = [[]]
        for k, ln in enumerate(m.group("body").split("\n")):
            s = ln.strip()
            if k == 0 or not s:
                continue  # attributes
            if s.startswith("|-"):
                rows.append([])
            elif s.startswith("|+"):
                rows[-1].append(s[2:].strip())
                rows.append([])
            elif s[0] in "!|":
                rows[-1] += [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|", "", c).strip() for c in re.split(r"!!|\|\|", s[1:])]
            elif rows[-1]:
                rows[-1][-1] += " " + s
        return "[TABLE]\n" + "\n".join("\t".join(r) for r in rows if r) + "\n[/TABLE]"

    text = _WIKI_TABLE.sub(table, text)
    text = _TEMPLATE.sub("", text)
    text = _WIKI_FILE.sub("", text)
    text = _WIKI_LINK.sub(lambda m: m.group("t"), text)
    text = _WIKI_HEADING.sub(lambda m: m.group("t"), text)
    for _ in range(2):
        text = _WIKI_BOLD.sub(lambda m: m.group("t"), text)
    return re.sub(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+)[ \t]*$\n?", "", text, flags=re.M)


def _markdown(text: str) -> str:
    def table(lines: list[str]) -> list[str]:
        cells = [[c.strip() for c in ln.strip().strip("|").split("|")] for ln in lines]
        return ["[TABLE]", *("\t".join(c) for c in cells), "[/TABLE]"]

    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if i + 1 < len(lines) and "|" in lines[i] and _RULE_ROW.match(lines[i + 1]):
            rows, i = [lines[i]], i + 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                rows.append(lines[i])
                i += 1
            out += table(rows)
        else:
            out.append(lines[i])
            i += 1
    text = "\n".join(out)
    listed = re.search(r"^[ \t]*[-+*][ \t]+(?:\*\*|__|_|\*|`|\[)(?=\S)", text, re.M) or _DASHES.search(text)
    text = _HEADING.sub(lambda m: m.group("t"), text)
    text = _LINK.sub(lambda m: m.group("t"), text)
    if listed:
        text = re.sub(r"^[ \t]*[-+][ \t]+(?=\S)|^[ \t]*\*[ \t]+(?=[*_`\[]\S)", "• ", text, flags=re.M)
    for p in (_STRONG, _EMPHASIS):
        text = p.sub(lambda m: m.group("t") if m.group("t") is not None else m.group("u"), text)
    text = _STRIKE.sub(lambda m: m.group("t"), text)
    if _QUOTES.search(text):
        text = re.sub(r"^>[ \t]?(?=\S)", "", text, flags=re.M)
    return text


def page(path: str | None) -> bool:
    """May a file be a page with parts that are no content? Unknown endings may."""
    ending = (path or "").rpartition(".")[2].lower()
    return ending not in ("md", "markdown", "tex", "txt", "wiki")


def clean(text: str, path: str | None = None) -> tuple[str, list[str]]:
    """(clean text, languages found). A text without markup comes back as it is.

    ``path``, the file the text was taken from, is a hint: what HTML there is in a file
    of another kind is content as a whole.
    """
    found = detect(text)
    if not found:
        return text, found
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x02{len(kept) - 1}\x03"

    made = text.replace("\x02", "").replace("\x03", "")
    if "markdown" in found:
        made = _FENCE.sub(lambda m: keep(m.group("body").rstrip("\n")), made)
        made = _CODE.sub(lambda m: keep(m.group("t")), made)
    if "html" in found:
        made = re.sub(r"(<(?:pre|code)\b[^<>]*>)(.*?)(</(?:pre|code)>)", lambda m: m.group(1) + keep(html.unescape(_TAG.sub("", m.group(2)))) + m.group(3), made, flags=re.S | re.I)
        made = _html(made, not page(path))
    for name, step in (("latex", _latex), ("wiki", _wiki), ("markdown", _markdown)):
        if name in found:
            made = step(made)
    made = re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m.group(1))], made)
    return re.sub(r"\n{3,}", "\n\n", made), found


#: What every element of the four languages holds at least one of; a superset of detect().
#: The four letters beside A-Z are those that Python takes for ASCII ones without case.
_HINT = r"<[A-Za-z/!İıſK]|&[A-Za-z#][A-Za-z0-9]*;|[*_`#\\]|~~|\]\(|\[\[|''|==|\{[{|]|\|[-}]|-{3}|\$[^ 0-9]|\$[0-9][^$\n=^]*+[=^][^$\n]*+\$|(?m)^[ \t]*[-+>]"


def hinted(c: Column) -> Column:
    """Cheap JVM test that leaves out most texts without markup."""
    return F.coalesce(c.rlike(_HINT), F.lit(False))


def strip_markup(df: DataFrame, keys: list[str], text: str, only_marked: bool = False, with_text: bool = True, path: str | None = None) -> DataFrame:
    """One row per row of ``df``: keys, ``languages`` (array, empty without markup)
    and, with ``with_text``, ``clean_text``.

    Null stays null with no language; an empty text stays empty. With
    ``only_marked`` rows without markup are left out. ``path`` is the column of the
    file's path, a hint (see ``clean``). Extra columns are ignored.
    """
    base = keyed(df, keys, _t=text, **({"_path": path} if path else {}))
    schema = schema_of(df, keys, "languages array<string>" + ", clean_text string" * with_text)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width).to_pylist()
            files = batch.column(width + 1).to_pylist() if path else [None] * len(texts)
            made = [clean(t, f) if with_text else (None, detect(t)) for t, f in zip(texts, files)]
            keep = pa.array([i for i, m in enumerate(made) if m[1] or not only_marked], pa.int64())
            made = [m for m in made if m[1] or not only_marked]
            cols = [pa.array([m[1] for m in made], pa.list_(pa.string()))] + [pa.array([m[0] for m in made], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(width)] + cols, names=schema.names)

    out = base.where(hinted(F.col("_t"))).mapInArrow(run, schema)
    if not only_marked:
        rest = base.where(~hinted(F.col("_t"))).select(*[f"_k{i}" for i in range(width)], F.array().cast("array<string>").alias("languages"), *[F.col("_t").alias("clean_text")] * with_text)
        out = out.unionByName(rest)
    return unkeyed(out, keys)
