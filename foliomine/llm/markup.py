"""Problem 3: texts with HTML, Markdown, wiki or LaTeX markup as clean text and cells.

A text is parsed into one tree whatever the mixture of markups: containers, headings, lists, code, formulas, tables;
every node knows the markups that were undone in it.  The leaves pass points for their length and commas to their
ancestors, less with each level, and the container with the best score after its link text is discounted is kept.
On the way down to it the siblings are judged by their own score against the best one (``SIBLING_SHARE``): sentences,
headings, lists, tables, code and formulas stay, low-scoring containers of short scraps and blocks of links go, and so does page
furniture.  Inside the best container only furniture and nested blocks of links go.  A text of one level has nothing
beside its best container and is kept whole, however short it is.

The clean text is what is kept, as blocks with a kind (``heading``, ``paragraph``, ``item``, ``code``, ``formula``,
``row``); the markups reported are those of the kept nodes, and of each block that goes the markup it is made of.

The pipes and the ruler of a pipe table are the text's own form.  Null texts have no markup and no blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map

#: What sends a text to the parser, for the scan; a text without any of it holds no markup.
SUSPECT = r"</?[A-Za-z!]|&#?[A-Za-z0-9]+;|(?:^|[^\w*])\*{1,3}[^\s*]|(?:^|\W)_{1,3}[^\s_]|~~|`|\]\(|\[\^|(?m:^\s*(?:#{1,6} |>|[-*+] \S))|\[\[|\{\{|''|(?m:^==)|\{\||(?m:^\|-\s*$)|\[(?:https?|ftp):|\\[A-Za-z\[\](){},%&$#_]|\\\\|\$\S"

#: Element names, by what they are in a tree.
CONTAINERS = frozenset("html body div section article main header footer nav aside form center table tbody thead tfoot ul ol dl figure blockquote".split())
LEAVES = frozenset("p li dt dd td th caption figcaption h1 h2 h3 h4 h5 h6 pre title".split())
ROWS = frozenset(["tr"])
INLINE = frozenset("a abbr b big br cite code del em font hr i img ins kbd mark q s small span strike strong sub sup tt u var wbr time label input button iframe script style noscript meta link".split())
VOID = frozenset("br hr img input meta link wbr".split())
FURNITURE = frozenset("nav footer aside form script style".split())
#: LaTeX commands and what they stand for.
LATEX_SIGNS = {"geq": "≥", "ge": "≥", "leq": "≤", "le": "≤", "times": "×", "pm": "±", "mu": "µ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "kappa": "κ", "lambda": "λ", "sigma": "σ", "approx": "≈", "neq": "≠", "cdot": "·", "infty": "∞", "degree": "°", "percent": "%", "to": "→", "rightarrow": "→", "sum": "∑", "milli": "m", "micro": "µ", "kilo": "k", "centi": "c", "gram": "g", "metre": "m", "meter": "m", "litre": "L", "liter": "L", "second": "s", "hertz": "Hz", "decibel": "dB"}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*((?:[^\[\]|]|\[[^\[\]]*\])*)\]\](?!\()")
_WIKI_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_WIKI_QUOTES = re.compile(r"(?<!')('{2,5})(?=[^'\s])([^'\n](?:[^'\n]|'(?!'))*?)(?<=\S)\1(?!')")
_WIKI_URL = re.compile(r"\[(?:https?|ftp)://[^\s\]]+\s+((?:[^\[\]]|\[[^\[\]]*\])*)\]")
_WIKI_HEAD = re.compile(r"\s*(={2,6})\s*(\S.*?)\s*\1\s*")
_MATH_MARK = re.compile(r"\\[\[\]()]|\$\$|(?<!\\)\$")
_MATH_SIGN = re.compile(r"[\\^_{}]")
_LATEX_UNIT = re.compile(r"\\(?:SI|qty)\{([^{}]*)\}\{([^{}]*)\}")
_LATEX_REF = re.compile(r"\s*\\(?:cite[a-z]*|ref|label|eqref)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_LATEX_NOTE = re.compile(r"\\footnote\{([^{}]*)\}")
_LATEX_WRAP = re.compile(r"\\(?:[a-zA-Z]+)\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_LATEX_SPACE = re.compile(r"\\[,;:!](?=\s|\w|$)")
_LATEX_ESCAPE = re.compile(r"\\([%&$#_{}])")
_LATEX_ROW = re.compile(r"(.*?)\s*\\\\(?:\[[^\]]*\])?\s*(?:\\hline|\\toprule|\\midrule|\\bottomrule)?\s*")
_LATEX_HEAD = re.compile(r"\s*\\((?:sub){0,2}section|chapter|paragraph|title)\*?\{([^{}]*)\}\s*")
_MD_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)(\S|\S.*?\S)(?<!`)\1(?!`)")
_MD_IMAGE = re.compile(r"!\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_MD_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_MD_NOTE = re.compile(r"\[\^[^\[\]\s]+\](?::)?")
_MD_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~")
_MD_RUN = {"*": re.compile(r"\*+"), "_": re.compile(r"_+")}
_MD_HEAD = re.compile(r"\s{0,3}(#{1,6})\s+(\S.*?)\s*#*\s*")
_MD_QUOTE = re.compile(r"\s{0,3}>\s?(.*)")
_MD_TASK = re.compile(r"\s*[-*+]\s+\[([ xX])\]\s+(.*)")
_MD_ITEM = re.compile(r"\s*[-*+]\s+(\S.*)")
_PAGE_LINE = re.compile(r"\s*[-–—]\s*\d+\s*[-–—]\s*")
_RULER = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*")


#: Containers nested deeper than this are one level, so a tree stays walkable whatever the text.
MAX_DEPTH = 100
#: A block with a greater share of link text is navigation.
LINK_SHARE = 0.6
#: A leaf of fewer characters has no points.
SCRAP = 25
#: A container beside the best one stays with this share of its score.
SIBLING_SHARE = 0.2


class Node:
    """A node of the tree: its kind, own text, children, the markups undone in it, how much of its text is link text."""

    __slots__ = ("kind", "text", "children", "links", "level", "kinds", "size", "linked", "points", "score")

    def __init__(self, kind: str, text: str = "", links: int = 0, level: int = 0) -> None:
        self.kind, self.text, self.links, self.level = kind, text, links, level
        self.children: list[Node] = []
        self.kinds: set[str] = set()
        self.size = self.linked = 0
        self.points = self.score = 0.0

    def add(self, node: Node) -> Node:
        self.children.append(node)
        return node


def undo_math(text: str, by) -> tuple[str, int]:
    """Replace each formula between its delimiters, of any length, in one pass; and their number."""
    marks = list(_MATH_MARK.finditer(text))
    # the next closing delimiter of each form, from the end
    following: list[dict[str, int]] = [{}] * len(marks)
    nearest: dict[str, int] = {}
    for k in range(len(marks) - 1, -1, -1):
        following[k] = nearest
        if marks[k].group() in ("\\]", "\\)", "$$"):
            nearest = nearest | {marks[k].group(): k}
    out, at, k, n = [], 0, 0, 0
    while k < len(marks):
        m, close, source = marks[k], None, ""
        form = {"\\[": "\\]", "\\(": "\\)", "$$": "$$"}.get(m.group())
        if form and form in following[k]:
            close = following[k][form]
        elif m.group() == "$" and k + 1 < len(marks) and marks[k + 1].group() == "$" and (m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_$")):
            end = marks[k + 1]
            inside = text[m.end() : end.start()]
            after = text[end.end() : end.end() + 1]
            if inside and not inside[0].isspace() and not inside[-1].isspace() and "\n" not in inside and _MATH_SIGN.search(inside) and not (after.isalnum() or after in ("_", "$") and after):
                close = k + 1
        if close is None or not text[m.end() : marks[close].start()]:
            k += 1
            continue
        source = text[m.end() : marks[close].start()]
        out += [text[at : m.start()], by(source)]
        at, k, n = marks[close].end(), close + 1, n + 1
    return "".join([*out, text[at:]]), n


def undo_emphasis(text: str, sign: str) -> tuple[str, int]:
    """Take away pairs of runs of one to three signs around a passage of a line, of any length; and their number.

    An opening run stands after no letter and before no space, a closing one after no space and before no letter.
    """
    runs = []
    for m in _MD_RUN[sign].finditer(text):
        if len(m.group()) <= 3:
            before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
            word = lambda c: c.isalnum() or c == "_"
            opens = not (before and (word(before) or (sign == "_" and before == "\\"))) and bool(after) and not after.isspace()
            closes = bool(before) and not before.isspace() and not (after and word(after))
            runs.append((m.start(), m.end(), opens, closes))
    opened: dict[int, tuple[int, int]] = {}
    gone, line_end = [], -1
    for start, end, opens, closes in runs:
        if start > line_end:
            opened.clear()
            line_end = text.find("\n", start)
            line_end = len(text) if line_end < 0 else line_end
        n = end - start
        # a closing run may begin with signs of its own text: the longest opened run that fits is closed
        fits = max((k for k, (_, b) in opened.items() if k <= n and b < start), default=0) if closes else 0
        if fits:
            gone += [opened.pop(fits), (start, start + fits)]
        elif opens and n not in opened:
            opened[n] = (start, end)
    out, at = [], 0
    for start, end in sorted(gone):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]]), len(gone) // 2


def formula(source: str) -> str:
    """A formula in plain signs."""
    out = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", source)
    out = _LATEX_UNIT.sub(r"\1 \2", out)
    out = re.sub(r"\\([a-zA-Z]+)", lambda m: LATEX_SIGNS.get(m.group(1), m.group(1)), out)
    out = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m.group(1) + m.group(2), out)
    return re.sub(r"\s+", " ", _LATEX_SPACE.sub(" ", out).replace("\\\\", " ").replace("{", "").replace("}", "")).strip()


def _unit(m: re.Match) -> str:
    unit = "".join(LATEX_SIGNS.get(x, x) for x in re.findall(r"[A-Za-zµ°%]+", m.group(2)))
    return f"{m.group(1)} {unit}"


class Parser:
    """Parses one text; ``root`` is the tree, ``kinds`` all markups met, wherever they stand."""

    def __init__(self, text: str, pipes: bool) -> None:
        self.kinds: set[str] = set()
        self._met: set[str] = set()
        self.root = Node("container")
        self.pipes = pipes
        self.stack = [self.root]
        self._parse(text)
        self.root.kinds |= self._take()

    def _note(self, kind: str) -> None:
        self.kinds.add(kind)
        self._met.add(kind)

    def _take(self) -> set[str]:
        """The markups met since the last node; they are the next node's."""
        met, self._met = self._met, set()
        return met

    def _new(self, node: Node) -> Node:
        node.kinds |= self._take()
        return self.stack[-1].add(node)

    # -- inline ---------------------------------------------------------------------------------------------------
    def _sub(self, kind: str, pattern: re.Pattern, by, text: str) -> str:
        out, n = pattern.subn(by, text)
        if n:
            self._note(kind)
        return out

    def _emphasis(self, text: str, sign: str) -> str:
        text, n = undo_emphasis(text, sign)
        if n:
            self._note("markdown")
        return text

    def spans(self, text: str) -> str:
        """What may hold a pipe: done before a row is cut into cells."""
        if "<" in text:
            text = self._sub("html", _COMMENT, "", text)
        if "{{" in text:
            text = self._sub("wiki", _WIKI_TEMPLATE, lambda m: self._template(m.group(1)), text)
        if "[[" in text:
            text = self._sub("wiki", _WIKI_LINK, r"\1", text)
        if "$" in text or "\\" in text:
            text, n = undo_math(text, formula)
            if n:
                self._note("latex")
        return text

    @staticmethod
    def _template(body: str) -> str:
        parts = [p.strip() for p in body.split("|")]
        if len(parts) < 2:
            return parts[0]
        return " ".join(parts[1:]) if parts[0].lower() in ("unit", "convert", "val") else parts[1]

    def inline(self, text: str) -> tuple[str, int]:
        """Plain text and the number of its characters that were link text."""
        links = 0
        if "<" in text:

            def tag(m: re.Match) -> str:
                name = m.group(2).lower()
                if name not in INLINE and name not in LEAVES and name not in CONTAINERS and name not in ROWS:
                    return m.group(0)
                self._note("html")
                return " " if name in ("br", "hr", "p", "div", "li", "td", "th") else ""

            for m in re.finditer(r"<a\b[^<>]*>(.*?)</a>", text, re.I | re.S):
                links += len(m.group(1))
            text = _TAG.sub(tag, text)
        if "&" in text:

            def entity(m: re.Match) -> str:
                plain = html.unescape(m.group(0))
                if plain == m.group(0):
                    return plain
                self._note("html")
                return plain.replace("\xa0", " ")

            text = _ENTITY.sub(entity, text)
        if "[" in text:

            def link(m: re.Match) -> str:
                nonlocal links
                links += len(m.group(1))
                return m.group(1)

            text = self._sub("wiki", _WIKI_URL, link, text)
            text = self._sub("markdown", _MD_IMAGE, r"\1", text)
            text = self._sub("markdown", _MD_LINK, link, text)
            text = self._sub("markdown", _MD_NOTE, "", text)
        if "''" in text:
            text = self._sub("wiki", _WIKI_QUOTES, r"\2", text)
        if "`" in text:
            text = self._sub("markdown", _MD_CODE, r"\2", text)
        if "~~" in text:
            text = self._sub("markdown", _MD_STRIKE, r"\1", text)
        if "*" in text:
            text = self._emphasis(text, "*")
        if "_" in text:
            text = self._emphasis(text, "_")
        if "\\" in text:
            text = self._sub("latex", _LATEX_UNIT, _unit, text)
            text = self._sub("latex", _LATEX_REF, "", text)
            text = self._sub("latex", _LATEX_NOTE, r" (\1)", text)
            before = None
            while before != text:
                before = text
                text = self._sub("latex", _LATEX_WRAP, r"\1", text)
            text = self._sub("latex", _LATEX_SPACE, " ", text)
            text = self._sub("latex", _LATEX_ESCAPE, r"\1", text)
        return re.sub(r"[ \t]+", " ", text).strip(), links

    def leaf(self, kind: str, text: str, level: int = 0) -> None:
        plain, links = self.inline(self.spans(text))
        if plain:
            self._new(Node(kind, plain, links, level))
        else:
            self.stack[-1].kinds |= self._take()

    # -- blocks ---------------------------------------------------------------------------------------------------
    def _parse(self, text: str) -> None:
        lines = _COMMENT.sub(self._comment, text).split("\n")
        i, wiki, tabular, environments = 0, False, False, 0
        while i < len(lines):
            line = lines[i]
            i += 1
            s = line.strip()
            if not s:
                continue
            if s.startswith("```") or s.startswith("~~~"):
                self._note("markdown")
                body = []
                while i < len(lines) and lines[i].strip()[:3] != s[:3]:
                    body.append(lines[i])
                    i += 1
                i += 1
                self._new(Node("code", "\n".join(body)))
            elif s.startswith("{|"):
                wiki = True
                self._note("wiki")
                self.stack.append(self._new(Node("table")))
            elif wiki and s.startswith("|}"):
                wiki = False
                self.stack.pop()
            elif wiki and (s.startswith("|-") or s.startswith("|+")):
                continue
            elif wiki and s[0] in "|!":
                self._row(re.split(r"\|\||!!", self.spans(s[1:])))
            elif m := re.match(r"\\begin\{([a-z*]+)\}", s):
                self._note("latex")
                if m.group(1).rstrip("*") in ("equation", "align", "math", "displaymath", "gather", "eqnarray"):
                    body = []
                    while i < len(lines) and not lines[i].strip().startswith("\\end{"):
                        body.append(lines[i])
                        i += 1
                    self._new(Node("formula", formula(" ".join(body))))
                elif m.group(1).rstrip("*") in ("verbatim", "lstlisting"):
                    body = []
                    while i < len(lines) and not lines[i].strip().startswith("\\end{"):
                        body.append(lines[i])
                        i += 1
                    self._new(Node("code", "\n".join(body)))
                else:
                    tabular = m.group(1).startswith("tab")
                    environments += 1
                    if len(self.stack) < MAX_DEPTH:
                        self.stack.append(self._new(Node("table" if tabular else "container")))
            elif s.startswith("\\end{"):
                self._note("latex")
                tabular = False
                if len(self.stack) > 1 and environments <= len(self.stack) - 1:
                    self.stack.pop()
                environments = max(0, environments - 1)
            elif tabular and (m := _LATEX_ROW.fullmatch(s)):
                self._row(re.split(r"(?<!\\)&", self.spans(m.group(1))))
            elif tabular and re.fullmatch(r"\\[a-z]+", s):
                continue
            elif re.match(r"\\item\b", s):
                self._note("latex")
                self.leaf("item", s[5:])
            elif (s.startswith("\\[") or s.startswith("$$")) and (s.endswith("\\]") or s.endswith("$$")) and len(s) > 4:
                self._note("latex")
                self._new(Node("formula", formula(s[2:-2])))
            elif m := _LATEX_HEAD.fullmatch(s):
                self._note("latex")
                self.leaf("heading", m.group(2), 1)
            elif self.pipes and s.startswith("|"):
                if not _RULER.fullmatch(s):
                    cells = self.spans(s).strip().strip("|")
                    target = self.stack[-1]
                    if not target.children or target.children[-1].kind != "table":
                        target.add(Node("table"))
                    self.stack.append(target.children[-1])
                    self._row(re.split(r"(?<!\\)\|", cells))
                    self.stack.pop()
            elif (m := _WIKI_HEAD.fullmatch(s)) and not re.fullmatch(r"=+", s):
                self._note("wiki")
                self.leaf("heading", m.group(2), len(m.group(1)))
            elif m := _MD_HEAD.fullmatch(line):
                self._note("markdown")
                self.leaf("heading", m.group(2), len(m.group(1)))
            elif m := _MD_TASK.fullmatch(line):
                self._note("markdown")
                self.leaf("item", ("[x] " if m.group(1) in "xX" else "[ ] ") + m.group(2))
            elif (m := _MD_QUOTE.fullmatch(line)) and self.pipes:
                self._note("markdown")
                self.leaf("paragraph", m.group(1))
            elif (m := _MD_ITEM.fullmatch(line)) and not _PAGE_LINE.fullmatch(line) and self.pipes:
                self._note("markdown")
                self.leaf("item", m.group(1))
            elif _TAG.search(line) and any(t.group(2).lower() in CONTAINERS | LEAVES | ROWS for t in _TAG.finditer(line)):
                i = self._html(lines, i - 1)
            else:
                self.leaf("paragraph", line)

    def _comment(self, m: re.Match) -> str:
        self._note("html")
        return ""

    def _row(self, cells: list[str]) -> None:
        row = self._new(Node("row"))
        for cell in cells:
            plain, links = self.inline(cell)
            row.add(Node("cell", plain, links)).kinds = self._take()

    def _html(self, lines: list[str], start: int) -> int:
        """Elements from a line on, until all are closed or the text ends; text between them becomes leaves."""
        source, at, opened = "\n".join(lines[start:]), 0, []
        last_p = source.lower().rfind("</p")
        base = len(self.stack)
        kind, buffer = "paragraph", ""

        def flush() -> None:
            nonlocal buffer
            if buffer.strip():
                if self.stack[-1].kind == "row":
                    self.leaf("cell", buffer.replace("\n", " "))
                elif kind == "code":
                    self._new(Node("code", html.unescape(_TAG.sub("", buffer))))
                else:
                    for part in buffer.split("\n"):
                        self.leaf(kind, part, level)
            elif kind == "cell" and self.stack[-1].kind == "row":
                self._new(Node("cell"))
            buffer = ""

        level, hidden = 0, ""
        for m in _TAG.finditer(source):
            name = m.group(2).lower()
            if hidden:
                if m.group(1) and name == hidden:
                    hidden, at = "", m.end()
                continue
            if name in ("script", "style"):
                buffer += source[at : m.start()]
                hidden, at = ("" if m.group(1) else name), m.end()
                self._note("html")
                continue
            if name not in CONTAINERS and name not in LEAVES and name not in ROWS:
                continue
            self._note("html")
            gap = source[at : m.start()]
            if not opened and "\n" in gap:
                # all closed: the rest of the text is for the lines to tell
                buffer += gap.split("\n", 1)[0]
                flush()
                return start + source[: at + gap.index("\n")].count("\n") + 1
            buffer += gap
            at = m.end()
            if m.group(1):
                flush()
                self.stack[-1].kinds |= self._take()
                kind = "paragraph"
                if any(n == name for n, _ in opened):
                    while opened:
                        last, pushed = opened.pop()
                        if pushed:
                            self.stack.pop()
                        if last == name:
                            break
                continue
            flush()
            kind = "paragraph"
            if name in CONTAINERS or name in ROWS:
                pushed = len(self.stack) < MAX_DEPTH
                opened.append((name, pushed))
                if not pushed:
                    continue
                self.stack.append(self._new(Node("row" if name in ROWS else "table" if name == "table" else "furniture" if name in FURNITURE else "list" if name in ("ul", "ol", "dl") else "container")))
            elif name in LEAVES and not m.group(4):
                if name in ("p", "li", "td", "th", "dt", "dd") and opened and opened[-1][0] == name:
                    opened.pop()
                # an unclosed <p> in a line of its own would swallow the text after it
                if name != "p" or last_p > at:
                    opened.append((name, False))
                kind = {"li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "pre": "code"}.get(name, "heading" if name[0] == "h" or name == "title" else "paragraph")
                level = int(name[1]) if name[0] == "h" and name[1:].isdigit() else 1 if kind == "heading" else 0
        rest = source[at:]
        if not opened and "\n" in rest:
            buffer += rest.split("\n", 1)[0]
            flush()
            del self.stack[base:]
            return start + source[: at + rest.index("\n")].count("\n") + 1
        buffer += rest
        flush()
        del self.stack[base:]
        return len(lines)


def score(root: Node) -> list[Node]:
    """Pass the leaves' points up and return the way from the root to the container with the best score.

    A leaf of ``SCRAP`` characters has a point, one for each comma and one for each 100 characters up to three; its parent takes them whole, the
    next one half, the further ones a third by level.  Ties go to the outer, earlier container.
    """
    best, way = -1.0, [root]
    trail: list[Node] = []

    def measure(node: Node) -> None:
        node.size, node.linked, node.points = len(node.text), node.links, 0.0
        trail.append(node)
        if node.text:
            points = 0 if len(node.text) < SCRAP else 1 + node.text.count(",") + min(len(node.text) // 100, 3)
            for up, ancestor in enumerate(reversed(trail[:-1])):
                ancestor.points += points / (1 if up == 0 else 2 if up == 1 else 3 * up)
        for child in node.children:
            measure(child)
            node.size += child.size
            node.linked += child.linked
        trail.pop()

    def choose(node: Node) -> None:
        nonlocal best, way
        trail.append(node)
        node.score = node.points * (1 - node.linked / (node.size or 1))
        if node.children and node.kind in ("container", "table", "list") and node.score > best:
            best, way = node.score, list(trail)
        for child in node.children:
            choose(child)
        trail.pop()

    measure(root)
    choose(root)
    return way


def _says(node: Node) -> bool:
    """Whether a node holds anything that is more than scraps: a sentence, or a structure that is kept."""
    if node.kind in ("heading", "code", "formula", "row") or (node.kind == "item" and not node.links):
        return True
    if node.text and node.links <= 0.25 * len(node.text) and (len(node.text) >= 80 or node.text.rstrip()[-1:] in ".!?:"):
        return True
    return any(_says(child) for child in node.children)


def left_out(root: Node) -> set[int]:
    """Ids of the nodes that go: furniture, blocks of links, and low-scoring containers beside the best one."""
    way = score(root)
    top = way[-1]
    on_way = {id(node) for node in way}
    out: set[int] = set()

    def walk(node: Node, beside: bool) -> None:
        for child in node.children:
            if child.kind == "furniture":
                out.add(id(child))
            elif id(child) in on_way:
                walk(child, child is not top)
            elif child.kind not in ("heading", "code", "formula", "row", "table"):
                links = child.linked > LINK_SHARE * (child.size or 1)
                if links and (beside or child.children):
                    out.add(id(child))
                elif beside and node is not top and child.children and child.score < SIBLING_SHARE * top.score and not _says(child):
                    out.add(id(child))
                else:
                    walk(child, False)

    walk(root, True)
    return out


def markups(root: Node) -> set[str]:
    """The markups of what is kept, and of each block that goes the markup it is made of."""
    gone = left_out(root)
    out: set[str] = set()

    def walk(node: Node) -> None:
        out.update(node.kinds)
        if id(node) not in gone:
            for child in node.children:
                walk(child)

    walk(root)
    return out


def blocks(root: Node) -> list[dict]:
    """What is kept as blocks in order of reading; a text that is nothing but links keeps them."""
    gone = left_out(root)
    out: list[dict] = []

    def emit(node: Node) -> None:
        if node.kind == "furniture" or id(node) in gone:
            return
        if node.kind == "row":
            cells = [c.text for c in node.children]
            out.append({"kind": "row", "level": 0, "text": " | ".join(cells), "cells": cells})
        elif node.kind in ("heading", "paragraph", "item", "code", "formula", "cell"):
            out.append({"kind": "paragraph" if node.kind == "cell" else node.kind, "level": node.level, "text": node.text, "cells": []})
        else:
            for child in node.children:
                emit(child)

    emit(root)
    if not out:
        gone = set()
        emit(root)
    return out


#: How a block shows in the clean text.
SHOWN = {"heading": "\n{}\n", "item": "• {}", "code": "    {}", "formula": "  {}", "row": "| {} |", "paragraph": "{}"}


def rendered(parts: list[dict]) -> str:
    return "\n".join(SHOWN[p["kind"]].format(p["text"].replace("\n", "\n    ") if p["kind"] == "code" else p["text"]) for p in parts).strip("\n")


def markup_found(df: DataFrame, row: str, text: str, pipes: bool) -> DataFrame:
    """``rec_id, markup``: one row per text and markup in it."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b["rec_id"], b["text"], strict=True):
                for kind in sorted(markups(Parser(t, pipes).root)):
                    ids.append(i)
                    kinds.append(kind)
            yield {"rec_id": ids, "markup": kinds}

    narrow = df.select(F.col(row).cast("long").alias("rec_id"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT))
    return arrow_map(narrow, kernel, "rec_id long, markup string")


def clean_texts(df: DataFrame, row: str, text: str, pipes: bool) -> DataFrame:
    """``rec_id, text, blocks``: clean text and its blocks; null texts have a null text and no blocks."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            parts = [[] if t is None else blocks(Parser(t, pipes).root) for t in b["text"]]
            yield {"rec_id": b["rec_id"], "text": [None if t is None else rendered(p) for t, p in zip(b["text"], parts, strict=True)], "blocks": parts}

    narrow = df.select(F.col(row).cast("long").alias("rec_id"), F.col(text).alias("text"))
    return arrow_map(narrow, kernel, "rec_id long, text string, blocks array<struct<kind:string,level:int,text:string,cells:array<string>>>")
