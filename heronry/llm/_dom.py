"""Reads a text with HTML, Markdown, wiki or LaTeX markup into blocks with a path, and writes blocks as plain text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_TAGS = "a|abbr|address|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|dd|del|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|sup|svg|table|tbody|td|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|wbr"
TAG = re.compile(rf"<!--|<!doctype\b|</?(?:{_TAGS})(?=[\s/>]|$)[^<>]*(?:>|$)", re.I)
_ATTRS = r"(?:\s+[a-zA-Z_:@][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*"
#: A tag that nothing closes: only its own name is markup, what follows is text.
_BROKEN = re.compile(rf"</?(?:{_TAGS})(?=[\s/>]|$)(?!{_ATTRS}\s*/?>)|<!--(?!.*?-->)", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)
_ESCAPED = re.compile(rf"&(?:amp;)*lt;(?:!--|/?(?:{_TAGS})\b)", re.I)

_COMMANDS = "begin|end|item|part|chapter|section|subsection|subsubsection|paragraph|textbf|textit|textsc|emph|underline|texttt|textrm|footnote|ref|label|cite|href|url|caption|includegraphics|documentclass|usepackage|title|author|date|maketitle|newline|newpage|noindent|centering|hline|frac|sqrt|sum|prod|int|alpha|beta|gamma|delta|lambda|mu|sigma|leq|geq|neq|log|cdot|times|infty|ldots|textbackslash|verb|bf|it|large|small|quad|hspace|vspace"
_MATH = r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$((?=[^$\n]*[\\^_{}])[^$\n]+)\$(?!\w)"
LATEX = re.compile(rf"\\(?:{_COMMANDS})(?![a-zA-Z])\*?|\\[&%$#](?=\W|\d|$)|{_MATH}", re.S)
_MAGIC = r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|FORCETOC|GALLERY)__"
WIKI = re.compile(rf"^\s*(={{1,6}})[^=\n]+\1\s*$|(?<!')'{{2,5}}(?!')[^'\n]+(?:'[^'\n]+)*'{{2,5}}(?!')|\[\[[^\]\n]+\]\]|\{{\{{[^{{}}]+\}}\}}|^\{{\|.*$|^\|\}}|(?<!\w)\[(?:https?|ftp|mailto):\S+[^\]\n]*\](?!\()|{_MAGIC}", re.M)
MARKDOWN = re.compile(
    r"^ {0,3}#{1,6}[ \t]+\S|(?<![*\\])\*{2,3}(?=[^\s*])[^*\n]*[^\s*]\*{2,3}(?!\*)|(?<![\w\\])(?!__[A-Z]+__)__(?=\S)[^_\n]+__(?!\w)|!?\[[^\]\n]+\]\((?!\s)[^()\n]*\)|^ {0,3}(?:```|~~~)|(?<!`)`[^`\n]+`(?!`)|^ {0,3}> ?\S"
    r"|^ {0,3}\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+|^[^\n]*\S[^\n]*\n {0,3}(?:-{3,}|={3,})[ \t]*$|\[[^\]\n]+\]\[[^\]\n]*\]|^ {0,3}\[[^\]\n]+\]:\s+\S+|~~[^~\n]+~~|(?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])",
    re.M,
)


@dataclass
class Block:
    kind: str  # heading, para, item, code, formula, row
    text: str
    path: str
    mark: str = ""  # an item's number
    level: int = 0


@dataclass
class Read:
    blocks: list[Block] = field(default_factory=list)
    markup: set[str] = field(default_factory=set)


_BLOCK_TAGS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table pre blockquote section article header footer nav aside main hr dl dt dd form figure body".split())
_SILENT = frozenset("script style head noscript template svg".split())
_VOID = frozenset("br img hr input meta link col wbr".split())


class _Tree(HTMLParser):
    """Blocks of an HTML text; missing and misplaced end tags are tolerated."""

    def __init__(self, out: Read):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.buf, self.lists, self.cells, self.silent = out, [], [], [], None, 0
        self.said: list[str] = []  # the leaf's text without code, a blank for each tag

    def leaf(self) -> None:
        """What stood in the leaf that ends here tells its kinds of markup."""
        self.out.markup |= kinds("".join(self.said))
        self.said = []

    def flush(self, kind: str | None = None) -> None:
        text = "".join(self.buf)
        self.buf = []
        self.leaf()
        if not text.strip():
            return
        path = "/".join(t for t in self.stack if t in _BLOCK_TAGS)
        if "pre" in self.stack:
            self.out.blocks.append(Block("code", text.strip("\n"), path))
            return
        head = next((t for t in reversed(self.stack) if re.fullmatch(r"h[1-6]", t)), None)
        if head:
            self.out.blocks.append(Block("heading", _one_line(text), path, level=int(head[1])))
        elif kind is None and "li" in self.stack:
            mark = ""
            if self.lists and self.lists[-1][0] == "ol":
                mark = str(self.lists[-1][1])
            self.out.blocks.append(Block("item", _one_line(text), path, mark, len(self.lists)))
        else:
            # what stands in a tag may still hold lines, lists and other markup
            lines(text, self.out, path)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.said.append(" ")
        if tag in _SILENT:
            self.flush()
            self.silent += 1
            return
        if tag in ("td", "th"):
            self.buf = [] if not "".join(self.buf).strip() else self.buf
            self._cell()
            self.cells = self.cells if self.cells is not None else []
            self.stack.append(tag)
            return
        if tag in _BLOCK_TAGS:
            if self.cells is not None and tag == "tr":
                self._row()
            elif self.cells is None:
                self.flush()
        if tag == "li":
            while "li" in self.stack and (not self.lists or self.stack[::-1].index("li") < next((k for k, t in enumerate(self.stack[::-1]) if t in ("ul", "ol")), 99)):
                self._close("li")
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self.buf.append(f" {alt} ")
        if tag not in _VOID:
            self.stack.append(tag)

    def _cell(self) -> None:
        if self.cells is not None and "".join(self.buf).strip():
            self.leaf()
            self.cells.append(_one_line("".join(self.buf)))
            self.buf = []

    def _row(self) -> None:
        self._cell()
        if self.cells:
            self.out.blocks.append(Block("row", "\t".join(self.cells), "/".join(t for t in self.stack if t in _BLOCK_TAGS)))
        self.cells = None

    def _close(self, tag: str) -> None:
        if tag in self.stack:
            if self.cells is None:
                self.flush()
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_endtag(self, tag: str) -> None:
        self.said.append(" ")
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if tag in ("td", "th"):
            self._cell()
            if tag in self.stack:
                while self.stack and self.stack.pop() != tag:
                    pass
            return
        if tag in ("tr", "table"):
            self._row()
        if tag in _BLOCK_TAGS:
            if tag in ("ul", "ol"):
                self._close("li") if "li" in self.stack else None
                if self.lists:
                    self.lists.pop()
            self._close(tag) if tag in self.stack else self.flush()
        elif tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buf.append(data)
            if "code" not in self.stack and "pre" not in self.stack:
                self.said.append(data)

    def finish(self) -> None:
        self.close()
        self._row() if self.cells is not None else None
        self.flush()


#: Without one of these a text has no inline markup.
_SIGNS = re.compile(r"[\\$\[{'*_`~]")
#: Without one of these it has no Markdown, wiki or LaTeX at all.
_ANY = re.compile(r"[\\$\[{'*_`~#=|>]|-{3}")


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", inline(text)).strip()


def inline(text: str) -> str:
    """Text without emphasis, links and commands; what they wrap stays."""
    if not _SIGNS.search(text):
        return text
    text = re.sub(_MATH, lambda m: next(g for g in m.groups() if g is not None).strip(), text, flags=re.S) if "\\" in text or "$" in text else text
    if "\\" in text:
        text = re.sub(r"\\(?:ref|label|cite)\{[^{}]*\}", "", text)
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        for _ in range(3):
            text = re.sub(r"\\(?:textbf|textit|textsc|emph|underline|texttt|textrm|url|title|author|caption)\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\\\\s*$", "", text, flags=re.M)
        text = re.sub(r"\\([&%$#])", r"\1", text)
        if LATEX.search(text) is None:
            text = re.sub(r"(?<=\w)~(?=--|\w)", " ", text)
    text = re.sub(r"!\[([^\]\n]*)\]\([^()\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\]\n]+)\]\((?!\s)[^()\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\]\n]+)\]\[[^\]\n]*\]", r"\1", text)
    text = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"(?<!\w)\[(?:https?|ftp|mailto):\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(_MAGIC, "", text)
    text = re.sub(r"(?<!')'{2,5}(?!')([^'\n]+(?:'[^'\n]+)*)'{2,5}(?!')", r"\1", text)
    text = re.sub(r"(?<![*\\])\*{2,3}(?=[^\s*])([^*\n]*[^\s*])\*{2,3}(?!\*)", r"\1", text)
    text = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w\\])__(?=\S)([^_\n]+)__(?!\w)", r"\1", text)
    text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)
    return re.sub(r"~~([^~\n]+)~~", r"\1", text)


_FENCE = re.compile(r" {0,3}(```|~~~)")
_BULLETS = frozenset("•·▪◦‣")
_RULE_UNDER = re.compile(r" {0,3}(?:-{3,}|={3,})[ \t]*")
_ITEM = re.compile(r"\s*(?:[•·▪◦‣]|[-*+])[ \t]+(.*)")
_LISTING = re.compile(r"\\begin\{(verbatim|lstlisting|equation\*?|align\*?|displaymath)\}(.*)")
_LAYOUT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:maketitle|noindent|centering|newpage|hline)")
_SECTION = re.compile(r"\\(?:part|chapter|(sub)?(sub)?section|paragraph)\*?\{(.*?)\}\s*(.*)")
_BOLD_LINE = re.compile(r"\\textbf\{([^{}]*)\}\s*\\\\")
_TEX_ITEM = re.compile(r"\\item\b\s*(?:\[[^\]]*\])?\s*(.*)")
_FORMULA = re.compile(r"(?:\$\$(.+)\$\$|\\\[(.+)\\\])")
_WIKI_HEAD = re.compile(r"(={1,6})\s*([^=].*?)\s*\1")
_MD_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$")
_RULE = re.compile(r"(?:-{3,}|\*{3,}|_{3,})")
_TABLE_RULE = re.compile(r"\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*")
_REFERENCE = re.compile(r" {0,3}\[[^\]\n]+\]:\s+\S+\s*$")
_WIKI_ITEM = re.compile(r"\s*[*#:;]{1,4}[ \t]+(.*)")
_NUMBERED = re.compile(r"\s*(\d{1,3})[.)][ \t]+(.*)")
_QUOTE = re.compile(r" {0,3}> ?(.*)")
_BOLD_HEAD = re.compile(r"\*\*([^*]+?):?\*\*:?")
_STOPS = re.compile(r"[.!?]")


def kinds(text: str) -> set[str]:
    """The kinds of markup besides HTML in the text of a leaf."""
    if not _ANY.search(text):
        return set()
    return {kind for kind, pattern in (("markdown", MARKDOWN), ("wiki", WIKI), ("latex", LATEX)) if pattern.search(text)}


def lines(text: str, out: Read, path: str = "") -> None:
    """Adds the blocks of a text of lines: Markdown, wiki, LaTeX or plain."""
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at, numbered = 0, 0

    def add(kind: str, t: str, **more) -> None:
        t = t if kind in ("code", "formula") else " ".join(inline(t).split())
        if t and not t.isspace():
            out.blocks.append(Block(kind, t, f"{path}/{kind}", **more))

    while at < len(rows):
        row = rows[at]
        bare = row.strip()
        at += 1
        if not bare:
            numbered = 0
            continue
        # what a line can be is told by its first sign; a plain line of text takes the first way out
        c = bare[0]
        under = at < len(rows) and rows[at][:4].lstrip(" ")[:1] in ("-", "=") and bool(_RULE_UNDER.fullmatch(rows[at]))
        if c in _BULLETS and (m := _ITEM.match(row)):
            add("item", m[1], level=1)
        elif c.isalpha() and not under and not bare.endswith(":"):
            add("para", row)
        elif c in "`~" and (m := _FENCE.match(row)):
            code = []
            while at < len(rows) and not rows[at].strip().startswith(m[1]):
                code.append(rows[at])
                at += 1
            at += 1
            add("code", "\n".join(code))
        elif c == "\\" and (m := _LISTING.match(bare)):
            body = [m[2]] if m[2].strip() else []
            while at < len(rows) and f"\\end{{{m[1]}}}" not in rows[at]:
                body.append(rows[at])
                at += 1
            if at < len(rows) and (last := rows[at].split("\\end{")[0]).strip():
                body.append(last)
            at += 1
            add("code" if m[1] in ("verbatim", "lstlisting") else "formula", "\n".join(body).strip("\n"))
        elif c == "\\" and _LAYOUT.fullmatch(bare):
            numbered = 0
        elif c == "\\" and (m := _SECTION.match(bare)):
            add("heading", m[3], level=2 + bool(m[1]) + bool(m[2]))
            add("para", m[4])
        elif c == "\\" and (m := _BOLD_LINE.fullmatch(bare)):
            add("heading", m[1], level=2)
        elif c == "\\" and (m := _TEX_ITEM.match(bare)):
            add("item", m[1], level=1)
        elif c in "$\\" and (m := _FORMULA.fullmatch(bare)):
            add("formula", (m[1] or m[2]).strip())
        elif c == "=" and (m := _WIKI_HEAD.fullmatch(bare)):
            add("heading", m[2], level=len(m[1]))
        elif bare.startswith("{|"):
            cells: list[str] = []

            def close() -> None:
                if cells:
                    out.blocks.append(Block("row", "\t".join(x for x in map(_one_line, cells) if x), f"{path}/row"))
                    cells.clear()

            while at < len(rows) and not rows[at].strip().startswith("|}"):
                r = rows[at].strip()
                at += 1
                if r.startswith("|-"):
                    close()
                elif r[:1] in ("|", "!"):
                    cells += [x.strip().split("|")[-1].strip() if "=" in x else x.strip() for x in re.split(r"\|\||!!", r.lstrip("|!+"))]
            at += 1
            close()
        elif c == "#" and (m := _MD_HEAD.match(row)):
            add("heading", m[2], level=len(m[1]))
        elif under and "|" not in bare:
            add("heading", bare, level=2 if "-" in rows[at] else 1)
            at += 1
        elif c in "-*_" and _RULE.fullmatch(bare):
            numbered = 0
        elif c in "|:-" and _TABLE_RULE.fullmatch(bare):
            continue  # the rule under a table's head
        elif c == "|" and bare.count("|") > 1:
            add("row", "\t".join(x.strip() for x in bare.strip("|").split("|")))
        elif c == "[" and _REFERENCE.match(row):
            continue  # where a reference link leads
        elif c in "-*+" and (m := _ITEM.match(row)):
            add("item", m[1], level=1)
        elif c in "*#:;" and (m := _WIKI_ITEM.match(row)):
            numbered += c == "#"
            add("item", m[1], mark=str(numbered) if c == "#" else "", level=1)
        elif c.isdigit() and (m := _NUMBERED.match(row)):
            add("item", m[2], mark=m[1], level=1)
        elif c == ">" and (m := _QUOTE.match(row)):
            add("para", m[1])
        elif c == "*" and (m := _BOLD_HEAD.fullmatch(bare)):
            add("heading", m[1], level=3)
        elif bare.endswith(":") and len(bare) < 60 and not _STOPS.search(bare):
            add("heading", bare, level=3)
        else:
            add("para", row)


def read(text: str | None) -> Read:
    """The blocks of a text and the kinds of markup found in it; nothing for null or blank text."""
    out = Read()
    if not text or not text.strip():
        return out
    src = text.replace("\0", "")
    if "<" in src and TAG.search(src) or "&" in src and ENTITY.search(src):
        out.markup.add("html")
        for _ in range(4):  # escaped, perhaps more than once
            if not _ESCAPED.search(src):
                break
            src = html.unescape(src)
        src = _BROKEN.sub("", src)
    if "<" in src and TAG.search(src):
        src = re.sub(r"<(?![a-zA-Z/!])", "&lt;", src)  # signs that open no tag
        t = _Tree(out)
        t.feed(re.sub(rf"<(?!/?(?:{_TAGS})\b|!)", "&lt;", src, flags=re.I))
        t.finish()
    else:
        src = html.unescape(src) if "html" in out.markup else src
        out.markup |= kinds(src)
        lines(src, out)
    return out


def parts(blocks: list[Block]) -> list[str]:
    """What each block adds to the text, with the line feeds before it."""
    out: list[str] = []
    before = ""
    for b in blocks:
        if b.kind == "item":
            t = f"{b.mark}. {b.text}" if b.mark else f"• {b.text}"
        elif b.kind in ("code", "formula"):
            t = "\n".join("    " + r for r in b.text.split("\n"))
        else:
            t = b.text
        near = b.kind == before and b.kind in ("item", "row")
        out.append(("\n" if near else "\n\n") + t if out else t)
        before = b.kind
    return out


def write(blocks: list[Block]) -> str:
    """Plain text: headings between blank lines, items with a bullet or their number, code and formulas indented, cells of a row a tab apart."""
    return "".join(parts(blocks))
