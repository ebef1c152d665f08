"""Markup residue in text: which kinds a text holds, and the text without it, by tag-path ratios.

A text is parsed into one tree, whatever notation it is in. Constructs are recognised in layers: fenced blocks and code
spans first, which protect what is in them; then comments and scripts, formulas, Windows paths and URLs; then the
constructs of wiki, LaTeX, Markdown and HTML. Each needs its full form (a closing mark, a known name, the right neighbours), so
that prices, comparisons, paths and names with underscores stay plain text. Each becomes an element of the tree with a tag,
family and name, such as ``markdown:li`` or ``html:div``; what has no text of its own, as a comment, is an empty leaf.

The kinds of a text are the families on the root-to-leaf tag paths of its tree.

Leaves are put together to blocks (lines, HTML blocks, code), the path of a block being what its text has in common. For each path the
length of its blocks and the punctuation by length are summed and taken by block (tag-path ratios), smoothed over the paths beside it by
a Gaussian of the steps between the two, and fused to one ratio, their product. The text's own ratios are then split where the two sides
differ most (the greatest variance between them), on a logarithmic scale. Paths on the lower side are residue, such as navigation,
footers and lists of links, if the sides lie apart by `CONTRAST` at least; where blocks are alike, none is. Headings, list
items, table cells, code, formulas, quotes and paragraphs are structure and stay, in a plain notation (``# ``, ``- ``, cells between
``|``, fences, the formula itself); so does text outside of HTML elements.

Null gives null and no kinds, an empty text an empty one.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
#: Names of HTML elements.
ELEMENTS = """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button
canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset
figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label
legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param
picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg
table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: LaTeX commands that need no argument.
COMMANDS = """item ldots dots cdots cdot times alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma
tau phi varphi chi psi omega Gamma Delta Theta Lambda Sigma Phi Psi Omega it bf em rm tt sc sl itshape bfseries ttfamily par newline linebreak pagebreak
newpage clearpage noindent maketitle tableofcontents LaTeX TeX quad qquad hline centering leq geq neq infty sum prod int partial nabla
rightarrow leftarrow Rightarrow textbackslash textasciitilde ss ae oe aa""".split()
#: Names of elements whose own text is structure and never residue.
STRUCTURE = {"h", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "cell", "td", "th", "caption", "code", "pre", "samp", "kbd", "formula", "quote", "blockquote", "p"}
#: Names of leaves that stand for the tag of the line they begin.
LINE = {"h", "li", "quote"}
#: Structure that says nothing of how the prose of a text is made.
SHORT = STRUCTURE - {"p", "quote", "blockquote"}
#: How many times as great the ratios above the split are, by geometric means, for what is below to be residue.
CONTRAST = 50.0
#: Punctuation by 100 characters of a block that has none.
LEAST_MARKS = 0.05
PUNCTUATION = re.compile(r"[.,;:!?。、！？，；：]")

_name = "|".join(sorted(ELEMENTS, key=len, reverse=True))
FENCE = re.compile(r"^(?P<q> {0,3}(?:> ?)*)(?P<f>`{3,}|~{3,})(?P<info>[^\n]*)\n(?P<body>.*?)(?:^[ >]{0,6}(?P=f)[`~]*[ \t]*\r?$|\Z)", re.M | re.S)
SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:[^\n]|\n(?!\s*\n))+?)(?<!`)\1(?!`)")
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>|<\?xml[^>]*\?>|<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
DISPLAY = re.compile(r"\$\$(?=[^$]*\S)[^$]+\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}.*?\\end\{\1\2\}", re.S)
INLINE = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*?)(?<=[^\s\\$])\$(?![\w$])")
PATH = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]:\\|\\\\[\w.$-]+\\)[^\s\"'<>|]*")
URL = re.compile(r"(?:https?|ftp)://[^\s<>\[\]{}|\"')]+")

W_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(?:(?![ \t]*(?:\{\||\|\}))[^\n]*\n)*+[ \t]*\|\}", re.M)  # an innermost one
W_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*\r?$", re.M)
W_LINK = re.compile(r"\[\[([^\[\]\n|]+)((?:\|[^\[\]\n|]*)*)\]\]")
W_OUTER = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:[ \t]+([^\]\n]+))?\](?!\()")
W_TEMPLATE = re.compile(r"(?<![{\w\\}])\{\{[ \t]*([A-Za-z#][^{}\n|]*)(?:\|[^{}]*)?\}\}(?!\}(?!\}))")
W_QUOTE = re.compile(r"(?<![A-Za-z0-9'])('{2,3}|'{5})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
W_WORD = re.compile(r"^[ \t]*#REDIRECT\b|__(?:NO)?(?:EDITSECTION|TOC|FORCETOC|INDEX|GALLERY|HIDDENCAT)__", re.M | re.I)

L_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
L_HEAD = re.compile(r"\\((?:sub)*section|chapter|part|paragraph)\*?\{((?:[^{}\n]|\{[^{}\n]*\})*)\}")
L_GROUP = re.compile(r"\{\\(?:it|bf|em|rm|tt|sc|sl|itshape|bfseries|ttfamily)\b[ \t]*([^{}]*)\}")
L_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?=[{\[])((?:\[[^\]\n]*\])*)(?:\{((?:[^{}]|\{[^{}]*\})*)\})?|\\(" + "|".join(sorted(COMMANDS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?[ \t]?")
#: Only with an argument, and none that holds deeper groups; the last group is never set.
L_INNER = re.compile(r"\\([A-Za-z]+)\*?(?=[{\[])((?:\[[^\]\n]*\])*+)(?:\{((?:[^{}]|\{[^{}]*\})*)\}|(?!\{))|((?!))")
L_ACCENT = re.compile(r"""\\([`'^"~=.])(?:\{\\?([A-Za-z])\}|([aeiouyncszAEIOUYNCSZ]))|\\([,;])""")
#: Combining marks of LaTeX accents.
MARKS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇"}

H_TAG = re.compile(rf"<(/?)({_name})\b((?:\s+[^<>\s=/\"']+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))?)*)\s*/?>", re.I)
H_ENTITY = re.compile(r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|([A-Za-z][A-Za-z0-9]{1,31})(;?))")

M_HEAD = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+([^\n]*?))??(?:[ \t]+#+)?[ \t]*\r?$", re.M)
M_UNDERLINE = re.compile(r"^ {0,3}(?:={2,}|-{2,})[ \t]*\r?$", re.M)
M_NO_TITLE = re.compile(r"\s*(?:[-+*>|#]|\d+[.)]|=+\s*$|$)")
M_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*\r?$", re.M)
M_LIST = re.compile(r"^([ \t]*(?:> ?)*)(?:[-+*]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
M_QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(?=\S)", re.M)
M_TABLE = re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?$", re.M)
M_ROW = re.compile(r"^[ \t]*\|(.*)\|[ \t]*\r?$", re.M)
M_NOTE = re.compile(r"^ {0,3}\[\^?[^\]\n]+\]:[ \t]+(?=\S)", re.M)
M_LINK = re.compile(r"!?\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\](?:\([ \t]*<?[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)|\[[^\[\]\n]*\])")
M_FOOT = re.compile(r"\[\^[^\]\s]+\]")
M_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
M_STAR = re.compile(r"(?<![A-Za-z0-9*\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*\\])\1(?![A-Za-z0-9*])")
M_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^\n]*?[^\s_\\])\1(?!\w)")
M_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^\n]*?[^\s~])~~(?!~)")

SPECIAL = re.compile(r"[<&\\$\[{|*_#`~=>]|''|^[ \t]*(?:[-+]|\d{1,9}[.)])[ \t]|^ {0,3}-{2,}[ \t]*\r?$", re.M)
BLOCKS = {"li", "dd", "dt", "p", "div", "tr", "table", "ul", "ol", "dl", "blockquote", "pre", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr"}
#: Marks around the number of a leaf, and of an element that begins; the mark where one ends. A text's own such characters become leaves.
LEAF, LEAF_END, BEGIN, BEGIN_END, END = "\ue000\ue001\ue002\ue003\ue004"
OWN = re.compile("[\ue000-\ue004]")
HELD = re.compile(f"{LEAF}(\\d+){LEAF_END}")
MARKS_OF = f"{LEAF}(?P<leaf>\\d+){LEAF_END}|{BEGIN}(?P<begin>\\d+){BEGIN_END}|(?P<end>{END})"
PART = re.compile(f"{MARKS_OF}|(?P<tag>{H_TAG.pattern})", re.I), re.compile(MARKS_OF)


def settled(change, t: str) -> str:
    """``t`` changed again and again, until nothing changes."""
    while (after := change(t)) != t:
        t = after
    return t


class Reading:
    """One text: the tree it makes, its kinds and its plain text."""

    def __init__(self, text: str):
        self.leaves: list[tuple[str, str, str, str]] = []  # family, name, text, and what is in it but not shown
        self.elements: list[tuple[str, str]] = []
        self.families: set[str] = set()
        #: Leaves of the tree: path and text; a None for text is a break between blocks.
        self.tree: list[tuple[tuple[str, ...], str | None]] = []
        self.grow(self.read(OWN.sub(lambda m: self.leaf("", "own", m[0]), text)), [])
        self.kinds = sorted({tag.partition(":")[0] for path, _ in self.tree for tag in path} - {""})
        self.blocks = list(self.joined())
        self.kept = select_blocks(self.blocks)
        text = "".join(t for (_, t), keep in zip(self.blocks, self.kept) if keep)
        self.text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()

    def leaf(self, family: str, name: str, text: str, hidden: str = "") -> str:
        self.families.add(family)
        self.leaves.append((family, name, text, hidden))
        return f"{LEAF}{len(self.leaves) - 1}{LEAF_END}"

    def element(self, family: str, name: str, inner: str) -> str:
        self.families.add(family)
        self.elements.append((family, name))
        return f"{BEGIN}{len(self.elements) - 1}{BEGIN_END}{inner}{END}"

    def gone(self, family: str, name: str):
        """A replacement for re.sub: an empty leaf in the place of the match."""
        return lambda m: self.leaf(family, name, "", m[0])

    def within(self, family: str, name: str, group: int):
        """A replacement for re.sub: an element that holds a group of the match."""
        return lambda m: self.element(family, name, m[group] or "")

    # Reading: constructs become marks.

    def read(self, t: str) -> str:
        if "```" in t or "~~~" in t:
            t = FENCE.sub(self.fence, t)
        if "`" in t:
            t = SPAN.sub(lambda m: self.leaf(MARKDOWN, "span", m[2].strip()), t)
        if "<" in t:
            t = COMMENT.sub(lambda m: " " + self.leaf(HTML, "comment", "", m[0]), t)
        if "\\" in t:
            t = PATH.sub(lambda m: self.leaf("", "path", m[0]), t)
        if "$" in t or "\\" in t:
            t = DISPLAY.sub(lambda m: self.leaf(LATEX, "formula", m[0]), t)
            t = INLINE.sub(self.formula, t)
        t = self.wiki(t)
        t = self.latex(t)
        t = self.markdown_links(t)
        t = URL.sub(lambda m: self.leaf("", "url", m[0]), t)
        return self.markdown(t)

    def fence(self, m: re.Match) -> str:
        if m["f"][0] != "~" and "`" in m["info"]:
            return m[0]
        return m["q"] + self.leaf(MARKDOWN, "code", f"```{m['info'].strip()}\n{m['body']}```")

    def formula(self, m: re.Match) -> str:
        if m[1][:1].isdigit() and not re.search(r"[\\^_={+*/<>]", m[1]):
            return m[0]
        return self.leaf(LATEX, "formula", m[0])

    def wiki(self, t: str) -> str:
        if "__" in t or "#" in t:
            t = W_WORD.sub(self.gone(WIKI, "word"), t)
        if "{{" in t:
            t = settled(lambda t: W_TEMPLATE.sub(self.gone(WIKI, "template"), t), t)
        if "[" in t:
            t = W_LINK.sub(self.wiki_link, t)
            t = W_OUTER.sub(self.within(WIKI, "link", 1), t)
        if "''" in t:
            t = settled(lambda t: W_QUOTE.sub(self.within(WIKI, "em", 2), t), t)
        if "{|" in t:
            t = settled(lambda t: W_TABLE.sub(self.wiki_table, t), t)
        if "==" in t:
            t = W_HEAD.sub(lambda m: f"{self.leaf(WIKI, 'h', '#' * len(m[1]))} {m[2]}", t)
        return t

    def wiki_link(self, m: re.Match) -> str:
        if re.match(r"(?i)(?:category|file|image):", m[1]):
            return self.leaf(WIKI, "link", "", m[0])
        return self.element(WIKI, "link", (m[2].rpartition("|")[2] or m[1]).strip())

    def wiki_table(self, m: re.Match) -> str:
        rows: list[list[str]] = []  # name and text
        for line in m[0].split("\n")[1:]:
            line = line.strip()
            if line[:2] in ("|-", "|}") or not line:
                continue
            if line[:2] == "|+":
                rows.append(["caption", line[2:].strip()])
            elif line[0] in "|!":
                rows.append(["cell", " | ".join(re.split(r"\s*(?:\|\||!!)\s*", line[1:].strip()))])
            elif rows:  # goes on with the caption or the last cell
                rows[-1][1] = f"{rows[-1][1]} {line}".strip()
            else:
                rows.append(["caption", line])
        lines = (self.leaf(WIKI, "cell", f"| {x} |") if name == "cell" else self.element(WIKI, "caption", x) for name, x in rows)
        return "\n".join(lines) if rows else self.leaf(WIKI, "table", "", m[0])

    def latex(self, t: str) -> str:
        if "\\" not in t:
            return t
        t = t.replace("~\\", " \\")  # a space that doesn't break, before a command
        t = L_ENV.sub(self.gone(LATEX, "environment"), t)
        t = L_ACCENT.sub(lambda m: self.leaf(LATEX, "accent", " " if m[4] else unicodedata.normalize("NFC", (m[2] or m[3]) + MARKS[m[1]])), t)
        t = settled(lambda t: self.commands(t, L_INNER), t)
        t = settled(lambda t: self.commands(t, L_COMMAND), t)
        return re.sub(r"\\([%&_#$])", r"\1", t) if LATEX in self.families else t

    def commands(self, t: str, pattern: re.Pattern) -> str:
        """One level of LaTeX headings, groups and commands."""
        t = L_HEAD.sub(lambda m: f"{self.leaf(LATEX, 'h', '#' * (1 + m[1].count('sub')))} {m[2]}", t)
        t = L_GROUP.sub(self.within(LATEX, "group", 1), t)
        return pattern.sub(self.command, t)

    def command(self, m: re.Match) -> str:
        if m[4] == "item":
            return self.leaf(LATEX, "li", "- ")
        if m[1] in ("label", "ref", "cite", "eqref", "index", "pageref"):
            return self.leaf(LATEX, "command", "", m[0])
        if m[3]:
            return self.element(LATEX, "command", m[3])
        return self.leaf(LATEX, "command", "…" if "dots" in (m[1] or m[4]) else "")

    def markdown_links(self, t: str) -> str:
        if "<" in t:
            t = M_AUTO.sub(lambda m: self.leaf(MARKDOWN, "url", m[1]), t)
        if "[" in t:
            t = M_NOTE.sub(lambda m: self.leaf(MARKDOWN, "note", "" if "^" in m[0] else m[0].strip() + " ", m[0]), t)
            t = M_FOOT.sub(self.gone(MARKDOWN, "note"), t)
            t = M_LINK.sub(self.within(MARKDOWN, "link", 1), t)
        return t

    def markdown(self, t: str) -> str:
        if "|" in t:
            t = M_TABLE.sub(lambda m: self.leaf(MARKDOWN, "table", "") + m[0].partition("\n")[0], t)
            if MARKDOWN in self.families:
                t = M_ROW.sub(lambda m: self.leaf(MARKDOWN, "cell", f"|{m[1]}|"), t)
        if "#" in t:
            t = M_HEAD.sub(lambda m: f"{self.leaf(MARKDOWN, 'h', m[1])} {m[2]}" if m[2] else m[0], t)
        if "--" in t or "==" in t:
            t = self.underlined(t)
        t = M_RULE.sub(self.gone(MARKDOWN, "rule"), t)
        t = M_LIST.sub(lambda m: m[1] + self.leaf(MARKDOWN, "li", "- "), t)
        if ">" in t:
            t = M_QUOTE.sub(lambda m: self.leaf(MARKDOWN, "quote", ""), t)
        for mark, pattern, group in (("*", M_STAR, 2), ("_", M_UNDER, 2), ("~~", M_STRIKE, 1)):
            if mark in t:
                t = settled(lambda t, p=pattern, g=group: p.sub(self.within(MARKDOWN, "em", g), t), t)
        return t

    def underlined(self, t: str) -> str:
        """Headings with a line below them."""
        parts, at = [], 0
        for m in M_UNDERLINE.finditer(t):
            begin = t.rfind("\n", 0, max(m.start() - 1, 0)) + 1
            if begin >= at and m.start() and not M_NO_TITLE.match(title := t[begin : m.start() - 1]):
                parts += [t[at:begin], f"{self.leaf(MARKDOWN, 'h', '##')} {title}"]
                at = m.end()
        return "".join(parts) + t[at:]

    # Growing: marks and HTML tags become the tree.

    def grow(self, t: str, stack: list[str]) -> None:
        at, bottom = 0, len(stack)
        for m in PART["<" not in t].finditer(t):
            self.plain(stack, t[at : m.start()])
            at = m.end()
            if m["leaf"] is not None:
                self.grow_leaf(stack, *self.leaves[int(m["leaf"])])
            elif m["begin"] is not None:
                family, name = self.elements[int(m["begin"])]
                stack.append(f"{family}:{name}")
                self.tree.append((tuple(stack), ""))
            elif m["end"] is not None:
                for i in range(len(stack) - 1, bottom - 1, -1):
                    if not stack[i].startswith(HTML):
                        del stack[i]
                        break
            else:
                self.html_tag(stack, bottom, m["tag"])
        self.plain(stack, t[at:])
        del stack[bottom:]

    def grow_leaf(self, stack: list[str], family: str, name: str, text: str, hidden: str) -> None:
        path = (*stack, f"{family}:{name}") if family else tuple(stack)
        if name in ("cell", "note"):  # their text was kept apart, and holds further constructs
            self.tree.append((path, ""))
            self.grow(text, list(path))
        else:
            self.tree.append((path, self.whole(text)))
        for m in HELD.finditer(hidden):
            family, name, _, deeper = self.leaves[int(m[1])]
            self.grow_leaf(list(path), family, name, "", deeper)
        for m in re.finditer(f"{BEGIN}(\\d+)", hidden):
            self.tree.append(((*path, ":".join(self.elements[int(m[1])])), ""))

    def whole(self, text: str) -> str:
        """The text of a leaf, with that of the leaves in it."""
        return HELD.sub(lambda m: self.whole(self.leaves[int(m[1])][2]) if self.leaves[int(m[1])][1] != "own" else self.leaves[int(m[1])][2], re.sub(f"{BEGIN}\\d+{BEGIN_END}|{END}", "", text) if BEGIN in text else text)

    def html_tag(self, stack: list[str], bottom: int, tag: str) -> None:
        m = H_TAG.match(tag)
        name = m[2].lower()
        own = f"{HTML}:{name}"
        self.tree.append(((*stack, own), ""))
        if name in BLOCKS:
            self.tree.append((tuple(stack), None))
        if m[1]:
            if own in stack[bottom:]:
                del stack[len(stack) - 1 - stack[::-1].index(own) :]
            return
        if name in ("li", "td", "th", "tr", "dt", "dd", "p", "option") and stack[bottom:] and stack[-1] == own:
            stack.pop()
        if name not in VOID:
            stack.append(own)
        notation = "#" * int(name[1]) + " " if re.fullmatch("h[1-6]", name) else "- " if name in ("li", "dt", "dd") else " | " if name in ("td", "th") else ""
        if notation:
            self.tree.append((tuple(stack), notation))

    def plain(self, stack: list[str], t: str) -> None:
        if "&" in t:
            t = H_ENTITY.sub(lambda m: self.entity(stack, m), t)
        if t:
            self.tree.append((tuple(stack), t))

    def entity(self, stack: list[str], m: re.Match) -> str:
        if m[1]:
            name = m[1] + m[2]
            after = m.string[m.end() : m.end() + 1]
            if name not in html.entities.html5 or (not m[2] and (after.isalnum() or after == "=")):
                return m[0]
        self.tree.append(((*stack, f"{HTML}:entity"), ""))
        return html.unescape(m[0]).replace("\xa0", " ")

    # Blocks: leaves that stand in one line or HTML block.

    def joined(self) -> Iterator[tuple[tuple[str, ...], str]]:
        """(path, text) of each block in order; breaks are blocks of white space."""
        run: list[tuple[tuple[str, ...], str]] = []
        for path, text in self.tree:
            if text is None or path[-1:] == (f"{MARKDOWN}:code",):
                yield from block(run)
                run = []
                yield (path, "\n") if text is None else (path, text)
                continue
            lines = text.split("\n")
            for line in lines[:-1]:
                yield from block([*run, (path, line)])
                run = []
                yield (), "\n"
            run.append((path, lines[-1]))
        yield from block(run)


def block(run: list[tuple[tuple[str, ...], str]]) -> Iterator[tuple[tuple[str, ...], str]]:
    """The block of leaves: its path is what the paths of its text have in common, and the tag of the line."""
    text = "".join(t for _, t in run)
    if not text:
        return
    line = [p[-1:] for p, _ in run if p and p[-1].partition(":")[2] in LINE and not p[-1].startswith(HTML)][:1]
    paths = [p for p, t in run if t.strip(" -#|") and not (line and p[-1:] == line[0])] or [run[0][0]]
    common = paths[0]
    for p in paths[1:]:
        common = common[: next((i for i, (x, y) in enumerate(zip(common, p)) if x != y), min(len(common), len(p)))]
    yield (*common, *(line[0] if line else ())), text


def path_ratios(blocks: list[tuple[tuple[str, ...], str]]) -> dict[tuple, float]:
    """The logarithm of the fused tag-path ratio of each path: the root of the length by block, times punctuation by 100 characters."""
    sums: dict[tuple, list[float]] = {}
    for path, text in blocks:
        if own := len(text.strip()):
            total = sums.setdefault(path, [0, 0, 0])
            total[0] += own
            total[1] += len(PUNCTUATION.findall(text))
            total[2] += 1
    plain = {p: (length / n, 100 * marks / length) for p, (length, marks, n) in sums.items()}
    paths, out = list(sums), {}
    for i, p in enumerate(paths):
        weights = [(1.0, p)]
        for q in paths[max(0, i - 1) : i] + paths[i + 1 : i + 2]:
            shared = next((k for k, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
            weights.append((math.exp(-((len(p) + len(q) - 2 * shared) ** 2) / 2), q))
        whole = sum(w for w, _ in weights)
        length, marks = (sum(w * plain[q][k] for w, q in weights) / whole for k in (0, 1))
        out[p] = math.log(length) / 2 + math.log(LEAST_MARKS + marks)
    return out


def split_point(values: list[float]) -> tuple[float, float]:
    """The value from which the upper side begins, where the variance between two sides is greatest; and how far their means lie apart."""
    x, n = sorted(values), len(values)
    best, least, apart, low, total = 0.0, -math.inf, 0.0, 0.0, sum(values)
    for i in range(1, n):
        low += x[i - 1]
        gap = (total - low) / (n - i) - low / i
        if x[i] > x[i - 1] and (between := i * (n - i) * gap * gap) > best:
            best, least, apart = between, x[i], gap
    return least, apart


def _name_of(path: tuple[str, ...]) -> str:
    return path[-1].partition(":")[2] if path else ""


def select_blocks(blocks: list[tuple[tuple[str, ...], str]]) -> list[bool]:
    """Which blocks are content, by tag-path ratios and how they are spread over the text's own blocks."""
    if not any(p and p[-1].startswith(HTML) for p, _ in blocks):
        return [True] * len(blocks)
    ratios = path_ratios(blocks)
    least, apart = split_point([ratios[p] for p, t in blocks if t.strip() and _name_of(p) not in SHORT])
    if apart < math.log(CONTRAST):
        return [True] * len(blocks)
    residue = {p for p, x in ratios.items() if x < least and p and p[-1].startswith(HTML) and _name_of(p) not in STRUCTURE}
    return [p not in residue or not t.strip() for p, t in blocks]


def read_markup(text: str | None) -> tuple[list[str], str | None]:
    """The kinds of markup in a text, sorted, and its plain text."""
    if not text or not SPECIAL.search(text):
        return [], text
    reading = Reading(text)
    return reading.kinds, reading.text


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [read_markup(x) for x in b.column(2).to_pylist()]
        kinds, texts = ([r[i] for r in rows] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["table_name", "record_key", "kinds", "clean"])


def clean_markup(values: DataFrame) -> DataFrame:
    """(table_name, record_key, kinds, clean) for each row of ``values`` (table_name, record_key, text). No shuffle."""
    rows = values.select("table_name", "record_key", "text")
    return rows.mapInArrow(_read, "table_name string, record_key string, kinds array<string>, clean string")


def _values(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities").select(F.lit("entities").alias("table_name"), F.col("entity_path").alias("record_key"), F.col("content").alias("text"))
    return entities.union(table(spark, d, "chunks").select(F.lit("chunks"), "chunk_id", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of markup of each field that holds any."""
    return clean_markup(_values(spark, d)).select("table_name", "record_key", F.explode("kinds").alias("markup")).distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The plain text of every field."""
    cleaned = clean_markup(_values(spark, d)).withColumn("digest", F.md5("clean"))
    return cleaned.groupBy("table_name", "record_key", "digest").agg(F.first("kinds").alias("kinds"), F.first("clean").alias("clean")).drop("digest")
