"""Markup residue of HTML, Markdown, wiki and LaTeX in text: label it by a minimum cut and turn it into clean text.

Plan: one narrow Arrow map over the rows that can hold markup at all (a JVM
filter keeps the rest out of Python).  A row's text is cut into candidate marks
and the runs of words between them; classifier costs become the capacities to
the two terminals, neighbours on a line and partners in the document tree
(opening and closing tag or delimiter) are joined by smoothness edges, and the
maximum flow of each block separates markup from content.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import cache
from html.entities import html5
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.runtime import spread

DIALECTS = ("html", "latex", "markdown", "wiki")

# The elements of HTML, old ones included.
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption "
    "center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark "
    "marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp "
    "script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr track tt u ul var video wbr".split()
)
_BREAKS = frozenset("br p div tr table ul ol dl section article header footer blockquote hr thead tbody tfoot form nav main aside figure".split())
_WIKI_TAGS = "ref|references|nowiki|gallery|math|syntaxhighlight|includeonly|noinclude|onlyinclude"
_CODE = re.compile(r"(?ms)^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)|(?<!`)(`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)\2(?!`)")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"'\]\)|{}]+|\bwww\.[^\s<>\"'\]\)|{}]+|\b[A-Za-z]:\\[^\s`\"]*|(?<![\\\w])\\\\[\w.-]+\\[^\s`\"]*")
_REF_OK = {k for k in html5 if not k.endswith(";")}
_INLINE = r"[^\n*_~`]"


class Mark(NamedTuple):
    start: int
    end: int
    dialect: str
    kind: str
    weight: float  # how sure its shape alone is, a feature of the classifier
    new: str  # what takes its place in the clean text
    pair: int  # marks of one pair bear one number; 0: none


def _tag(m: re.Match) -> tuple[str, float, str] | None:
    name = (m["name"] or "").lower()
    close = m["close"]
    if name not in TAGS:
        return None
    whole = m.group().rstrip().endswith(">")
    rest = m["rest"] or ""
    if not whole and not (re.fullmatch(r"\s*/?", rest) and m.end() == len(m.string)) and not re.search(r"=", rest) and not (close and m.end() == len(m.string)):
        return None
    if whole and rest.strip(" \t\r\n/") and "=" not in rest and not re.fullmatch(r"(?:\s+[a-z][\w:-]*)+\s*/?", rest):
        return None
    if re.fullmatch(r"h[1-6]", name):
        new = "\n" if close else "\n" + "#" * int(name[1]) + " "
    elif name == "li":
        new = "" if close else "\n- "
    elif name == "pre":
        new = "\n```\n"
    elif name == "code":
        new = ""
    elif name in ("td", "th"):
        new = "" if close else "| "
    elif name == "tr":
        new = "|\n" if close else "\n"
    elif name == "img":
        alt = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", rest)
        new = next((g for g in alt.groups() if g), "") if alt else ""
    else:
        new = "\n" if name in _BREAKS else ""
    return name, 6.0 if whole else 2.5, new


_HTML_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)\b(?P<rest>(?:\"[^\"]*\"|'[^'<>]*'|[^<>\"'])*)(?:>|(?=<|\Z)|\Z)")
_HTML_OTHER = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[|<!(?i:doctype)\b[^>]*>?|<\?xml\b[^>]*>?|(?<![<!-])-->")
_ENTITY = re.compile(r"&(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)")
_WIKI = [
    ("link", re.compile(r"\[\[[^\[\]\n]++(?:\[\[[^\[\]\n]*\]\][^\[\]\n]*)*(?:\]\]|$)", re.M), 5.0),
    ("linkend", re.compile(r"(?<![\]\w])\]\]|\]\](?!\])"), 2.0),
    ("template", re.compile(r"\{\{\{?[^{}]++\}?\}\}|\{\{[#A-Za-z][^{}\n]*"), 5.0),
    ("templateend", re.compile(r"(?m)^[ \t]*\}\}|\}\}"), 1.5),
    ("table", re.compile(r"(?m)^[ \t]*\{\|[^\n]*|^[ \t]*\|\}|^[ \t]*\|-+[ \t]*(?:[A-Za-z][^\n|]*)?$|^[ \t]*\|\+[^\n]*"), 5.0),
    ("cell", re.compile(r"(?<=\S)[ \t]+\|\|[ \t]+(?=\S)"), 1.2),
    ("emph", re.compile(r"(?<!')'{2,3}(?!')|(?<!')'{5}(?!')"), 2.0),
    ("heading", re.compile(r"(?m)^[ \t]*(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$"), 5.0),
    ("extlink", re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+[^\]\n]*)?(?:\](?!\()|$)", re.M), 5.0),
    ("magic", re.compile(r"__(?:NO)?(?:TOC|FORCETOC|NOTOC|NOEDITSECTION|INDEX|NOINDEX)__|(?i:#REDIRECT)\b[ \t]*(?=\[\[)|(?<!~)~{3,5}(?![~\w])"), 4.0),
    ("tag", re.compile(rf"</?(?:{_WIKI_TAGS})\b[^<>\n]*/?>", re.I), 5.0),
]
_LATEX = [
    ("env", re.compile(r"\\(?:begin|end)[ \t]*\{[A-Za-z]+\*?\}?(?:\[[^\]\n]*\])?(?:\{[lcrp|@ .\d]*\})?"), 6.0),
    ("display", re.compile(r"(?s)\\\[.+?(?:\\\]|\Z)|\\\(.+?(?:\\\)|\Z)|\$\$(?!\$)(?:(?!\n[ \t]*\n).)+?\$\$"), 6.0),
    ("math", re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)+?(?<=[^\s\\])\$(?![\d\w$])"), 4.0),
    ("section", re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?[ \t]*\{"), 6.0),
    ("item", re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*"), 6.0),
    ("drop", re.compile(r"\\(?:cite[tp]?|ref|eqref|label|pageref|index|vspace|hspace|usepackage|documentclass|bibliography|bibliographystyle|input|include|includegraphics|autoref|cref)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}?"), 6.0),
    ("symbol", re.compile(r"~?\\(?:pounds|euro|texteuro|textsterling|S|P|copyright|dots|ldots|ss|ae|oe|AE|OE|aa|AA|o|O|l|L|textdegree|degree|LaTeX|TeX|quad|qquad|newline|linebreak|noindent|newpage|clearpage|today|maketitle|tableofcontents|hline|toprule|midrule|bottomrule|centering|par)\b(?:\{\})?[ \t]?"), 5.0),
    ("cmd", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"), 5.0),
    ("bare", re.compile(r"\\[A-Za-z]{2,}\*?"), 1.5),
    ("accent", re.compile(r"\\(['`^\"~=.])(?:\{([A-Za-z])\}|([A-Za-z]))|\\([cvuHk])\{([A-Za-z])\}"), 4.0),
    ("escape", re.compile(r"\\[%&#$_{}](?![A-Za-z]\\)"), 3.0),
    ("newline", re.compile(r"\\\\(?:\[[^\]\n]*\])?(?=[ \t]*(?:\n|$|&|\\))"), 3.0),
]
_MD = [
    ("badge", re.compile(r"\[!\[([^\]\n]*)\]\([^()\n]*\)\]\([^()\n]*\)?"), 6.0),
    ("image", re.compile(r"!\[([^\]\n]*)\](?:\((?:[^()\n]|\([^()\n]*\))*\)?|\[[^\]\n]*\])"), 6.0),
    ("link", re.compile(r"(?<!\[)\[(?!\^)((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\((?!\s)(?:[^()\s\n]|\([^()\n]*\))+(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)?"), 6.0),
    ("reflink", re.compile(r"(?<![\[\w\]])\[([^\[\]\n^]+)\]\[([^\[\]\n]*)\]"), 3.5),
    ("refdef", re.compile(r"(?m)^[ ]{0,3}\[(?!\^)[^\]\n]+\]:[ \t]*<?(?:https?://|/|\.|mailto:|#|\w+\.)[^\n]*$"), 6.0),
    ("notedef", re.compile(r"(?m)^[ ]{0,3}\[\^[^\]\s]+\]:[ \t]*"), 6.0),
    ("note", re.compile(r"\[\^[^\]\s]+\]"), 6.0),
    ("auto", re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>"), 4.0),
]
_EMPH = [
    ("strong3", re.compile(rf"(?<![*\w\\])\*\*\*(?=[^\s*])({_INLINE}+?)(?<=[^\s*])\*\*\*(?!\*)"), 3),
    ("strong", re.compile(r"(?<![*\\])\*\*(?=[^\s*])((?:[^\n*`]|\*(?!\*))+?)(?<=[^\s*])\*\*(?!\*)"), 2),
    ("strongu3", re.compile(r"(?<![\w\\])___(?=[^\s_])([^\n_`]+?)(?<=[^\s_])___(?!\w)"), 3),
    ("strongu", re.compile(r"(?<![\w\\])__(?=[^\s_])((?:[^\n_`]|_(?!_))+?)(?<=[^\s_])__(?!\w)"), 2),
    ("strike", re.compile(r"(?<!~)~~(?=[^\s~])([^\n~`]+?)(?<=[^\s~])~~(?!~)"), 2),
    ("em", re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^\n*`]+?)(?<=[^\s*])\*(?![*\w])"), 1),
    ("emcjk", re.compile(r"(?<![*\x21-\x7e\\])\*(?=[^\s*\d])([^\n*`]+?)(?<=[^\s*])\*(?![*\x30-\x7a])"), 1),
    ("emu", re.compile(r"(?<![\w\\])_(?=[^\s_])([^\n_`]+?)(?<=[^\s_])_(?!\w)"), 1),
]
# What only looks like a mark, or is one that no standard names: the classifier and the cut decide.
_DOUBTFUL = [
    ("html", "name", re.compile(r"</?[A-Za-z][\w-]*\s*/?>")),
    ("html", "amp", re.compile(r"&[A-Za-z][A-Za-z0-9]{1,31};?")),
    ("latex", "money", re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]+?(?<=\S)\$(?![\d\w$])")),
    ("latex", "path", re.compile(r"\\[A-Za-z]{2,}")),
    ("markdown", "numbers", re.compile(r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]")),
]
_DOUBTS = frozenset(kind for _, kind, _ in _DOUBTFUL)
MAYBE = r"[<&\\$*_~{}\[\]=]|''|-->|\|\||\|-"


def _marks(text: str) -> list[Mark]:
    """All candidate marks outside code, none overlapping another."""
    shut = bytearray(len(text))

    def block(a: int, z: int, v: int = 1) -> None:
        shut[a:z] = bytes([v]) * (z - a)

    for m in _CODE.finditer(text):
        block(*m.span())
    urls = bytearray(len(text))
    for m in _URL.finditer(text):
        urls[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out: list[Mark] = []
    pairs = 0

    def free(a: int, z: int) -> bool:
        return not any(shut[a:z])

    def add(m: re.Match, dialect: str, kind: str, weight: float, new: str, a: int | None = None, z: int | None = None, pair: int = 0) -> None:
        a, z = m.start() if a is None else a, m.end() if z is None else z
        out.append(Mark(a, z, dialect, kind, weight, new, pair))
        block(a, z)

    has = text.__contains__
    if has("<") or has("-->"):
        for m in _HTML_OTHER.finditer(text):
            if free(*m.span()):
                add(m, "html", "comment", 6.0 if m.group() != "-->" else 2.0, "")
        for m in _WIKI[-1][1].finditer(text):
            if free(*m.span()):
                add(m, "wiki", "tag", 5.0, "")
        open_tags: dict[str, list[int]] = {}
        for m in _HTML_TAG.finditer(text):
            if not shut[m.start()] and (t := _tag(m)):
                name, weight, new = t
                pair = 0
                if m["close"] and open_tags.get(name):
                    pair = open_tags[name].pop()
                elif not m["close"]:
                    pairs += 1
                    pair = pairs
                    open_tags.setdefault(name, []).append(pair)
                add(m, "html", "tag", weight, new, pair=pair)
    if has("&"):
        for m in _ENTITY.finditer(text):
            name = m.group(1)
            if shut[m.start()]:
                continue
            if name[0] == "#":
                ok, weight = True, 6.0 if name.endswith(";") else 2.5
                end = m.end()
            elif name in html5:
                ok, weight, end = True, 6.0 if name.endswith(";") else 2.5, m.end()
            else:
                short = next((name[:k] for k in range(len(name), 1, -1) if name[:k] in _REF_OK), "")
                ok, weight, end = bool(short) and not urls[m.start()], 1.0, m.start() + 1 + len(short)
            if ok and not name.endswith(";") and (urls[m.start()] or text[end : end + 1] == "=" or text[end : end + 1].isalnum()):
                ok = False
            if ok:
                add(m, "html", "entity", weight, html.unescape(text[m.start() : end]), z=end)
    if has("\\") or has("$"):
        for kind, p, weight in _LATEX:
            for m in p.finditer(text):
                if not free(*m.span()) or urls[m.start()]:
                    continue
                g = m.group()
                if kind == "math" and not re.search(r"[\\^_={}+<>|]|\A[a-zA-Z]\Z", g[1:-1]):
                    continue
                if kind in ("cmd", "section"):  # the braces are marks, what they hold is text
                    depth, k = 1, m.end()
                    while k < len(text) and depth:
                        depth += (text[k] == "{") - (text[k] == "}")
                        k += 1
                    pairs += 1
                    level = 1 + g.count("sub")
                    add(m, "latex", kind, weight, "\n" + "#" * level + " " if kind == "section" else "", pair=pairs)
                    if not depth and not shut[k - 1]:
                        out.append(Mark(k - 1, k, "latex", "brace", 3.0, "\n" if kind == "section" else "", pairs))
                        block(k - 1, k)
                    continue
                new = ""
                if kind == "display":
                    new = g if g.startswith("$") else "$" + g[2:].removesuffix("\\]").removesuffix("\\)").strip() + "$"
                elif kind == "math":
                    new = g
                elif kind == "item":
                    new = "\n- "
                elif kind == "env" and "verbatim" in g:
                    new = "\n```\n"
                elif kind == "accent":
                    letter = m[2] or m[3] or m[5]
                    mark = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "k": "̨"}[m[1] or m[4]]
                    new = unicodedata.normalize("NFC", letter + mark)
                elif kind == "escape":
                    new = g[1:]
                elif kind == "newline":
                    new = "\n"
                elif kind == "symbol":
                    name = g.strip("~\\{} \t")
                    new = {"pounds": "£", "textsterling": "£", "euro": "€", "texteuro": "€", "S": "§", "P": "¶", "copyright": "©", "dots": "…", "ldots": "…", "ss": "ß", "ae": "æ", "oe": "œ", "AE": "Æ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "textdegree": "°", "degree": "°", "LaTeX": "LaTeX", "TeX": "TeX"}.get(name, "\n" if name in ("newline", "par", "linebreak") else "")
                    new = (" " if g.startswith("~") else "") + new
                elif kind == "bare" and re.match(r"[\w.:\\-]", text[m.start() - 1 : m.start()] or " "):
                    continue
                add(m, "latex", kind, weight, new)
    if has("[") or has("{") or has("''") or has("=") or has("|") or has("__") or has("~~~"):
        for kind, p, weight in _WIKI[:-1]:
            if kind == "emph" and text.count("''") < 2:
                continue
            for m in p.finditer(text):
                if not free(*m.span()):
                    continue
                g, new = m.group(), ""
                if kind == "link":
                    inner = g[2:].removesuffix("]]")
                    new = "" if re.match(r"(?i)\s*category\s*:", inner) else inner.split("|")[-1]
                elif kind == "template":
                    parts = [x.strip() for x in g.strip("{}").split("|")[1:]]
                    new = "\n".join(parts) if "\n" in g else ""
                elif kind == "heading":
                    new = "\n" + "#" * len(m[1]) + " " + m[2] + "\n"
                elif kind == "extlink":
                    new = g.strip("[]").partition(" ")[2].strip()
                elif kind == "cell":
                    new = " | "
                elif kind == "emph":
                    if re.match(r"\d", text[m.start() - 1 : m.start()] or "x"):
                        continue
                add(m, "wiki", kind, weight, new)
    if has("[") or has("<"):
        for kind, p, weight in _MD:
            for m in p.finditer(text):
                if free(*m.span()):
                    new = m[1] if m.lastindex and kind not in ("refdef",) else ""
                    if kind == "reflink" and not re.search(r"[A-Za-z]", m[1]):
                        continue
                    if kind == "image" and re.fullmatch(r"\^\d+", m[1]):
                        continue
                    add(m, "markdown", kind, weight, new)
    if has("*") or has("_") or has("~"):
        for kind, p, width in _EMPH:
            for m in p.finditer(text):
                a, z = m.span()
                if any(shut[a : a + width]) or any(shut[z - width : z]) or (width == 1 and urls[a]) or (kind.endswith("u") and urls[a]):
                    continue
                pairs += 1
                for s in (a, z - width):
                    out.append(Mark(s, s + width, "markdown", kind, 2.5 if width > 1 else 1.5, "", pairs))
                    block(s, s + width)
    names: dict[str, list[int]] = {}
    for dialect, kind, p in _DOUBTFUL:
        for m in p.finditer(text):
            if not free(*m.span()):
                continue
            g, pair = m.group(), 0
            if kind == "name":
                name = g.strip("</ >")
                if g.startswith("</") and names.get(name):
                    pair = names[name].pop()
                elif not g.startswith("</"):
                    pairs += 1
                    pair = pairs
                    names.setdefault(name, []).append(pair)
            add(m, dialect, kind, 0.5, g if kind in ("money", "amp") else g[1:].partition("]")[0] if kind == "numbers" else "", pair=pair)
    out.sort()
    return out


# The labelled sample that the context's log-odds are fitted on; the label holds for every mark in the text.
_SAMPLE_MARKUP = (
    "<p>The pump</p> was <b>late</b>.", "a <br> b", "x</td></tr> left over", "Tea &amp; milk, 5 &lt; 6", "the <i>old</i> (new) one = fine", "see <a href=x>here</a>", "caf&eacute", "cut off <span",
    "**Due** on Monday", "It was *never* paid", "the _red_ key", "[form](https://x.example/a) sent", "~~gone~~ and __kept__", "(*maybe*) later", "*a* = 1; *b* = 2",
    "[[Key|the key]] of [[Hall]]", "'''Bold''' and ''slanted'' words", "{{cite|a=b|c=d}}", "lost its head]] and went on [sic]", "tail of a template}} and {more} words", "| year = 1950\n}}\nIt was built", "{| class=wikitable\n|-\n| oak || elm\n| ash || fir\n|}",
    "| oak || elm || ash", "| 12 || 15", "! Year || Cost\n|-\n| 1 || 2", "see the hall]] (now closed) in [[Eskton]]", "|name=x|size=9}} was cited",
    "<p><item>Milk</item></p>", "<ul><entry>old key</entry><entry>new key</entry></ul>", "<b>Due</b> <note>soon</note> <i>now</i>",
    "\\textbf{Next} to \\emph{it}", "so $x^2 = 4$ holds", "a rate \\alpha of growth", "\\begin{itemize}\n\\item one\n\\end{itemize}", "50\\% off, \\$5", "\\noindent The key", "with \\lambda = 3 and \\mu = 4",
)
_SAMPLE_CONTENT = (
    'the answer was {"a": {"b": 1}}', 'it sent {"id": 7, "at": {"x": 3, "y": 4}}', "f = {k: {v: 2}}", "use map(x => { return { y: x }})", '{"user":{"name":"Ann"}} came back',
    "take m[idx[3]] first", "x = a[b[0]] + c[d[1]]", "rows[order[k]] = 5;", "the list [1, [2, 3]] has two", "v = [[1, 2], [3, 4]][n[0]]",
    "use <name> or <path> here", "a List<String> of it", "from <start> to <end>", "Map<Key> m", "write to <whom>", "R&D; and AT&T", "A&B;", "Q&A here",
    "it cost $5 or $6$ each", "from $20 to 30$ in all", "pay $9, get 3$ back", "in C:\\temp\\new files", "see D:\\old\\keys", "the share \\\\host\\folder", "see [1][2] and [3][4]", "m[4][5] and n[1][2]",
    "if (done || late) stop", "while (a || b) { wait(); }", "ok = x || y;", "return left || right", "test -f key || exit 1", "run(a) || fail(b)", "when p || q holds then r",
)
_CODE_SIGNS = frozenset("=;(){}[]\"<>+:,")


def _features(marks: list[Mark], text: str) -> np.ndarray:
    """A row for each mark: the shape of its own and what stands around it."""
    out = np.zeros((len(marks), 12))
    partners: dict[int, int] = {}
    for m in marks:
        partners[m.pair] = partners.get(m.pair, 0) + 1
    for k, m in enumerate(marks):
        lo, hi = max(0, m.start - 40), m.end + 40
        around = text[lo : m.start] + text[m.end : hi]
        line = text[max(text.rfind("\n", 0, m.start) + 1, m.start - 400) : m.start]
        rest = text[m.end : m.end + 40].partition("\n")[0]
        kin = sum(x.dialect == m.dialect and (x.weight >= 3 or x.kind == m.kind) and x.start - m.end < 200 and m.start - x.end < 200 for x in marks[max(0, k - 6) : k + 7]) - 1 if m.weight < 3 else sum(x.dialect == m.dialect for x in marks[max(0, k - 6) : k + 7]) - 1
        g = text[m.start : m.end].strip()
        opener = {"}}": "{", "]]": "["}.get(g, "")
        balanced = bool(opener) and line.count(opener) - line.count(g[0]) >= 2  # both closing signs belong to openers in the line
        row = bool(re.match(r"[ \t]*[|!]", line + g))
        before, after = text[m.start - 1 : m.start], text[m.end : m.end + 1]
        near = [ch for ch in around if not ch.isspace()]
        out[k] = (
            1.0,
            m.weight >= 3,
            min(kin, 3) / 3,
            m.pair > 0 and partners[m.pair] > 1,
            sum(ch in _CODE_SIGNS for ch in near) / max(1, len(near)),
            balanced,
            row,
            m.kind == "cell",
            not line.strip() or not rest.strip(),
            before.isalnum() and after.isalnum(),
            m.kind in _DOUBTS,
            m.kind == "path" and (before.isalnum() or before in tuple(":\\.-_")),
        )
    return out


@cache
def _log_odds() -> np.ndarray:
    """Logistic regression on the labelled sample, by Newton's method: log-odds of markup for each feature, of either sign."""
    xs, ys = [], []
    for label, texts in ((1.0, _SAMPLE_MARKUP), (0.0, _SAMPLE_CONTENT)):
        for t in texts:
            f = _features(_marks(t), t)
            xs.append(f)
            ys.append(np.full(len(f), label))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def _cut(marks: list[Mark], text: str) -> list[bool]:
    """Minimum cut: whether each mark is markup. Source side: markup; sink side: content."""
    keep = [True] * len(marks)
    odds = (_features(marks, text) @ _log_odds()).tolist()
    start = 0
    while start < len(marks):  # blocks are cut at blank lines that no pair spans
        stop, spans = start, {}
        while stop < len(marks):
            if stop > start and not any(v == 1 for v in spans.values()) and "\n\n" in text[marks[stop - 1].end : marks[stop].start]:
                break
            if marks[stop].pair:
                spans[marks[stop].pair] = spans.get(marks[stop].pair, 0) + 1
            stop += 1
        block = marks[start:stop]
        n = len(block)
        size = 2 * n + 1  # marks, runs of words between them
        graph: list[dict[int, float]] = [{} for _ in range(size + 2)]
        s, t = size, size + 1

        def join(a: int, b: int, c: float, d: float = 0.0) -> None:
            graph[a][b] = graph[a].get(b, 0.0) + c
            graph[b][a] = graph[b].get(a, 0.0) + d

        for k, m in enumerate(block):
            join(s, k, max(0.0, odds[start + k]))
            join(k, t, max(0.0, -odds[start + k]))
            before = text[block[k - 1].end if k else max(0, m.start - 80) : m.start]
            words = sum(ch.isalnum() for ch in before)
            join(n + k, t, min(6.0, 0.5 + 0.1 * words))  # words are content
            join(k, n + k, 0.15, 0.15)
            if k and before.count("\n") <= 1:
                join(k - 1, n + k, 0.15, 0.15)
                near = 0.9 / (1 + len(before) / 20)
                if block[k - 1].dialect == m.dialect:
                    join(k - 1, k, near, near)
        first: dict[int, int] = {}
        for k, m in enumerate(block):
            if m.pair:
                if m.pair in first:
                    join(first[m.pair], k, 3.0, 3.0)
                first[m.pair] = k
        for k, marked in enumerate(_max_flow(graph, s, t)[:n]):
            keep[start + k] = marked
        start = stop
    return keep


def _max_flow(graph: list[dict[int, float]], s: int, t: int) -> list[bool]:
    """Dinic's algorithm on residual capacities; which nodes stay on the source side of the minimum cut."""
    while True:
        level = [-1] * len(graph)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c in graph[a].items():
                if c > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [x >= 0 for x in level]
        ways, at = [list(g) for g in graph], [0] * len(graph)  # the next way of each node; none is tried twice in a phase
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                c = min(graph[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    graph[x][y] -= c
                    graph[y][x] = graph[y].get(x, 0.0) + c
                full = next(n for n, (x, y) in enumerate(zip(path, path[1:])) if graph[x][y] <= 1e-9)
                path = path[: full + 1]
                continue
            while at[a] < len(ways[a]):
                b = ways[a][at[a]]
                if graph[a][b] > 1e-9 and level[b] == level[a] + 1:
                    path.append(b)
                    break
                at[a] += 1
            else:
                level[a] = -1
                path.pop()


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """``(clean text, dialects found)``; headings, lists, code and formulas stay, in Markdown's own forms."""
    if not text:
        return text, []
    marks = _marks(text)
    if not marks:
        return text, []
    kept = _cut(marks, text)
    out, at, found = [], 0, set()
    for m, k in zip(marks, kept):
        if k:
            out.append(text[at : m.start] + m.new)
            at = m.end
            found.add(m.dialect)
    if not found:
        return text, []
    new = "".join(out) + text[at:]
    return re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", re.sub(r"[ \t]+\n", "\n", new)).strip("\n"), sorted(found)


def clean_markup(texts: DataFrame, id_col: str = "id", text_col: str = "text", heading_col: str = "heading_path") -> DataFrame:
    """``(id, text, heading_path, dialects array<string>)``, one row per row: clean text and what was found in either column.

    Fences and backtick code are never touched. Null texts or headings stay null, empty ones empty; rows
    without markup come out unchanged, so do empty tables; repeated rows are treated alike; other columns
    are not read.
    """
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, h in zip(b["i"], b["t"], b["h"]):
                t, a = clean(t)
                h, z = clean(h)
                rows.append((i, t, h, sorted({*a, *z})))
            yield pd.DataFrame(rows, columns=[id_col, "text", "heading_path", "dialects"])

    t, h = F.col(text_col), F.col(heading_col)
    maybe = F.coalesce(t.rlike(MAYBE), F.lit(False)) | F.coalesce(h.rlike(MAYBE), F.lit(False))
    some = texts.select(F.col(id_col).alias("i"), t.alias("t"), h.alias("h"), maybe.alias("m"))
    done = spread(some.where("m").drop("m")).mapInPandas(run, f"`{id_col}` {kind}, text string, heading_path string, dialects array<string>")
    rest = some.where("not m").select(F.col("i").alias(id_col), F.col("t").alias("text"), F.col("h").alias("heading_path"), F.array().cast("array<string>").alias("dialects"))
    return done.unionByName(rest)


def markup_found(texts: DataFrame, id_col: str = "id", text_col: str = "text", heading_col: str = "heading_path") -> DataFrame:
    """``(id, dialect)``: one row per row and dialect found, through :func:`clean_markup`."""
    some = texts.where(F.coalesce(F.col(text_col).rlike(MAYBE), F.lit(False)) | F.coalesce(F.col(heading_col).rlike(MAYBE), F.lit(False)))
    found = clean_markup(some, id_col, text_col, heading_col)
    return found.select(id_col, F.explode("dialects").alias("dialect"))
