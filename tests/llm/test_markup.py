import pytest

from vellumine.llm.markup import _marks, _max_flow, clean, clean_markup, markup_found

FOUND = {
    "<TD>debit</TD>": ["html"], "caf&eacute; &#163;38 it&#x27;s": ["html"], "text <!-- open": ["html"], "pump</td>\n</tr>": ["html"], "<font\n color=red>x</font>": ["html"],
    "**bold** and [a](https://x.example/y)": ["markdown"], "note[^2]": ["markdown"], "~~old~~": ["markdown"], "*spare key* indeed": ["markdown"], "_heat pump_ too": ["markdown"],
    "[a][3]\n\n[3]: https://x.example/f": ["markdown"], "![key](i/2.png)": ["markdown"], "[[permit|name]]": ["wiki"], "{{cite|a|2021}}": ["wiki"], "== Costs ==\nx": ["wiki"],
    "{| class=wikitable\n|-\n| a || b\n|}": ["wiki"], "'''key'''": ["wiki"], "[https://x.example/f the form]": ["wiki"], "\\textbf{Next}": ["latex"], "so $Q = m c \\Delta T$": ["latex"],
    "\\begin{itemize}\n\\item one\n\\end{itemize}": ["latex"], "caf\\'e, 50\\% off": ["latex"], "<b>**x**</b>": ["html", "markdown"],
}
FREE = [
    "The value must stay < 2 and > 65.", "Write to <post at harlow-oak> now.", "The tag `<br>` was typed, `\\section{x}` too.", "In C:\\notes\\textbooks\\8_60.", "Use a==b or x != 6; y == 7.",
    "It measures 11 * 88 * 2 cm.", "meter_read_15_raw and meter_read_85_old", "He wrote [sic] R&D budget 2.", "Parts came at $7 to $81 each.", "Draft {32} replaces draft {56}.", "#9 and #70 -> see shelf",
    "```\n<b>x</b> **y**\n```", "- item\n1. other\n\n| a | b |\n|---|---|\n| 1 | 2 |", "https://x.example/a?b=1&c=2", "",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert clean(text)[1] == FOUND[text]


@pytest.mark.parametrize("text", FREE)
def test_free(text):
    assert clean(text) == (text, [])


def test_structure_is_kept():
    assert clean("<h3 id=a>Costs</h3><ul><li>one</li>\n<li>two &amp; three</li></ul>")[0] == "### Costs\n\n- one\n\n- two & three"
    assert clean("\\section{Van}\nSee $x^2$ and \\(y\\).")[0] == "# Van\n\nSee $x^2$ and $y$."
    assert clean("<pre><code>a = 1</code></pre>")[0] == "```\na = 1\n```"
    assert clean("== Key ==\n[[a|the key]] '''is''' here")[0] == "## Key\n\nthe key is here"


def test_minimum_cut_against_all_labellings():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(30):
        n = 6
        g = [{} for _ in range(n + 2)]
        for a in range(n + 2):
            for b in range(n + 2):
                if a != b and rng.random() < 0.5:
                    g[a][b] = round(rng.random() * 5, 2)
        for a in range(n + 2):
            for b in list(g[a]):
                g[b].setdefault(a, 0.0)
        cost = lambda side: sum(c for a in range(n + 2) for b, c in original[a].items() if side[a] and not side[b])
        original = [dict(x) for x in g]
        best = min(cost([*bits, True, False]) for bits in itertools.product([False, True], repeat=n))
        got = _max_flow(g, n, n + 1)
        assert got[n] and not got[n + 1] and abs(cost(got) - best) < 1e-6


def test_table(spark):
    rows = [(1, "<b>x</b>", "**H**"), (2, None, "a"), (3, "", None), (4, "x " * 50_000 + "&amp;", ""), (None, "[[k]]", ""), (5, "<b>x</b>", ""), (5, "<b>x</b>", "")]
    d = spark.createDataFrame(rows, "id long, text string, heading_path string").selectExpr("*", "'q' as dialects")
    assert clean_markup(d).count() == 7
    got = sorted((r["id"] or 0, r["dialect"]) for r in markup_found(d).collect())
    assert got == [(0, "wiki"), (1, "html"), (1, "markdown"), (4, "html"), (5, "html"), (5, "html")]
    assert clean_markup(d.limit(0)).count() == 0


@pytest.mark.parametrize("text", ['They logged {"pump": {"state": "off"}} at noon.', "Then size = grid[cols[i]] was read.", "if (closed || full) return", "build || echo failed"])
def test_context_overrules_the_regex(text):
    assert _marks(text) and clean(text) == (text, [])


def test_context_speaks_for_a_doubtful_mark():
    assert clean("| Key || Wall\n|-\n| 7 || 9")[1] == ["wiki"]
    assert clean("See [1] and the wall]] after it.")[1] == ["wiki"]


def test_sure_and_overruled_marks_in_one_text():
    assert clean('<b>Log</b>: {"pump": {"state": "off"}}') == ('Log: {"pump": {"state": "off"}}', ["html"])


def test_the_cut_overrules_the_classifier_among_close_neighbours():
    from vellumine.llm.markup import _cut, _features, _log_odds, _marks

    def labels(text):
        marks = _marks(text)
        return [(text[m.start : m.end], o > 0, k) for m, o, k in zip(marks, (_features(marks, text) @ _log_odds()).tolist(), _cut(marks, text))]

    close = {m: (own, kept) for m, own, kept in labels("<b>a</b> <x> <i>b</i>")}
    apart = {m: (own, kept) for m, own, kept in labels(f"<b>a</b> {'and then ' * 30} <x> {'and so on ' * 30} <i>b</i>")}
    assert close["<x>"] == (False, True) and apart["<x>"] == (False, False)


def test_what_only_looks_like_markup_is_kept():
    for text in ("write to <whom> or <name> now", "from $20 to 30$ in all", "it lies in C:\\notes\\textbooks\\8", "see [1][2]", "List<String> of R&Dx; and Q&Ab"):
        assert clean(text) == (text, [])


def test_long_constructs_and_many_marks():
    import time

    word = "word " * 1000
    assert clean(f"a [[Page|{word.strip()}]] b")[1] == ["wiki"] and clean(f"a {{{{cite|{word}}}}} b") == ("a  b", ["wiki"])
    assert clean(f"so $${word}= 1$$ it is")[1] == ["latex"] and clean(f"x[^{'n' * 90}] y")[1] == ["markdown"]
    began = time.perf_counter()
    text, found = clean("<b>a</b> of " * 4000)
    assert found == ["html"] and "<" not in text and time.perf_counter() - began < 20
