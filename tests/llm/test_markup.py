import pytest

from loreweave.llm.markup import Reading, clean_markup, path_ratios, read_markup, select_blocks

PLAIN = ["Its grade is # 4 <3 of 9.", "The set {a | b} has 2 ^ 3 members (see [4]).", "It cost $12 to $15, or 40% of the C# and C++ copies.", "It takes 5 * 3 * 2 steps.", "Here a < b holds, and so does c > d.", "R&D prices it at $5, the copy at $7.", "See C:\\data\\new for snake_case_name.", "D:\\index\\table_1, its rule p && q.", "So a => b and b <= c, filed under #tag, about ~5 km off.", "3 < x and y > 1; AT & T differ.", "The mark [sic] and {curly}.", "It is 6'' by 4'' wide.", "List<Text> of __init", "", " "]
MARKED = [("See [x y][3] there.", "markdown"), ("<a href=\"u\" title='v'>w</a>", "html"), ("a `b_c` d", "markdown"), ("$$ a^2 $$", "latex"), ("'''A''' was ''b''.", "wiki"), ("[[A|b]]", "wiki"), ("[https://a.example/w the road]", "wiki"), ("\\(s \\in R\\)", "latex"), ("is $n_i = \\frac{n^2}{4}$ here", "latex"), ("m<sup>2</sup> &times; 5", "html"), ("a&nbsp,b", "html"), ("`<b>1</b>`", "markdown"), ("~~x~~", "markdown"), ("<https://a.example>", "markdown"), ("Caf\\'{e} and M\\\"uhle", "latex"), ("x.{{cite|date=1}} y", "wiki"), ("```\n[[a]] <b>\n== x ==\n```", "markdown"), ("Title\n-----\n\nNo", "markdown"), ("{| class=\"w\"\n|-\n| 1 || b\n|}", "wiki"), ("== S ==", "wiki"), ("## S ##", "markdown"), ("- [x] A", "markdown"), ("| a |\n|---|\n| b |", "markdown"), ("a <!-- b --> c", "html"), ("__TOC__", "wiki"), ("{\\it a} b", "latex")]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert read_markup(text)[0] == []


@pytest.mark.parametrize("text,kind", MARKED)
def test_kinds(text, kind):
    assert read_markup(text)[0] == [kind]


def test_structure_is_kept():
    clean = read_markup("<h3>Top</h3>\n<ul>\n<li>one\n<li>two</ul>\n\n## Sub ##\n\n* x **bold** [l](u)\n\n```py\na_b = 1\n```\n\nIs $x^2$ &amp; more.\n\\section{S}\n\\begin{itemize}\n\\item y\n\\end{itemize}\n'''w'''")[1]
    for part in ("### Top", "- one", "- two", "## Sub", "- x bold l", "```py\na_b = 1\n```", "Is $x^2$ & more.", "# S", "- y", "\nw"):
        assert part in clean, part
    assert "**" not in clean and "<" not in clean and "'''" not in clean
    assert read_markup("{|\n! a !! b\n|-\n| 1 || 2\n|}")[1] == "| a | b |\n| 1 | 2 |"


def test_wiki_tables_need_their_end():
    for text in ("{|x| < 1} holds.\nAll else\nstays.", "a\n{| class=w\n| 1\n\nMore text."):
        assert read_markup(text) == ([], text)
    assert read_markup("{|x| < 1}\nb\n{|\n| 1\n|}\nc")[1] == "{|x| < 1}\nb\n| 1 |\nc"


def test_wiki_tables_are_kept_whole():
    assert read_markup("{|\n|+ The caption\ngoes on\n|-\n| a\nand more || b\n! c\nlast\n|}\nend")[1] == "The caption goes on\n| a and more || b |\n| c last |\nend"
    clean = read_markup("{|\n| out\n{|\n| in\n|}\n|}")[1]
    assert "out" in clean and "in" in clean and "{|" not in clean and "|}" not in clean


def test_readings_have_no_depth_or_length():
    long = "$" + " + ".join(f"x_{i}''y''" for i in range(100)) + "$"
    assert read_markup(f"so {long} holds") == (["latex"], f"so {long} holds")
    assert read_markup("a {{b|{{c|{{d}}}}}} e") == (["wiki"], "a  e")
    assert read_markup("a {{b|{{{c}}}}} and {{{d}}}")[0] == []
    assert read_markup("\\textbf{\\textit{" * 8 + "a" + "}}" * 8) == (["latex"], "a")
    assert read_markup("{\\it a {\\bf b {\\em c}}}")[1] == "a b c"
    assert read_markup("\\section{\\textbf{\\emph{\\textit{a}}}}")[1] == "# a"
    assert read_markup("**a *b __c _d ~~e *f* e~~ d_ c__ b* a**")[1] == "a b c d e f e d c b a"
    assert read_markup("| a | b |\n|---|---|\n| `see https://a.example/x` | <https://b.example> |")[1].count("https://") == 2
    deep = read_markup("{|\n| 1\n{|\n| 2\n{|\n| 3\n{|\n| `https://a.example/x`\n|}\n|}\n|}\n|}")[1]
    assert "\ue000" not in deep and all(x in deep for x in ("1", "2", "3", "https://a.example/x"))


PAGE = """<html><head><title>Knowledge base</title></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">All notes</a></li><li><a href="/b">Contact</a></li></ul></nav>
<div class="main"><h1>The archive</h1><p>The archive was founded in 1853 by the guild, which kept its records, maps and letters in two rooms. It grew quickly, and was moved twice.</p>
<p>Its first keeper, a copyist, wrote an index of all letters; the index is lost, but <a href="q">quotations</a> of it remain in three later works.</p>
<ul><li>letters of the guild</li><li>maps, see <a href="m">there</a></li></ul>
<pre>x = 1</pre>
<p>The rate is $x^2$ per year, as the second keeper noted in the margin of his own copy.</p>
<table><tr><td>1853</td><td>founded</td></tr></table>
<div>The rooms were painted green, which the visitors of that time mention in nearly all of their letters.</div></div>
<footer>Imprint</footer></body></html>"""


def test_residue_of_a_page_goes_and_structure_stays():
    reading = Reading(PAGE)
    gone = " ".join(t for (_, t), keep in zip(reading.blocks, reading.kept) if not keep)
    for part in ("Home", "All notes", "Contact", "Imprint"):
        assert part in gone and part not in reading.text
    for part in ("# The archive", "- letters of the guild", "- maps, see there", "x = 1", "$x^2$", "1853", "| founded", "moved twice.", "quotations of it", "painted green"):
        assert part in reading.text and part not in gone
    assert reading.kinds == ["html", "latex"]


def test_kinds_are_the_families_of_the_tree():
    reading = Reading("# A\n\n- [b](u) and ''c'' in <div><b>d</b></div> $x^2$ {{t|`e`}}")
    paths = {p for p, _ in reading.tree}
    assert ("markdown:h",) in paths and ("markdown:link",) in paths and ("html:div", "html:b") in paths and ("wiki:template", "markdown:span") in paths
    assert reading.kinds == ["html", "latex", "markdown", "wiki"] == sorted({t.split(":")[0] for p in paths for t in p})


def test_blocks_alike_have_no_residue():
    assert all(Reading("<div>One</div><div>Two</div><nav>Three</nav>").kept)
    assert Reading("Short.<div>A</div>").text == "Short.\nA"
    blocks = [(("html:div", "html:p"), "A long paragraph, with marks, of many words. " * 5)] * 4 + [(("html:nav", "html:a"), "Home"), (("html:li",), "y"), ((), "\n")]
    ratios = path_ratios(blocks)
    assert ratios["html:nav", "html:a"] < ratios["html:div", "html:p"] and () not in ratios
    assert select_blocks(blocks) == [True] * 4 + [False, True, True]


def test_own_private_characters_stay():
    for text in ("a \ue000 b *c*", "`x \ue0000\ue001 y` **z**", "\ue0020\ue003 <b>q</b> \ue004", "```\n\ue0011\ue000\n```"):
        assert [c for c in read_markup(text)[1] if "\ue000" <= c <= "\ue004"] == [c for c in text if "\ue000" <= c <= "\ue004"]
    deep = "| a | b |\n|---|---|\n| $x `y` z$ | c |"
    assert read_markup(deep) == (["latex", "markdown"], "| a | b |\n| $x y z$ | c |")


def test_residue_in_data_is_found_in_no_plain_sentence(spark):
    """Layout elements around whole sentences aren't residue."""
    text = "The first note is here, and long enough.\n<div class='x'><span>Both the seed and the loom point to one place.</span></div>\n" + "Some more text, of the same kind, follows it. " * 20
    assert "Both the seed and the loom" in read_markup(text)[1]


def test_rows(spark):
    df = spark.createDataFrame([("t", "a", "**b**", 1), ("t", "b", None, 1), ("t", "c", "", 1), ("t", "a", "**b**", 2)], "table_name string, record_key string, text string, kinds int")
    got = sorted(((r.record_key, tuple(r.kinds), r.clean) for r in clean_markup(df).collect()), key=repr)
    assert got == [("a", ("markdown",), "b"), ("a", ("markdown",), "b"), ("b", (), None), ("c", (), "")]
    assert clean_markup(df.limit(0)).collect() == []


@pytest.mark.parametrize("bit", ["*", "[[", "<div>", "{{a", "$a ", "\\[", "> ", "| - ", "&a", "_a", "''a"])
def test_long_repetitions_end(bit):
    read_markup(bit * 4000)
