"""Problems 3 and 4."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliomine.llm import markup as M
from foliomine.llm import text_quality as Q


@pytest.mark.parametrize(
    "text, kinds, clean",
    [
        ("| a | <b>x</b> &#8805; 3 |\n|---|---|\n| 0.001** | *masked |", {"html"}, "| a | x ≥ 3 |\n| 0.001** | *masked |"),
        ("| **a** | *b* | __c__ | ~~d~~ | `e` | [f](http://x/y) | g[^1] |", {"markdown"}, "| a | b | c | d | e | f | g |"),
        ("| [[x|y]] | {{unit|5|mg}} | ''z'' | [https://a.b w] |", {"wiki"}, "| y | 5 mg | z | w |"),
        ("| $x_{2}^{3}$ | \\SI{4}{\\milli\\gram} | \\emph{q}\\cite{r} | 9\\,mg |", {"latex"}, "| x_2^3 | 4 mg | q | 9 mg |"),
        ("| [[3]](http://x/y) | ![[3]](i.png) |", {"markdown"}, "| [3] | [3] |"),
        ("| [[a|[3]]] | [https://a.b/4 [3]] |", {"wiki"}, "| [3] | [3] |"),
        ("{| class=\"wikitable\"\n|-\n| a || b\n|-\n| c || d\n|}", {"wiki"}, "| a | b |\n| c | d |"),
        ("\\begin{tabular}{ll}\na & 5\\% \\\\\n\\end{tabular}", {"latex"}, "| a | 5% |"),
        ("<table><tr><td>a</td><td>b, c</td></tr></table>", {"html"}, "| a | b, c |"),
        ("### Head\n\n> quoted\n- [x] done\n```\nx = 1 * 2\n```", {"markdown"}, "Head\n\nquoted\n• [x] done\n    x = 1 * 2"),
        ("== Head ==\n\\[ s = \\frac{a}{b} \\]", {"wiki", "latex"}, "Head\n\n  s = (a)/(b)"),
        ("<h3>T</h3>\n<ul><li>first</li><li>second</li></ul>", {"html"}, "T\n\n• first\n• second"),
        ("| a < b > c | H&N clinic | cost $ 40 | gain_max | [3] | ~ ~ | # | || |", set(), None),
        ("- 38 -", set(), "- 38 -"),
        ("", set(), ""),
    ],
)
def test_markup(text, kinds, clean):
    parser = M.Parser(text, True)
    assert parser.kinds == kinds
    if clean is not None:
        assert M.rendered(M.blocks(parser.root)) == clean


def test_the_best_container_is_kept():
    page = "<html><body><nav><a href=x>Home</a> <a href=y>Index</a></nav><div><p>One, two, three, and a long paragraph of text, with commas.</p><p>Another, longer one, that says more, and more, and more.</p></div><div><a href=z>Related things to read</a></div><footer><p>Imprint</p></footer></body></html>"
    text = M.rendered(M.blocks(M.Parser(page, False).root))
    assert "One, two" in text and "Another" in text and "Home" not in text and "Imprint" not in text


PROSE_DIV = "<div><p>One, two, three, and a long paragraph of text, with commas.</p><p>More, and more.</p></div>"


@pytest.mark.parametrize(
    "page, clean",
    [
        (f"<html><body><div class=menu><a href=x>Home</a> <a href=y>Index</a></div>{PROSE_DIV}</body></html>", "One, two, three, and a long paragraph of text, with commas.\nMore, and more."),
        ("<html><body><div><div><ul><li><a href=x>Home</a></li></ul></div><div><p>One, two, and a long paragraph.</p><p><a href=z>See figure 3</a></p><ul><li><a href=q>Related</a></li></ul></div><p>Short note</p></div></body></html>", "One, two, and a long paragraph.\nSee figure 3\nShort note"),
        ("<html><body><p>Intro, text</p><div><a href=x>Home</a></div><p>More, text</p></body></html>", "Intro, text\nMore, text"),
        ("Table 3 [Outcome of surgery](https://a.b/3)", "Table 3 Outcome of surgery"),
    ],
)
def test_blocks_of_links_go_at_any_depth(page, clean):
    assert M.rendered(M.blocks(M.Parser(page, False).root)) == clean


def test_scoring_decides_what_stands_beside_the_best_container(monkeypatch):
    """Without the scores the scraps stay; with them they go, and lists and sentences stay."""
    page = "<html><body><div><p>Share</p><p>**Print**</p></div>" + PROSE_DIV + "<div><ul><li>first choice</li></ul></div><div><p>A sentence beside it.</p></div></body></html>"
    tree = lambda: M.Parser(page, False).root
    scored = M.rendered(M.blocks(tree()))
    assert "Share" not in scored and "first choice" in scored and "A sentence beside it." in scored and "One, two" in scored
    assert M.markups(tree()) == {"html"}
    monkeypatch.setattr(M, "SIBLING_SHARE", 0.0)
    assert "Share" in M.rendered(M.blocks(tree())) and M.markups(tree()) == {"html", "markdown"}


@pytest.mark.parametrize("size", [10, 5_000])
def test_spans_of_any_length(size):
    body = "x y " * size + "z"
    for text, kind in ((f"a *{body}* b", "markdown"), (f"a __{body}__ b", "markdown"), (f"a \\[ {body}^2 \\] b", "latex"), (f"a ${body}_2$ b", "latex"), (f"$${body}$$", "latex")):
        parser = M.Parser(text, True)
        assert parser.kinds == {kind}
        assert "*" not in M.rendered(M.blocks(parser.root)) and "$" not in M.rendered(M.blocks(parser.root))


def test_signs_that_are_data_stay():
    for text in ("*masked, 0.5 or 0.01", "cost $ 40 and $ 50", "gain_max and loss_max", "$5 and $6", "2 * 3 * 4", "\\[ open"):
        assert not M.Parser(text, True).kinds - {"latex"} and (text[0] == "\\" or not M.Parser(text, True).kinds)
    assert M.rendered(M.blocks(M.Parser("*0.004*** and ***b***", True).root)) == "0.004** and b"


@pytest.mark.parametrize("part", ["<div>x", "<table><tr><td>y", "\\begin{tabular}\n", "**a ", "_a ", "\\[", "{{a|", "[a](", "<!--", "$", "$a_", "\\(", "*a", "_a*"])
def test_texts_of_any_make_are_read(part):
    assert M.blocks(M.Parser(part * 4_000, True).root) is not None


def test_markup_frames(spark):
    rows = [(1, "<b>x</b>"), (2, None), (3, ""), (4, "| a | " * 20_000), (5, "<b>x</b>"), (5, "<b>x</b>")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("text", F.lit(3)).withColumn("rec_id", F.lit("clash"))
    assert sorted(tuple(r) for r in M.markup_found(df, "k", "t", True).collect()) == [(1, "html"), (5, "html"), (5, "html")]
    clean = {r["rec_id"]: r["text"] for r in M.clean_texts(df, "k", "t", True).collect()}
    assert clean[1] == "x" and clean[2] is None and clean[3] == ""
    assert M.markup_found(df.where("k < 0"), "k", "t", True).count() == 0


PROSE = "The surgeon must identify the recess first, because it may be displaced by previous surgery, and the wound is closed."


def classes(spark, texts, promised):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r["text_class"] for r in Q.quality(df, "t", promised).orderBy("k").collect()]


def test_classes_of_blocks(spark):
    cases = {
        PROSE: "prose",
        f"{PROSE}\n1. One item at the end": "prose",
        "1. First thing\n2. Second thing\n3. Third thing": "list",
        "tinnitus, posterior triangle, 834, 1066–1982\notosclerosis, pyriform fossa, 656, 1376–1912": "list",
        "Imaging of tinnitus ......... 129\nOutcome of palsy ........ 250": "list",
        "Drug\tDose\tDays\nx\t1\t2\ny\t3\t4": "table",
        "Site | n | Mean\nnose | 3 | 4\near | 5 | 6": "table",
        "(cid:12)(cid:7) (cid:9)(cid:10)(cid:11)": "junk",
        "/g12 /g7 /g9 /g33": "junk",
        "*" * 50_000: "junk",
        "hh uu v jj bb kk " * 5_000: "junk",
        "z5x0kt10x 5hkh1ttmz 1s3hb97skb 7ts 2bkj1 jm k3xl6j8n6": "junk",
        "– 365 –": "junk",
        "CHAPTER 15 Differential diagnosis of globus sensation": "junk",
        "COMPLICATIONS OF SCHWANNOMA   92": "junk",
        "Yes, see above.": "prose",
        "PAEDIATRIC ASPECTS OF OTITIS": "prose",
        "word " * 40_000: "prose",
        "": "none",
        None: "none",
    }
    assert dict(zip(cases, classes(spark, list(cases), "prose"), strict=True)) == cases


def test_classes_of_tables(spark):
    cases = {
        "| Drug | Dose |\n|---|---|\n| x | 5 |": "table",
        f"| {PROSE} |\n|---|": "prose",
        "| 1 | Outcome of palsy | ........ 871 |\n|---|---|---|\n| 2 | Imaging | ........ 5 |": "list",
        "| # | (cid:36) | || |\n|---|---|---|\n| · | /g4 | -- |": "junk",
        None: "none",
    }
    assert dict(zip(cases, classes(spark, list(cases), "table"), strict=True)) == cases


def test_statistics_reasons_and_names(spark):
    df = spark.createDataFrame([(1, "- a b c\n- d e f\nend…", "own", 7)], "k int, t string, _lines string, n_words int")
    r = Q.quality(df, "t", "prose").collect()[0]
    assert r["_lines"] == "own" and r["n_words"] == 9 and r["n_lines"] == 3
    assert r["bullet_line_share"] == 0.6667 and r["ellipsis_line_share"] == 0.3333
    assert set(r["reasons"]) == {"short_words", "few_common_words", "few_alpha_words", "ellipses"} or "few_common_words" in r["reasons"]
    assert Q.quality(df.where("k < 0"), "t", "prose").count() == 0


def test_the_class_is_read_from_the_reasons(spark, monkeypatch):
    """Each reason a verdict rests on is recorded; without the thresholds nothing but the promise is left."""
    cases = ["1. First thing\n2. Second thing\n3. Third thing", "Drug\tDose\tDays\nx\t1\t2\ny\t3\t4", "(cid:12)(cid:7) (cid:9)(cid:10)(cid:11)", "– 365 –", "x9 4z 7q 8w 5r 3t 2y 6u 1p 9a 8s 7d f5 g4", PROSE]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    rows = {r["k"]: r for r in Q.quality(df, "t", "prose").collect()}
    for r in rows.values():
        said = set(r["reasons"]) | ({"not_short"} if r["n_words"] >= Q.LEAST_WORDS else set())
        first = next((name for name, there, absent in Q.VERDICTS["prose"] if set(there) <= said and not set(absent) & said), "prose")
        assert r["text_class"] == first
    assert [rows[k]["text_class"] for k in range(6)] == ["list", "table", "junk", "junk", "junk", "prose"]
    assert rows[0]["list_share"] == 1.0 and rows[1]["column_share"] == 1.0 and rows[3]["furniture_share"] == 1.0
    assert [r["text_class"] for r in Q.text_classes(df, "t", "prose", "k").orderBy("k").collect()] == [rows[k]["text_class"] for k in range(6)]
    monkeypatch.setattr(Q, "MAJORITY", 2.0)
    monkeypatch.setattr(Q, "COMMON_WORD", "")
    assert {r["text_class"] for r in Q.quality(df, "t", "prose").where("k in (0, 1, 2, 4)").collect()} == {"prose"}


def test_the_greater_part_decides(spark):
    assert classes(spark, ["1. " + "word " * 30 + "\nsome words"], "prose") == ["list"]
    assert classes(spark, ["1. word\n" + "some words " * 30], "prose") == ["prose"]
