from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomine.functions import tables as T
from foliomine.functions import text as X
from foliomine.operators import cite, filters, retrieve
from foliomine.operators.chunking import n_windows, token_chunks

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, expression, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(expression).collect()]


@FEW
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_strip_and_squash_are_pythons(spark, texts):
    texts = [t.replace("\x00", "") for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    if texts:
        assert values(spark, X.strip(F.col("t")), texts) == [t.strip() for t in texts]
        assert values(spark, X.squash(F.col("t")), texts) == [" ".join(t.split()) for t in texts]
        assert values(spark, X.tokens(F.col("t")), texts) == [re.findall("[a-z0-9]+", t.lower()) for t in texts]


def test_mask_name(spark):
    assert values(spark, X.mask_name(F.col("t")), ["JANE ROE", " ", None, "al", "  ute x"]) == ["Dr. Jan**", "Dr. Anonymous", "Dr. Anonymous", "Dr. Al**", "Dr. Ute**"]


def test_title_case_and_natural_key(spark):
    assert values(spark, X.title_case(F.col("t")), ["src1a x-y"]) == ["Src1A X-Y"]
    ids = ["p1_b10", "p1_b2", "p1_b2_c0"]
    keys = values(spark, X.natural_key(F.col("t")), ids)
    assert [i for _, i in sorted(zip(keys, ids, strict=True))] == ["p1_b2", "p1_b2_c0", "p1_b10"]


def test_pieces_guard_the_empty_text(spark):
    got = values(spark, X.pieces(F.col("t"), 700, 600), ["", None, "x" * 1250])
    assert [len(g) for g in got] == [0, 0, 3]
    assert [(p["start_char"], len(p["piece"])) for p in got[2]] == [(0, 700), (600, 650), (1200, 50)]


def test_tables(spark):
    rows = [[["a", None], ["", ""], ["b\u00ad\nc", "d-\ne", "x"]], [], None]
    assert values(spark, T.to_markdown(F.col("t")), rows, "t array<array<string>>") == ["| a |  |  |\n| --- | --- | --- |\n| bc | d-e | x |", "", ""]
    assert values(spark, T.to_markdown_by_header(F.col("t")), [[["a", "b"], ["1"], ["1", "2", "3"]]], "t array<array<string>>") == ["| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"]
    assert values(spark, T.quality(F.col("t")), [None], "t array<array<string>>")[0]["keep"] is False
    assert values(spark, T.caption(F.col("t"), F.lit(None).cast("string")), ["| TABLE 79.1 Granulomatous conditions |"]) == ["Granulomatous conditions"]
    assert values(spark, T.collapse_repeats(F.col("t")), ["| TX | Unable to assess | Unable to assess |", "| same | same |", "plain ", "|---|\n| a | " + "b" * 20 + " | " + "b" * 20 + " |"]) == ["TX | Unable to assess | Unable to assess", "same", "plain", "a | " + "b" * 20]
    index = "\n".join(f"| term {i}, {i} | |" for i in range(8))
    assert values(spark, T.is_navigation(F.col("t")), [index, index.split("\n")[0], "| Table 1 |\n" + index, None]) == [True, False, False, False]
    assert values(spark, T.is_droppable(F.col("t")), ["Fig. 3 x", "| 12.3 | video |", "| 12.3 | box |", None]) == [True, True, False, False]
    assert values(spark, T.is_fragment(F.col("t"), F.lit(None).cast("string")), ["| K+ |", "| Table 1.2 x |", "x" * 60]) == [True, False, False]


def test_prose_filters(spark):
    header = "79: Granulomatous conditions of the nose 857"
    assert values(spark, filters.is_running_header(F.col("t")), [header, "79 Granulomatous", None, header + "x" * 90]) == [True, False, False, False]
    rows = [("short", None), ("long enough to be kept here", "Subject Index"), ("long enough to be kept here", "References"), (header, None), ("long enough to be kept here", None)]
    assert values(spark, filters.drop_reason(F.col("t"), F.col("s")), rows, "t string, s string") == ["too_short", "index", "reference", "running_header", None]
    assert values(spark, filters.is_figure_caption(F.col("t")), ["Fig. 3", "FIGURE 2 x", "Figment 3", None]) == [True, True, False, False]


def test_windows_of_tokens(spark):
    counts = [254, 255, 476, 477, 700]
    assert values(spark, n_windows(F.col("t")), counts, "t int") == [1, 2, 2, 3, 4]
    text = " ".join(f"w{i}" for i in range(600))
    got = token_chunks(spark.createDataFrame([(1, text), (2, "a few"), (3, None)], "k int, t string"), "k", "t").collect()
    parts = [r["piece"] for r in got if r["k"] == 1]
    assert len(parts) == 3 and set(" ".join(parts).split()) == set(text.split())
    assert [r["piece"] for r in got if r["k"] == 2] == ["a few"]


def test_acronyms(spark):
    known = {"FESS": "functional endoscopic sinus surgery", "US": "ultrasound", "PET": "positron emission tomography", "ESS": "sinus surgery"}
    asked = ["complications of FESS", "FESS then FESS", "an us pet", "US and fess, ESS", None]
    assert values(spark, retrieve.expand_acronyms(F.col("t"), known), asked) == [
        "complications of FESS (functional endoscopic sinus surgery)",
        "FESS (functional endoscopic sinus surgery) then FESS",
        "an us pet",
        "US (ultrasound) and fess (functional endoscopic sinus surgery), ESS (sinus surgery)",
        "",
    ]


def test_aliases(spark):
    known = {"auralis": "auralis", "otto-braun": "otto", "otto braun": "otto", "otto": "otto", "vella & moran": "vella", "vella": "vella"}
    asked = ["Otto Braun vs vella & moran", "a novella of signs", "none", None]
    assert values(spark, retrieve.route_aliases(F.col("t"), known), asked) == [["vella", "otto"], ["vella"], None, None]


def test_markers_and_refusals(spark):
    answers = spark.createDataFrame([(1, "[auralis, p.3431] [vestibula, p.1042] [auralis p. 3431]"), (2, "[auralis, p.3431; vestibula, p.1042] [x, p.742-743]"), (3, None)], "id int, answer string")
    got = {(r["id"], r["pos"], r["book"], r["page"]) for r in cite.markers(answers, "id", "answer").collect()}
    assert got == {(1, 0, "auralis", "3431"), (1, 1, "vestibula", "1042")}
    assert values(spark, cite.is_refusal(F.col("t"), "nothing found"), ['"# Nothing found here', "x" * 360 + " nothing found", "well, nothing found", None]) == [True, False, True, False]


def test_citations_take_one_part_of_a_table(spark):
    found = spark.createDataFrame([(1, "b", "7", 0), (1, "c", "083", 1)], "id int, book string, page string, pos int")
    picked = spark.createDataFrame([(1, "b_p7_t0_c1", "B", 7, "table", "x"), (1, "b_p7_t0_c0", "B", 7, "table", "y"), (1, "b_p7_b10", "B", 7, "prose", "z"), (1, "b_p7_b2", "B", 7, "prose", "w"), (1, "c", "C", 83, "prose", "v")], "id int, cid string, source string, page int, type string, doc string")
    got = cite.citations(found, picked, "id", chunk_id="cid").collect()
    assert [(r["cite_no"], r["page"], r["ids"], r["passages"]) for r in got] == [(0, 7, ["b_p7_b2", "b_p7_b10", "b_p7_t0_c0"], ["w", "z", "y"])]


def test_replies(spark):
    kind = "t string, c array<struct<book:string,page:int>>"
    rows = [("a", [("otto_braun", 3), ("otto_braun", 3), (None, 4), ("x", None), (None, None)]), ("b", None)]
    assert values(spark, cite.reply_with_sources(F.col("t"), F.col("c")), rows, kind) == ["a\n\n— Sources: Otto Braun p.3; p.4; X", "b"]
    assert values(spark, cite.envelope(F.col("t"), F.col("c"), F.lit(True)), [("b", None)], kind) == ["b\n\nSources: none\nGrounded: yes"]
