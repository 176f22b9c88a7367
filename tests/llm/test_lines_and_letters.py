"""Problems 5, 6 and 7."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliomine.llm import lookalike as L
from foliomine.llm import scan_noise as N
from foliomine.llm import site_lines as S

SCHEMA = "block_id long, doc string, text string, source string, h long, removed_lines string"


def site_rows(seed: int = 1, hot: str = "hot", n: int = 900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        doc = hot if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        lines = [f"unique {rng.choice('abcdef')}{rng.choice('ghijk')} words {rng.choice('lmnop')} number {i}"]
        if rng.random() < 0.2:
            lines.insert(0, f"© {i} {doc} Press.  All rights   reserved.")
        if rng.random() < 0.04:
            lines.append("Share this page")
        if rng.random() < 0.5:
            lines += ["12", "ab"]
        out.append((i, doc, rng.choice(["\n".join(lines)] * 9 + [None, ""]), "clash", 5, "clash"))
    return out


def brute(rows):
    per, total = defaultdict(Counter), Counter()
    norm = lambda x: re.sub(r"[ \t]+", " ", re.sub("[0-9]+", "", x.lower())).strip()
    keep = lambda x: sum(c.isalpha() for c in x) >= 3
    for _, doc, text, *_ in rows:
        if doc is None:
            continue
        total[doc] += 1
        for line in {norm(x) for x in (text or "").split("\n")}:
            if keep(line):
                per[doc][line] += 1
    return {(i, k + 1) for i, doc, text, *_ in rows if doc is not None for k, x in enumerate((text or "").split("\n")) if keep(norm(x)) and per[doc][norm(x)] >= 5 and per[doc][norm(x)] >= 0.03 * total[doc]}


def test_site_lines_equal_brute_force(spark):
    rows = site_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 100
    assert {tuple(r) for r in S.marked_lines(df, "doc", "text", "block_id").collect()} == want
    clean = {r["block_id"]: (r["text"], r["removed_lines"]) for r in S.without_site_lines(df, "doc", "text", "block_id").collect()}
    for i, _, text, *_ in rows:
        bad = {k for j, k in want if j == i}
        assert clean[i] == (text if not bad else "\n".join(x for k, x in enumerate(text.split("\n"), 1) if k not in bad), len(bad))


def test_a_line_of_every_site_is_one_of_each(spark):
    rows = [(i, f"d{i % 4}", f"same for all\nown words {'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}", None, None, None) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(i, 1) for i in range(80)} <= {tuple(r) for r in S.marked_lines(df, "doc", "text", "block_id").collect()}
    one = df.where("doc = 'd1'")
    assert {r["line_no"] for r in S.marked_lines(one, "doc", "text", "block_id").collect()} >= {1}


def test_the_test_rejects_chance_repeats_and_decides_without_floors(spark):
    """A line twice among thousands of rows is no more than chance over all pairs; lifting the level lets it through."""
    pool = [f"common {a}{b} line" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]
    rng = random.Random(8)
    rows = [(i, f"d{i % 3}", rng.choice(pool) + ("\nFrom the site of one" if i % 3 == 0 and i % 9 == 0 else ""), None, None, None) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    strict = S.excess_lines(df, "doc", "text", "block_id")
    assert strict.count() < S.excess_lines(df, "doc", "text", "block_id", fdr=1.0).count() / 3
    assert strict.where("share > 0.1").select("source").collect()[0][0] == "d0"
    marked = lambda **p: {(r[0], r[1]) for r in S.marked_lines(df, "doc", "text", "block_id", min_rows=2, min_share=0.0, **p).collect()}
    assert {(i, 2) for i in range(0, 1500, 9)} <= marked() < marked(fdr=1.0)


def test_site_lines_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.marked_lines(df, "doc", "text", "block_id").count() == 0
    assert S.without_site_lines(df, "doc", "text", "block_id").count() == 0
    long = spark.createDataFrame([(1, "d", "line of words\n" * 20_000, "", 1, "")], SCHEMA)
    assert S.marked_lines(long, "doc", "text", "block_id").count() == 0


WORDS = ["patients", "with", "access", "score", "voice", "fenêtre", "window", "lower", "a"]


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("ｖｏｉｃｅ ５", "voice 5", {"fullwidth"}),
        ("fene\u0302tre", "fenêtre", {"combining"}),
        ("pat\u200bients wi\u00adth", "patients with", {"invisible"}),
        ("with\u00a0voice\u3000x", "with voice x", {"space"}),
        ("раtіеntѕ", "patients", {"lookalike"}),
        ("ѕсоrе and νoice windοw", "score and voice window", {"lookalike"}),
        ("unlistеd", "unlisted", {"lookalike"}),
        ("Раtіеntѕ", "Patients", {"lookalike"}),
        ("TGF-β, α = 0.05, 5 µm, x², “quoted” – dash, fenêtre", None, set()),
        ("IFNγ and TNFα", None, set()),
        ("У пациентов оса", None, set()),
        ("plain", None, set()),
    ],
)
def test_look_alikes(text, clean, kinds):
    assert L.Normaliser(WORDS).text(text) == (clean or text, kinds)


def test_the_trie_prefers_the_cheapest_spelling():
    trie = L.Trie(["resume", "résumé"])
    assert trie.match("résumé") == (0.0, "résumé") and trie.match("RESUME") == (0.0, "resume")
    assert trie.match("re\u0301sume", 0.5) == (0.5, "resume") and trie.match("other") is None


def test_the_automaton_takes_the_written_token():
    """Ignorables left out, accents apart, more or less, full-width and look-alike letters, all in one token."""
    trie = L.Trie(["fenêtre", "voice"])
    assert trie.align("ｖ\u200bо\u00adісе", 0.0) == (0.0, 4, "voice")
    assert trie.align("fene\u0302\u200btre", 0.0) == (0.0, 0, "fenêtre") == trie.align("fenêtre", 0.0)
    assert trie.align("fenetre", 0.5) == (0.5, 0, "fenêtre") and trie.align("fe\u0301ne\u0302tre", 0.5) == (0.5, 0, "fenêtre")
    assert trie.align("fenetre", 0.0) is None and trie.align("v", 0.5) is None and trie.align("", 0.5) is None
    assert L.Normaliser(["voice"]).token("ｖ\u200bо\u00adісе")[:2] == ("voice", frozenset({"fullwidth", "invisible", "lookalike"}))


def test_look_alike_frames(spark):
    rows = [(1, "раtіеntѕ", [["раtіеntѕ", None], None]), (2, None, None), (3, "", []), (4, "x\u200b" * 40_000, [["ok"]]), (5, "plain", [[None]])]
    df = spark.createDataFrame(rows, "k long, t string, r array<array<string>>").withColumn("text", F.lit(1)).withColumn("rec_id", F.lit("c"))
    assert sorted(tuple(r) for r in L.kinds_found(df, WORDS, "k", "t").collect()) == [(1, "lookalike"), (4, "invisible")]
    assert {r["rec_id"]: r["text"] for r in L.normal_texts(df, WORDS, "k", "t").collect()} == {1: "patients", 2: None, 3: "", 4: "x" * 40_000, 5: "plain"}
    assert {r["rec_id"]: r["rows"] for r in L.normal_cells(df, WORDS, "k", "r").collect()} == {1: [["patients", None], None], 2: None, 3: [], 4: [["ok"]], 5: [[None]]}
    assert L.kinds_found(df.where("k < 0"), WORDS, "k", "t").count() == 0


VOCABULARY = "the posterior triangle is best inspected with stroboscopy before any surgery was planned in patients and fungal sinusitis of first hours drain field long term pre operative cone beam imaging recess swallow a after which it may be seen at once".split()


@pytest.fixture(scope="module")
def decoder():
    return N.Decoder(N.Vocabulary(dict.fromkeys(VOCABULARY, 1000), 100_000, VOCABULARY))


LINE = "the posterior triangle is best inspected with"


@pytest.mark.parametrize(
    "text, kinds, repaired",
    [
        (f"{LINE} stro-\nboscopy before any surgery", {"hyphen"}, f"{LINE} stroboscopy before any surgery"),
        (f"{LINE} stro¬\nboscopy before", {"hyphen"}, f"{LINE} stroboscopy before"),
        (f"{LINE} stro- boscopy before", {"hyphen"}, f"{LINE} stroboscopy before"),
        (f"{LINE} cone-\nbeam imaging", {"hyphen"}, f"{LINE} cone-beam imaging"),
        (f"{LINE} pre-\nor long-term imaging", set(), None),
        (f"{LINE} pre- and post", set(), None),
        (f"{LINE} fiingal 5inusitis of", {"ocr"}, f"{LINE} fungal sinusitis of"),
        (f"{LINE} rccess in thc frst 2l hours", {"ocr"}, None),
        (f"{LINE} s w a l l o w imaging in", {"ocr"}, f"{LINE} swallow imaging in"),
        (f"{LINE} s w a l\nl o w, which", {"ocr"}, f"{LINE} swallow, which"),
        (f"{LINE} clrain", {"ocr"}, f"{LINE} drain"),
        (f"{LINE} Xyloquent T1bN2 IL-5 1990s", set(), None),
        (f"{LINE}\n– 43 –\nsurgery", {"page_no"}, f"{LINE} surgery"),
        (f"{LINE} stro-\n735  Compendium – Imaging of fungal sinusitis\nboscopy", {"header", "hyphen"}, f"{LINE} stroboscopy"),
        (f"CHAPTER 7 Imaging of fungal sinusitis\n{LINE}", {"header"}, LINE),
        (f"IMAGING OF FUNGAL SINUSITIS   64\n{LINE}", {"header"}, LINE),
        (f"IMAGING OF FUNGAL SINUSITIS\n{LINE}", set(), None),
        (f"9: Imaging of fungal sinusitis 120\n{LINE}", {"header"}, LINE),
        ("| 1: Imaging of sinusitis 75 | | |\n| the | surgery |", {"header"}, None),
        ("(cid:12) qq ww\n– 4 –", {"page_no"}, "(cid:12) qq ww\n– 4 –"),
        ("raises 5tr0b0sc0py z9 qq xx ww vv kk jj", set(), None),
        ("", set(), ""),
    ],
)
def test_noise(decoder, text, kinds, repaired):
    assert decoder.noise(text, False, False) == kinds
    if repaired is not None:
        assert decoder.repair(text, False, False) == repaired


def test_a_heading_is_no_running_header(decoder):
    assert decoder.noise("CHAPTER 7 Imaging of fungal sinusitis", False, True) == set()


def test_paragraphs_break_after_short_ended_lines():
    wide = "a line that runs over the whole width of the column without"
    assert N.paragraphs([wide, "end here.", "Next one begins and goes on over the width of the column", "and ends."]) == f"{wide} end here.\nNext one begins and goes on over the width of the column and ends."
    assert N.paragraphs(["1. one", "2. two"]) == "1. one\n2. two"
    assert N.paragraphs([]) == ""


def test_noise_frames(spark):
    good = " ".join(VOCABULARY)
    rows = [("t", i, good, False) for i in range(30)] + [("t", 90, None, False), ("t", 91, "", False), ("t", 92, f"{good} fiingal", False), ("t", 92, f"{good} fiingal", False), ("t", 93, (good + "\n") * 400 + "stro-\nboscopy", False)]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, text string, heading boolean").withColumn("suspect", F.lit("clash")).withColumn("word", F.lit(1))
    counts, total = N.word_counts(df)
    assert counts["posterior"] == 432 and total == sum(counts.values())
    found = sorted(tuple(r) for r in N.noise_found(df, counts, total, VOCABULARY).collect())
    assert found == [("t", 92, "ocr"), ("t", 92, "ocr"), ("t", 93, "hyphen")]
    texts = {r["rec_id"]: r["text"] for r in N.repaired(df, counts, total, VOCABULARY).collect()}
    assert texts[90] is None and texts[91] == "" and texts[92].endswith("fungal") and texts[93].endswith("stroboscopy")
    empty = df.where("rec_id < 0")
    assert N.noise_found(empty, *N.word_counts(empty), VOCABULARY).count() == 0


def test_reading_by_windows_equals_the_full_decode(spark):
    """On every record of the small tables: the kinds found window by window are those of one program over the whole stream."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    from foliomine.llm.encoding import word_list
    from foliomine.llm.queries import _scanned
    from foliomine.session import table

    texts = _scanned(spark, folder)
    counts, total = N.word_counts(texts)
    decoder = N.Decoder(N.Vocabulary(counts, total, word_list(table(spark, folder, "word_freq"))))
    compared = 0
    for r in texts.where("text is not null").toLocalIterator():
        lines, _, junk, odd = decoder.read(decoder.normal.text(r["text"])[0])
        full = decoder.decode(decoder.stream(lines))[1]
        assert decoder.operations(lines) == full, r["text"]
        assert odd or not full
        compared += 1
    assert compared > 3_000
