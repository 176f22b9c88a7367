"""Problem 4: statistics of each text and a verdict whether it is prose, a list, a table or junk.

Everything is a column expression: one scan, no shuffle, no Python.  The statistics are taken first: those of the
published web-text rules (mean word length, symbols and letters per word, common words, bullets, ellipses, ends of
lines), and the shares of the characters that stand in lines of items and entries, in lines of columns, in lines of
garbage, in running headers and page numbers, and (in tables) in rows of running sentences.  Fixed thresholds turn them
into ``reasons``, one name for each rule that fails, and ``text_class`` is read from the reasons alone (``VERDICTS``):
a structural reason says what the text looks like, the published rules say whether it is natural prose.

Null and blank texts get zero statistics, no reasons and the class ``none``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import JAVA_INVISIBLE, JAVA_SPACES

#: Common words by which prose is known, of the languages of the corpus; single Latin letters tell nothing.
COMMON = (
    "the be to of and that have with is in for was by are as or from may not "
    "der die das und ist nicht mit von bei le la les des et est une dans pour pas "
    "el los las que es con por os da do em não um uma para "
    "na się jest nie и в на с не что по при"
)
COMMON_WORD = r"(?<!\p{L})(?:" + "|".join(COMMON.split()) + r")(?!\p{L})"
WORD_LENGTH = (3.0, 10.0)
SYMBOL_RATIO = 0.1
ALPHA_WORDS = 0.8
BULLET_LINES = 0.9
ELLIPSIS_LINES = 0.3
LEAST_COMMON = 2
#: The greater part of a text.
MAJORITY = 0.5
#: Texts of fewer words are too short for the published rules alone to call them junk.
LEAST_WORDS = 12

#: By what is promised: a class, the reasons that must all be there, and those of which none may be; the first that holds.
VERDICTS = {
    "prose": (
        ("list", ("list_lines",), ()),
        ("table", ("columns", "few_common_words", "few_alpha_words"), ()),
        ("junk", ("furniture",), ()),
        *(("junk", ("garbage", failed), ()) for failed in ("few_common_words", "few_alpha_words", "symbols", "short_words", "long_words")),
        ("junk", ("not_short", "few_common_words", "few_alpha_words"), ("columns",)),
    ),
    "table": (
        ("prose", ("sentences",), ("few_common_words", "few_alpha_words", "short_words", "long_words")),
        ("list", ("list_lines",), ()),
        ("junk", ("garbage", "few_common_words", "few_alpha_words"), ()),
    ),
}

GLYPH = r"\(cid:[0-9]+\)|/g[0-9]+\b"
BULLET = r"^\s*(?:[-*+•‣▪●·–]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)])\s+\S"
CONTENTS = r"\.{4,}\s*[0-9]{1,4}\s*\|?\s*$"
#: Entry and page numbers after commas, as in an index.
INDEX = r"^[^.;:0-9]*\p{L}(?:,\s*[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?){2,40}\s*$"
REFERENCE = r"(?:19|20)[0-9]{2};\s*[0-9]+"
COLUMNS = r"\S(?:\t|\s{2,}|\s\|\s)\S.*\S?(?:\t|\s{2,}|\s\|\s)\S"
PAGE_NO = r"^\s*(?:[-–—\[(|]\s*)?(?:p\.?\s*|page\s+)?[0-9]{1,4}(?:\s*[-–—\])|])?\s*$"
RUNNING = (
    r"^\s*(?:(?:(?i:chapter|section|part))\s+[0-9]+\s*[|·:–-]?\s*\S.{2,90}"
    r"|[0-9]{1,4}\s*:\s+\S.{2,90}\s[0-9]{1,4}"
    r"|[0-9]{1,4}\s+\p{L}[^|]{1,50}\s[–|·]\s\p{L}[^|]{2,90}"
    r"|\p{L}[^|]{2,90}\s[–|·]\s\p{L}[^|]{1,50}\s[0-9]{1,4}"
    r"|[^\p{Ll}]{6,110}\s{2,}[0-9]{1,4})\s*$"
)


#: The columns that are added.
RESULTS = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "alpha_share", "common_share", "stop_line_share", "bullet_line_share", "ellipsis_line_share", "list_share", "column_share", "garbage_share", "furniture_share", "sentence_share", "reasons", "text_class")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _plain(text: Column) -> Column:
    """Without invisible characters, other spaces as plain ones, so that they change no verdict."""
    odd = text.rlike(f"[{JAVA_INVISIBLE}{JAVA_SPACES}]")
    return F.when(odd, F.regexp_replace(F.regexp_replace(text, f"[{JAVA_INVISIBLE}]", ""), f"[{JAVA_SPACES}]", " ")).otherwise(text)


def _junk_line(line: Column) -> Column:
    """Glyph codes, symbols only, one character over and over, runs of one or two letters, letters mixed with digits."""
    glyphs = line.rlike(GLYPH) & (F.length(F.regexp_replace(line, GLYPH, "")) * 2 < F.length(line))
    symbols = line.rlike(r"^[^\p{L}\p{N}]{6,}$")
    # nothing that nests deeper as the line grows: a line of any length must do
    repeat = ~line.rlike(r"(\S)\s*(?!\1|\s)\S") & (F.length(line) >= 10)
    soup = ~line.rlike(r"\p{L}{3}|[^\p{L}\s]") & (_count(line, r"\S+") >= 8)
    coded = line.rlike(r"(?:^|\s)[\p{L}#]*[0-9#][0-9#]*\p{L}[\p{L}0-9#]*\s") & (
        _count(line, r"(?:^|(?<=\s))(?=\S*\p{L})(?=\S*[0-9#])[\p{L}0-9#]+(?=\s|$)") * 5 >= _count(line, r"\S+") * 2
    )
    return glyphs | symbols | repeat | soup | coded


def _block_line(line: Column) -> Column:
    return (
        F.when(~line.rlike(r"\S"), "blank")
        .when(line.rlike(PAGE_NO), "page")
        .when(line.rlike(CONTENTS) | line.rlike(BULLET) | line.rlike(INDEX) | (line.rlike(REFERENCE) & line.rlike(r"^\s*\[?[0-9]")), "list")
        .when(_junk_line(line), "junk")
        .when((F.length(line) < 150) & line.rlike(RUNNING), "page")
        .when(line.rlike(COLUMNS), "table")
        .otherwise("prose")
    )


def _sentence(cell: Column) -> Column:
    """Eight words in a row at least, and an end of a sentence at the end of the cell."""
    return cell.rlike(r"[\p{L}\p{N}’'–-][.!?]\s*$") & cell.rlike(r"(?<![\p{L}\p{N}’'–-])(?:[\p{L}\p{N}’'–-]++[,;:]?\s++){8}")


def _table_line(line: Column) -> Column:
    bare = F.regexp_replace(line, GLYPH, "")
    return (
        F.when(~line.rlike(r"[^|:\-\s]"), "blank")
        .when(line.rlike(CONTENTS) | line.rlike(r"\p{L},\s*[0-9]{1,4},\s*[0-9]{1,4}\s*[-–]\s*[0-9]{1,4}\s*(?:\||$)"), "list")
        .when(~bare.rlike(r"[\p{L}\p{N}]"), "junk")
        .when(line.rlike(PAGE_NO), "page")
        .when(line.rlike(r"[\p{L})]\.\s+\p{Lu}\p{Ll}*\s+\p{Ll}") | (line.rlike(r"[\p{L}\p{N}’'–-][.!?]\s*(?:\||$)") & F.exists(F.split(line, r"\|"), _sentence)), "prose")
        .otherwise("table")
    )


def _prepared(df: DataFrame, text: str, promised: str, own: Column) -> DataFrame:
    """``_own``, the body, its lines with their types, and the characters that stand in lines of each type."""
    df = df.select(own.alias("_own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_body"))
    kind = _block_line if promised == "prose" else _table_line
    df = df.withColumn("_lines", F.split(_plain(F.col("_body")), "\n"))
    df = df.withColumn("_typed", F.transform("_lines", lambda x: F.struct(kind(x).alias("k"), F.length(F.trim(x)).alias("n"))))
    size = lambda k: F.aggregate("_typed", F.lit(0), lambda a, x: a + F.when(x["k"] == k, x["n"]).otherwise(0))
    df = df.withColumns({f"_{k}": size(k) for k in ("prose", "list", "table", "junk", "page")})
    # one row of columns alone is a site line; a table has at least two
    rows = F.size(F.filter("_typed", lambda x: x["k"] == "table"))
    columns = F.when(rows < 2, 0).otherwise(F.col("_table")) if promised == "prose" else F.lit(0)
    # headers and page numbers are no part of a text that has another
    return df.withColumns({"_columns": columns, "_size": F.col("_prose") + F.col("_list") + F.col("_table") + F.col("_junk")})


def _statistics(promised: str) -> dict[str, Column]:
    """The statistics by name, over the columns of ``_prepared``."""
    body = F.col("_body")
    words = _count(body, r"\S+")
    lines = F.size(F.filter("_typed", lambda x: x["k"] != "blank"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    matching = lambda pattern: F.size(F.filter("_lines", lambda x: x.rlike(pattern)))
    size, page = F.col("_size"), F.col("_page")
    return {
        "n_chars": F.length(body),
        "n_words": words,
        "n_lines": lines,
        "mean_word_length": part(F.length(body) - _count(body, r"\s"), words),
        "symbol_ratio": part(_count(body, r"[^\p{L}\p{N}\p{M}\s.,;:!?()'\"’“”‘\-–—%/]"), words),
        "alpha_share": part(_count(body, r"(?<!\S)[^\s\p{L}]*+\p{L}"), words),
        "common_share": part(_count(F.lower(body), COMMON_WORD), words),
        "stop_line_share": part(matching(r"[.!?][)\]\"”’*]*\s*$"), lines),
        "bullet_line_share": part(matching(BULLET), lines),
        "ellipsis_line_share": part(matching(r"(?:\.\.\.|…)\s*$"), lines),
        "list_share": part(F.col("_list"), size),
        "column_share": part(F.col("_columns"), size),
        "garbage_share": part(F.col("_junk"), size),
        "furniture_share": part(page, page + size),
        "sentence_share": part(F.col("_prose"), size) if promised == "table" else F.lit(0.0),
    }


def _failures(of: Callable[[str], Column]) -> dict[str, Column]:
    """The rules by name, over statistics: true where a rule fails."""
    return {
        "short_words": of("mean_word_length") < WORD_LENGTH[0],
        "long_words": of("mean_word_length") > WORD_LENGTH[1],
        "symbols": of("symbol_ratio") > SYMBOL_RATIO,
        "few_alpha_words": of("alpha_share") < ALPHA_WORDS,
        "bullets": of("bullet_line_share") > BULLET_LINES,
        "ellipses": of("ellipsis_line_share") > ELLIPSIS_LINES,
        # fewer than LEAST_COMMON; the second one ends the search
        "few_common_words": ~F.lower("_body").rlike("(?s)" + ".*?".join([COMMON_WORD] * LEAST_COMMON)),
        "list_lines": of("list_share") >= MAJORITY,
        "columns": of("column_share") >= MAJORITY,
        "garbage": of("garbage_share") >= MAJORITY,
        "furniture": of("furniture_share") == 1.0,
        "sentences": of("sentence_share") >= MAJORITY,
    }


def _verdict(failed: dict[str, Column], promised: str) -> Column:
    """The class by ``VERDICTS``."""
    failed = failed | {"not_short": F.col("_body").rlike(r"(?:\S++\s++){%d}\S" % (LEAST_WORDS - 1))}
    out = F.when(~F.col("_body").rlike(r"\S"), "none")
    for name, there, absent in VERDICTS[promised]:
        condition = failed[there[0]]
        for k in there[1:]:
            condition = condition & failed[k]
        for k in absent:
            condition = condition & ~failed[k]
        out = out.when(condition, name)
    return out.otherwise(promised)


def text_classes(df: DataFrame, text: str, promised: str, *own: str) -> DataFrame:
    """The named columns and ``text_class`` alone: the same verdict, with a statistic computed only where a rule asks for it."""
    ready = _prepared(df, text, promised, F.struct(*[F.col(f"`{c}`") for c in own]))
    statistics = _statistics(promised)
    return ready.select(*[F.col("_own")[c].alias(c) for c in own], _verdict(_failures(statistics.__getitem__), promised).alias("text_class"))


def quality(df: DataFrame, text: str, promised: str) -> DataFrame:
    """Add the statistics, ``reasons`` and ``text_class`` of a text column.

    ``promised`` is what the table should hold: ``prose`` takes lines as they are, ``table`` as rows of a pipe table.
    Extra columns pass through; one that has the name of a result is replaced by it.  A text without a verdict of
    ``VERDICTS`` is what was promised.
    """
    own = [c for c in df.columns if c not in RESULTS]
    ready = _prepared(df, text, promised, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    ready = ready.withColumns(_statistics(promised))
    failed = _failures(F.col)
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]), lambda x: x.isNotNull())
    ready = ready.withColumn("reasons", F.when(F.col("n_words") == 0, F.array().cast("array<string>")).otherwise(reasons))
    ready = ready.withColumn("text_class", _verdict({k: F.array_contains("reasons", k) for k in failed}, promised))
    return ready.select(*[F.col("_own")[c].alias(c) for c in own], *RESULTS)
