"""Column expressions over text.  White space is Unicode white space everywhere, as `str.strip` has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for Java's regular expressions: its own class plus what Unicode adds.
SPACE = r"\s\x0B\x1C-\x1F\x85\u00a0\u1680\u2000-\u200a  \u202f\u205f\u3000"
#: Ends of lines.
LINE_END = r"\n\r\x0B\x0C\x1C-\x1E\x85  "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def norm(c: Column) -> Column:
    """The form captions are compared in: squashed, lower case, '' for null."""
    return F.lower(squash(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def first_line(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"^[^{LINE_END}]*", 0)


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), f"[{LINE_END}]")


def pipe_cells(line: Column) -> Column:
    """The stripped cells of a row of a pipe table."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits compare as numbers of up to 20 digits."""
    parts = F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def title_case(c: Column) -> Column:
    """A capital at the start of every run of letters, the rest small."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def mask_name(c: Column) -> Column:
    """The first three letters of the first name; blank and null names are anonymous."""
    shown = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2)))
    first = F.split(squash(F.coalesce(c, F.lit(""))), " ")[0]
    return let(first, lambda x: F.when(x != "", F.concat(F.lit("Dr. "), shown(x), F.lit("**"))).otherwise("Dr. Anonymous"))


def pieces(c: Column, width: int, step: int | None = None) -> Column:
    """Slices of a fixed width, beginning every ``step`` characters; '' and null give none."""
    step = step or width
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_char"), F.substr(text, s + 1, F.lit(width)).alias("piece")))
