"""Column expressions over tables: cells, rows and pipe-table text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomine.functions.text import SPACE, first_line, let, lines, pipe_cells, squash, strip

RULER = rf"^[{SPACE}]*\|?[{SPACE}|:-]+\|?[{SPACE}]*$"


def clean_cell(c: Column) -> Column:
    """A cell as one line: soft hyphens and control characters go, line ends and thin spaces become spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\u00ad\n?", "")
    c = F.regexp_replace(F.regexp_replace(c, r"-\n", "-"), r"[\n\u00a0\u2009\u202f\u2007\u2060]", " ")
    return squash(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def clean_rows(rows: Column) -> Column:
    """Clean cells; rows without any text are dropped, null rows too."""
    cells = F.transform(F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: r.isNotNull()), lambda r: F.transform(r, clean_cell))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _page(rows: Column, width: Column) -> Column:
    """Header, ruler and body of rows of one width."""
    ruler = _row(F.array_repeat(F.lit("---"), width))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: _row(r))
    return F.array_join(F.concat(F.array(_row(rows[0]), ruler), body), "\n")


def to_markdown(rows: Column) -> Column:
    """Rows as a pipe table padded to the widest row; '' if nothing is left."""

    def padded(kept: Column) -> Column:
        width = F.array_max(F.transform(kept, lambda r: F.size(r)))
        full = let(width, lambda w: F.struct(w.alias("w"), F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))).alias("r")))
        return F.when(F.size(kept) > 0, let(full, lambda x: _page(x["r"], x["w"]))).otherwise("")

    return let(clean_rows(rows), padded)


def to_markdown_by_header(rows: Column) -> Column:
    """Rows as a pipe table cut or padded to the header's width; cells as they are, null cells empty."""
    plain = F.transform(F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))

    def fitted(kept: Column) -> Column:
        width = F.size(kept[0])
        return _page(F.transform(kept, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)), width)

    return let(plain, lambda kept: F.when(F.size(kept) > 0, fitted(kept)).otherwise(""))


def quality(rows: Column, min_rows: int = 2, min_cols: int = 2, filled: float = 0.30) -> Column:
    """``kept_rows, max_cols, filled_share, keep`` of a table's rows."""

    def judged(kept: Column) -> Column:
        add = lambda f: F.aggregate(F.transform(kept, f), F.lit(0), lambda a, x: a + x)
        share = add(lambda r: F.size(F.filter(r, lambda c: c != ""))) / F.greatest(add(lambda r: F.size(r)), F.lit(1))
        cols = F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0))
        facts = F.struct(F.size(kept).alias("n"), cols.alias("c"), share.alias("s"))
        return let(facts, lambda x: F.struct(x["n"].alias("kept_rows"), x["c"].alias("max_cols"), F.round(x["s"], 6).alias("filled_share"), ((x["n"] >= min_rows) & (x["c"] >= min_cols) & (x["s"] >= filled)).alias("keep")))

    return let(clean_rows(rows), judged)


def caption(markdown: Column, explicit: Column) -> Column:
    """The explicit caption, else the first filled cell of the first line; a leading 'table 1.2' is taken off."""
    filled = F.filter(pipe_cells(first_line(markdown)), lambda c: c != "")
    head = F.when(F.coalesce(explicit, F.lit("")) != "", strip(explicit)).otherwise(F.coalesce(F.try_element_at(filled, F.lit(1)), F.lit("")))
    named = rf"(?i)^table[{SPACE}]+[0-9.]+[{SPACE}]+(.*)$"
    return F.when(head.rlike(named), strip(F.regexp_extract(head, named, 1))).otherwise(head)


def flatten(markdown: Column) -> Column:
    """A pipe table as running text."""
    return squash(F.regexp_replace(F.regexp_replace(F.coalesce(markdown, F.lit("")), r"\|", " "), "-{2,}", " "))


def search_text(markdown: Column, title: Column) -> Column:
    """What is embedded for a table: the caption twice, then the flat text."""
    flat = flatten(markdown)
    return F.when(title != "", F.concat(F.lit("Table: "), title, F.lit(". "), title, F.lit(". "), flat)).otherwise(flat)


def is_navigation(markdown: Column) -> Column:
    """Index pages and tables of contents read as tables: at least 8 rows, half of them with page references or bare numbers."""
    reference = rf",[{SPACE}]*[0-9]+([{SPACE}]*[-–][{SPACE}]*[0-9]+)?[{SPACE}]*$"
    first = lambda cells: F.coalesce(F.try_element_at(F.filter(cells, lambda c: c != ""), F.lit(1)), F.lit(""))

    def judged(rows: Column) -> Column:
        cells = F.transform(rows, lambda r: pipe_cells(r))
        facts = F.transform(cells, lambda r: F.struct(F.exists(r, lambda c: c.rlike(reference)).alias("i"), first(r).rlike("^[0-9]{1,3}$").alias("n")))
        half = lambda k, x: F.size(F.filter(x, lambda y: y[k])) * 2 >= F.size(rows)
        captioned = rows[0].rlike(r"(?i)\btable\s+[0-9]")
        return F.when((F.size(rows) >= 8) & ~captioned, let(facts, lambda x: half("i", x) | half("n", x))).otherwise(False)

    kept = F.filter(lines(markdown), lambda x: x.rlike(rf"[^{SPACE}]") & ~x.rlike(RULER))
    return let(kept, lambda rows: F.when(F.size(rows) >= 8, judged(rows)).otherwise(False))


def is_droppable(markdown: Column) -> Column:
    """Stray figure captions and lists of numbered media without a table or box mark near the top."""
    line = strip(first_line(markdown))
    cell = F.coalesce(F.try_element_at(F.filter(pipe_cells(line), lambda c: c != ""), F.lit(1)), F.lit(""))
    top = F.lower(F.substring(F.coalesce(markdown, F.lit("")), 1, 200))
    return line.rlike(r"(?i)^fig\.?\s+[0-9]") | (cell.rlike(r"^[0-9]+\.[0-9]+$") & ~F.contains(top, F.lit("table")) & ~F.contains(top, F.lit("box")))


def is_fragment(markdown: Column, explicit: Column) -> Column:
    """Tables without a caption and with fewer than 60 characters of content."""
    named = r"(?i)^table\s+[0-9.]+"
    head = strip(F.regexp_replace(strip(first_line(markdown)), r"^\|+|\|+$", ""))
    content = F.length(F.regexp_replace(F.coalesce(markdown, F.lit("")), rf"[|\-{SPACE}]", ""))
    return ~F.coalesce(strip(explicit).rlike(named), F.lit(False)) & ~head.rlike(named) & (content < 60)


def collapse_repeats(text: Column) -> Column:
    """Rows of one value repeated over all cells become the value; long cells equal to the one before are dropped."""

    def joined(cells: Column) -> Column:
        filled = F.filter(cells, lambda c: c != "")
        kept = F.filter(cells, lambda c, i: (c != "") & ((i == 0) | (F.length(c) < 20) | (F.get(cells, i - 1) != c)))
        return let(filled, lambda f: F.when((F.size(f) >= 2) & (F.size(F.array_distinct(f)) == 1), f[0]).otherwise(F.array_join(kept, " | ")))

    def row(line: Column) -> Column:
        head = lambda c: F.when(c[0] == "", F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(c)
        tail = lambda c: F.when((F.size(c) > 0) & (F.try_element_at(c, F.lit(-1)) == ""), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
        return let(F.transform(F.split(line, r"\|"), lambda c: strip(c)), lambda c: let(head(c), lambda h: let(tail(h), joined)))

    ruler = lambda x: x.rlike(rf"^[{SPACE}]*[|\-:][|\-: ]*[{SPACE}]*$")
    kept = F.filter(F.split(text, "\n"), lambda x: ~ruler(x))
    out = F.filter(F.transform(kept, lambda x: F.when(F.contains(x, F.lit("|")), row(x)).otherwise(x)), lambda x: x.rlike(rf"[^{SPACE}]"))
    return F.when(F.contains(text, F.lit("|")), strip(F.array_join(out, "\n"))).otherwise(strip(F.coalesce(text, F.lit(""))))


def pipe_rows(markdown: Column) -> Column:
    """How many lines hold two pipes at least; null holds none."""
    return F.size(F.filter(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)).cast("int")
