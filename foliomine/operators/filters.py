"""Which records are kept for search: the prose cascade, margins, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomine.functions.text import squash, strip

MIN_CHARS = 15
PAGE_HEIGHT = 842.0


def is_reference(text: Column, section: Column) -> Column:
    """By the section's name, or at least four numbered lines and three years before a semicolon."""
    section = F.lower(F.coalesce(section, F.lit("")))
    text = F.coalesce(text, F.lit(""))
    listed = (F.regexp_count(text, F.lit(r"(?m)^\s*[0-9]{1,3}[.\t]")) >= 4) & (F.regexp_count(text, F.lit("(19|20)[0-9]{2};")) >= 3)
    return F.contains(section, F.lit("reference")) | F.contains(section, F.lit("bibliograph")) | listed


def is_running_header(text: Column) -> Column:
    """Chapter number, colon, title, page number, in fewer than 90 characters."""
    line = squash(F.coalesce(text, F.lit("")))
    return (F.length(line) < 90) & line.rlike(r"^[0-9]+:\s+.+?\s+[0-9]+$")


def drop_reason(text: Column, section: Column, min_chars: int = MIN_CHARS) -> Column:
    """The first rule of the cascade that rejects a record; null if it is kept."""
    return (
        F.when(F.length(strip(F.coalesce(text, F.lit("")))) < min_chars, "too_short")
        .when(F.contains(F.lower(F.coalesce(section, F.lit(""))), F.lit("index")), "index")
        .when(is_reference(text, section), "reference")
        .when(is_running_header(text), "running_header")
    )


def kept_prose(blocks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The records the cascade keeps."""
    return blocks.where(drop_reason(F.col("text"), F.col("section"), min_chars).isNull())


def is_figure_caption(text: Column) -> Column:
    return F.coalesce(strip(F.split(F.coalesce(text, F.lit("")), "\n")[0]).rlike(r"(?i)^fig(ure)?\.?\s*[0-9]"), F.lit(False))


def in_margin(y0: Column, y1: Column, text: Column, height: float = PAGE_HEIGHT) -> Column:
    """Short texts in the top or bottom six per cent of the page."""
    return ((y1 < 0.06 * height) | (y0 > 0.94 * height)) & (F.length(text) < 40)


def page_texts(blocks: DataFrame) -> DataFrame:
    """``doc, page, page_text, near_empty``: headings and blocks in order, blank line between; under 40 characters is flagged."""
    parts = F.array_sort(F.collect_list(F.struct("block_index", "block_id", F.col("text").alias("t"))))
    text = strip(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n"))
    return blocks.where(F.col("text").isNotNull()).groupBy("doc", "page").agg(text.alias("page_text")).withColumn("near_empty", F.length("page_text") < 40)
