"""What comes out of file parsers: the rules by which their output becomes records.

Parsers themselves stay outside; one is given as a function from the bytes of a file to rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomine.functions import tables as T
from foliomine.functions.text import norm, strip


def parsed_files(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[tuple]], schema: str, glob: str = "*.pdf") -> DataFrame:
    """``doc`` and the rows a parser gives for each file; the name of the file without its ending is the doc."""
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                rows = pd.DataFrame(list(parser(content)), columns=names)
                rows.insert(0, "doc", doc)
                yield rows

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    doc = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(doc.alias("doc"), "content").mapInPandas(run, f"doc string, {schema}")


def layout_labels(label: Column) -> Column:
    """Labels in small letters, '' for null."""
    return F.lower(F.coalesce(label.cast("string"), F.lit("")))


def first_page(provs: Column) -> Column:
    """The page of an item's first provenance, null where it has none."""
    return F.try_element_at(provs, F.lit(1))["page"]


#: How columns and rows of a table are told, by the finder's strategy.
FINDER = {"lines": ("lines", "lines"), "text": ("text", "text"), "mixed": ("lines", "text")}


def finder_settings(strategy: Column) -> Column:
    """``name, vertical, horizontal`` of a table finder's strategy; an unknown one has only its name."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in FINDER.items() for x in (k, v[i])]), strategy)
    return F.struct(strategy.alias("name"), pick(0).alias("vertical"), pick(1).alias("horizontal"))


def joined_text_blocks(blocks: Column) -> Column:
    """The text of a reply's blocks of type text, joined and stripped."""
    kept = F.filter(F.coalesce(blocks, F.array().cast("array<struct<type:string,text:string>>")), lambda b: b["type"] == "text")
    return strip(F.array_join(F.transform(kept, lambda b: F.coalesce(b["text"], F.lit(""))), ""))


def simple_tables(raw: DataFrame) -> DataFrame:
    """Cells stripped, rows and tables without text dropped; ``table_index`` counts the kept tables of a page, from 0.

    ``raw`` has ``doc, page, ord, rows``.
    """
    cells = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    kept = raw.withColumn("rows", F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))).where(F.size("rows") > 0)
    index = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord")) - 1
    return kept.select("doc", "page", index.alias("table_index"), "rows", T.to_markdown_by_header(F.col("rows")).alias("markdown"))


def found_tables(raw: DataFrame, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """Tables of a line finder that pass the quality rule; ``table_index`` is the finder's own, so it has gaps.

    ``raw`` has ``doc, page, ord, rows, x0, y0, x1, y1``.
    """
    box = F.concat_ws(",", *[F.format_string("%.1f", c) for c in ("x0", "y0", "x1", "y1")])
    kept = raw.withColumn("_q", T.quality(F.col("rows"), min_rows, min_cols)).where(F.col("_q.keep"))
    return kept.select("doc", "page", F.col("ord").cast("int").alias("table_index"), box.alias("bbox"), F.col("_q.kept_rows").alias("n_rows"), F.col("_q.max_cols").alias("n_cols"), T.clean_rows(F.col("rows")).alias("rows"), T.to_markdown(F.col("rows")).alias("markdown"))


def converted_tables(raw: DataFrame) -> DataFrame:
    """Tables of a converter: blank markdown is skipped, ``table_index`` counts the kept ones of a page from 0.

    ``raw`` has ``doc, page, ord, markdown, caption, n_rows, n_cols``.
    """
    kept = raw.where(strip(F.coalesce("markdown", F.lit(""))) != "")
    index = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord")) - 1
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption"))
    return kept.select("doc", "page", index.alias("table_index"), "markdown", caption.alias("caption"), "n_rows", "n_cols")


def converted_tables_only(raw: DataFrame, page_offset: int = 0) -> DataFrame:
    """The same without prose: ``table_index`` is the place among all tables of the document, and pages may be shifted.

    ``raw`` has ``doc, page, ord, markdown, caption, n_rows, n_cols`` with ``ord`` from 0 over the document.
    """
    kept = raw.where(strip(F.coalesce("markdown", F.lit(""))) != "")
    return kept.select("doc", (F.col("page") + page_offset).alias("page"), F.col("ord").cast("int").alias("table_index"), "markdown", F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption")).alias("caption"), "n_rows", "n_cols")


def caption_set(tables: DataFrame) -> DataFrame:
    """``doc, caption``: the normalised captions of each document's tables."""
    return tables.select("doc", norm(F.col("caption")).alias("caption")).where(F.col("caption") != "").distinct()
