"""Reading order of a page, regions of tables, and the folding of headings into what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomine.functions.text import norm, strip
from foliomine.operators.scans import run_numbers, running

PAGE_WIDTH = 595.0
WIDE, GUTTER, LEAST_COLUMN = 0.60, 0.04, 0.15
#: Labels of page furniture; they end a list but give no record.
SKIPPED = ("page_header", "page_footer", "document_index", "picture", "table", "table_of_contents", "form", "key_value_region")


def boxes(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """``x0, y0, x1, y1`` from an array of four numbers or a string of them; records without a whole box are left out."""
    box = F.split(F.col(bbox), ",") if dict(df.dtypes)[bbox] == "string" else F.col(bbox)
    df = df.withColumn("_b", F.transform(box, lambda x: x.try_cast("double")))
    df = df.where((F.size("_b") == 4) & ~F.exists("_b", lambda x: x.isNull()))
    return df.withColumns({n: F.col("_b")[i] for i, n in enumerate(("x0", "y0", "x1", "y1"))}).drop("_b")


def page_columns(df: DataFrame, width: float = PAGE_WIDTH, by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """``by, col_no, cx0, cx1``: the x-ranges of a page's columns.

    The intervals of narrow blocks are merged over small gutters; ranges too narrow go; a page without any is one
    column over its width.
    """
    group = list(by)
    narrow = df.where((F.col("x1") - F.col("x0")) < WIDE * width).select(*group, "x0", "x1")
    order = Window.partitionBy(*group).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = narrow.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach + GUTTER * width), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*group, "_island").agg(F.min("x0").alias("cx0"), F.max("x1").alias("cx1")).where(F.col("cx1") - F.col("cx0") > LEAST_COLUMN * width)
    pages = df.select(*group).distinct()
    same = None
    right = merged.select(*[F.col(g).alias(f"_{g}") for g in group], "cx0", "cx1")
    for g in group:
        test = pages[g].eqNullSafe(right[f"_{g}"])
        same = test if same is None else same & test
    every = pages.join(right, same, "left").drop(*[f"_{g}" for g in group])
    every = every.withColumns({"cx0": F.coalesce("cx0", F.lit(0.0)), "cx1": F.coalesce("cx1", F.lit(width))})
    return every.withColumn("col_no", F.row_number().over(Window.partitionBy(*group).orderBy("cx0", "cx1")) - 1).select(*group, "col_no", "cx0", "cx1")


def assigned_columns(df: DataFrame, width: float = PAGE_WIDTH, by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Add ``col``: 0 on a page of one column, -1 for a full-width block, else the first range that holds the centre, or the nearest."""
    group = list(by)
    columns = page_columns(df, width, by).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("col_no", "cx0", "cx1"))).alias("_cols"))
    right = columns.select(*[F.col(g).alias(f"_{g}") for g in group], "_cols")
    same = None
    for g in group:
        test = df[g].eqNullSafe(right[f"_{g}"])
        same = test if same is None else same & test
    df = df.join(right, same).drop(*[f"_{g}" for g in group])
    centre = (F.col("x0") + F.col("x1")) / 2
    inside = F.filter("_cols", lambda c: (c["cx0"] <= centre) & (centre <= c["cx1"]))
    near = F.array_min(F.transform("_cols", lambda c: F.struct(F.abs(centre - (c["cx0"] + c["cx1"]) / 2).alias("far"), c["col_no"].alias("n"))))["n"]
    col = F.when(F.size("_cols") <= 1, 0).when((F.col("x1") - F.col("x0")) >= WIDE * width, -1).otherwise(F.coalesce(F.try_element_at(inside, F.lit(1))["col_no"], near))
    return df.withColumn("col", col.cast("int")).drop("_cols")


def reading_order(df: DataFrame, key: str, width: float = PAGE_WIDTH, by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Add ``col`` and ``read_no`` from 0: bands between full-width blocks, each column by column."""
    df = assigned_columns(df, width, by)
    down = Window.partitionBy(*by).orderBy("y0", "x0", key)
    df = df.withColumn("_band", F.sum(F.when(F.col("col") == -1, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # a separator stands before the band it opens
    across = Window.partitionBy(*by).orderBy("_band", F.when(F.col("col") == -1, 0).otherwise(1), "col", "y0", "x0", key)
    return df.withColumn("read_no", F.row_number().over(across) - 1).drop("_band")


def outside_tables(blocks: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """The blocks whose centre lies in no table region of their page; the equal keys come first, so no product is built."""
    r = regions.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), *[(F.col(c) * scale).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (blocks["x0"] + blocks["x1"]) / 2, (blocks["y0"] + blocks["y1"]) / 2
    hit = (blocks["doc"] == r["_doc"]) & (blocks["page"] == r["_page"]) & cx.between(r["_x0"], r["_x1"]) & cy.between(r["_y0"], r["_y1"])
    return blocks.join(r, hit, "left_anti")


def body_size(df: DataFrame, size: str, order: list[str], by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """``by, body_size``: the commonest size, rounded half to even, sizes of 0 left out; ties go to the first seen, none is 0."""
    rounded = df.where(F.coalesce(F.col(size), F.lit(0.0)) != 0).select(*by, F.bround(F.col(size), 0).cast("int").alias("_s"), F.struct(*order).alias("_o"))
    counted = rounded.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("o"), F.col("_s").alias("s"))).alias("_b")).select(*by, F.col("_b.s").alias("_body"))
    pages = df.select(*by).distinct()
    right = best.select(*[F.col(g).alias(f"_{g}") for g in by], "_body")
    same = None
    for g in by:
        test = pages[g].eqNullSafe(right[f"_{g}"])
        same = test if same is None else same & test
    return pages.join(right, same, "left").select(*by, F.coalesce("_body", F.lit(0)).alias("body_size"))


def assembled_blocks(spans: DataFrame, by: list[str], order: str, text: str, size: str, bold: str) -> DataFrame:
    """Blocks from their spans: the largest size to one place, bold if over 0.6 of the characters are, lines joined."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    heavy = F.sum(F.when(F.coalesce(F.col(bold), F.lit(False)), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: strip(x["t"]) != "")
    return spans.groupBy(*by).agg(F.round(F.max(size), 1).alias("size"), (heavy > 0.6).alias("bold"), F.array_join(F.transform(kept, lambda x: x["t"]), "\n").alias("text"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """At most 120 characters, and larger than the body, bold, or a numbered step."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) <= 120) & ((size > 1.15 * body) | F.coalesce(bold, F.lit(False)) | t.rlike(r"^[0-9]{1,2}\.\s"))


def fold_items(items: DataFrame, captions: DataFrame | None = None, doc: str = "doc", page: str = "page", ord: str = "ord", label: str = "label", text: str = "text") -> DataFrame:
    """``doc, page, block_index, text, is_heading, is_figure, section`` of a document's layout items.

    Headings wait for the next record and are put before it, across pages; runs of list items are one record on the
    page of the first; captions that are table captions are left out; skipped labels end a list.  Headings with
    nothing after them are one record without a page.  ``ord`` orders the items of a page.
    """
    order = [ord]
    df = items.select(doc, page, ord, F.lower(F.coalesce(F.col(label), F.lit(""))).alias("_label"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = F.when(F.col("_label") == "section_header", "heading").when(F.col("_label") == "list_item", "item").when(F.col("_label") == "caption", "caption").when(F.col("_label").isin(*SKIPPED), "skip").otherwise("text")
    df = df.withColumn("_kind", kind)
    if captions is not None:
        known = captions.select(F.col("doc").alias("_cdoc"), norm(F.col("caption")).alias("_cap")).where(F.col("_cap") != "").distinct()
        df = df.join(known.withColumn("_is", F.lit(True)), (F.col("_kind") == "caption") & (F.col(doc) == F.col("_cdoc")) & (norm(F.col("_text")) == F.col("_cap")), "left")
        df = df.withColumn("_kind", F.when(F.coalesce("_is", F.lit(False)), "skip").otherwise(F.col("_kind"))).drop("_is", "_cdoc", "_cap")
    # runs of list items
    # whether a text is blank, and the text of a heading, stand in columns of their own: what runs over pages needs no text
    line = strip(F.col("_text"))
    df = df.withColumns({"_line": line, "_full": line != "", "_head": F.when((F.col("_kind") == "heading") & (line != ""), line)})
    df = run_numbers(df, doc, page, order, "_kind", "item", "_unit")
    first = F.min(F.struct(F.col(page).isNull().alias("n"), F.col(page).alias("p"), F.col(ord).alias("o")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).isNull().alias("n"), F.col(page).alias("p"), F.col(ord).alias("o"), F.col("_line").alias("t"))))
    units = df.groupBy(doc, "_unit", "_kind").agg(first.alias("_at"), F.max("_full").alias("_full"), F.max("_head").alias("_head"), strip(F.array_join(F.transform(parts, lambda x: x["t"]), "\n")).alias("_t"))
    units = units.select(doc, F.col("_at.p").alias(page), F.col("_at.o").alias(ord), "_kind", "_full", "_head", "_t")
    emits = F.col("_kind").isin("item", "caption", "text") & F.col("_full")
    units = units.withColumn("_emits", emits)
    units = running(units, doc, page, order, {"_fold": F.when(F.col("_emits"), 1).otherwise(0)}, {"section": F.col("_head")})
    kept = units.where(F.col("_emits") | F.col("_head").isNotNull())
    texts = F.array_sort(F.collect_list(F.struct(F.col("_emits").alias("e"), F.col(page).isNull().alias("n"), F.col(page).alias("p"), F.col(ord).alias("o"), F.col("_t").alias("t"), F.col("section").alias("s"), F.col("_kind").alias("k"))))
    groups = kept.groupBy(doc, "_fold").agg(texts.alias("_g"))
    end = F.element_at("_g", -1)
    out = groups.select(
        doc,
        F.when(end["e"], end["p"]).alias(page),
        F.when(end["e"], end["o"]).alias("_o"),
        F.array_join(F.transform("_g", lambda x: x["t"]), "\n").alias("text"),
        (~end["e"]).alias("is_heading"),
        F.coalesce(end["k"] == "caption", F.lit(False)).alias("is_figure"),
        end["s"].alias("section"),
    )
    index = F.row_number().over(Window.partitionBy(doc, page).orderBy(F.col("is_heading"), "_o")) - 1
    return out.select(doc, page, index.alias("block_index"), "text", "is_heading", "is_figure", "section")


def fold_page_headings(df: DataFrame, order: str = "read_no", heading: str = "is_heading", text: str = "text", by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """``by, block_index, text, is_heading, section``: page by page, the last of stacked headings is put before the next block.

    A heading with nothing after it on its page is a record of its own.
    """
    rows = Window.partitionBy(*by).orderBy(order)
    line = strip(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n", " "))
    df = df.withColumn("_h", F.coalesce(F.col(heading), F.lit(False)))
    df = df.withColumn("_head", F.when(F.col("_h"), line))
    df = df.withColumn("section", F.last("_head", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_prev_h", F.coalesce(F.lag("_h").over(rows), F.lit(False))).withColumn("_next", F.lead("_h").over(rows))
    body = F.when(F.col("_prev_h"), F.concat("section", F.lit("\n"), F.coalesce(F.col(text), F.lit("")))).otherwise(F.col(text))
    kept = df.where(~F.col("_h") | F.col("_next").isNull())
    out = F.when(F.col("_h"), F.col("section")).otherwise(body)
    return kept.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).alias("block_index"), out.alias("text"), F.col("_h").alias("is_heading"), "section")
