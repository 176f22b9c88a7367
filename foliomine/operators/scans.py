"""Running values over the records of a document in order, without one task for a whole document.

A document may hold a third of all records.  Records are ordered by page and then within the page; what runs is taken
within each page first, then over one row per page, and the two are put together.  Only the rows of a page, and one
row for each page of a document, ever meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomine.session import cut


def _windows(doc: str, page: str, order: list[str]):
    rows = Window.partitionBy(doc, page).orderBy(*order)
    pages = Window.partitionBy(doc).orderBy(F.col(page).asc_nulls_last())
    return rows, pages


def _with_pages(df: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    p = pages.select(F.col(doc).alias("_d"), F.col(page).alias("_p"), *[c for c in pages.columns if c not in (doc, page)])
    return df.join(p, df[doc].eqNullSafe(p["_d"]) & df[page].eqNullSafe(p["_p"])).drop("_d", "_p")


def running_sum(df: DataFrame, doc: str, page: str, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add the sum of ``value`` over the records before this one, and over this one if inclusive."""
    rows, pages = _windows(doc, page, order)
    end = 0 if inclusive else -1
    df = df.withColumn("_sc_v", value.cast("long"))
    per_page = df.groupBy(doc, page).agg(F.sum("_sc_v").alias("_sc_s")).withColumn("_sc_before", F.coalesce(F.sum("_sc_s").over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sc_s")
    local = F.coalesce(F.sum("_sc_v").over(rows.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    return _with_pages(df.withColumn("_sc_l", local), per_page, doc, page).withColumn(name, F.col("_sc_l") + F.col("_sc_before")).drop("_sc_v", "_sc_l", "_sc_before")


def running_last(df: DataFrame, doc: str, page: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` up to this record."""
    rows, pages = _windows(doc, page, order)
    df = df.withColumn("_sc_v", value)
    last = F.last("_sc_v", ignorenulls=True)
    df = df.withColumn("_sc_l", last.over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    per_page = df.groupBy(doc, page).agg(F.max_by(F.struct(F.col("_sc_l").alias("v")), F.struct(*order)).alias("_sc_e"))
    per_page = per_page.select(doc, page, F.last("_sc_e.v", ignorenulls=True).over(pages.rowsBetween(Window.unboundedPreceding, -1)).alias("_sc_before"))
    return _with_pages(df, per_page, doc, page).withColumn(name, F.coalesce("_sc_l", "_sc_before")).drop("_sc_v", "_sc_l", "_sc_before")


def previous(df: DataFrame, doc: str, page: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the ``value`` of the record before this one in the document."""
    rows, pages = _windows(doc, page, order)
    df = df.withColumn("_sc_v", value)
    df = df.withColumn("_sc_l", F.lag(F.struct(F.col("_sc_v").alias("v"))).over(rows))
    per_page = df.groupBy(doc, page).agg(F.max_by(F.struct(F.col("_sc_v").alias("v")), F.struct(*order)).alias("_sc_e"))
    per_page = per_page.select(doc, page, F.lag("_sc_e").over(pages).alias("_sc_before"))
    return _with_pages(df, per_page, doc, page).withColumn(name, F.coalesce("_sc_l", "_sc_before")["v"]).drop("_sc_v", "_sc_l", "_sc_before")


#: Stands for a null document or page, so that both are plain keys: rows, pages and their join share one partitioning.
NO_DOC, NO_PAGE = "\u0000", 1 << 62


def keyed(df: DataFrame, doc: str, page: str) -> DataFrame:
    """Add ``_sc_d`` and ``_sc_p``, the document and the page without nulls; a null page comes last."""
    return df.withColumns({"_sc_d": F.coalesce(F.col(doc).cast("string"), F.lit(NO_DOC)), "_sc_p": F.coalesce(F.col(page).cast("long"), F.lit(NO_PAGE))})


def running(df: DataFrame, doc: str, page: str, order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Add the sum of each of ``sums`` over the records before, and the last non-null of each of ``lasts`` up to this record.

    All of them in one pass: one exchange by page, one row a page, and a join on the keys the rows already lie by.
    """
    df = keyed(df, doc, page)
    rows = Window.partitionBy("_sc_d", "_sc_p").orderBy(*order)
    pages = Window.partitionBy("_sc_d").orderBy("_sc_p").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_sc_v_{n}": v.cast("long") for n, v in sums.items()} | {f"_sc_w_{n}": v for n, v in lasts.items()})
    local = {f"_sc_l_{n}": F.coalesce(F.sum(f"_sc_v_{n}").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in sums}
    local |= {f"_sc_m_{n}": F.last(f"_sc_w_{n}", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)) for n in lasts}
    df = df.withColumns(local)
    ends = [F.sum(f"_sc_v_{n}").alias(f"_sc_s_{n}") for n in sums] + [F.max_by(F.struct(F.col(f"_sc_m_{n}").alias("v")), F.struct(*order)).alias(f"_sc_e_{n}") for n in lasts]
    before = [F.coalesce(F.sum(f"_sc_s_{n}").over(pages), F.lit(0)).alias(f"_sc_b_{n}") for n in sums] + [F.last(F.col(f"_sc_e_{n}.v"), ignorenulls=True).over(pages).alias(f"_sc_c_{n}") for n in lasts]
    per_page = df.groupBy("_sc_d", "_sc_p").agg(*ends).select("_sc_d", "_sc_p", *before)
    out = df.join(per_page, ["_sc_d", "_sc_p"])
    out = out.withColumns({n: F.col(f"_sc_l_{n}") + F.col(f"_sc_b_{n}") for n in sums} | {n: F.coalesce(f"_sc_m_{n}", f"_sc_c_{n}") for n in lasts})
    return out.drop(*[c for c in out.columns if c.startswith("_sc_")])


def run_numbers(df: DataFrame, doc: str, page: str, order: list[str], kind: str, runs: str, name: str) -> DataFrame:
    """Add the number of each record's unit: neighbours of kind ``runs`` are one unit, across pages; any other is its own."""
    df = keyed(df, doc, page)
    rows = Window.partitionBy("_sc_d", "_sc_p").orderBy(*order)
    pages = Window.partitionBy("_sc_d").orderBy("_sc_p")
    df = df.withColumn("_sc_k", F.lag(F.struct(F.col(kind).alias("k"))).over(rows))
    # a page's first record is told by the page before
    df = df.withColumn("_sc_v", F.when(F.col("_sc_k").isNull(), 0).when((F.col(kind) != runs) | (F.col("_sc_k.k") != runs), 1).otherwise(0))
    df = df.withColumn("_sc_l", F.sum("_sc_v").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    per_page = df.groupBy("_sc_d", "_sc_p").agg(F.sum("_sc_v").alias("_sc_s"), F.min_by(kind, F.struct(*order)).alias("_sc_first"), F.max_by(kind, F.struct(*order)).alias("_sc_end"))
    fresh = F.when((F.col("_sc_first") == runs) & (F.lag("_sc_end").over(pages) == runs), 0).otherwise(1)
    per_page = per_page.withColumn("_sc_fresh", fresh)
    base = F.coalesce(F.sum(F.col("_sc_s") + F.col("_sc_fresh")).over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_page = per_page.select("_sc_d", "_sc_p", (base + F.col("_sc_fresh")).alias("_sc_base"))
    out = df.join(per_page, ["_sc_d", "_sc_p"]).withColumn(name, F.col("_sc_base") + F.col("_sc_l"))
    return out.drop(*[c for c in out.columns if c.startswith("_sc_")])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place of each row from 1 in the order of all rows: ranges are numbered on their own, then shifted."""
    # the ranges are drawn from a sample, so they are cut: both readings below must see the same ones
    ranged = cut(df.repartitionByRange(*order).withColumn("_sc_r", F.spark_partition_id()))
    before = F.coalesce(F.sum("_sc_n").over(Window.orderBy("_sc_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_sc_r").agg(F.count(F.lit(1)).alias("_sc_n")).select("_sc_r", before.alias("_sc_before"))
    local = ranged.withColumn("_sc_l", F.row_number().over(Window.partitionBy("_sc_r").orderBy(*order)))
    return local.join(F.broadcast(ranges), "_sc_r").withColumn(name, F.col("_sc_l") + F.col("_sc_before")).drop("_sc_r", "_sc_l", "_sc_before")
