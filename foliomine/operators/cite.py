"""Citations in answers: markers, their records, one chunk per table; and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomine.functions.tables import collapse_repeats
from foliomine.functions.text import natural_key, strip

#: Fixed value: a source in brackets with its page; sources are runs of letters.
MARKER = r"(?i)\[([a-z]+),?\s*p\.?\s*([0-9]+)\]"


def markers(answers: DataFrame, key: str, text: str, pattern: str = MARKER) -> DataFrame:
    """``key, pos, book, page``: every distinct marker at its first place; the page stays as it is written."""
    body = F.coalesce(F.col(text), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("book"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("page"))
    long = answers.select(key, F.posexplode(pairs).alias("pos", "m")).select(key, "pos", F.lower("m.book").alias("book"), F.col("m.page").alias("page"))
    return long.groupBy(key, "book", "page").agg(F.min("pos").alias("pos"))


def citations(found: DataFrame, picked: DataFrame, key: str, chunk_id: str = "id", source: str = "source", page: str = "page", kind: str = "type", text: str = "doc") -> DataFrame:
    """``key, cite_no, book, page, ids, passages``: each marker with the picked chunks of its source and page.

    Chunks stand in natural order of their ids; a table gives its first part only.  Markers without a chunk are left
    out.  The page is compared as text.
    """
    own = picked.select(key, F.lower(F.coalesce(F.col(source), F.lit(""))).alias("book"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), F.col(chunk_id).alias("_cid"), F.col(kind).alias("_kind"), F.col(text).alias("_doc"))
    joined = found.join(own, [key, "book", "page"])
    family = F.when(F.col("_kind") == "table", F.regexp_replace("_cid", r"_c[0-9]+$", "")).otherwise(F.col("_cid"))
    first = Window.partitionBy(key, "book", "page", "_kind", family).orderBy(natural_key(F.col("_cid")))
    kept = joined.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) | (F.col("_kind") != "table"))
    parts = F.array_sort(F.collect_list(F.struct(natural_key(F.col("_cid")).alias("o"), F.col("_cid").alias("i"), collapse_repeats(F.col("_doc")).alias("d"))))
    cited = kept.groupBy(key, "book", "page", "pos").agg(F.transform(parts, lambda x: x["i"]).alias("ids"), F.transform(parts, lambda x: x["d"]).alias("passages"))
    order = Window.partitionBy(key).orderBy("pos")
    return cited.select(key, (F.row_number().over(order) - 1).alias("cite_no"), "book", F.col("page").cast("int").alias("page"), "ids", "passages")


def families(chunks: DataFrame, by: list[str], chunk_id: str = "id", kind: str = "type") -> DataFrame:
    """Per group the ids in natural order, a table once."""
    family = F.when(F.col(kind) == "table", F.regexp_replace(chunk_id, r"_c[0-9]+$", "")).otherwise(F.col(chunk_id))
    one = chunks.groupBy(*by, F.col(kind).alias("_kind"), family.alias("_family")).agg(F.min(F.struct(natural_key(F.col(chunk_id)).alias("o"), F.col(chunk_id).alias("i"))).alias("_first"))
    return one.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_first")), lambda x: x["i"]), " ").alias("ids"), F.count(F.lit(1)).alias("n_kept"))


def is_refusal(reply: Column, marker: str) -> Column:
    """The marker leads the reply, or stands anywhere in one of fewer than 350 characters."""
    whole = strip(F.coalesce(reply, F.lit("")))
    core = strip(F.regexp_replace(whole, '^["# ]+', ""))
    return F.lower(core).startswith(marker.lower()) | (F.contains(F.lower(whole), F.lit(marker.lower())) & (F.length(whole) < 350))


def names_marker(body: Column, marker: str) -> Column:
    """Whether a reply holds the sign of being out of scope."""
    return F.contains(F.coalesce(body, F.lit("")), F.lit(marker))


def fallback_reply(body: Column, marker: str, outside: str, disclaimer: str) -> Column:
    """A reply that isn't from the sources: the disclaimer before it, or the fixed reply where it holds the sign of being out of scope."""
    return F.when(names_marker(body, marker), F.lit(outside)).otherwise(F.concat(F.lit(disclaimer), F.coalesce(body, F.lit(""))))


def source_label(source: Column, names: dict[str, str] | None = None) -> Column:
    """A source's listed name, else its own with spaces and capitals; null and '' have none."""
    from foliomine.functions.text import title_case

    plain = title_case(F.replace(source, F.lit("_"), F.lit(" ")))
    if names:
        plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), source), plain)
    return F.when(F.coalesce(source, F.lit("")) != "", plain)


def reply_with_sources(text: Column, cited: Column, names: dict[str, str] | None = None) -> Column:
    """The reply and its distinct sources; what lacks a page or a source shows the other."""
    pairs = F.array_distinct(F.transform(F.coalesce(cited, F.array().cast("array<struct<book:string,page:int>>")), lambda c: F.struct(source_label(c["book"], names).alias("s"), c["page"].alias("p"))))
    shown = F.transform(pairs, lambda x: F.when(x["s"].isNotNull() & x["p"].isNotNull(), F.concat(x["s"], F.lit(" p."), x["p"].cast("string"))).when(x["s"].isNotNull(), x["s"]).otherwise(F.concat(F.lit("p."), x["p"].cast("string"))))
    shown = F.filter(shown, lambda x: x.isNotNull())
    return F.when(F.size(shown) > 0, F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n— Sources: "), F.array_join(shown, "; "))).otherwise(F.coalesce(text, F.lit("")))


def envelope(answer: Column, cited: Column, grounded: Column) -> Column:
    """An answer with its sources and whether it is grounded, as one text."""
    sources = F.array_join(F.transform(F.coalesce(cited, F.array().cast("array<struct<book:string,page:int>>")), lambda c: F.concat(F.coalesce(c["book"], F.lit("?")), F.lit(" p."), F.coalesce(c["page"].cast("string"), F.lit("?")))), "; ")
    return F.concat(F.coalesce(answer, F.lit("")), F.lit("\n\nSources: "), F.when(sources == "", "none").otherwise(sources), F.lit("\nGrounded: "), F.when(F.coalesce(grounded, F.lit(False)), "yes").otherwise("no"))
