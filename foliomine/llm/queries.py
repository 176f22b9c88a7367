"""The pN queries, with production parameters over whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomine.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _words(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    rows = table(spark, folder, "word_freq").where("word is not null and lang is not null").select("word", "lang").distinct()
    if rows.count() > 2_000_000:
        raise ValueError("the reference list is too long to be sent to the tasks")
    return sorted((r["word"], r["lang"]) for r in rows.collect())


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every log with its defect, if any, and the share of the answer under each tag."""
    from foliomine.llm.broken_pairs import defects

    return defects(table(spark, folder, "query_logs"), _words(spark, folder)).withColumn("cover", F.to_json("cover"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.broken_pairs import defects

    return defects(table(spark, folder, "query_logs"), _words(spark, folder)).select("log_id", "defect").where(F.col("defect").isNotNull())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.disclosure import items_found

    found = items_found(table(spark, folder, "query_logs"), [w for w, _ in _words(spark, folder)])
    return found.select(F.col("row_id").alias("log_id"), "field_name", "pii_type", "start_pos")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Both fields of every log with placeholders."""
    from foliomine.llm.disclosure import sanitised

    return sanitised(table(spark, folder, "query_logs"), [w for w, _ in _words(spark, folder)]).withColumnRenamed("row_id", "log_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.markup import markup_found

    tables = table(spark, folder, "tables")
    found = lambda field, pipes: markup_found(tables, "table_id", field, pipes).select(F.col("rec_id").alias("table_id"), F.lit(field).alias("field_name"), "markup")
    return found("markdown", True).unionByName(found("caption", False))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every table's markdown and caption as clean text and blocks."""
    from foliomine.llm.markup import clean_texts

    tables = table(spark, folder, "tables")
    clean = lambda field, pipes: clean_texts(tables, "table_id", field, pipes).select(F.col("rec_id").alias("table_id"), F.lit(field).alias("field_name"), "text", "blocks")
    return clean("markdown", True).unionByName(clean("caption", False))


def p4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's statistics, reasons and class."""
    from foliomine.llm.text_quality import quality

    blocks = table(spark, folder, "blocks").select(F.lit("blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), "text")
    tables = table(spark, folder, "tables").select(F.lit("tables").alias("rec_table"), F.col("table_id").alias("rec_id"), F.col("markdown").alias("text"))
    return quality(blocks, "text", "prose").unionByName(quality(tables, "text", "table")).drop("text")


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of words and characters of every record, which SQL can say too."""
    return p4_quality(spark, folder).select("rec_table", "rec_id", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "alpha_share", "common_share")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that aren't what their table promises; headings aren't cases."""
    from foliomine.llm.frames import keep
    from foliomine.llm.text_quality import text_classes

    blocks = table(spark, folder, "blocks").where(~F.coalesce("is_heading", F.lit(False))).select(F.lit("blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), "text")
    tables = table(spark, folder, "tables").select(F.lit("tables").alias("rec_table"), F.col("table_id").alias("rec_id"), F.col("markdown").alias("text"))
    bad = lambda df, promised: keep(text_classes(df, "text", promised, "rec_table", "rec_id"), ~F.col("text_class").isin(promised, "none"))
    return bad(blocks, "prose").unionByName(bad(tables, "table")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.site_lines import marked_lines

    return marked_lines(table(spark, folder, "blocks"), "doc", "text", "block_id").select("block_id", "line_no")


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every block without its site lines."""
    from foliomine.llm.site_lines import without_site_lines

    return without_site_lines(table(spark, folder, "blocks"), "doc", "text", "block_id").select("block_id", "doc", "text", "removed_lines")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.encoding import word_list
    from foliomine.llm.lookalike import cells_text, kinds_found

    words = word_list(table(spark, folder, "word_freq"))
    blocks = kinds_found(table(spark, folder, "blocks"), words, "block_id", "text").select(F.lit("blocks").alias("rec_table"), "rec_id", "char_kind")
    tables = table(spark, folder, "tables").select("table_id", cells_text("rows").alias("cells"))
    return blocks.unionByName(kinds_found(tables, words, "table_id", "cells").select(F.lit("tables").alias("rec_table"), "rec_id", "char_kind"))


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block's text in one form."""
    from foliomine.llm.encoding import word_list
    from foliomine.llm.lookalike import normal_texts

    return normal_texts(table(spark, folder, "blocks"), word_list(table(spark, folder, "word_freq")), "block_id", "text").withColumnRenamed("rec_id", "block_id")


def p6_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table's cells in one form."""
    from foliomine.llm.encoding import word_list
    from foliomine.llm.lookalike import normal_cells

    return normal_cells(table(spark, folder, "tables"), word_list(table(spark, folder, "word_freq")), "table_id", "rows").withColumnRenamed("rec_id", "table_id")


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks").select(F.lit("blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), "text", F.coalesce("is_heading", F.lit(False)).alias("heading"))
    tables = table(spark, folder, "tables").select(F.lit("tables").alias("rec_table"), F.col("table_id").alias("rec_id"), F.col("markdown").alias("text"), F.lit(False).alias("heading"))
    return blocks.unionByName(tables)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.encoding import word_list
    from foliomine.llm.scan_noise import noise_found, word_counts

    texts = _scanned(spark, folder)
    return noise_found(texts, *word_counts(texts), word_list(table(spark, folder, "word_freq")))


def p7_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as continuous paragraphs."""
    from foliomine.llm.encoding import word_list
    from foliomine.llm.scan_noise import repaired, word_counts

    texts = _scanned(spark, folder)
    return repaired(texts, *word_counts(texts), word_list(table(spark, folder, "word_freq")))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.packing import pack

    return pack(table(spark, folder, "documents"), "doc_id", "text", "source")


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a wanted mixture, the same share for every language, over shards of 250,000 tokens.

    One row per shard, window and language: its tokens and how far its share is from the wanted one.
    """
    from foliomine.llm.packing import pack

    docs = table(spark, folder, "documents").withColumn("language", F.coalesce("lang", F.lit("unknown")))
    langs = [r[0] for r in docs.select("language").distinct().orderBy("language").limit(1000).collect()]
    packed = pack(docs, "doc_id", "text", "language", targets=dict.fromkeys(langs, 1.0), shard_tokens=250_000, window=8)
    tokens = packed.join(docs.select(F.col("doc_id").alias("item_id"), "language"), "item_id").groupBy("shard", "window", "language").agg(F.sum("n_tokens").alias("n_tokens"))
    # the languages of one window are few rows
    whole = F.sum("n_tokens").over(Window.partitionBy("shard", "window"))
    return tokens.select("shard", "window", "language", "n_tokens", F.round(F.col("n_tokens") / F.greatest(whole, F.lit(1)) - 1.0 / max(1, len(langs)), 4).alias("off_target"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """With the longest match and its place."""
    from foliomine.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without any passage of a test item."""
    from foliomine.llm.leakage import without_leaks

    return without_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "source", "n_chars", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.llm.encoding import garbled, word_list

    words = word_list(table(spark, folder, "word_freq"))
    return garbled(table(spark, folder, "documents"), words).select(F.col("row_id").alias("doc_id"))


def p10_restore(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with the text restored as far as it can be."""
    from foliomine.llm.encoding import restore, word_list

    words = word_list(table(spark, folder, "word_freq"))
    return restore(table(spark, folder, "documents"), words).withColumnRenamed("row_id", "doc_id")


P5_LINES = r"""
WITH l AS (SELECT block_id, doc, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line
           FROM blocks WHERE text IS NOT NULL AND doc IS NOT NULL),
n AS (SELECT block_id, doc, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '', 'g'), '[ \t]+', ' ', 'g')) AS line FROM l),
k AS (SELECT * FROM n WHERE length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 3),
r AS (SELECT doc, count(*) AS n_rows FROM blocks GROUP BY doc),
c AS (SELECT doc, line, count(DISTINCT block_id) AS n FROM k GROUP BY doc, line),
s AS (SELECT doc, line FROM c JOIN r USING (doc) WHERE n >= 5 AND n >= 0.03 * n_rows)
"""


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_clean": p2_clean, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_quality": p4_quality, "p4_statistics": p4_statistics, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_blocks": p6_blocks, "p6_tables": p6_tables, "p7_found": p7_found, "p7_repair": p7_repair, "p8_pack": p8_pack, "p8_mixed": p8_mixed, "p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean, "p10_found": p10_found, "p10_restore": p10_restore}


P5_CLEAN = (
    P5_LINES
    + r"""
, m AS (SELECT DISTINCT k.block_id, k.line_no FROM k JOIN s USING (doc, line)),
a AS (SELECT block_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM blocks WHERE text IS NOT NULL),
j AS (SELECT a.block_id, string_agg(line, chr(10) ORDER BY a.line_no) FILTER (WHERE m.line_no IS NULL) AS text, CAST(count(m.line_no) AS INT) AS removed_lines FROM a LEFT JOIN m ON m.block_id = a.block_id AND m.line_no = a.line_no GROUP BY a.block_id)
SELECT b.block_id, b.doc, CASE WHEN b.text IS NOT NULL THEN coalesce(j.text, '') END AS text, coalesce(removed_lines, 0) AS removed_lines FROM blocks b LEFT JOIN j USING (block_id)
"""
)

P9_WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
P9_FOUND = f"""
WITH i AS (SELECT item_id, {P9_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {P9_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


P4_STATISTICS = r"""
WITH t AS (SELECT 'blocks' AS rec_table, block_id AS rec_id, coalesce(text, '') AS t FROM blocks UNION ALL SELECT 'tables', table_id, coalesce(markdown, '') FROM tables),
w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0b\f\r]+') AS ws, regexp_extract_all(lower(t), '\p{L}+') AS ls FROM t),
c AS (SELECT *, len(ws) AS n, list_sum([length(_w) for _w in ws]) AS solid, length(regexp_replace(t, '[\p{L}\p{N}\p{M} \t\n\x0b\f\r.,;:!?()''"’“”‘\-–—%/]', '', 'g')) AS symbols, len([1 for _w in ws if regexp_matches(_w, '\p{L}')]) AS alpha, len([1 for _w in ls if _w IN (COMMON_WORDS)]) AS common FROM w)
SELECT rec_table, rec_id, CAST(length(t) AS INT) AS n_chars, CAST(n AS INT) AS n_words, CASE WHEN n > 0 THEN round(solid / n, 4) ELSE 0 END AS mean_word_length, CASE WHEN n > 0 THEN round(symbols / n, 4) ELSE 0 END AS symbol_ratio, CASE WHEN n > 0 THEN round(alpha / n, 4) ELSE 0 END AS alpha_share, CASE WHEN n > 0 THEN round(common / n, 4) ELSE 0 END AS common_share FROM c
"""


def _p4_statistics_sql() -> str:
    from foliomine.llm.text_quality import COMMON

    return P4_STATISTICS.replace("COMMON_WORDS", ", ".join(f"'{w}'" for w in sorted(set(COMMON.split()))))


#: The longest run of words that a document and an item share, its length and first places.
P9_MATCHES = f"""
WITH i AS (SELECT item_id, {P9_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {P9_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, k, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
h AS (SELECT doc_id, item_id, dg.k AS dk, ig.k AS ik FROM dg JOIN ig USING (g)),
r AS (SELECT doc_id, item_id, dk, ik, dk - row_number() OVER (PARTITION BY doc_id, item_id, dk - ik ORDER BY dk) AS run FROM h),
m AS (SELECT doc_id, item_id, CAST(count(*) + 9 AS INT) AS words, CAST(min(dk) - 1 AS INT) AS doc_word, CAST(min(ik) - 1 AS INT) AS item_word FROM r GROUP BY doc_id, item_id, dk - ik, run)
SELECT doc_id, item_id, words, doc_word, item_word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_word, item_word) AS n FROM m) WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_statistics": _p4_statistics_sql(), "p5_found": P5_LINES + "SELECT k.block_id, k.line_no FROM k JOIN s USING (doc, line)", "p5_clean": P5_CLEAN, "p9_found": P9_FOUND, "p9_clean": f"SELECT doc_id, source, n_chars, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P9_FOUND}))", "p9_matches": P9_MATCHES}
