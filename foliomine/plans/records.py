"""Queries of the sources, sinks, streams and per-record rules: what is written is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomine.functions import tables as T
from foliomine.functions import text as X
from foliomine.operators import cite, layout, logs, repair, retrieve, select
from foliomine.plans import sql as S
from foliomine.plans.catalog import ACRONYMS, MARKED, SOURCES, SQL, _repairs, query
from foliomine.session import scratch, table
from foliomine.sources import parsed, records
from foliomine.sources.pages import page_list
from foliomine.streaming import records as streams

#: How a list of texts is shown in one column.
SEP = " ¦ "


# -- record files ---------------------------------------------------------------------------------------------------
@query('SELECT doc, page, block_index, bbox[1] AS x0, len(bbox) AS n_bbox, column_no AS "column", text, is_heading, is_figure, section FROM blocks')
def jsonl_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks written as JSON lines, nulls left out, and read back by the explicit schema."""
    path = scratch(spark, "blocks")
    records.write_jsonl(table(spark, folder, "blocks").select("doc", "page", "block_index", "bbox", F.col("column_no").alias("column"), "text", "is_heading", "is_figure", "section"), path)
    back = records.read_jsonl(spark, path, records.BLOCKS)
    return back.select("doc", "page", "block_index", F.try_element_at("bbox", F.lit(1)).alias("x0"), F.when(F.col("bbox").isNotNull(), F.size("bbox")).cast("long").alias("n_bbox"), "column", "text", "is_heading", "is_figure", "section")


@query(f"SELECT doc, page, table_index, bbox, n_rows, n_cols, replace(markdown, chr(7), '') AS markdown, caption, array_to_string([array_to_string([coalesce(_c, '') for _c in _r], '|') for _r in rows], '{SEP}') AS cells FROM tables")
def jsonl_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written as JSON lines and read back; bells in the markdown go."""
    path = scratch(spark, "tables")
    records.write_jsonl(table(spark, folder, "tables").select("doc", "page", "table_index", "bbox", "n_rows", "n_cols", "rows", "markdown", "caption"), path)
    back = records.read_jsonl(spark, path, records.TABLES)
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "|")), SEP)
    return back.select("doc", "page", "table_index", "bbox", "n_rows", "n_cols", "markdown", "caption", cells.alias("cells"))


@query("SELECT doc, page, count(*) AS n, sum(length(text)) AS n_chars FROM blocks WHERE doc IS NOT NULL GROUP BY doc, page")
def jsonl_blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Page records with a blank line after each: blank lines are no records."""
    path = scratch(spark, "pages")
    lines = table(spark, folder, "blocks").where("doc is not null").select(F.concat(F.to_json(F.struct("doc", "page", "text")), F.lit("\n  ")).alias("value"))
    lines.write.text(path)
    return records.read_jsonl(spark, path, records.PAGES).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("decimal(38,0)").alias("n_chars"))


@query("SELECT item_id, text || chr(10) AS text FROM eval_items WHERE text IS NOT NULL")
def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each text a file of its own, and each file a row."""
    path = scratch(spark, "texts")
    table(spark, folder, "eval_items").where("text is not null").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    back = records.read_whole_texts(spark, path + "/*")
    return back.select(F.regexp_extract("path", r"item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text")


@query("SELECT lower(word) AS key, CAST(max(per_million) AS VARCHAR) AS value FROM (SELECT word, CAST(floor(per_million) AS BIGINT) AS per_million FROM word_freq WHERE word IS NOT NULL AND per_million IS NOT NULL) GROUP BY lower(word)")
def dictionary_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A file that holds one JSON object, its entries as rows."""
    path = scratch(spark, "dictionary")
    words = table(spark, folder, "word_freq").where("word is not null and per_million is not null").groupBy(F.lower("word").alias("key")).agg(F.max(F.floor("per_million")).cast("string").alias("value"))
    # a dictionary is one object, of one row for each word of the reference list
    words.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value")).write.text(path)
    return records.read_dictionary(spark, path)


@query("SELECT doc_id, title, lang FROM documents WHERE doc_id = 7")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return records.find(table(spark, folder, "documents"), "doc_id", 7).select("doc_id", "title", "lang")


@query("SELECT s AS source, EXISTS (SELECT 1 FROM documents WHERE source = s) AS there, EXISTS (SELECT 1 FROM documents WHERE source = s) AS resumable FROM (VALUES ('wardround'), ('no such source')) AS v(s)")
def source_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a source is loaded, and whether a load without a manifest would be turned away."""
    docs = table(spark, folder, "documents")
    rows = [(s, records.has_source(docs, s), not records.may_load(docs, s, None)) for s in ("wardround", "no such source")]
    return spark.createDataFrame(rows, "source string, there boolean, resumable boolean")


@query("SELECT doc, page, count(*) AS n FROM blocks WHERE doc = 'compendium' GROUP BY doc, page")
def page_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a line naming the page before each, written and counted by that line."""
    path = scratch(spark, "marked")
    blocks = table(spark, folder, "blocks").where("doc = 'compendium'")
    records.write_page_markers(blocks, path)
    page = F.regexp_extract("value", r"^\[\[PAGE ([0-9]+|\?)\]\]$", 1)
    return spark.read.text(path).select(page.alias("p")).where("p <> ''").groupBy(F.lit("compendium").alias("doc"), F.col("p").try_cast("int").alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT format('p{:04d}_t{:d}', coalesce(page, 0), coalesce(table_index, 0)) AS preview, count(*) AS n FROM (SELECT page, table_index, unnest(string_split(markdown, chr(10))) AS line FROM tables WHERE markdown IS NOT NULL) WHERE line <> '' GROUP BY 1")
def table_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Each table's markdown in a folder of its page and index; the filled lines there."""
    path = scratch(spark, "previews")
    # one task a folder, so that a folder has one file
    previews = table(spark, folder, "tables").select("page", "table_index", F.regexp_replace("markdown", "\r", " ").alias("markdown")).repartition("page", "table_index")
    records.write_previews(previews, path)
    return spark.read.text(path).where("value <> ''").groupBy("preview").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, question, coalesce(answer, '') AS answer, grounded, input_tokens, total_tokens FROM query_logs UNION ALL SELECT -id, question, '', false, NULL, NULL FROM query_logs WHERE answer IS NULL")
def log_append(spark: SparkSession, folder: str) -> DataFrame:
    """Log records appended twice: with their usage, and without any, where those columns are null."""
    path = scratch(spark, "log")
    asked = table(spark, folder, "query_logs")
    records.append_logs(asked.select("id", "question", "answer", "grounded", "input_tokens", "total_tokens"), path)
    records.append_logs(asked.where("answer is null").select((-F.col("id")).alias("id"), "question", F.lit(None).cast("string").alias("answer"), F.lit(False).alias("grounded")), path)
    return spark.read.schema("id long, question string, answer string, grounded boolean, input_tokens int, total_tokens int").parquet(path)


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new', lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT -doc_id, 'new', lang FROM documents WHERE doc_id % 6 = 0")
def upsert_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """New rows take the place of old ones with their id; a third of the ids is loaded anew, some for the first time."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    new = docs.where("doc_id % 3 = 0").withColumn("source", F.lit("new"))
    return records.upserted(docs, new.unionByName(new.where("doc_id % 6 = 0").withColumn("doc_id", -F.col("doc_id"))), "doc_id")


@query("SELECT doc_id // 100 AS batch, count(*) AS n FROM documents WHERE (doc_id // 100) % 2 = 1 GROUP BY 1")
def batches_left(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that the manifest doesn't name."""
    docs = table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("batch"))
    done = docs.where("batch % 2 = 0").distinct()
    return records.not_done(docs, done).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc, page, block_index, block_id FROM (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY loaded_at DESC NULLS LAST, block_id DESC) AS n FROM blocks) WHERE n = 1 AND block_index IS NOT NULL")
def upsert_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream loaded in batches into a table of versions; the latest version of each key is what is left."""
    source, target = scratch(spark, "arrivals"), scratch(spark, "versions")
    blocks = table(spark, folder, "blocks").where("block_index is not null").select("doc", "page", "block_index", "block_id", "loaded_at")
    blocks.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 2).parquet(source)
    streams.upsert_stream(stream, target, scratch(spark, "progress"), "block_index", "loaded_at", "block_id").awaitTermination()
    return streams.upserted_table(spark, target, "block_index", "loaded_at", "block_id").select("doc", "page", "block_index", "block_id")


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY id DESC) AS r FROM query_logs WHERE user_email IS NOT NULL)
SELECT user_email, string_agg('User: ' || coalesce(question, '') || '{SEP}' || 'Assistant: ' || coalesce(answer, ''), '{SEP}' ORDER BY id) AS entries FROM t WHERE r <= 10 GROUP BY user_email""")
def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last 20 entries, kept as state over a stream of turns that arrive in the order of their ids."""
    source, out = scratch(spark, "turns"), scratch(spark, "history")
    turns = table(spark, folder, "query_logs").select("user_email", "id", "question", "answer")
    # the order of arrival is the order of the turns
    turns = turns.withColumn("created_at", F.timestamp_seconds(F.col("id")))
    turns.coalesce(1).write.parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream = spark.readStream.schema(turns.schema).parquet(source)
    streams.bounded_history(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    held = logs.latest_version(spark.read.parquet(out).drop("part"), ["user_email"], "_batch", "_batch")
    return held.select("user_email", F.array_join("entries", SEP).alias("entries"))


@query("SELECT block_id, doc, page, block_index, column_no, text, is_heading, is_figure, section, loaded_at FROM blocks")
def scalar_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return records.scalar_fields(table(spark, folder, "blocks"))


# -- what parsers hand over -----------------------------------------------------------------------------------------
def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").withColumnRenamed("table_id", "ord")


STRIPPED = f"[_r for _r in [[{S.strip("coalesce(_c, '')")} for _c in _q] for _q in coalesce(rows, []) if _q IS NOT NULL] if len([1 for _y in _r if _y <> '']) > 0]"


@query(f"WITH k AS (SELECT doc, page, table_id, {STRIPPED} AS rs FROM tables) SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY table_id) - 1 AS INT) AS table_index, array_to_string([array_to_string(_r, '|') for _r in rs], '{SEP}') AS cells FROM k WHERE len(rs) > 0")
def simple_tables(spark: SparkSession, folder: str) -> DataFrame:
    found = parsed.simple_tables(_raw(spark, folder).select("doc", "page", "ord", F.filter(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: r.isNotNull()).alias("rows")))
    return found.select("doc", "page", F.col("table_index").cast("int").alias("table_index"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), SEP).alias("cells"))


@query(f"""WITH c AS (SELECT *, {S.CLEAN_ROWS} AS rs, string_split(bbox, ',') AS b FROM tables WHERE bbox IS NOT NULL), q AS (SELECT *, coalesce(list_max([len(_r) for _r in rs]), 0) AS w, coalesce(list_sum([len(_r) for _r in rs]), 0) AS total, coalesce(list_sum([len([1 for _x in _r if _x <> '']) for _r in rs]), 0) AS filled FROM c)
SELECT doc, page, CAST(table_id AS INT) AS table_index, CAST(len(rs) AS INT) AS n_rows, CAST(w AS INT) AS n_cols, array_to_string([printf('%.1f', CAST(_x AS DOUBLE)) for _x in b], ',') AS bbox FROM q WHERE len(rs) >= 2 AND w >= 2 AND filled / greatest(total, 1) >= 0.3""")
def found_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A line finder's tables that pass the quality rule, by the finder's own index."""
    raw = _raw(spark, folder).where("bbox is not null").withColumn("b", F.split("bbox", ","))
    raw = raw.select("doc", "page", "ord", "rows", *[F.col("b")[i].cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return parsed.found_tables(raw).select("doc", "page", "table_index", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), "bbox")


@query(f"SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY table_id) - 1 AS INT) AS table_index, markdown, CASE WHEN coalesce(caption, '') <> '' THEN caption END AS caption, n_rows, n_cols FROM tables WHERE {S.strip("coalesce(markdown, '')")} <> ''")
def converted_tables(spark: SparkSession, folder: str) -> DataFrame:
    return parsed.converted_tables(_raw(spark, folder)).withColumn("table_index", F.col("table_index").cast("int"))


@query(f"SELECT doc, page + 10 AS page, CAST(table_id AS INT) AS table_index, markdown, CASE WHEN coalesce(caption, '') <> '' THEN caption END AS caption, n_rows, n_cols FROM tables WHERE {S.strip("coalesce(markdown, '')")} <> ''")
def converted_tables_only(spark: SparkSession, folder: str) -> DataFrame:
    return parsed.converted_tables_only(_raw(spark, folder), 10)


@query(f"""WITH k AS (SELECT table_id, doc, page, {S.CLEAN_ROWS} AS rs, rows FROM tables), q AS (SELECT *, coalesce(list_max([len(_r) for _r in rs]), 0) AS w FROM k)
SELECT table_id, CASE WHEN rows IS NULL THEN 'none' WHEN w > 3 THEN 'lines' WHEN len(rs) > 6 THEN 'text' ELSE 'mixed' END AS strategy FROM q""")
def finder_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """The strategy whose settings a finder is called with, page by page."""
    q = T.quality(F.col("rows"))
    chosen = F.when(F.col("rows").isNull(), "none").when(F.col("q.max_cols") > 3, "lines").when(F.col("q.kept_rows") > 6, "text").otherwise("mixed")
    found = table(spark, folder, "tables").withColumn("q", q).select("table_id", chosen.alias("strategy"))
    return found.select("table_id", parsed.finder_settings(F.col("strategy"))["name"].alias("strategy"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    blocks = layout.boxes(table(spark, folder, "blocks").where("doc is not null and page is not null").select("block_id", "doc", "page", "bbox", "text", "is_heading"))
    return blocks.select("doc", "page", "block_id", "text", (F.col("y1") - F.col("y0")).alias("size"), F.col("is_heading").alias("bold"))


SPANS = f"{S.BOXES}, s AS (SELECT b.doc, b.page, b.block_id, coalesce(b.text, '') AS text, y1 - y0 AS size, coalesce(o.is_heading, false) AS bold FROM b JOIN blocks o USING (block_id) WHERE b.doc IS NOT NULL AND b.page IS NOT NULL)"


@query(f"WITH {SPANS} SELECT doc, page, round(max(size), 1) AS size, sum(CASE WHEN bold THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1) > 0.6 AS bold, coalesce(string_agg(text, chr(10) ORDER BY block_id) FILTER (WHERE {S.strip('text')} <> ''), '') AS text FROM s GROUP BY doc, page")
def assembled_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks from their spans: a page's blocks stand for the spans of one."""
    return layout.assembled_blocks(_spans(spark, folder), ["doc", "page"], "block_id", "text", "size", "bold")


@query(f"WITH {SPANS} SELECT block_id, length({S.strip('text')}) <= 120 AND (size > 1.15 * 20.0 OR bold OR regexp_matches({S.strip('text')}, '^[0-9]{{1,2}}\\.[ \\t\\n\\r\\f\\x0b]')) AS heading FROM s")
def heading_test(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("block_id", layout.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.lit(20.0)).alias("heading"))


@query("SELECT block_id, lower(coalesce(CASE WHEN is_figure THEN 'Picture' ELSE section END, '')) AS label, page AS first_page FROM blocks")
def layout_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels in small letters and the page of the first provenance."""
    label = F.when(F.col("is_figure"), "Picture").otherwise(F.col("section"))
    provs = F.when(F.col("page").isNotNull(), F.array(F.struct(F.col("page").alias("page")), F.struct((F.col("page") + 1).alias("page")))).otherwise(F.array().cast("array<struct<page:int>>"))
    return table(spark, folder, "blocks").select("block_id", parsed.layout_labels(label).alias("label"), parsed.first_page(provs).alias("first_page"))


@query(f"SELECT id, {S.strip("CASE WHEN grounded THEN coalesce(question, '') ELSE '' END || coalesce(answer, '')")} AS reply FROM query_logs")
def reply_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The text blocks of a reply joined; blocks of other types are left out."""
    kind = F.when(F.col("grounded"), "text").otherwise("tool")
    blocks = F.array(F.struct(kind.alias("type"), F.col("question").alias("text")), F.struct(F.lit("text").alias("type"), F.col("answer").alias("text")))
    return table(spark, folder, "query_logs").select("id", parsed.joined_text_blocks(blocks).alias("reply"))


@query("SELECT table_id, CAST(len([1 for _l in string_split(coalesce(markdown, ''), chr(10)) if length(_l) - length(replace(_l, '|', '')) >= 2]) AS INT) AS pipe_rows FROM tables")
def pipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.pipe_rows(F.col("markdown")).alias("pipe_rows"))


# -- pages and plans from the tables --------------------------------------------------------------------------------
RANGES = "(SELECT block_id, CASE WHEN block_id % 4 = 0 THEN '' ELSE (block_id % 7) || '-' || (block_id % 7 + block_id % 5) || ', ' || (block_id % 11) END AS spec, 10 AS n FROM blocks)"


@query(f"""WITH s AS {RANGES}, p AS (SELECT block_id, CASE WHEN spec = '' THEN range(1, 11) ELSE list_concat(range(block_id % 7, block_id % 7 + block_id % 5 + 1), [block_id % 11]) END AS ps FROM s), k AS (SELECT block_id, [_x for _x in ps if _x >= 1 AND _x <= 10] AS ps FROM p)
SELECT block_id, array_to_string(list_sort(list_distinct(ps)), ',') AS pages, array_to_string(ps, ',') AS as_written FROM k""")
def page_ranges_of_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Page specifications made from the numbers of the blocks, one for each."""
    i = F.col("block_id")
    text = lambda c: c.cast("string")
    spec = F.when(i % 4 == 0, "").otherwise(F.concat(text(i % 7), F.lit("-"), text(i % 7 + i % 5), F.lit(", "), text(i % 11)))
    shown = lambda distinct: F.array_join(page_list(F.col("spec"), F.lit(10), distinct).cast("array<string>"), ",")
    return table(spark, folder, "blocks").select("block_id", spec.alias("spec")).select("block_id", shown(True).alias("pages"), shown(False).alias("as_written"))


ASKED = S.strip("coalesce(question, '')")
RESOLVED = S.strip("coalesce(resolved_question, '')")


@query(f"""WITH p AS (SELECT id, {ASKED} AS q, {RESOLVED} AS r, grounded, id % 5 AS form FROM query_logs WHERE question IS NOT NULL),
s AS (SELECT id, q, form, grounded, CASE WHEN form IN (0, 4) OR r = '' THEN q ELSE r END AS standalone, r FROM p),
l AS (SELECT *, CASE WHEN form = 1 THEN [_x for _x in [q, r] if _x <> ''] WHEN form = 2 THEN [_x for _x in [q] if _x <> ''] ELSE [standalone] END AS subs FROM s)
SELECT id, standalone, array_to_string(CASE WHEN len(subs) = 0 OR length(array_to_string(subs, '')) < 3 * len(subs) THEN [standalone] ELSE subs END, ';') AS sub_queries, CASE WHEN form IN (0, 4) THEN true WHEN form = 3 THEN true ELSE coalesce(grounded, true) END AS in_scope FROM l""")
def plan_of_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Planner replies made from every log: no JSON, a list of sub-questions, one string, none, or a bare list."""
    form = F.col("id") % 5
    null = lambda c: F.to_json(F.array(c))
    quoted = lambda c: F.regexp_replace(null(c), r"^\[|\]$", "")
    q, r = quoted(F.coalesce("question", F.lit(""))), quoted(F.coalesce("resolved_question", F.lit("")))
    scope = F.concat(F.lit(', "in_scope": '), F.coalesce(F.col("grounded").cast("string"), F.lit("null")), F.lit("}"))
    head = F.concat(F.lit('{"standalone_question": '), r)
    plan = (
        F.when(form == 0, F.lit("not json"))
        .when(form == 1, F.concat(head, F.lit(', "sub_queries": ['), q, F.lit(', " ", 7, '), r, F.lit("]"), scope))
        .when(form == 2, F.concat(head, F.lit(', "sub_queries": '), q, scope))
        .when(form == 3, F.concat(head, F.lit("}")))
        .otherwise(F.concat(F.lit("["), r, F.lit("]")))
    )
    got = table(spark, folder, "query_logs").where("question is not null").select("id", select.sanitised_plan(plan, F.col("question")).alias("p"))
    return got.select("id", "p.standalone", F.array_join("p.sub_queries", ";").alias("sub_queries"), "p.in_scope")


@query("SELECT id, CASE WHEN coalesce(grounded, true) THEN coalesce(answer, '') ELSE 'This is outside what the books cover.' END AS answer, coalesce(grounded, true) AS in_scope, coalesce(grounded, true) AS grounded FROM query_logs")
def scope_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What is out of scope gets a fixed reply and isn't grounded; an unknown scope is in."""
    df = table(spark, folder, "query_logs").select("id", F.col("grounded").alias("scope"), "answer")
    return select.scope_gate(df, F.col("scope"), "This is outside what the books cover.").select("id", "answer", "in_scope", "grounded")


@query("SELECT id, CASE WHEN contains(coalesce(answer, ''), 'not permitted') THEN 'This is outside what the books cover.' ELSE 'Not from the books: ' || coalesce(answer, '') END AS reply, contains(coalesce(answer, ''), 'not permitted') AS outside FROM query_logs")
def fallback_reply(spark: SparkSession, folder: str) -> DataFrame:
    """A reply from elsewhere gets the disclaimer before it, or the fixed reply where it names the sign of being out of scope."""
    shown = cite.fallback_reply(F.col("answer"), "not permitted", "This is outside what the books cover.", "Not from the books: ")
    return table(spark, folder, "query_logs").select("id", shown.alias("reply"), cite.names_marker(F.col("answer"), "not permitted").alias("outside"))


# -- citations ------------------------------------------------------------------------------------------------------
CITED = """(SELECT id, c.book AS book, c.page AS page FROM (SELECT id, unnest(from_json(citations, '[{"book": "VARCHAR", "page": "INTEGER"}]')) AS c FROM query_logs WHERE citations IS NOT NULL))"""


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_logs").withColumn("cited", F.from_json("citations", "array<struct<book:string,page:int>>"))


LABELLED = "upper(substr(book, 1, 1)) || lower(substr(book, 2))"


@query(f"""WITH c AS (SELECT id, n, {LABELLED} || ' p.' || page AS s FROM (SELECT id, c.book AS book, c.page AS page, n FROM (SELECT id, unnest(x) AS c, unnest(range(0, len(x))) AS n FROM (SELECT id, from_json(citations, '[{{"book": "VARCHAR", "page": "INTEGER"}}]') AS x FROM query_logs WHERE citations IS NOT NULL)))),
d AS (SELECT id, s, min(n) AS n FROM c GROUP BY id, s), j AS (SELECT id, string_agg(s, '; ' ORDER BY n) AS s FROM d GROUP BY id)
SELECT q.id, coalesce(answer, '') || CASE WHEN s IS NOT NULL THEN chr(10) || chr(10) || '— Sources: ' || s ELSE '' END AS reply FROM query_logs q LEFT JOIN j ON j.id = q.id""")
def reply_with_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _cited(spark, folder).select("id", cite.reply_with_sources(F.col("answer"), F.col("cited")).alias("reply"))


@query("""WITH c AS (SELECT id, string_agg(c.book || ' p.' || c.page, '; ' ORDER BY n) AS s FROM (SELECT id, unnest(x) AS c, unnest(range(0, len(x))) AS n FROM (SELECT id, from_json(citations, '[{"book": "VARCHAR", "page": "INTEGER"}]') AS x FROM query_logs WHERE citations IS NOT NULL)) GROUP BY id)
SELECT q.id, coalesce(answer, '') || chr(10) || chr(10) || 'Sources: ' || coalesce(s, 'none') || chr(10) || 'Grounded: ' || CASE WHEN coalesce(grounded, false) THEN 'yes' ELSE 'no' END AS reply FROM query_logs q LEFT JOIN c ON c.id = q.id""")
def answer_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return _cited(spark, folder).select("id", cite.envelope(F.col("answer"), F.col("cited"), F.col("grounded")).alias("reply"))


#: Pages of the collection's hot book that the pages of the logs' books stand for.
SHELF = 50


def _picked(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks each log's citations were picked from: page p of a book stands for page p % SHELF of the compendium."""
    asked = _cited(spark, folder).select("id", F.explode("cited").alias("c")).select("id", F.col("c.book").alias("source"), F.col("c.page").alias("page")).where("page is not null").distinct()
    blocks = table(spark, folder, "blocks").where("doc = 'compendium'").select("page", F.concat(F.lit("b"), F.col("block_id").cast("string")).alias("stem"), F.lit("prose").alias("type"), F.coalesce("text", F.lit("")).alias("doc"), F.lit(1).alias("parts"))
    tabs = table(spark, folder, "tables").where("doc = 'compendium'").select("page", F.concat(F.lit("t"), F.col("table_id").cast("string")).alias("stem"), F.lit("table").alias("type"), F.coalesce("markdown", F.lit("")).alias("doc"), F.lit(2).alias("parts"))
    held = blocks.unionByName(tabs).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    chunk = F.concat("source", F.lit("_p"), F.col("page").cast("string"), F.lit("_"), "stem", F.when(F.col("parts") > 1, F.concat(F.lit("_c"), F.col("part").cast("string"))).otherwise(""))
    return asked.join(held.withColumnRenamed("page", "_p"), F.col("page") % SHELF == F.col("_p")).select(F.col("id").alias("log_id"), chunk.alias("id"), "source", "page", "type", "doc")


@query(f"""WITH asked AS (SELECT DISTINCT id, book AS source, page FROM {CITED} WHERE page IS NOT NULL),
held AS (SELECT page AS p, 'b' || block_id AS stem, 'prose' AS type, coalesce(text, '') AS body, 0 AS part, 1 AS parts FROM blocks WHERE doc = 'compendium' UNION ALL SELECT page, 't' || table_id, 'table', coalesce(markdown, ''), k, 2 FROM tables, (VALUES (0), (1)) AS v(k) WHERE doc = 'compendium'),
picked AS (SELECT id AS log_id, source || '_p' || page || '_' || stem || CASE WHEN parts > 1 THEN '_c' || part ELSE '' END AS cid, lower(source) AS book, CAST(page AS VARCHAR) AS page, type, stem, part, length(body) AS size FROM asked JOIN held ON page % {SHELF} = p),
m AS (SELECT id AS log_id, book, page, pos FROM {MARKED}),
j AS (SELECT m.log_id, m.book, m.page, m.pos, cid, {S.natural('cid')} AS o, size, row_number() OVER (PARTITION BY m.log_id, m.book, m.page, type, stem ORDER BY {S.natural('cid')}) AS n, type FROM m JOIN picked USING (log_id, book, page)),
g AS (SELECT log_id, book, page, pos, string_agg(cid, ' ' ORDER BY o, cid) AS ids, count(*) AS n_passages FROM j WHERE n = 1 OR type <> 'table' GROUP BY log_id, book, page, pos)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY pos) - 1 AS cite_no, book, CAST(page AS INT) AS page, ids, n_passages FROM g""")
def citations_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer's markers with the picked chunks of their source and page: all ids in natural order, a table once."""
    found = cite.markers(table(spark, folder, "query_logs").withColumnRenamed("id", "log_id"), "log_id", "answer")
    cited = cite.citations(found, _picked(spark, folder), "log_id")
    return cited.select("log_id", F.col("cite_no").cast("long").alias("cite_no"), "book", "page", F.array_join("ids", " ").alias("ids"), F.size("passages").cast("long").alias("n_passages"))


# -- search ---------------------------------------------------------------------------------------------------------
def _denied(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    items = table(spark, folder, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    ranked = retrieve.only_sources(retrieve.bm25_topk(docs, items, 3 * retrieve.RAW_K), docs, SOURCES)
    none = ranked.select("query_id", "doc_id", F.col("rank")).where("false")
    facts = docs.select("doc_id", "text", "source", F.lit("prose").alias("type"))
    return retrieve.kept_hits(retrieve.fuse(none, ranked), facts, keep=6, denied=("1", "22")).join(facts.select("doc_id", "source", F.col("text").alias("body")), "doc_id")


@query(f"""WITH {S.BM25}, {S.scores(S.ITEMS).replace('{k}', '180')}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM sparse JOIN documents USING (doc_id) WHERE source IN ({', '.join(f"'{s}'" for s in SOURCES)})),
h AS (SELECT query_id, doc_id, source, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS n FROM a JOIN documents USING (doc_id) WHERE rank < 60 AND length({S.strip("coalesce(text, '')")}) >= 80 AND NOT starts_with(CAST(doc_id AS VARCHAR), '1') AND NOT starts_with(CAST(doc_id AS VARCHAR), '22'))
SELECT query_id, n AS hit_rank, doc_id, source, CAST(NULL AS INT) AS page, text FROM h WHERE n < 6""")
def search_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Search among allowed sources without denied ids: source, page and text of the best six."""
    hits = _denied(spark, folder).withColumn("page", F.lit(None).cast("int"))
    return select.search_rows(hits, "query_id", "hit_rank", "doc_id", "source", "page", "body")


@query("SELECT count(*) AS n_questions, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0")
def dense_approximate_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The approximate index held against the exact search over the same questions: are nine tenths of the nearest found?"""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieve.dense_topk(vectors, asked).select("query_id", "vec_id")
    found = retrieve.DenseIndex(vectors).topk(asked).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    both = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("n_questions"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_of_nine_tenths"))
    return both


EXPAND = r"(?i)\b(?:" + "|".join(sorted(ACRONYMS, key=lambda k: (-len(k), k))) + r")\b"
SQL["acronym_expand"] = f"""WITH t AS (SELECT id, coalesce(question, '') AS q, regexp_extract_all(coalesce(question, ''), '{EXPAND}') AS f, string_split_regex(coalesce(question, ''), '{EXPAND}') AS g FROM query_logs),
e AS (SELECT id, q, f, g, [upper(_w) for _w in f] AS u, [_w = upper(_w) OR NOT (lower(_w) IN ('an', 'ar', 'pet', 'spa', 'us')) for _w in f] AS ok FROM t),
n AS (SELECT id, q, g, f, u, ok, unnest(range(1, len(f) + 1)) AS i FROM e WHERE len(f) > 0),
p AS (SELECT id, i, f[i] || CASE WHEN ok[i] AND len([1 for _j in range(1, i) if u[_j] = u[i] AND ok[_j]]) = 0 THEN ' (' || CASE u[i] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACRONYMS.items())} END || ')' ELSE '' END || coalesce(g[i + 1], '') AS part FROM n),
j AS (SELECT id, string_agg(part, '' ORDER BY i) AS rest FROM p GROUP BY id)
SELECT e.id, CASE WHEN rest IS NULL THEN q ELSE g[1] || rest END AS expanded FROM e LEFT JOIN j ON j.id = e.id"""


# -- chunks and repairs ---------------------------------------------------------------------------------------------
BLANK = r"[ \t\n\r\f\x0b]"
SQL["token_chunk_texts"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {S.n_tokens('text')} AS n FROM documents), p AS (SELECT doc_id, t, n, regexp_extract_all(t, '{BLANK}*(?:{S.TOKEN})') AS p, {S.windows('n', 254, 32)} AS w FROM d WHERE n > 254),
k AS (SELECT *, unnest(range(0, w)) AS k FROM p), x AS (SELECT doc_id, t, k, array_to_string(p[1:k * 222], '') AS pre, array_to_string(p[k * 222 + 1:least(n, k * 222 + 254)], '') AS mid FROM k),
y AS (SELECT doc_id, k, {S.strip(f"CASE WHEN regexp_matches(mid, '^{BLANK}') THEN '' ELSE regexp_extract(pre, '[^{S.WS}]*$') END || mid || regexp_extract(substr(t, length(pre) + length(mid) + 1), '^[^{S.WS}]*')")} AS piece FROM x),
z AS (SELECT doc_id, k, piece FROM y WHERE piece <> '' UNION ALL SELECT doc_id, 0, t FROM d WHERE n <= 254)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n_chunks, piece FROM z"""

SQL["ligature_repair_texts"] = f"""WITH r AS ({S.repairs()}), p AS (SELECT block_id, text, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS part, unnest(range(0, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')))) AS n FROM blocks WHERE text IS NOT NULL),
f AS (SELECT block_id, n, CASE WHEN repaired IS NULL THEN part WHEN part = upper(part) THEN upper(repaired) WHEN substr(part, 1, 1) = upper(substr(part, 1, 1)) THEN upper(substr(repaired, 1, 1)) || substr(repaired, 2) ELSE repaired END AS part FROM p LEFT JOIN r ON r.word = lower(part)),
j AS (SELECT block_id, string_agg(part, '' ORDER BY n) AS text FROM f GROUP BY block_id)
SELECT b.block_id, CASE WHEN b.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text FROM blocks b LEFT JOIN j USING (block_id)"""


@query(SQL["ligature_repair_texts"])
def repaired_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same rule over a file of records, which is told from a file of plain text by its name."""
    path = scratch(spark, "records") + ".jsonl"
    records.write_jsonl(table(spark, folder, "blocks").select("block_id", "text"), path)
    return repair.repaired_file(spark, path, _repairs(spark, folder), "block_id long, text string").select("block_id", "text")


WHOLE = S.strip("coalesce(answer, '')")


def _text(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit("")))


@query(f"SELECT id, {S.strip("coalesce(resolved_question, question, '')")} AS asked, coalesce(nullif({WHOLE}, ''), 'No answer.') AS answer FROM query_logs")
def answer_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """The text of a reply under either of its names, and a fixed reply where there is none."""
    asked = X.strip(F.coalesce("resolved_question", "question", F.lit("")))
    return table(spark, folder, "query_logs").select("id", asked.alias("asked"), F.coalesce(F.nullif(_text("answer"), F.lit("")), F.lit("No answer.")).alias("answer"))
