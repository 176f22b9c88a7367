"""The query catalogue: every operator over whole tables, with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomine.functions import tables as T
from foliomine.functions import text as X
from foliomine.operators import chunking, cite, filters, layout, logs, repair, retrieve, scans, select
from foliomine.plans import sql as S
from foliomine.session import table
from foliomine.sources.pages import page_list

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "2024-06-01 00:00:00"
#: Parameters of the catalogue: how the books of the logs are called, and some acronyms.
ALIASES = {"auralis": "auralis", "auralis atlas": "auralis", "vestibula": "vestibula", "vestibula atlas": "vestibula", "otonaut": "otonaut", "otonaut atlas": "otonaut", "laryngia": "laryngia", "rhinarium": "rhinarium", "cervica": "cervica"}
ACRONYMS = {"MRN": "medical record number", "SSN": "social security number", "NHS": "national health service", "ID": "identity", "XX": "unknown region"}
MARKER = "could not find this"
SOURCES = ["wardround", "voiceiforum", "larynoforum"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- prose records ----------------------------------------------------------------------------------------------------
@query(f"SELECT coalesce({S.DROP}, 'kept') AS drop_reason, count(*) AS n FROM blocks GROUP BY ALL")
def scan_filter_cascade(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks")
    return blocks.groupBy(F.coalesce(filters.drop_reason(F.col("text"), F.col("section")), F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT block_id, doc, page, block_index FROM blocks WHERE ({S.DROP}) IS NULL")
def kept_prose(spark: SparkSession, folder: str) -> DataFrame:
    return filters.kept_prose(table(spark, folder, "blocks")).select("block_id", "doc", "page", "block_index")


@query(f"SELECT block_id, coalesce(regexp_matches({S.strip("string_split(coalesce(text, ''), chr(10))[1]")}, '(?i)^fig(ure)?\\.?\\s*[0-9]'), false) AS is_figure FROM blocks")
def figure_tag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").select("block_id", filters.is_figure_caption(F.col("text")).alias("is_figure"))


@query(f"SELECT block_id, lower({S.squash("coalesce(text, '')")}) AS norm FROM blocks")
def whitespace_norm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").select("block_id", X.norm(F.col("text")).alias("norm"))


@query(f"WITH {S.BOXES} SELECT block_id FROM b WHERE NOT coalesce((y1 < 50.52 OR y0 > 791.48) AND length(text) < 40, false)")
def margin_drop(spark: SparkSession, folder: str) -> DataFrame:
    b = layout.boxes(table(spark, folder, "blocks").select("block_id", "bbox", "text"))
    return b.where(~F.coalesce(filters.in_margin(F.col("y0"), F.col("y1"), F.col("text")), F.lit(False))).select("block_id")


@query(f"SELECT doc, page, {S.strip("string_agg(text, chr(10) || chr(10) ORDER BY block_index NULLS FIRST, block_id)")} AS page_text, length({S.strip("string_agg(text, chr(10) || chr(10) ORDER BY block_index NULLS FIRST, block_id)")}) < 40 AS near_empty FROM blocks WHERE text IS NOT NULL GROUP BY doc, page")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return filters.page_texts(table(spark, folder, "blocks"))


@query("SELECT doc_id, CAST(start_char // 600 AS INT) AS chunk_index, CAST(start_char AS INT) AS start_char, substr(text, CAST(start_char AS INT) + 1, 700) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 600)) AS start_char FROM documents WHERE text <> '')")
def char_chunks_700_100(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.char_chunks(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", "start_char", "piece")


@query("SELECT doc_id, CAST(k AS INT) AS part_no, substr(text, CAST(k * 4000 + 1 AS INT), 4000) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 3999) // 4000)) AS k FROM documents WHERE text <> '')")
def split_message_4000(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(X.pieces(F.col("text"), 4000)).alias("part_no", "p")).select("doc_id", "part_no", F.col("p.piece").alias("part"))


@query(f"WITH p AS (SELECT doc_id, [{S.strip('_x')} for _x in string_split(coalesce(text, ''), chr(10) || chr(10)) if {S.strip('_x')} <> ''] AS ps FROM documents) SELECT doc_id, unnest(range(0, len(ps))) AS para_no, {S.strip("replace(replace(unnest(ps), '-' || chr(10), ''), chr(10), ' ')")} AS para FROM p")
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("para_no", "p"))
    return docs.select("doc_id", F.col("para_no").cast("long").alias("para_no"), chunking.clean_page(F.col("p")).alias("para"))


@query(f"""WITH t AS (SELECT doc_id, {S.n_tokens('text')} AS n FROM documents), w AS (SELECT doc_id, n, {S.windows('n', 254, 32)} AS n_chunks FROM t)
SELECT doc_id, n_chunks, CAST(k AS INT) AS chunk_index, CAST(k * 222 AS INT) AS start_token, CAST(least(n, k * 222 + 254) AS INT) AS end_token FROM (SELECT *, unnest(range(0, n_chunks)) AS k FROM w)""")
def token_chunks_254_32(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return chunking.token_windows(docs, "text").select("doc_id", "n_chunks", "chunk_index", "start_token", "end_token")


@query()
def token_chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.token_chunks(table(spark, folder, "documents"), "doc_id", "text")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    prose = chunking.token_windows(filters.kept_prose(table(spark, folder, "blocks").select("block_id", "doc", "page", "block_index", "text", "section")), "text", 64, 8)
    prose = prose.select(chunking.chunk_id(F.col("doc"), F.col("page"), "b", F.col("block_index"), F.col("chunk_index"), F.col("n_chunks")).alias("id"), "doc", "page", F.lit("prose").alias("type"), F.col("block_id").alias("rec_id"), "chunk_index", "n_chunks")
    tabs = chunking.token_windows(table(spark, folder, "tables").select("table_id", "doc", "page", "table_index", "markdown"), "markdown", 64, 8)
    tabs = tabs.select(chunking.chunk_id(F.col("doc"), F.col("page"), "t", F.col("table_index"), F.col("chunk_index"), F.col("n_chunks")).alias("id"), "doc", "page", F.lit("table").alias("type"), F.col("table_id").alias("rec_id"), "chunk_index", "n_chunks")
    return prose.unionByName(tabs)


def _chunk_sql(key: str, letter: str, index: str, text: str, source: str, kind: str) -> str:
    return f"""SELECT doc || '_p' || coalesce(CAST(page AS VARCHAR), 'None') || '_{letter}' || coalesce(CAST({index} AS VARCHAR), 'None') || CASE WHEN n_chunks > 1 THEN '_c' || k ELSE '' END AS id, doc, page, '{kind}' AS type, {key} AS rec_id, CAST(k AS INT) AS chunk_index, n_chunks
FROM (SELECT *, unnest(range(0, n_chunks)) AS k FROM (SELECT *, {S.windows(S.n_tokens(text), 64, 8)} AS n_chunks FROM ({source})))"""


CHUNKS = _chunk_sql("block_id", "b", "block_index", "text", f"SELECT * FROM blocks WHERE ({S.DROP}) IS NULL", "prose") + " UNION ALL " + _chunk_sql("table_id", "t", "table_index", "markdown", "SELECT * FROM tables", "table")


@query(CHUNKS)
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder)


@query(f"""WITH c AS ({CHUNKS}), f AS (SELECT doc, page, type, CASE WHEN type = 'table' THEN regexp_replace(id, '_c[0-9]+$', '') ELSE id END AS family, id, {S.natural('id')} AS o FROM c WHERE id IS NOT NULL),
one AS (SELECT doc, page, type, family, min(o) AS o, first(id ORDER BY o) AS id FROM f GROUP BY ALL)
SELECT doc, page, string_agg(id, ' ' ORDER BY o, id) AS ids, count(*) AS n_kept FROM one GROUP BY doc, page""")
def citation_families(spark: SparkSession, folder: str) -> DataFrame:
    return cite.families(_chunks(spark, folder).where(F.col("id").isNotNull()), ["doc", "page"])


# -- tables -----------------------------------------------------------------------------------------------------------
@query(f"""WITH c AS (SELECT table_id, {S.CLEAN_ROWS} AS rs FROM tables), w AS (SELECT table_id, rs, list_max([len(_r) for _r in rs]) AS w FROM c), p AS (SELECT table_id, [list_resize(_r, w, '') for _r in rs] AS rs, w FROM w)
SELECT table_id, CASE WHEN len(rs) > 0 THEN array_to_string(list_concat(['| ' || array_to_string(rs[1], ' | ') || ' |', '| ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), w, '---'), ' | ') || ' |'], ['| ' || array_to_string(_r, ' | ') || ' |' for _r in rs[2:]]), chr(10)) ELSE '' END AS markdown FROM p""")
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.to_markdown(F.col("rows")).alias("markdown"))


@query("""WITH c AS (SELECT table_id, [[coalesce(_x, '') for _x in _r] for _r in coalesce(rows, []) if _r IS NOT NULL] AS rs FROM tables)
SELECT table_id, CASE WHEN len(rs) > 0 THEN array_to_string(list_concat(['| ' || array_to_string(rs[1], ' | ') || ' |', '| ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), len(rs[1]), '---'), ' | ') || ' |'], ['| ' || array_to_string(list_resize(_r, len(rs[1]), ''), ' | ') || ' |' for _r in rs[2:]]), chr(10)) ELSE '' END AS markdown FROM c""")
def table_markdown_by_header(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.to_markdown_by_header(F.col("rows")).alias("markdown"))


@query(f"""WITH c AS (SELECT table_id, {S.CLEAN_ROWS} AS rs FROM tables), q AS (SELECT table_id, len(rs) AS kept_rows, coalesce(list_max([len(_r) for _r in rs]), 0) AS max_cols, coalesce(list_sum([len(_r) for _r in rs]), 0) AS total, coalesce(list_sum([len([1 for _x in _r if _x <> '']) for _r in rs]), 0) AS filled FROM c)
SELECT table_id, CAST(kept_rows AS INT) AS kept_rows, CAST(max_cols AS INT) AS max_cols, round(filled / greatest(total, 1), 6) AS filled_share, kept_rows >= 2 AND max_cols >= 2 AND filled / greatest(total, 1) >= 0.3 AS keep FROM q""")
def table_quality(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.quality(F.col("rows")).alias("q")).select("table_id", "q.*")


CAPTION = f"CASE WHEN coalesce(caption, '') <> '' THEN {S.strip('caption')} ELSE coalesce([_h for _h in {S.cells(S.first_line('markdown'))} if _h <> ''][1], '') END"
NAMED = f"(?i)^table[{S.WS}]+[0-9.]+[{S.WS}]+(.*)$"
FLAT = S.squash("regexp_replace(replace(coalesce(markdown, ''), '|', ' '), '-{2,}', ' ', 'g')")
CAPTIONED = f"(SELECT table_id, CASE WHEN regexp_matches(head, '{NAMED}') THEN {S.strip(f"regexp_extract(head, '{NAMED}', 1)")} ELSE head END AS title, flat FROM (SELECT table_id, {CAPTION} AS head, {FLAT} AS flat FROM tables))"


@query(f"SELECT table_id, title, flat FROM {CAPTIONED}")
def table_caption_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.caption(F.col("markdown"), F.col("caption")).alias("title"), T.flatten(F.col("markdown")).alias("flat"))


@query(f"SELECT table_id, CASE WHEN title <> '' THEN 'Table: ' || title || '. ' || title || '. ' || flat ELSE flat END AS search_text FROM {CAPTIONED}")
def table_embed_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.search_text(F.col("markdown"), T.caption(F.col("markdown"), F.col("caption"))).alias("search_text"))


NAV_ROWS = f"[_l for _l in string_split_regex(coalesce(markdown, ''), '[{S.LE}]') if {S.strip('_l')} <> '' AND NOT regexp_matches(_l, '^[{S.WS}]*\\|?[{S.WS}|:-]+\\|?[{S.WS}]*$')]"


@query(f"""WITH r AS (SELECT table_id, {NAV_ROWS} AS rs FROM tables), n AS (SELECT table_id, rs, len([1 for _r in rs if len([1 for _c in string_split(regexp_replace({S.strip('_r')}, '^\\|+|\\|+$', '', 'g'), '|') if regexp_matches({S.strip('_c')}, ',[{S.WS}]*[0-9]+([{S.WS}]*[-–][{S.WS}]*[0-9]+)?[{S.WS}]*$')]) > 0]) AS n_index,
  len([1 for _r in rs if regexp_matches(coalesce([{S.strip('_c')} for _c in string_split(regexp_replace({S.strip('_r')}, '^\\|+|\\|+$', '', 'g'), '|') if {S.strip('_c')} <> ''][1], ''), '^[0-9]{{1,3}}$')]) AS n_number FROM r)
SELECT table_id, len(rs) >= 8 AND NOT regexp_matches(coalesce(rs[1], ''), '(?i)\\btable\\s+[0-9]') AND (2 * n_index >= len(rs) OR 2 * n_number >= len(rs)) AS is_nav FROM n""")
def nav_table_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.is_navigation(F.col("markdown")).alias("is_nav"))


FIRST = S.strip(S.first_line("markdown"))
TOP = "lower(substr(coalesce(markdown, ''), 1, 200))"


@query(f"""SELECT table_id, regexp_matches({FIRST}, '(?i)^fig\\.?\\s+[0-9]') OR (regexp_matches(coalesce([_h for _h in {S.cells(FIRST)} if _h <> ''][1], ''), '^[0-9]+\\.[0-9]+$') AND NOT contains({TOP}, 'table') AND NOT contains({TOP}, 'box')) AS droppable,
  NOT coalesce(regexp_matches({S.strip('caption')}, '(?i)^table\\s+[0-9.]+'), false) AND NOT regexp_matches({S.strip(f"regexp_replace({FIRST}, '^\\|+|\\|+$', '', 'g')")}, '(?i)^table\\s+[0-9.]+') AND length(regexp_replace(coalesce(markdown, ''), '[|\\-{S.WS}]', '', 'g')) < 60 AS fragment FROM tables""")
def junk_table_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.is_droppable(F.col("markdown")).alias("droppable"), T.is_fragment(F.col("markdown"), F.col("caption")).alias("fragment"))


@query(f"""WITH l AS (SELECT table_id, markdown, n, line FROM (SELECT table_id, markdown, unnest(string_split(coalesce(markdown, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(markdown, ''), chr(10))))) AS n FROM tables)),
k AS (SELECT *, [{S.strip('_c')} for _c in string_split(line, '|')] AS c0 FROM l WHERE NOT ({S.strip('line')} <> '' AND regexp_matches({S.strip('line')}, '^[|\\-: ]+$'))),
k1 AS (SELECT *, CASE WHEN c0[1] = '' THEN c0[2:] ELSE c0 END AS c1 FROM k), k2 AS (SELECT *, CASE WHEN len(c1) > 0 AND c1[-1] = '' THEN c1[:-2] ELSE c1 END AS c2 FROM k1),
k3 AS (SELECT *, [_f for _f in c2 if _f <> ''] AS filled FROM k2),
o AS (SELECT table_id, n, CASE WHEN NOT contains(line, '|') THEN line WHEN len(filled) >= 2 AND len(list_distinct(filled)) = 1 THEN filled[1] ELSE array_to_string([_z[1] for _z in list_zip(c2, list_concat([NULL], c2[:-2])) if _z[1] <> '' AND NOT (length(_z[1]) >= 20 AND _z[1] IS NOT DISTINCT FROM _z[2])], ' | ') END AS line FROM k3)
SELECT t.table_id, CASE WHEN contains(coalesce(markdown, ''), '|') THEN coalesce({S.strip('joined')}, '') ELSE {S.strip("coalesce(markdown, '')")} END AS text FROM tables t LEFT JOIN (SELECT table_id, string_agg(line, chr(10) ORDER BY n) AS joined FROM o WHERE {S.strip('line')} <> '' GROUP BY table_id) USING (table_id)""")
def collapse_dup_cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tables").select("table_id", T.collapse_repeats(F.col("markdown")).alias("text"))


# -- retrieval --------------------------------------------------------------------------------------------------------
@query(f"WITH {S.BM25} SELECT term, df, round(idf, 9) AS idf FROM w")
def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return retrieve.idf(retrieve.term_doc_freq(docs, "text"), docs.count()).withColumn("idf", F.round("idf", 9))


@query(f"WITH {S.BM25} SELECT doc_id, term, tf FROM tf")
def postings(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.postings(table(spark, folder, "documents"), "doc_id", "text")


@query(f"WITH {S.BM25} SELECT doc_id, CAST(n_terms AS INT) AS n_terms FROM sizes")
def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.doc_lengths(table(spark, folder, "documents"), "doc_id", "text")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(f"WITH {S.BM25}, {S.scores(S.ITEMS).replace('{k}', '60')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieve.bm25_topk(table(spark, folder, "documents"), _items(spark, folder))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {S.BM25}, {S.scores(S.ITEMS).replace('{k}', '180')}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM sparse JOIN documents USING (doc_id) WHERE source IN ({', '.join(f"'{s}'" for s in SOURCES)}))
SELECT query_id, doc_id, rank FROM a WHERE rank < 60""")
def bm25_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    ranked = retrieve.bm25_topk(docs, _items(spark, folder), 3 * retrieve.RAW_K)
    return retrieve.only_sources(ranked, docs, SOURCES).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {S.dense('SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0')} SELECT query_id, doc_id AS vec_id, round(distance, 6) AS distance, rank FROM dense")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors, asked = _vectors(spark, folder)
    found = retrieve.dense_topk(vectors, asked)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {S.dense('SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0', 'e.label IN (1, 3, 5)')} SELECT query_id, doc_id AS vec_id, rank FROM dense")
def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors, asked = _vectors(spark, folder)
    return retrieve.dense_topk(vectors.where(F.col("label").isin(1, 3, 5)), asked).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def _fused(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs, vectors = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text"))
    # a question without a vector is ranked by its words alone
    held = asked.select("query_id").join(vectors.select("vec_id", "embedding"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    near = retrieve.dense_topk(vectors, held).withColumnRenamed("vec_id", "doc_id")
    return docs, retrieve.fuse(near, retrieve.bm25_topk(docs, asked))


@query(S.HITS + " SELECT query_id, doc_id, dense_rank, sparse_rank, round(rrf, 9) AS rrf FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    fused = _fused(spark, folder)[1]
    return fused.select("query_id", "doc_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.round("rrf", 9).alias("rrf"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    docs, fused = _fused(spark, folder)
    facts = docs.select("doc_id", "text", F.when(F.col("doc_kind") == "guideline", "table").otherwise("prose").alias("type"))
    return retrieve.kept_hits(fused, facts)


@query(S.HITS + " SELECT query_id, doc_id, hit_rank, round(rrf, 9) AS rrf FROM hits")
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("query_id", "doc_id", F.col("hit_rank").cast("long").alias("hit_rank"), F.round("rrf", 9).alias("rrf"))


def _picks(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("query_id")
    hits = _hits(spark, folder).select(F.floor(q / 60).cast("long").alias("group_id"), F.floor((q % 60) / 20).cast("long").alias("sub_index"), "doc_id", "hit_rank", "rrf")
    return select.reserve_and_fill(hits)


@query(S.PICKS + " SELECT group_id, doc_id, round(rrf, 9) AS rrf, reserved, pick_rank FROM picks")
def quota_reserve_fill(spark: SparkSession, folder: str) -> DataFrame:
    return _picks(spark, folder).select("group_id", "doc_id", F.round("rrf", 9).alias("rrf"), "reserved", F.col("pick_rank").cast("long").alias("pick_rank"))


@query(S.PICKS + " SELECT group_id, string_agg('[' || coalesce(source, 'unknown') || ', p.?]' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pick_rank) AS context FROM picks JOIN documents USING (doc_id) GROUP BY group_id")
def context_render(spark: SparkSession, folder: str) -> DataFrame:
    picked = _picks(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id").withColumn("page", F.lit(None).cast("int"))
    return select.render_context(picked, "group_id", "pick_rank", "source", "page", "text")


@query(S.PICKS + " SELECT group_id, string_agg('[' || (pick_rank + 1) || '] ' || coalesce(source, 'unknown') || ', p.?' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pick_rank) AS passages FROM picks JOIN documents USING (doc_id) GROUP BY group_id")
def passage_list(spark: SparkSession, folder: str) -> DataFrame:
    picked = _picks(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id").withColumn("page", F.lit(None).cast("int"))
    return select.render_passages(picked, "group_id", "pick_rank", "source", "page", "text")


@query(f"SELECT id, CASE WHEN len(f) > 0 THEN array_to_string([_x[1] for _x in list_zip(f, range(1, len(f) + 1)) if list_position(f, _x[1]) = _x[2]], ',') END AS sources FROM (SELECT id, {S.routed(ALIASES)} AS f FROM query_logs)")
def alias_route(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieve.route_aliases(F.col("question"), ALIASES)
    return table(spark, folder, "query_logs").select("id", F.array_join(found, ",").alias("sources"))


@query()
def acronym_expand(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_logs").select("id", retrieve.expand_acronyms(F.col("question"), ACRONYMS).alias("expanded"))


PLANS = [
    (1, "q one", '{"standalone_question": " What now? ", "sub_queries": ["first part", " ", "second part", 7], "in_scope": true}'),
    (2, "q two", '{"standalone_question": "Whole", "sub_queries": "one string", "in_scope": false}'),
    (3, "q three", '{"standalone_question": "Whole", "sub_queries": ["a", "b", "c"]}'),
    (4, "q four", "not json"),
    (5, "q five", '["a list"]'),
    (6, "q six", '{"sub_queries": {"a": 1}, "in_scope": null}'),
    (7, "q seven", None),
]


@query(
    "SELECT * FROM (VALUES (1, 'What now?', 'first part;second part', true), (2, 'Whole', 'one string', false), (3, 'Whole', 'Whole', true), (4, 'q four', 'q four', true), (5, 'q five', 'q five', true), (6, 'q six', 'q six', true), (7, 'q seven', 'q seven', true)) AS v(plan_id, standalone, sub_queries, in_scope)"
)
def plan_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    plans = spark.createDataFrame(PLANS, "plan_id int, question string, plan string")
    got = plans.select("plan_id", select.sanitised_plan(F.col("plan"), F.col("question")).alias("p"))
    return got.select("plan_id", "p.standalone", F.array_join("p.sub_queries", ";").alias("sub_queries"), "p.in_scope")


# -- answers ----------------------------------------------------------------------------------------------------------
MARKS = r"(?i)\[([a-z]+),?\s*p\.?\s*([0-9]+)\]"
MARKED = f"(SELECT id, book, page, min(pos) AS pos FROM (SELECT id, lower(unnest(regexp_extract_all(answer, '{MARKS}', 1))) AS book, unnest(regexp_extract_all(answer, '{MARKS}', 2)) AS page, unnest(range(0, len(regexp_extract_all(answer, '{MARKS}', 1)))) AS pos FROM query_logs WHERE answer IS NOT NULL) GROUP BY id, book, page)"


@query(f"SELECT id, CAST(pos AS INT) AS pos, book, page FROM {MARKED}")
def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    return cite.markers(table(spark, folder, "query_logs"), "id", "answer").select("id", "pos", "book", "page")


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    kind = "array<struct<book:string,page:int>>"
    return table(spark, folder, "query_logs").select("id", F.explode(F.from_json("citations", kind)).alias("c")).select("id", F.lower("c.book").alias("book"), F.col("c.page").cast("string").alias("page")).distinct()


@query(f"""SELECT m.id, CAST(m.pos AS INT) AS pos, m.book, m.page FROM {MARKED} m JOIN (SELECT DISTINCT id, lower(c.book) AS book, CAST(c.page AS VARCHAR) AS page FROM (SELECT id, unnest(from_json(citations, '[{{"book": "VARCHAR", "page": "INTEGER"}}]')) AS c FROM query_logs WHERE citations IS NOT NULL)) j ON j.id = m.id AND j.book = m.book AND j.page = m.page""")
def citation_join(spark: SparkSession, folder: str) -> DataFrame:
    return cite.markers(table(spark, folder, "query_logs"), "id", "answer").join(_cited(spark, folder), ["id", "book", "page"], "left_semi").select("id", "pos", "book", "page")


WHOLE = S.strip("coalesce(answer, '')")
CORE = S.strip(f"""regexp_replace({WHOLE}, '^["# ]+', '')""")


@query(f"SELECT id, starts_with(lower({CORE}), '{MARKER}') OR (contains(lower({WHOLE}), '{MARKER}') AND length({WHOLE}) < 350) AS refused FROM query_logs")
def refusal_detect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_logs").select("id", cite.is_refusal(F.col("answer"), MARKER).alias("refused"))


@query("SELECT doc, array_to_string([upper(substr(_w, 1, 1)) || substr(_w, 2) for _w in regexp_extract_all(lower(replace(doc, '_', ' ')), '\\p{L}+|[^\\p{L}]+')], '') AS label FROM (SELECT DISTINCT doc FROM blocks WHERE doc <> '')")
def source_format_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").where("doc <> ''").select("doc").distinct().select("doc", cite.source_label(F.col("doc")).alias("label"))


# -- logs -------------------------------------------------------------------------------------------------------------
@query("SELECT model, count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, round(sum(coalesce(cost_usd, 0)), 6) AS cost_usd FROM usage_calls GROUP BY model")
def usage_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return logs.usage_by(table(spark, folder, "usage_calls"), "model")


@query(
    """WITH m AS (SELECT log_id, model, count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS i, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS o, CAST(round(sum(coalesce(cost_usd, 0)) * 1000000) AS BIGINT) AS c FROM usage_calls GROUP BY log_id, model)
SELECT log_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens, count(*) AS n_models, CAST(sum(c) AS BIGINT) AS cost_millionths, string_agg(coalesce(model, 'unknown') || ' ' || calls || ' ' || i || ' ' || o || ' ' || c, '; ' ORDER BY coalesce(model, 'unknown')) AS breakdown FROM m GROUP BY log_id"""
)
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = logs.usage_totals(table(spark, folder, "usage_calls"))
    millionths = lambda c: F.round(c * 1000000).cast("long")
    shown = F.array_join(F.transform(F.map_entries("cost_breakdown"), lambda e: F.concat_ws(" ", e["key"], e["value"]["calls"].cast("string"), e["value"]["input_tokens"].cast("string"), e["value"]["output_tokens"].cast("string"), millionths(e["value"]["cost_usd"]).cast("string"))), "; ")
    return totals.select("log_id", "input_tokens", "output_tokens", "total_tokens", F.size("cost_breakdown").cast("long").alias("n_models"), millionths(F.col("cost_usd")).alias("cost_millionths"), shown.alias("breakdown"))


@query("SELECT user_email, count(*) AS n FROM query_logs WHERE user_email IS NOT NULL GROUP BY user_email")
def user_counts(spark: SparkSession, folder: str) -> DataFrame:
    return logs.user_counts(table(spark, folder, "query_logs"))


@query(f"SELECT user_email, count(*) AS n FROM query_logs WHERE user_email IS NOT NULL AND created_at >= TIMESTAMP '{NOW}' GROUP BY user_email")
def user_counts_since(spark: SparkSession, folder: str) -> DataFrame:
    return logs.user_counts(table(spark, folder, "query_logs"), NOW)


LAST = f"(SELECT * FROM (SELECT user_email, id AS pack_id, purchased_at, expires_at, row_number() OVER (PARTITION BY user_email ORDER BY purchased_at DESC NULLS LAST, id DESC) AS n FROM packs WHERE user_email IS NOT NULL AND expires_at > TIMESTAMP '{NOW}') WHERE n = 1)"


@query(f"SELECT user_email, pack_id, purchased_at, expires_at FROM {LAST}")
def latest_valid_pack(spark: SparkSession, folder: str) -> DataFrame:
    return logs.latest_valid(table(spark, folder, "packs"), NOW)


@query(f"SELECT p.user_email, p.pack_id, (SELECT count(*) FROM query_logs q WHERE q.user_email = p.user_email AND q.created_at >= p.purchased_at) AS used FROM {LAST} p")
def used_since_purchase(spark: SparkSession, folder: str) -> DataFrame:
    return logs.used_since_purchase(table(spark, folder, "packs"), table(spark, folder, "query_logs"), NOW).select("user_email", "pack_id", "used")


MASK = f"CASE WHEN {S.squash("coalesce(user_name, '')")} <> '' THEN 'Dr. ' || upper(substr({S.squash('user_name')}, 1, 1)) || lower(substr(string_split({S.squash('user_name')}, ' ')[1], 2, 2)) || '**' ELSE 'Dr. Anonymous' END"


@query(f"""WITH n AS (SELECT * FROM query_logs WHERE grounded ORDER BY created_at DESC, id DESC LIMIT 60), q AS (SELECT *, {S.strip("coalesce(resolved_question, '')")} AS question2 FROM n), d AS (SELECT *, row_number() OVER (PARTITION BY lower(question2) ORDER BY created_at DESC, id DESC) AS r FROM q WHERE question2 <> '')
SELECT id, {MASK} AS who, question2 AS question, coalesce(answer, '') AS answer FROM d WHERE r = 1 ORDER BY created_at DESC, id DESC LIMIT 3""")
def recent_feed(spark: SparkSession, folder: str) -> DataFrame:
    return logs.recent_feed(table(spark, folder, "query_logs"))


@query(f"SELECT id, {MASK} AS who FROM query_logs")
def mask_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_logs").select("id", X.mask_name(F.col("user_name")).alias("who"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM query_logs WHERE user_email IS NOT NULL)
SELECT user_email, CAST((r - 1) * 2 + 1 AS INT) AS entries_back, 'User: ' || coalesce(question, '') AS entry FROM t WHERE r <= 10 UNION ALL SELECT user_email, CAST((r - 1) * 2 AS INT), 'Assistant: ' || coalesce(answer, '') FROM t WHERE r <= 10""")
def history_last20(spark: SparkSession, folder: str) -> DataFrame:
    return logs.last_entries(table(spark, folder, "query_logs"))


@query("SELECT doc_id, title, added_at FROM documents WHERE doc_kind = 'guideline' ORDER BY added_at DESC NULLS LAST, doc_id DESC LIMIT 100")
def worth_read_feed(spark: SparkSession, folder: str) -> DataFrame:
    return logs.newest(table(spark, folder, "documents").select("doc_id", "title", "added_at", "doc_kind"), "added_at", "doc_id", 100, F.col("doc_kind") == "guideline").select("doc_id", "title", "added_at")


@query("SELECT doc, page, block_index, block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, block_index ORDER BY loaded_at DESC NULLS LAST, block_id DESC) AS n FROM blocks) WHERE n = 1")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return logs.latest_version(table(spark, folder, "blocks").select("doc", "page", "block_index", "block_id", "loaded_at"), ["doc", "page", "block_index"], "loaded_at", "block_id").select("doc", "page", "block_index", "block_id")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts_daily(spark: SparkSession, folder: str) -> DataFrame:
    from foliomine.streaming.records import daily_counts

    return daily_counts(table(spark, folder, "events"))


@query("SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM tables) AS tables, (SELECT count(*) FROM documents) AS documents")
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = {n: table(spark, folder, n).count() for n in ("blocks", "tables", "documents")}
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


# -- layout -----------------------------------------------------------------------------------------------------------
def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    return layout.boxes(table(spark, folder, "blocks").select("block_id", "doc", "page", "block_index", "bbox", "text"))


@query(f"WITH {S.COLUMNS} SELECT doc, page, col_no, cx0, cx1 FROM cols")
def interval_merge_columns(spark: SparkSession, folder: str) -> DataFrame:
    return layout.page_columns(_boxes(spark, folder)).withColumn("col_no", F.col("col_no").cast("long"))


@query(f"WITH {S.ASSIGNED} SELECT block_id, col FROM assigned")
def assign_column(spark: SparkSession, folder: str) -> DataFrame:
    return layout.assigned_columns(_boxes(spark, folder)).select("block_id", "col")


@query(f"""WITH {S.ASSIGNED}, banded AS (SELECT *, sum(CASE WHEN col = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, block_id ROWS UNBOUNDED PRECEDING) AS band FROM assigned)
SELECT block_id, row_number() OVER (PARTITION BY doc, page ORDER BY band, CASE WHEN col = -1 THEN 0 ELSE 1 END, col, y0, x0, block_id) - 1 AS read_no FROM banded""")
def band_order(spark: SparkSession, folder: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, folder), "block_id").select("block_id", F.col("read_no").cast("long").alias("read_no"))


@query(f"WITH {S.BOXES}, {S.REGIONS} SELECT block_id FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE rdoc = doc AND rpage = page AND (x0 + x1) / 2 BETWEEN a0 AND a1 AND (y0 + y1) / 2 BETWEEN b0 AND b1)")
def table_region_anti(spark: SparkSession, folder: str) -> DataFrame:
    regions = layout.boxes(table(spark, folder, "tables").select("doc", "page", "bbox").where("bbox is not null"))
    return layout.outside_tables(_boxes(spark, folder), regions).select("block_id")


@query(f"""WITH {S.BOXES}, s AS (SELECT doc, page, CAST(round_even((y1 - y0) / greatest(len(string_split(coalesce(text, ''), chr(10))), 1), 0) AS INT) AS s, block_index, block_id FROM b WHERE (y1 - y0) / greatest(len(string_split(coalesce(text, ''), chr(10))), 1) <> 0),
c AS (SELECT doc, page, s, count(*) AS n, min((coalesce(block_index, -1), block_id)) AS o FROM s GROUP BY doc, page, s), f AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, o, s) AS r FROM c)
SELECT p.doc, p.page, coalesce(f.s, 0) AS body_size FROM (SELECT DISTINCT doc, page FROM b) p LEFT JOIN f ON f.doc IS NOT DISTINCT FROM p.doc AND f.page IS NOT DISTINCT FROM p.page AND r = 1""")
def body_font_mode(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder).withColumn("size", (F.col("y1") - F.col("y0")) / F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    return layout.body_size(b.withColumn("block_index", F.coalesce("block_index", F.lit(-1))), "size", ["block_index", "block_id"])


def _label() -> Column:
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(F.coalesce("is_heading", F.lit(False)), "section_header")
        .when(F.coalesce("is_figure", F.lit(False)), "caption")
        .when(text.rlike(r"^[-•*–] |^[0-9]{1,3}[.)] "), "list_item")
        .when(text.rlike(r"^[-–\[ ]*[0-9]+[-–\] ]*$"), "page_footer")
        .otherwise("text")
    )


@query(S.FOLD)
def heading_fold(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "blocks").where("doc is not null").select("doc", "page", F.col("block_id").alias("ord"), _label().alias("label"), "text")
    captions = table(spark, folder, "tables").select("doc", "caption").where("caption is not null")
    return layout.fold_items(items, captions).withColumn("block_index", F.col("block_index").cast("long"))


@query(f"""WITH i AS (SELECT doc, page, block_id, text, coalesce(is_heading, false) AS h, {S.strip("replace(coalesce(text, ''), chr(10), ' ')")} AS line FROM blocks),
w AS (SELECT *, last_value(CASE WHEN h THEN line END IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS section, lag(h) OVER (PARTITION BY doc, page ORDER BY block_id) AS ph, lead(h) OVER (PARTITION BY doc, page ORDER BY block_id) AS nx FROM i)
SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY block_id) - 1 AS block_index, CASE WHEN h THEN section WHEN coalesce(ph, false) THEN section || chr(10) || coalesce(text, '') ELSE text END AS text, h AS is_heading, section FROM w WHERE NOT h OR nx IS NULL""")
def page_heading_fold(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks").select("doc", "page", "block_id", "text", "is_heading")
    return layout.fold_page_headings(blocks, "block_id").withColumn("block_index", F.col("block_index").cast("long"))


# -- words ------------------------------------------------------------------------------------------------------------
def _repairs(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "blocks").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).where(F.contains("word", F.lit("f"))).distinct()
    return repair.repaired_words(words, repair.zipf(table(spark, folder, "word_freq")))


@query(S.repairs())
def ligature_repair(spark: SparkSession, folder: str) -> DataFrame:
    return _repairs(spark, folder)


@query()
def ligature_repair_texts(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired_texts(table(spark, folder, "blocks"), "block_id", "text", _repairs(spark, folder))


SPECS = [(1, "1-3,2,9", 5), (2, "", 3), (3, "7, 2-4", 10), (4, "3,1,3", 3)]


@query("SELECT * FROM (VALUES (1, '1,2,3', '1,2,3,2'), (2, '1,2,3', '1,2,3'), (3, '2,3,4,7', '7,2,3,4'), (4, '1,3', '3,1,3')) AS v(spec_id, pages, as_written)")
def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    specs = spark.createDataFrame(SPECS, "spec_id int, spec string, n int")
    return specs.select("spec_id", F.array_join(page_list(F.col("spec"), F.col("n")).cast("array<string>"), ",").alias("pages"), F.array_join(page_list(F.col("spec"), F.col("n"), False).cast("array<string>"), ",").alias("as_written"))


@query(f"SELECT id, row_number() OVER (ORDER BY {S.natural('id')}, id) AS place FROM (SELECT DISTINCT doc || '_b' || block_index AS id FROM blocks WHERE doc IS NOT NULL AND block_index IS NOT NULL)")
def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every id with its place in natural order; no task sorts more than a range of them."""
    ids = table(spark, folder, "blocks").where("doc is not null and block_index is not null").select(F.concat("doc", F.lit("_b"), F.col("block_index").cast("string")).alias("id")).distinct()
    placed = scans.numbered(ids.withColumn("o", X.natural_key(F.col("id"))), ["o", "id"], "place")
    return placed.select("id", F.col("place").cast("long").alias("place"))
