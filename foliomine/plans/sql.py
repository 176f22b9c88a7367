"""The catalogue's queries in SQL, written for an engine with RE2 expressions and list comprehensions."""

from __future__ import annotations

WS = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LE = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0b]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def first_line(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '^[^{LE}]*')"


def cells(x: str) -> str:
    return f"[{strip('_c')} for _c in string_split(regexp_replace({strip(x)}, '^\\|+|\\|+$', '', 'g'), '|')]"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{TOKEN}'))"


def natural(x: str) -> str:
    return f"array_to_string([CASE WHEN regexp_matches(_n, '^[0-9]') THEN lpad(_n, 20, '0') ELSE _n END for _n in regexp_extract_all({x}, '[0-9]+|[^0-9]+')], '')"


def clean_cell(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), '\\x{{ad}}\\n?', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '-\\n', '-', 'g'), '[\\n\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{2007}}\\x{{2060}}]', ' ', 'g')"
    return squash(f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")


def windows(n: str, size: int, overlap: int) -> str:
    return f"CAST(CASE WHEN {n} <= {size} THEN 1 ELSE ceil(({n} - {size}) / {float(size - overlap)}) + 1 END AS INT)"


DROP = f"""CASE WHEN length({strip("coalesce(text, '')")}) < 15 THEN 'too_short'
  WHEN contains(lower(coalesce(section, '')), 'index') THEN 'index'
  WHEN contains(lower(coalesce(section, '')), 'reference') OR contains(lower(coalesce(section, '')), 'bibliograph')
    OR (len(regexp_extract_all(coalesce(text, ''), '(?m)^[\\t\\n\\x0b\\f\\r ]*[0-9]{{1,3}}[.\\t]')) >= 4 AND len(regexp_extract_all(coalesce(text, ''), '(19|20)[0-9]{{2}};')) >= 3) THEN 'reference'
  WHEN length({squash("coalesce(text, '')")}) < 90 AND regexp_matches({squash("coalesce(text, '')")}, '^[0-9]+:\\s+.+?\\s+[0-9]+$') THEN 'running_header' END"""

CLEAN_ROWS = f"[_r for _r in [[{clean_cell('_x')} for _x in _q] for _q in coalesce(rows, []) if _q IS NOT NULL] if len([1 for _y in _r if _y <> '']) > 0]"
ROW = "'| ' || array_to_string({}, ' | ') || ' |'"

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25 = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY doc_id, term),
sizes AS (SELECT doc_id, len({TOKENS}) AS n_terms FROM documents),
n AS (SELECT count(*) AS docs, avg(n_terms) AS mean FROM sizes),
raw AS (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def scores(questions: str) -> str:
    """Scores of all records, those without a shared term at 0."""
    return f"""asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z0-9]+')) AS term FROM ({questions})) GROUP BY query_id, term),
hit AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / mean))) AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), n GROUP BY query_id, doc_id),
scored AS (SELECT q.query_id, d.doc_id, coalesce(score, 0) AS score FROM ({questions}) q CROSS JOIN documents d LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = d.doc_id),
sparse AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM scored) WHERE rank < {{k}})"""


ITEMS = "SELECT item_id AS query_id, text AS query_text FROM eval_items WHERE item_id % 20 = 0"
TITLES = "SELECT doc_id AS query_id, title AS query_text FROM documents WHERE doc_id % 20 = 0"
DISTANCE = "list_sum([(CAST(_z[1] AS DOUBLE) - CAST(_z[2] AS DOUBLE)) * (CAST(_z[1] AS DOUBLE) - CAST(_z[2] AS DOUBLE)) for _z in list_zip(e.embedding, q.embedding)])"


def dense(questions: str, where: str = "true") -> str:
    return f"""dense AS (SELECT query_id, vec_id AS doc_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {DISTANCE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DISTANCE}, 9), e.vec_id) - 1 AS rank
  FROM embeddings e CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN ({questions})) q WHERE {where}) WHERE rank < 60)"""


HITS = f"""WITH {BM25}, {scores(TITLES).replace('{k}', '60')}, {dense("SELECT doc_id FROM documents WHERE doc_id % 20 = 0")},
fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dense_rank, s.rank AS sparse_rank,
  CASE WHEN d.rank IS NULL THEN 0 ELSE 1.0 / (61 + d.rank) END + CASE WHEN s.rank IS NULL THEN 0 ELSE 0.5 / (61 + s.rank) END AS rrf FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
boosted AS (SELECT f.query_id, f.doc_id, dense_rank, sparse_rank, rrf + CASE WHEN dense_rank IS NOT NULL AND doc_kind = 'guideline' THEN 0.01 ELSE 0 END AS rrf FROM fused f JOIN documents c ON c.doc_id = f.doc_id
  WHERE NOT (coalesce(doc_kind, '') <> 'guideline' AND length({strip("coalesce(text, '')")}) < 80)),
hits AS (SELECT query_id, doc_id, rrf, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) - 1 AS hit_rank FROM boosted) WHERE hit_rank < 9)"""

PICKS = (
    HITS
    + """, h AS (SELECT query_id // 60 AS g, (query_id % 60) // 20 AS s, doc_id, hit_rank AS r, rrf AS v FROM hits),
r0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) AS n FROM h WHERE s = 0 AND v >= 0.015) WHERE n <= 2),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) AS n FROM h WHERE s = 1 AND v >= 0.015 AND (g, doc_id) NOT IN (SELECT g, doc_id FROM r0)) WHERE n <= 2),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) AS n FROM h WHERE s = 2 AND v >= 0.015 AND (g, doc_id) NOT IN (SELECT g, doc_id FROM r0 UNION ALL SELECT g, doc_id FROM r1)) WHERE n <= 2),
res AS (SELECT g, doc_id, v, 0 AS part, row_number() OVER (PARTITION BY g ORDER BY s, r) - 1 AS pos FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, doc_id ORDER BY v DESC, s, r) AS n FROM h WHERE (g, doc_id) NOT IN (SELECT g, doc_id FROM res)) WHERE n = 1),
fill AS (SELECT g, doc_id, v, 1 AS part, row_number() OVER (PARTITION BY g ORDER BY round(v, 9) DESC, s, r) - 1 AS pos FROM pool),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY part, pos) AS n FROM (SELECT * FROM res UNION ALL SELECT * FROM fill)) WHERE n <= 16),
picks AS (SELECT g AS group_id, doc_id, v AS rrf, part = 0 AS reserved, row_number() OVER (PARTITION BY g ORDER BY round(v, 9) DESC, part, pos) - 1 AS pick_rank FROM capped)"""
)

BOXES = "b AS (SELECT block_id, doc, page, block_index, text, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM blocks WHERE len(bbox) = 4)"
COLUMNS = f"""{BOXES}, narrow AS (SELECT doc, page, x0, x1 FROM b WHERE x1 - x0 < 357.0),
marked AS (SELECT *, CASE WHEN reach IS NULL OR x0 > reach + 23.8 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM narrow)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT doc, page, min(x0) AS cx0, max(x1) AS cx1 FROM islands GROUP BY doc, page, island HAVING max(x1) - min(x0) > 89.25),
cols AS (SELECT p.doc, p.page, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY coalesce(cx0, 0), coalesce(cx1, 595)) - 1 AS col_no, coalesce(cx0, 0) AS cx0, coalesce(cx1, 595) AS cx1
  FROM (SELECT DISTINCT doc, page FROM b) p LEFT JOIN merged m ON m.doc IS NOT DISTINCT FROM p.doc AND m.page IS NOT DISTINCT FROM p.page)"""
ASSIGNED = f"""{COLUMNS}, counted AS (SELECT doc, page, count(*) AS n FROM cols GROUP BY doc, page),
near AS (SELECT block_id, col_no, row_number() OVER (PARTITION BY block_id ORDER BY CASE WHEN (x0 + x1) / 2 BETWEEN cx0 AND cx1 THEN 0 ELSE 1 END, CASE WHEN (x0 + x1) / 2 BETWEEN cx0 AND cx1 THEN 0 ELSE abs((x0 + x1) / 2 - (cx0 + cx1) / 2) END, col_no) AS n
  FROM b JOIN cols c ON c.doc IS NOT DISTINCT FROM b.doc AND c.page IS NOT DISTINCT FROM b.page),
assigned AS (SELECT b.*, CAST(CASE WHEN k.n <= 1 THEN 0 WHEN x1 - x0 >= 357.0 THEN -1 ELSE near.col_no END AS INT) AS col
  FROM b JOIN counted k ON k.doc IS NOT DISTINCT FROM b.doc AND k.page IS NOT DISTINCT FROM b.page JOIN near ON near.block_id = b.block_id AND near.n = 1)"""
REGIONS = "r AS (SELECT doc AS rdoc, page AS rpage, TRY_CAST(s[1] AS DOUBLE) AS a0, TRY_CAST(s[2] AS DOUBLE) AS b0, TRY_CAST(s[3] AS DOUBLE) AS a1, TRY_CAST(s[4] AS DOUBLE) AS b1 FROM (SELECT doc, page, string_split(bbox, ',') AS s FROM tables WHERE bbox IS NOT NULL) WHERE len(s) = 4)"

LABEL = "CASE WHEN coalesce(is_heading, false) THEN 'section_header' WHEN coalesce(is_figure, false) THEN 'caption' WHEN regexp_matches(coalesce(text, ''), '^[-•*–] |^[0-9]{1,3}[.)] ') THEN 'list_item' WHEN regexp_matches(coalesce(text, ''), '^[-–\\[ ]*[0-9]+[-–\\] ]*$') THEN 'page_footer' ELSE 'text' END"
FOLD = f"""WITH i AS (SELECT doc, page, block_id AS ord, {LABEL} AS label, coalesce(text, '') AS text FROM blocks WHERE doc IS NOT NULL),
k AS (SELECT *, CASE label WHEN 'section_header' THEN 'heading' WHEN 'list_item' THEN 'item' WHEN 'caption' THEN 'caption' WHEN 'page_footer' THEN 'skip' ELSE 'text' END AS kind FROM i),
c AS (SELECT DISTINCT doc, lower({squash("coalesce(caption, '')")}) AS cap FROM tables WHERE caption IS NOT NULL),
k2 AS (SELECT k.* REPLACE (CASE WHEN k.kind = 'caption' AND c.cap IS NOT NULL THEN 'skip' ELSE k.kind END AS kind) FROM k LEFT JOIN c ON k.kind = 'caption' AND c.doc = k.doc AND c.cap = lower({squash('k.text')}) AND c.cap <> ''),
p AS (SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY page NULLS LAST, ord) AS before FROM k2),
u AS (SELECT *, sum(CASE WHEN kind <> 'item' OR coalesce(before, '') <> 'item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page NULLS LAST, ord ROWS UNBOUNDED PRECEDING) AS unit FROM p),
units AS (SELECT doc, unit, kind, first(page ORDER BY page NULLS LAST, ord) AS page, first(ord ORDER BY page NULLS LAST, ord) AS ord, {strip(f"string_agg({strip('text')}, chr(10) ORDER BY page NULLS LAST, ord)")} AS t FROM u GROUP BY doc, unit, kind),
e AS (SELECT *, kind IN ('item', 'caption', 'text') AND t <> '' AS emits FROM units),
f AS (SELECT *, coalesce(sum(CASE WHEN emits THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page NULLS LAST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fold,
  last_value(CASE WHEN kind = 'heading' AND t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page NULLS LAST, ord ROWS UNBOUNDED PRECEDING) AS section FROM e),
g AS (SELECT doc, fold, string_agg(t, chr(10) ORDER BY emits, page NULLS LAST, ord) AS text, bool_or(emits) AS has, max(CASE WHEN emits THEN page END) AS epage, max(CASE WHEN emits THEN ord END) AS eord,
  bool_or(emits AND kind = 'caption') AS is_figure, last(section ORDER BY emits, page NULLS LAST, ord) AS section FROM f WHERE emits OR (kind = 'heading' AND t <> '') GROUP BY doc, fold)
SELECT doc, CASE WHEN has THEN epage END AS page, row_number() OVER (PARTITION BY doc, CASE WHEN has THEN epage END ORDER BY NOT has, CASE WHEN has THEN eord END NULLS FIRST) - 1 AS block_index, text, NOT has AS is_heading, is_figure, section FROM g"""


def repairs() -> str:
    """Words with an f of the blocks, one or two insertions."""
    ins = "flatten([[substr({w}, 1, _i) || 'i' || substr({w}, _i + 1), substr({w}, 1, _i) || 'l' || substr({w}, _i + 1)] for _i in range(1, length({w}) + 1) if substr({w}, _i, 1) = 'f'])"
    return f"""WITH z AS (SELECT lower(word) AS word, log10(max(per_million)) + 3 AS zipf FROM word_freq WHERE per_million > 0 GROUP BY lower(word)),
w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM blocks) WHERE contains(word, 'f')),
own AS (SELECT w.word, coalesce(zipf, 0) AS own FROM w LEFT JOIN z USING (word)),
c1 AS (SELECT word, own, unnest({ins.format(w='word')}) AS cand, unnest(range(0, 2 * len(string_split(word, 'f')) - 2)) AS pos FROM own),
b1 AS (SELECT * FROM (SELECT c1.word, own, cand, zipf, row_number() OVER (PARTITION BY c1.word ORDER BY zipf DESC, pos) AS n FROM c1 JOIN z ON z.word = cand WHERE zipf > own) WHERE n = 1),
l2 AS (SELECT word, own, pos, cand FROM c1 WHERE word NOT IN (SELECT word FROM b1)),
c2 AS (SELECT word, own, pos, unnest({ins.format(w='cand')}) AS cand, unnest(range(0, 2 * len(string_split(cand, 'f')) - 2)) AS pos2 FROM l2),
b2 AS (SELECT * FROM (SELECT c2.word, own, cand, zipf, row_number() OVER (PARTITION BY c2.word ORDER BY zipf DESC, pos, pos2) AS n FROM c2 JOIN z ON z.word = cand WHERE zipf > own) WHERE n = 1)
SELECT word, cand AS repaired FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) WHERE zipf >= 2.0 AND zipf - own >= 1.3"""


def routed(aliases: dict[str, str]) -> str:
    rest, found = "lower(coalesce(question, ''))", "CAST([] AS VARCHAR[])"
    for alias in sorted(aliases, key=lambda a: (-len(a), list(aliases).index(a))):
        found = f"list_concat({found}, CASE WHEN contains({rest}, '{alias}') THEN ['{aliases[alias]}'] ELSE CAST([] AS VARCHAR[]) END)"
        rest = f"replace({rest}, '{alias}', ' ')"
    return found
