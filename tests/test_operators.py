from __future__ import annotations

import math

from pyspark.sql import functions as F

from foliomine.operators import layout, logs, repair, retrieve, scans, select
from foliomine.sources import records
from foliomine.sources.pages import page_list
from foliomine.streaming import records as streams


def test_fusion_bounds(spark):
    dense = spark.createDataFrame([(1, 10, 0), (1, 11, 5), (1, 12, 6)], "query_id long, doc_id long, rank int")
    sparse = spark.createDataFrame([(1, 10, 0), (1, 13, 0)], "query_id long, doc_id long, rank int")
    got = {r["doc_id"]: round(r["rrf"], 6) for r in retrieve.fuse(dense, sparse).collect()}
    assert got == {10: 0.02459, 11: 0.015152, 12: 0.014925, 13: 0.008197}


def test_kept_hits_boost_and_drop_stubs(spark):
    fused = spark.createDataFrame([(1, "a", 0, None, 0.0164), (1, "b", None, 0, 0.0082), (1, "c", 1, None, 0.0161), (1, "d", 2, None, 0.0159), (1, "gone", 3, None, 0.5)], "query_id long, doc_id string, dense_rank int, sparse_rank int, rrf double")
    corpus = spark.createDataFrame([("a", "x" * 90, "prose"), ("b", "x" * 90, "table"), ("c", "short", "prose"), ("d", "t", "table")], "doc_id string, text string, type string")
    got = retrieve.kept_hits(fused, corpus, denied=("z",)).orderBy("hit_rank").collect()
    assert [r["doc_id"] for r in got] == ["d", "a", "b"]


def test_bm25_zero_tail_and_empty_questions(spark):
    corpus = spark.createDataFrame([(i, "alpha beta" if i == 3 else "gamma") for i in range(1, 6)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha alpha"), (2, ""), (3, None)], "query_id long, query_text string")
    got = retrieve.bm25_topk(corpus, asked, 3).collect()
    ranked = {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert ranked == {1: [3, 1, 2], 2: [1, 2, 3], 3: [1, 2, 3]}
    idf = math.log(5 - 1 + 0.5) - math.log(1.5)
    best = next(r["score"] for r in got if r["query_id"] == 1 and r["doc_id"] == 3)
    assert abs(best - 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.2))) < 1e-9


def test_dense_ties_go_to_the_lower_id(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in retrieve.dense_topk(vectors, asked, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert retrieve.dense_topk(vectors, asked.where("query_id < 0"), 4).count() == 0
    many = vectors.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    assert retrieve.dense_topk(vectors, many, 4, sent=4).orderBy("query_id", "rank").collect() == retrieve.dense_topk(vectors, many, 4).orderBy("query_id", "rank").collect()


def test_quota(spark):
    # the second sub-question's best hit is taken, so it goes on to the next two; the third has none above the floor
    rows = [(0, 0, "a", 0, 0.03), (0, 0, "b", 1, 0.02), (0, 0, "c", 2, 0.018), (0, 1, "a", 0, 0.03), (0, 1, "d", 1, 0.02), (0, 1, "e", 2, 0.016), (0, 2, "f", 0, 0.001)]
    hits = spark.createDataFrame(rows, "group_id long, sub_index long, doc_id string, hit_rank int, rrf double")
    got = select.reserve_and_fill(hits, cap=5).orderBy("pick_rank").collect()
    assert [(r["doc_id"], r["reserved"]) for r in got] == [("a", True), ("b", True), ("d", True), ("c", False), ("e", True)]


def test_quota_is_one_with_many_sub_questions(spark):
    rows = [(0, s, f"{s}{r}", r, 0.02 - r / 1000) for s in range(5) for r in range(2)]
    hits = spark.createDataFrame(rows, "group_id long, sub_index long, doc_id string, hit_rank int, rrf double")
    assert select.reserve_and_fill(hits).where("reserved").count() == 5


def test_running_values_over_pages(spark):
    rows = [("a", p, o, v) for p, o, v in [(1, 1, 1), (1, 2, None), (3, 1, 5), (None, 1, 7), (3, 2, None)]] + [("b", 1, 1, 2)]
    df = spark.createDataFrame(rows, "doc string, page int, o int, v int")
    got = scans.running_sum(df, "doc", "page", ["o"], F.coalesce("v", F.lit(0)), "s")
    got = scans.running_last(got, "doc", "page", ["o"], F.col("v"), "l")
    got = scans.previous(got, "doc", "page", ["o"], F.col("v"), "b")
    got = scans.running_sum(got, "doc", "page", ["o"], F.lit(1), "n", inclusive=False)
    a = {(r["page"], r["o"]): (r["s"], r["l"], r["b"], r["n"]) for r in got.where("doc = 'a'").collect()}
    assert a == {(1, 1): (1, 1, None, 0), (1, 2): (1, 1, 1, 1), (3, 1): (6, 5, None, 2), (3, 2): (6, 5, 5, 3), (None, 1): (13, 7, None, 4)}


def test_fold_items(spark):
    items = [("d", 1, 1, "section_header", "H1"), ("d", 1, 2, "text", " "), ("d", 1, 3, "section_header", "H2"), ("d", 2, 1, "list_item", "one"), ("d", 2, 2, "list_item", "two"), ("d", 2, 3, "page_footer", "9"), ("d", 2, 4, "list_item", "three"), ("d", 2, 5, "caption", "Table  1"), ("d", 2, 6, "caption", "Fig 1"), ("d", 3, 1, "Section_Header", "End")]
    df = spark.createDataFrame(items, "doc string, page int, ord int, label string, text string")
    captions = spark.createDataFrame([("d", "table 1")], "doc string, caption string")
    got = layout.fold_items(df, captions).orderBy(F.col("page").asc_nulls_last(), "block_index").collect()
    assert [(r["page"], r["block_index"], r["text"], r["is_heading"], r["is_figure"], r["section"]) for r in got] == [
        (2, 0, "H1\nH2\none\ntwo", False, False, "H2"),
        (2, 1, "three", False, False, "H2"),
        (2, 2, "Fig 1", False, True, "H2"),
        (None, 0, "End", True, False, "End"),
    ]


def test_page_heading_fold_keeps_the_last_of_a_stack(spark):
    rows = [("d", 1, 0, "A", True), ("d", 1, 1, "B\nb", True), ("d", 1, 2, "text", False), ("d", 1, 3, "C", True), ("d", 2, 0, "more", False)]
    df = spark.createDataFrame(rows, "doc string, page int, read_no int, text string, is_heading boolean")
    got = layout.fold_page_headings(df).orderBy("page", "block_index").collect()
    assert [(r["page"], r["text"], r["section"]) for r in got] == [(1, "B b\ntext", "B b"), (1, "C", "C"), (2, "more", None)]


def test_assembled_blocks_and_headings(spark):
    spans = spark.createDataFrame([(1, 0, "Bold text", 12.04, True), (1, 1, " ", 9.0, False), (1, 2, "x", 9.0, False)], "b int, o int, t string, s double, h boolean")
    r = layout.assembled_blocks(spans, ["b"], "o", "t", "s", "h").collect()[0]
    assert (r["size"], r["bold"], r["text"]) == (12.0, True, "Bold text\nx")
    one = spark.range(1).select(layout.is_heading(F.lit("2. Incision"), F.lit(9.0), F.lit(False), F.lit(9)).alias("a"), layout.is_heading(F.lit("Plain"), F.lit(9.0), F.lit(False), F.lit(9)).alias("b"))
    assert tuple(one.collect()[0]) == (True, False)


def test_repair(spark):
    freqs = spark.createDataFrame([("first", 5.5), ("frst", 1.0), ("difficult", 5.0), ("for", 7.0), ("field", 5.0), ("staff", 5.0), ("feld", 4.5)], "word string, zipf double")
    words = spark.createDataFrame([(w,) for w in ("frst", "diffcult", "for", "feld", "staff", "fap", "xyz", None)], "word string")
    got = {r["word"]: r["repaired"] for r in repair.repaired_words(words, freqs, {"fap": "flap"}).collect()}
    assert got == {"frst": "first", "diffcult": "difficult", "fap": "flap"}
    texts = spark.createDataFrame([(1, "Frst, the FRST diffcult fap."), (2, "nothing"), (3, None)], "id int, text string")
    repairs = spark.createDataFrame(list(got.items()), "word string, repaired string")
    fixed = {r["id"]: r["text"] for r in repair.repaired_texts(texts, "id", "text", repairs).collect()}
    assert fixed == {1: "First, the FIRST difficult flap.", 2: "nothing", 3: None}


def test_page_specifications(spark):
    df = spark.createDataFrame([("1-3,2,9", 5), ("", 2), (None, 2), ("x,2", 3), ("3-1", 3)], "s string, n int")
    got = [tuple(r) for r in df.select(page_list(F.col("s"), F.col("n")), page_list(F.col("s"), F.col("n"), False)).collect()]
    assert got == [([1, 2, 3], [1, 2, 3, 2]), ([1, 2], [1, 2]), ([1, 2], [1, 2]), ([2], [2]), ([], [])]


def test_files_and_upserts(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "é\ttext"), ("d", None, None)], "doc string, page int, text string")
    path = str(tmp_path / "pages")
    records.write_jsonl(df, path)
    back = records.read_jsonl(spark, path, records.PAGES)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    (tmp_path / "t.jsonl").write_text('{"doc": "a", "markdown": "x\\u0007y"}\n\n', encoding="utf-8")
    assert [r["markdown"] for r in records.read_jsonl(spark, str(tmp_path / "t.jsonl"), records.TABLES).collect()] == ["xy"]
    (tmp_path / "d.json").write_text('{"A": "b",\n "C": "d"}', encoding="utf-8")
    assert {tuple(r) for r in records.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {("A", "b"), ("C", "d")}
    assert [r["text"] for r in records.read_whole_texts(spark, str(tmp_path / "d.json")).collect()] == ['{"A": "b",\n "C": "d"}']
    records.write_page_markers(df, str(tmp_path / "marked"))
    assert "[[PAGE 1]]" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "marked").glob("part-*"))
    records.write_previews(spark.createDataFrame([(3, 1, "| a |")], "page int, table_index int, markdown string"), str(tmp_path / "prev"))
    assert (tmp_path / "prev" / "preview=p0003_t1").is_dir()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert {tuple(r) for r in records.upserted(old, new).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    manifest = str(tmp_path / "manifest")
    records.record_batch(spark, manifest, 0)
    batches = spark.createDataFrame([(0, 1), (1, 2)], "batch int, id int")
    done = spark.read.parquet(manifest)
    assert [r["id"] for r in records.not_done(batches, done).collect()] == [2]
    src = old.withColumn("source", F.lit("s"))
    assert not records.may_load(src, "s", None) and records.may_load(src, "s", done) and records.may_load(src, "t", None)
    assert records.find(src, "id", 2).count() == 1 and records.scalar_fields(src.withColumn("x", F.array())).columns == ["id", "v", "source"]


def test_usage_and_packs(spark):
    calls = spark.createDataFrame([(1, "m", 1, None, 0.1), (1, "m", 2, 3, None), (1, None, 1, 1, 0.5)], "log_id long, model string, input_tokens int, output_tokens int, cost_usd double")
    r = logs.usage_totals(calls).collect()[0]
    assert (r["total_tokens"], r["cost_usd"], r["cost_breakdown"]["m"]["calls"], r["cost_breakdown"]["unknown"]["calls"]) == (8, 0.6, 2, 1)
    packs = spark.sql("SELECT * FROM VALUES (1, 'u', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-31'), (2, 'u', TIMESTAMP_NTZ '2024-05-20', TIMESTAMP_NTZ '2024-06-19'), (3, NULL, NULL, NULL) AS t(id, user_email, purchased_at, expires_at)")
    asked = spark.sql("SELECT * FROM VALUES (1, 'u', TIMESTAMP_NTZ '2024-05-19'), (2, 'u', TIMESTAMP_NTZ '2024-05-20'), (3, 'v', NULL) AS t(id, user_email, created_at)")
    got = logs.used_since_purchase(packs, asked, "2024-06-01 00:00:00").collect()
    assert [(g["user_email"], g["pack_id"], g["used"]) for g in got] == [("u", 2, 1)]


def test_feed_limits_before_it_filters(spark):
    rows = [(i, f"2024-01-{i:02d} 00:00:00", "hide@x" if i > 3 else None, None, "Q" if i % 2 else " q ", None, True) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "id long, created_at string, user_email string, user_name string, resolved_question string, answer string, grounded boolean")
    assert [r["id"] for r in logs.recent_feed(df, window=5, hidden=("HIDE@x",)).collect()] == [3]


def test_streams_equal_batches(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    batch = {tuple(r) for r in streams.daily_counts(events).collect()}
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.daily_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("daily").collect()} == batch
    versions = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "id string, v int, loaded_at int")
    versions.coalesce(1).write.parquet(str(tmp_path / "v"))
    for _ in range(2):
        streams.upsert_stream(spark.readStream.schema(versions.schema).parquet(str(tmp_path / "v")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert {(r["id"], r["v"]) for r in streams.upserted_table(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}
    turns = spark.createDataFrame([(i, i, "u", f"q{i}", None) for i in range(15)], "id long, created_at long, user_email string, question string, answer string")
    turns.coalesce(1).write.parquet(str(tmp_path / "t"))
    held = streams.bounded_history(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t")))
    query = held.writeStream.outputMode("update").format("memory").queryName("held").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    query.awaitTermination(120)
    entries = spark.table("held").collect()[0]["entries"]
    last = [r["entry"] for r in logs.last_entries(turns).orderBy(F.col("entries_back").desc()).collect()]
    assert entries == last and len(entries) == 20


def test_parsed_files_and_tables(spark, tmp_path):
    from foliomine.sources import parsed

    (tmp_path / "book.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "other.txt").write_bytes(b"no")
    got = parsed.parsed_files(spark, str(tmp_path), lambda b: [(i + 1, t) for i, t in enumerate(b.decode().split("\n"))], "page int, text string")
    assert sorted(tuple(r) for r in got.collect()) == [("book", 1, "one"), ("book", 2, "two")]
    raw = spark.createDataFrame([("d", 1, 0, [["", None]]), ("d", 1, 1, [[" a ", "b"], ["", ""], ["1", "2"]]), ("d", 1, 2, [["x", "y"], ["1", None]])], "doc string, page int, ord int, rows array<array<string>>")
    assert [(r["table_index"], r["markdown"].split("\n")[0]) for r in parsed.simple_tables(raw).orderBy("table_index").collect()] == [(0, "| a | b |"), (1, "| x | y |")]
    boxed = raw.select("*", *[F.lit(1.25).alias(c) for c in ("x0", "y0", "x1", "y1")])
    assert [(r["table_index"], r["n_rows"], r["bbox"]) for r in parsed.found_tables(boxed).orderBy("table_index").collect()] == [(1, 2, "1.3,1.3,1.3,1.3"), (2, 2, "1.3,1.3,1.3,1.3")]
    conv = spark.createDataFrame([("d", 1, 0, " ", None, 1, 1), ("d", 1, 1, "| a |", "", 1, 1), ("d", None, 2, "| b |", "Cap", 1, 1)], "doc string, page int, ord int, markdown string, caption string, n_rows int, n_cols int")
    assert sorted((r["page"] or 0, r["table_index"], r["caption"]) for r in parsed.converted_tables(conv).collect()) == [(0, 0, "Cap"), (1, 0, None)]
    assert sorted((r["page"] or 0, r["table_index"]) for r in parsed.converted_tables_only(conv, 10).collect()) == [(0, 2), (11, 1)]
    assert [tuple(r) for r in parsed.caption_set(conv).collect()] == [("d", "cap")]
    reply = spark.range(1).select(parsed.joined_text_blocks(F.array(F.struct(F.lit("text").alias("type"), F.lit(" a").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("b ").alias("text")))).alias("t"))
    assert reply.collect()[0]["t"] == "ab"


def test_top_k_is_cut_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    top = retrieve.top_ranked(scored, "query_id", "doc_id", "score", 5)
    plan = spark._jvm.PythonSQLUtils.explainString(top._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") == 2


def test_dense_search_takes_any_ids_blocks_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(300, 6)), 1)
    points[200:] = points[0]  # a third are copies
    vectors = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)] + [("none", None)], "vec_id string, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id in ('v000', 'v007', 'v050', 'none')").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {}
    for q in (0, 7, 50):
        far = np.round(((points - points[q]) ** 2).sum(axis=1), 9)
        want[f"v{q:03d}"] = [f"v{i:03d}" for i in sorted(range(300), key=lambda i: (far[i], i))[:20]]

    def ranked(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["vec_id"])
        return out

    assert ranked(retrieve.dense_topk(vectors, asked, k=20)) == want
    assert ranked(retrieve.dense_topk(vectors, asked, k=20, sent=7)) == want
    index = retrieve.DenseIndex(vectors, cells=8)
    assert ranked(index.topk(asked, k=20, probed=1.0)) == want
    assert index.vectors.count() == 300
    assert retrieve.DenseIndex(vectors.where("false"), cells=8).topk(asked, k=20).count() == 0
    assert retrieve.dense_topk(vectors, asked.where("false"), k=20).count() == 0


def test_the_sparse_index_is_kept_while_its_files_stay(spark, tmp_path):
    import os
    import time

    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "doc_id long, text string").write.parquet(path)
    first = retrieve.sparse_index(spark.read.parquet(path))
    assert retrieve.sparse_index(spark.read.parquet(path)) is first and first.docs == 3 and first.mean == 1.0
    time.sleep(1.1)
    spark.createDataFrame([(1, "gamma")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    again = retrieve.sparse_index(spark.read.parquet(path))
    assert again is not first and [r["term"] for r in again.weights.collect()] == ["gamma"]
    plain = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    assert retrieve.sparse_index(plain) is not retrieve.sparse_index(plain)
    assert os.path.exists(path)


def test_busy_users_are_spread_and_counted_whole(spark):
    from foliomine.operators import logs

    day = "2024-01-0{} 00:00:00"
    packs = spark.createDataFrame([(1, "hot", day.format(2), "2030-01-01 00:00:00"), (2, "idle", day.format(1), "2030-01-01 00:00:00")], "id long, user_email string, p string, e string").selectExpr("id", "user_email", "cast(p as timestamp_ntz) purchased_at", "cast(e as timestamp_ntz) expires_at")
    asked = spark.createDataFrame([(i, "hot", day.format(1 + i % 3)) for i in range(300)] + [(900, None, day.format(3))], "id long, user_email string, c string").selectExpr("id", "user_email", "cast(c as timestamp_ntz) created_at")
    got = {r["user_email"]: r["used"] for r in logs.used_since_purchase(packs, asked, "2024-06-01 00:00:00").collect()}
    assert got == {"hot": 200, "idle": 0}


def test_later_versions_win_whichever_batch_brings_them(spark, tmp_path):
    from foliomine.streaming import records as streams

    for n, rows in enumerate(([("a", 5, "new"), ("b", 1, "old")], [("a", 2, "late"), ("b", 1, "again")])):
        spark.createDataFrame(rows, "id string, loaded_at int, v string").write.parquet(str(tmp_path / f"t/batch={n}"))
    got = lambda path: {(r["id"], r["v"]) for r in streams.upserted_table(spark, str(path)).collect()}
    assert got(tmp_path / "t") == {("a", "new"), ("b", "again")}
    streams.compacted(spark, str(tmp_path / "t"), str(tmp_path / "c"))
    assert got(tmp_path / "c") == {("a", "new"), ("b", "again")}


def test_scans_in_one_pass_equal_the_plain_ones(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None]), i, rng.choice(["item", "item", "text"]), rng.choice([None, None, f"h{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc string, page int, o int, kind string, head string")
    got = scans.run_numbers(df, "doc", "page", ["o"], "kind", "item", "unit")
    got = scans.running(got, "doc", "page", ["o"], {"n": F.lit(1)}, {"section": F.col("head")}).collect()
    for doc in ("x", "y", None):
        mine = sorted((r for r in got if r["doc"] == doc), key=lambda r: (r["page"] is None, r["page"] or 0, r["o"]))
        unit, last, before = 0, None, None
        for n, r in enumerate(mine):
            unit += not (r["kind"] == "item" == before)
            before, last = r["kind"], r["head"] or last
            assert (r["n"], r["unit"], r["section"]) == (n, unit, last)
