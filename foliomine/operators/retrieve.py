"""Sparse, dense and fused ranking of records for many questions at once.

Questions are a stated, bounded set; records are never joined to them as a product.  Sparse scores come from an index
that is written once (a row of terms and counts for each record, weights, the mean length) and kept for as long as the files it
was made from stay the same; dense scores from blocks of vectors held against all questions, with the best of each task
kept before anything is shuffled.  Scores are ranked rounded to nine places, ties by ascending id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foliomine.functions.text import strip, tokens
from foliomine.session import cut, scratch

#: Depths, weights and floors of the ranking.
RAW_K = 60
KEEP = 9
RRF_K = 60
DENSE_WEIGHT, SPARSE_WEIGHT = 1.0, 0.5
BOOST = 0.010
STUB = 80
K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_QUESTION_VALUES = 4_000_000
#: Terms of questions that are sent to every task.
MAX_ASKED = 1_000_000


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: how often each term stands in each record."""
    return corpus.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(corpus: DataFrame, key: str, text: str) -> DataFrame:
    return corpus.select(key, F.size(tokens(F.col(text))).alias("n_terms"))


def term_doc_freq(corpus: DataFrame, text: str) -> DataFrame:
    """``term, df``: in how many records each term stands; terms are made distinct within the record, before the shuffle."""
    return corpus.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(freqs: DataFrame, n: int) -> DataFrame:
    """``term, df, idf``: negative values become a quarter of the vocabulary's mean, which includes them."""
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    freqs = freqs.withColumn("raw", raw)
    mean = freqs.agg(F.avg("raw")).first()[0] or 0.0
    return freqs.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


class SparseIndex:
    """``records`` (key, n_terms, terms, tfs), one row a record, ``weights`` (term, df, idf), ``docs`` and ``mean``.

    The index is cut by records and not by terms: a record's score for a question is the sum of what stands in one row,
    so a task keeps the best of its records and nothing is shuffled but those.  No term, however common, is a group.
    """

    def __init__(self, corpus: DataFrame, key: str, text: str) -> None:
        spark = corpus.sparkSession
        self.key = key
        path, words = scratch(spark, "records"), scratch(spark, "weights")
        schema = f"{key} {dict(corpus.dtypes)[key]}, n_terms int, terms array<string>, tfs array<int>"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                coded = pc.dictionary_encode(lists.flatten())
                width = len(coded.dictionary) + 1
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                pairs, tf = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=batch.num_rows))]).astype(np.int32)
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=[key, "n_terms", "terms", "tfs"])

        corpus.select(F.col(key), tokens(F.col(text)).alias("t")).mapInArrow(count, schema).write.parquet(path)
        self.records = spark.read.parquet(path)
        freqs = self.records.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sums = self.records.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_terms").alias("n")).first()
        self.docs = sums["docs"]
        self.mean = float((sums["n"] or 0) / self.docs if self.docs else 0) or 1.0
        freqs.withColumn("raw", F.log(F.lit(float(self.docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).write.parquet(words)
        freqs = spark.read.parquet(words)
        ends = freqs.agg(F.avg("raw").alias("mean"), F.min("raw").alias("least")).first()
        mean = ends["mean"] or 0.0
        #: The least weight: negative weights are raised to a share of the mean, so it is below 0 only with that.
        self.least = EPSILON * mean if (ends["least"] or 0.0) < 0 else 0.0
        self.weights = freqs.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))

    def asked(self, questions: DataFrame, qkey: str, qtext: str) -> DataFrame:
        """``qkey, term, w``: the known terms of each question; repeated ones count again."""
        terms = questions.select(qkey, F.explode(tokens(F.col(qtext))).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qtf"))
        return cut(terms.join(self.weights, "term").select(qkey, "term", (F.col("qtf") * F.col("idf")).alias("w")))

    def best(self, asked: DataFrame, k: int, qkey: str) -> DataFrame:
        """``qkey, key, score``: of each task's records the k of best positive score for each question.

        The terms asked for are sent in blocks of at most ``MAX_ASKED``, one pass over the records and one written
        result each.
        """
        blocks = max(1, -(-asked.count() // MAX_ASKED))
        found = None
        for block in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == block)
            one = self._best(part.collect(), k, qkey, dict(asked.dtypes)[qkey])
            one = cut(one) if blocks > 1 else one
            found = one if found is None else found.unionByName(one)
        return found

    def _best(self, rows: list, k: int, qkey: str, qkind: str) -> DataFrame:
        spark, key, mean = self.records.sparkSession, self.key, self.mean
        schema = f"{qkey} {qkind}, {key} {dict(self.records.dtypes)[key]}, score double"
        frame = spark.createDataFrame([], schema)
        if not rows:
            return frame
        arrow = to_arrow_schema(frame.schema)
        number = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        wanted: dict = {}
        for r in sorted(rows, key=lambda r: number[r["term"]]):
            wanted.setdefault(r[0], []).append((number[r["term"]], r["w"]))
        ids, lists = list(wanted), [(np.array([t for t, _ in v]), np.array([w for _, w in v])) for v in wanted.values()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = pa.array(list(number), pa.string())
            near: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                keys = np.array(batch.column(0).to_pylist())
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(term >= 0)
                doc, term = np.repeat(np.arange(n), sizes)[hit], term[hit]
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)[hit].astype(np.float64)
                length = batch.column(1).to_numpy(zero_copy_only=False)[doc]
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                order = np.argsort(term, kind="stable")
                doc, part = doc[order], part[order]
                ends = np.searchsorted(term[order], np.arange(len(number) + 1))
                for q, (terms, weights) in enumerate(lists):
                    score = np.zeros(n)
                    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                        # a record holds a term once, so places don't repeat
                        score[doc[ends[t] : ends[t + 1]]] += w * part[ends[t] : ends[t + 1]]
                    # scores are ranked as they are rounded; all that tie with the k-th are looked at
                    rounded = np.round(score, 9)
                    some = np.flatnonzero(rounded > 0)
                    if len(some) > k:
                        some = some[rounded[some] >= np.partition(rounded[some], len(some) - k)[len(some) - k]]
                    if len(some):
                        held = near[q]
                        all_keys, all_scores = (keys[some], score[some]) if held is None else (np.concatenate([held[0], keys[some]]), np.concatenate([held[1], score[some]]))
                        top = np.lexsort((all_keys, -np.round(all_scores, 9)))[:k]
                        near[q] = all_keys[top], all_scores[top]
            kept = [(q, x) for q, x in zip(ids, near, strict=True) if x is not None]
            if kept:
                columns = [[q for q, (x, _) in kept for _ in x], np.concatenate([x for _, (x, _) in kept]).tolist(), np.concatenate([f for _, (_, f) in kept])]
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        return self.records.select(key, "n_terms", "terms", "tfs").mapInArrow(run, schema)


_kept: dict[tuple, tuple[tuple, SparseIndex]] = {}


def _files(df: DataFrame) -> tuple:
    """The files a table is read from, with their sizes and times; () where it isn't read from files."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def sparse_index(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> SparseIndex:
    """The index of a corpus; the one made before if neither its files nor what is taken from them changed."""
    narrow = corpus.select(key, text)
    files = _files(narrow)
    if not files:
        return SparseIndex(narrow, key, text)
    name = (id(corpus.sparkSession._jsparkSession), narrow.sparkSession.sparkContext.applicationId, narrow.semanticHash(), key, text)
    held = _kept.get(name)
    if held is None or held[0] != files:
        held = _kept[name] = (files, SparseIndex(narrow, key, text))
    return held[1]


def bm25_scores(corpus: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", qkey: str = "query_id", qtext: str = "query_text") -> DataFrame:
    """``qkey, key, score`` of every record that shares a term with a question; repeated question terms count again."""
    index = sparse_index(corpus, key, text)
    asked = index.asked(questions, qkey, qtext)
    # what is asked for is sent to the tasks once its size is checked, and joined by shuffle only beyond that
    asked = F.broadcast(asked) if asked.count() <= MAX_ASKED else asked
    long = index.records.select(key, "n_terms", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, "n_terms", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.lit(index.mean)))
    return long.join(asked, "term").groupBy(qkey, key).agg(F.sum(part).alias("score"))


def top_ranked(scored: DataFrame, qkey: str, key: str, score: str, k: int, descending: bool = True) -> DataFrame:
    """The best k per question with a rank from 0."""
    order = F.round(score, 9)
    window = Window.partitionBy(qkey).orderBy(order.desc() if descending else order.asc(), F.col(key).asc())
    # the bare row number under the filter lets each partition keep its own best k before the shuffle
    return scored.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


def bm25_topk(corpus: DataFrame, questions: DataFrame, k: int = RAW_K, key: str = "doc_id", text: str = "text", qkey: str = "query_id", qtext: str = "query_text") -> DataFrame:
    """``qkey, key, score, rank`` of the best k records per question, those without a shared term at score 0 included."""
    index = sparse_index(corpus, key, text)
    best = cut(top_ranked(index.best(index.asked(questions, qkey, qtext), k, qkey), qkey, key, "score", k))
    full = best.groupBy(qkey).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = cut(questions.select(qkey, qtext).join(full, qkey, "left_anti"))
    if short.isEmpty():
        return best
    # a question with fewer than k positive records has them all in ``best``; it gets records of score 0, the lowest ids
    # first: those among the lowest k + m that it has no score for.  Only where weights are negative, in a corpus of few
    # words, are there other scores, and m may be over k
    positive = best.join(short.select(qkey).distinct(), qkey, "left_semi").select(qkey, key, "score")
    scored = cut(bm25_scores(corpus, short, key, text, qkey, qtext)) if index.least < 0 else positive
    most = scored.groupBy(qkey).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    kind = dict(corpus.dtypes)[key]
    heads = [r[0] for r in corpus.where(F.col(key).isNotNull()).select(key).orderBy(key).limit(k + most).collect()]
    pairs = short.select(qkey).distinct().select(qkey, F.explode(F.from_json(F.lit(json.dumps(heads)), f"array<{kind}>")).alias(key))
    zeros = pairs.join(scored, [qkey, key], "left_anti").withColumn("score", F.lit(0.0))
    rest = top_ranked(scored.unionByName(zeros), qkey, key, "score", k)
    return best.join(full.select(qkey), qkey, "left_semi").unionByName(rest)


def only_sources(ranked: DataFrame, corpus: DataFrame, sources: list[str], k: int = RAW_K, key: str = "doc_id", source: str = "source", qkey: str = "query_id") -> DataFrame:
    """The best 3k of all records cut to the allowed sources, then to k: the limit comes before the filter."""
    allowed = ranked.where(F.col("rank") < 3 * k).join(corpus.where(F.col(source).isin(sources)).select(key), key, "left_semi")
    window = Window.partitionBy(qkey).orderBy("rank")
    return allowed.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int = RAW_K, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", sent: int = MAX_QUESTION_VALUES) -> DataFrame:
    """``qkey, key, distance, rank``: the k nearest by squared distance, exact.

    The questions' vectors are sent to the tasks in blocks of at most ``sent`` numbers, one pass over the vectors and one
    written result each, so the driver holds one block.  A task keeps its best k of each question over all its batches
    and gives them once, so what is shuffled grows with the tasks and not with the vectors.  Null vectors are left out.
    """
    asked = questions.where(F.col(vector).isNotNull()).select(qkey, vector)
    numbers = asked.agg(F.sum(F.size(vector))).first()[0] or 0
    blocks = max(1, -(-numbers // sent))
    near = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == block)
        found = top_ranked(_nearest(vectors, part.collect(), k, key, vector, qkey, dict(questions.dtypes)[qkey]), qkey, key, "distance", k, descending=False)
        found = cut(found) if blocks > 1 else found
        near = found if near is None else near.unionByName(found)
    return near


def best_of(near: tuple[np.ndarray, np.ndarray], block: np.ndarray, keys: np.ndarray, one: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of what is held (keys, distances) and a block; ``rough`` distances choose whose exact one is taken."""
    if len(rough) > k:
        limit = np.partition(rough, k - 1)[k - 1] + 1e-6
        chosen = np.flatnonzero(rough <= limit)
    else:
        chosen = np.arange(len(rough))
    far = ((block[chosen] - one) ** 2).sum(axis=1)
    all_keys, all_far = np.concatenate([near[0], keys[chosen]]), np.concatenate([near[1], far])
    # ties are settled by the id
    order = np.lexsort((all_keys, np.round(all_far, 9)))[:k]
    return all_keys[order], all_far[order]


def _nearest(vectors: DataFrame, rows: list, k: int, key: str, vector: str, qkey: str, qkind: str) -> DataFrame:
    """``qkey, key, distance``: of each task's vectors the k nearest to each question."""
    kind = dict(vectors.dtypes)[key]
    schema = f"{qkey} {qkind}, {key} {kind}, distance double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    ids = [r[0] for r in rows]
    held = np.array([r[1] for r in rows], dtype=np.float64)
    arrow = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple[np.ndarray, np.ndarray]] | None = None
        lengths = (held**2).sum(axis=1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            keys = np.array(batch.column(0).to_pylist())
            near = near or [(keys[:0], np.zeros(0))] * len(ids)
            own = (block**2).sum(axis=1)
            for at in range(0, len(ids), 256):
                rough = lengths[at : at + 256, None] + own - 2 * held[at : at + 256] @ block.T
                for i, row in enumerate(rough, at):
                    near[i] = best_of(near[i], block, keys, held[i], row, k)
        if near:
            sizes = [len(f) for _, f in near]
            columns = [[q for q, m in zip(ids, sizes, strict=True) for _ in range(m)], np.concatenate([x for x, _ in near]).tolist(), np.concatenate([f for _, f in near])]
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def fuse(dense: DataFrame, sparse: DataFrame, key: str = "doc_id", qkey: str = "query_id") -> DataFrame:
    """``qkey, key, dense_rank, sparse_rank, rrf``: weighted reciprocal rank fusion; a side without the record adds nothing."""
    d = dense.select(qkey, key, F.col("rank").alias("dense_rank"))
    s = sparse.select(qkey, key, F.col("rank").alias("sparse_rank"))
    both = d.join(s, [qkey, key], "full_outer")
    part = lambda c, w: F.when(F.col(c).isNotNull(), F.lit(w) / (RRF_K + F.col(c) + 1)).otherwise(0.0)
    return both.withColumn("rrf", part("dense_rank", DENSE_WEIGHT) + part("sparse_rank", SPARSE_WEIGHT))


def kept_hits(fused: DataFrame, corpus: DataFrame, keep: int = KEEP, boosted: str = "table", stub_of: str = "prose", denied: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", kind: str = "type", figure: str | None = None, qkey: str = "query_id") -> DataFrame:
    """The best ``keep`` per question after the boost, the denied id prefixes and the stubs, with ``hit_rank`` from 0.

    Records of kind ``boosted`` that the dense side found gain ``BOOST``; texts of kind ``stub_of`` under 80
    characters that are no figure are left out before counting.  Records that are in no corpus are skipped.
    """
    facts = corpus.select(key, F.col(kind).alias("_kind"), F.length(strip(F.coalesce(F.col(text), F.lit("")))).alias("_size"), (F.coalesce(F.col(figure), F.lit(False)) if figure else F.lit(False)).alias("_figure"))
    hits = fused.join(facts, key)
    rrf = F.col("rrf") + F.when(F.col("dense_rank").isNotNull() & (F.col("_kind") == boosted), BOOST).otherwise(0.0)
    hits = hits.withColumn("rrf", rrf).where(~((F.col("_kind") == stub_of) & ~F.col("_figure") & (F.col("_size") < STUB)))
    for prefix in denied:
        hits = hits.where(~F.col(key).cast("string").startswith(prefix))
    window = Window.partitionBy(qkey).orderBy(F.round("rrf", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col(key))
    best = hits.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= keep)
    return best.withColumn("hit_rank", F.col("_n") - 1).drop("_kind", "_size", "_figure", "_n")


#: Small letters that are words and not acronyms.
WORDS_NOT_ACRONYMS = ("an", "ar", "pet", "spa", "us")


def expand_acronyms(text: Column, acronyms: dict[str, str], blocked: tuple[str, ...] = WORDS_NOT_ACRONYMS) -> Column:
    """The first allowed occurrence of each acronym is followed by its expansion; what is inserted isn't looked at again.

    Longest acronyms first; upper case always expands, other writings unless they are blocked.
    """
    known = F.create_map(*[F.lit(x) for k, v in acronyms.items() for x in (k.upper(), v)])
    pattern = r"\b(?i:" + "|".join(sorted(acronyms, key=lambda k: (-len(k), k))) + r")\b"
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, pair: Column) -> Column:
        word, gap = pair["w"], pair["g"]
        up = F.upper(word)
        fresh = word.isNotNull() & ~F.array_contains(state["seen"], F.coalesce(up, F.lit(""))) & ((word == up) | ~F.lower(word).isin(*blocked))
        out = F.concat(state["out"], gap, F.coalesce(word, F.lit("")), F.when(fresh, F.concat(F.lit(" ("), F.coalesce(F.try_element_at(known, up), F.lit("")), F.lit(")"))).otherwise(""))
        return F.struct(out.alias("out"), F.when(fresh, F.array_append(state["seen"], up)).otherwise(state["seen"]).alias("seen"))

    pairs = F.zip_with(gaps, found, lambda g, w: F.struct(F.coalesce(g, F.lit("")).alias("g"), w.alias("w")))
    return F.aggregate(pairs, start, step)["out"]


def route_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """The sources named in a text in the order they are found, null if none: longest alias first, each match taken out."""
    rest = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    found = none
    for alias in sorted(aliases, key=lambda a: (-len(a), list(aliases).index(a))):
        there = F.contains(rest, F.lit(alias))
        found = F.concat(found, F.when(there, F.array(F.lit(aliases[alias]))).otherwise(none))
        rest = F.replace(rest, F.lit(alias), F.lit(" "))
    found = F.array_distinct(found)
    return F.when(F.size(found) > 0, found)


#: Vectors the cells of the approximate index are fitted on, rounds of fitting, and the share of the cells a search looks into.
CELL_SAMPLE, CELL_ROUNDS, PROBED = 20_000, 10, 0.6


def cell_centres(vectors: DataFrame, key: str, vector: str, cells: int, sample: int = CELL_SAMPLE, rounds: int = CELL_ROUNDS) -> np.ndarray:
    """Centres of cells by k-means over at most ``sample`` vectors, those with the least hash of their key.

    The fit alone is on a sample; every vector is put into a cell.  Empty cells keep their first centre.
    """
    held = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), vector)
    total = held.count()
    if total > sample:
        held = held.where(F.col("h") < F.lit(int(-(2**63) + min(1.0, (sample + 5 * sample**0.5) / total) * 2**64)))
    rows = [r[1] for r in sorted(held.collect(), key=lambda r: r["h"])][:sample]
    if not rows:
        return np.zeros((0, 0))
    points = np.array(rows, dtype=np.float64)
    centres = points[:: max(1, len(points) // cells)][:cells].copy()
    for _ in range(rounds):
        nearest = ((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


class DenseIndex:
    """Every vector beside its cell, written in order of the cells; a search looks into the cells nearest to a question.

    A crowded cell is spread over files by its keys, so a group of equal vectors of any size is several tasks.  What a
    search misses lies in cells it doesn't look into; ``dense_topk`` is the exact way.  Of the exact 60 nearest of the
    test vectors, which are spread almost evenly, 0.93 are found with ``PROBED`` of the cells (0.88 with half of them);
    vectors that lie in groups need fewer.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int = 128) -> None:
        spark = vectors.sparkSession
        self.key, self.vector = key, vector
        self.centres = centres = cell_centres(vectors, key, vector, cells)
        kinds = dict(vectors.dtypes)
        path = scratch(spark, "cells")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths = (centres**2).sum(axis=1)
            for batch in batches:
                if batch.num_rows:
                    block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    near = (lengths - 2 * block @ centres.T).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], names=["cell", key, vector])

        held = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(assign, f"cell int, {key} {kinds[key]}, {vector} {kinds[vector]}")
        held.repartitionByRange("cell", key).sortWithinPartitions("cell").write.parquet(path)
        self.vectors = spark.read.parquet(path)

    def topk(self, questions: DataFrame, k: int = RAW_K, qkey: str = "query_id", probed: float = PROBED, sent: int = MAX_QUESTION_VALUES) -> DataFrame:
        """``qkey, key, distance, rank`` of the k nearest among the vectors of the cells looked into."""
        spark, key, vector = questions.sparkSession, self.key, self.vector
        asked = questions.where(F.col(vector).isNotNull()).select(qkey, vector)
        kinds, qkind = dict(self.vectors.dtypes), dict(questions.dtypes)[qkey]
        schema = f"{qkey} {qkind}, {key} {kinds[key]}, distance double"
        arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
        blocks = max(1, -(-(asked.agg(F.sum(F.size(vector))).first()[0] or 0) // sent))
        near = None
        for block in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == block)
            found = top_ranked(self._near(part.collect(), k, probed, schema, arrow), qkey, key, "distance", k, descending=False)
            found = cut(found) if blocks > 1 else found
            near = found if near is None else near.unionByName(found)
        return near

    def _near(self, rows: list, k: int, probed: float, schema: str, arrow: pa.Schema) -> DataFrame:
        ids = [r[0] for r in rows]
        held = np.array([r[1] for r in rows], dtype=np.float64)
        if not rows or not len(self.centres):
            return self.vectors.sparkSession.createDataFrame([], schema)
        looked = max(1, -(-int(probed * len(self.centres) * 1000) // 1000))
        far = (self.centres**2).sum(axis=1) - 2 * held @ self.centres.T
        cells = np.argsort(far, axis=1, kind="stable")[:, :looked]
        asking = [np.flatnonzero((cells == c).any(axis=1)) for c in range(len(self.centres))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            lengths = (held**2).sum(axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column(0).to_numpy(zero_copy_only=False)
                block = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                keys = np.array(batch.column(1).to_pylist())
                for c in np.unique(cell):
                    inside = np.flatnonzero(cell == c)
                    some, some_keys = block[inside], keys[inside]
                    own = (some**2).sum(axis=1)
                    for at in range(0, len(asking[c]), 256):
                        who = asking[c][at : at + 256]
                        rough = lengths[who, None] + own - 2 * held[who] @ some.T
                        for q, row in zip(who.tolist(), rough, strict=True):
                            near[q] = best_of(near.get(q, (some_keys[:0], np.zeros(0))), some, some_keys, held[q], row, k)
            if near:
                columns = [[ids[q] for q, (x, _) in near.items() for _ in x], np.concatenate([x for x, _ in near.values()]).tolist(), np.concatenate([f for _, f in near.values()])]
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        return self.vectors.select("cell", self.key, self.vector).mapInArrow(run, schema)
