"""From the hits of several sub-questions to one bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomine.functions.text import strip

FLOOR = 0.015
CAP = 16


def reserve_and_fill(hits: DataFrame, key: str = "doc_id", group: str = "group_id", sub: str = "sub_index", score: str = "rrf", rank: str = "hit_rank", floor: float = FLOOR, cap: int = CAP) -> DataFrame:
    """``group, key, rrf, reserved, pick_rank``.

    Sub-questions in order reserve up to two of their hits (one if there are more than four) that clear the floor and
    aren't taken; a taken hit uses up no place.  What is left is filled by the best of all.  The hits of a group are
    bounded (sub-questions times hits kept), so the fold is over a short array.
    """
    each = F.struct(F.col(sub).alias("s"), F.col(rank).alias("r"), F.col(key).alias("k"), F.col(score).alias("v"))
    grouped = hits.groupBy(group).agg(F.array_sort(F.collect_list(each)).alias("hits"), F.count_distinct(sub).alias("subs"))
    kind = dict(hits.dtypes)[key]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.lit(-1).cast("long").alias("s"), F.lit(0).alias("n"), F.array().cast(f"array<struct<k:{kind},v:double>>").alias("picked"))
    quota = F.when(F.col("subs") <= 4, 2).otherwise(1)

    def step(state: Column, hit: Column) -> Column:
        used = F.when(hit["s"].cast("long") == state["s"], state["n"]).otherwise(0)
        take = (used < quota) & ~F.array_contains(state["taken"], hit["k"]) & (hit["v"] >= floor)
        return F.struct(
            F.when(take, F.array_append(state["taken"], hit["k"])).otherwise(state["taken"]).alias("taken"),
            hit["s"].cast("long").alias("s"),
            (used + F.when(take, 1).otherwise(0)).alias("n"),
            F.when(take, F.array_append(state["picked"], F.struct(hit["k"].alias("k"), hit["v"].cast("double").alias("v")))).otherwise(state["picked"]).alias("picked"),
        )

    folded = grouped.withColumn("fold", F.aggregate("hits", start, step))
    reserved = folded.select(group, F.posexplode("fold.picked").alias("at", "p")).select(group, F.col("p.k").alias(key), F.col("p.v").alias(score), F.lit(0).alias("part"), "at")
    pool = folded.select(group, F.col("fold.taken").alias("taken"), F.explode("hits").alias("h")).where(~F.array_contains("taken", F.col("h.k")))
    first = Window.partitionBy(group, "h.k").orderBy(F.col("h.v").desc(), "h.s", "h.r")
    pool = pool.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1)
    order = Window.partitionBy(group).orderBy(F.round("h.v", 9).desc(), "h.s", "h.r")
    pool = pool.withColumn("at", F.row_number().over(order) - 1).select(group, F.col("h.k").alias(key), F.col("h.v").cast("double").alias(score), F.lit(1).alias("part"), "at")
    both = reserved.unionByName(pool)
    taken = Window.partitionBy(group).orderBy("part", "at")
    both = both.withColumn("n", F.row_number().over(taken)).where(F.col("n") <= cap)
    final = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), "part", "at")
    return both.select(group, key, score, (F.col("part") == 0).alias("reserved"), (F.row_number().over(final) - 1).alias("pick_rank"))


def render_context(picked: DataFrame, group: str, rank: str, source: str, page: str, text: str) -> DataFrame:
    """``group, context``: ``[source, p.page]`` and the text of each, in order, blank lines between."""
    head = F.concat(F.lit("["), F.coalesce(F.col(source), F.lit("unknown")), F.lit(", p."), F.coalesce(F.col(page).cast("string"), F.lit("?")), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), head.alias("t"))))
    return picked.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def render_passages(picked: DataFrame, group: str, rank: str, source: str, page: str, text: str) -> DataFrame:
    """``group, passages``: a numbered list of passages."""
    body = F.concat(F.coalesce(F.col(source), F.lit("unknown")), F.lit(", p."), F.coalesce(F.col(page).cast("string"), F.lit("?")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), body.alias("t"))))
    listed = F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"]))
    return picked.groupBy(group).agg(F.array_join(listed, "\n\n").alias("passages"))


def sanitised_plan(plan: Column, question: Column) -> Column:
    """``standalone, sub_queries, in_scope`` of a planner's JSON, or the question alone where it is no object.

    A string of sub-questions is one; other forms give the standalone question; blanks and non-strings are left out;
    fragments shorter than three characters on average are discarded.  A missing scope is in scope.
    """
    value = F.try_parse_json(plan)
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    shape = F.schema_of_variant(value)
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    asked = get("$.standalone_question", "string")
    standalone = F.when(is_object & (F.coalesce(asked, F.lit("")) != ""), strip(asked)).otherwise(strip(question))
    subs = get("$.sub_queries", "variant")
    sub_shape = F.coalesce(F.schema_of_variant(subs), F.lit("VOID"))
    many = F.when(sub_shape.startswith("ARRAY"), F.try_variant_get(value, "$.sub_queries", "array<variant>"))
    strings = F.filter(F.transform(many, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())
    listed = F.when(is_object & (sub_shape == "STRING"), F.array(get("$.sub_queries", "string"))).when(is_object & strings.isNotNull(), strings).otherwise(F.array(standalone))
    clean = F.filter(F.transform(listed, strip), lambda s: s != "")
    size = F.aggregate(F.transform(clean, F.length), F.lit(0), lambda a, x: a + x)
    kept = F.when((F.size(clean) == 0) | (size < 3 * F.size(clean)), F.array(standalone)).otherwise(clean)
    scope = F.coalesce(get("$.in_scope", "boolean"), F.lit(True))
    return F.struct(standalone.alias("standalone"), kept.alias("sub_queries"), F.when(is_object, scope).otherwise(True).alias("in_scope"))


def scope_gate(df: DataFrame, in_scope: Column, reply: str, answer: str = "answer", missing: str = "") -> DataFrame:
    """``in_scope`` (true for null), the answer or the fixed reply of what is out of scope, and ``grounded``, which follows."""
    kept = F.coalesce(in_scope, F.lit(True))
    return df.withColumn("in_scope", kept).withColumn(answer, F.when(F.col("in_scope"), F.coalesce(F.col(answer), F.lit(missing))).otherwise(reply)).withColumn("grounded", F.col("in_scope"))


def search_rows(hits: DataFrame, qkey: str, rank: str, key: str, source: str, page: str, text: str) -> DataFrame:
    """What a search gives of its hits: the question, the place, the id, and source, page and text."""
    return hits.select(qkey, F.col(rank).cast("long").alias("hit_rank"), key, F.col(source).alias("source"), F.col(page).alias("page"), F.col(text).alias("text"))
