"""Analytics over question logs, calls and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomine.functions.text import mask_name, strip

HISTORY = 20
#: Parts a busy user is spread over.
SALTS = 16


def usage_by(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost per group; null numbers count as 0, cost to six places."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Per log the totals and ``cost_breakdown`` by model."""
    each = usage_by(calls, "log_id", "model")
    entry = F.struct(F.coalesce("model", F.lit("unknown")).alias("key"), F.struct("calls", "input_tokens", "output_tokens", "cost_usd").alias("value"))
    return each.groupBy("log_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cost_breakdown"),
    )


def user_counts(logs: DataFrame, since: str | None = None) -> DataFrame:
    """``user_email, n``: logs per user, from a time on if given; logs without a user are left out."""
    kept = logs.where(F.col("user_email").isNotNull())
    if since:
        kept = kept.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return kept.groupBy("user_email").agg(F.count(F.lit(1)).alias("n"))


def latest_valid(packs: DataFrame, now: str) -> DataFrame:
    """Per user the pack bought last among those that expire after ``now``; ties go to the larger id."""
    valid = packs.where(F.col("user_email").isNotNull() & (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    last = F.max_by(F.struct("id", "purchased_at", "expires_at"), F.struct("purchased_at", "id"))
    return valid.groupBy("user_email").agg(last.alias("p")).select("user_email", F.col("p.id").alias("pack_id"), "p.purchased_at", "p.expires_at")


def used_since_purchase(packs: DataFrame, logs: DataFrame, now: str) -> DataFrame:
    """Per user the latest valid pack and how many questions were asked since it was bought.

    A busy user's logs are spread over ``SALTS`` parts, each beside a copy of the user's one pack, and counted there
    before the counts meet.
    """
    last = latest_valid(packs, now)
    spread = last.select("user_email", "purchased_at", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    salted = logs.where(F.col("user_email").isNotNull()).select("user_email", "created_at", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt"))
    asked = salted.join(spread, ["user_email", "_salt"]).where(F.col("created_at") >= F.col("purchased_at"))
    counts = asked.groupBy("user_email", "_salt").agg(F.count(F.lit(1)).alias("n")).groupBy("user_email").agg(F.sum("n").alias("used"))
    return last.join(counts, "user_email", "left").withColumn("used", F.coalesce("used", F.lit(0)))


def recent_feed(logs: DataFrame, window: int = 60, shown: int = 3, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The newest grounded questions, distinct, with masked names: the limit comes first, so fewer may be left."""
    newest = logs.where(F.col("grounded")).select("id", "created_at", "user_email", "user_name", "resolved_question", "answer").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(window)
    asked = strip(F.coalesce("resolved_question", F.lit("")))
    if hidden:
        newest = newest.where(~F.lower(F.coalesce("user_email", F.lit(""))).isin(*[h.lower() for h in hidden]))
    kept = newest.withColumn("question", asked).where(F.col("question") != "")
    first = Window.partitionBy(F.lower("question")).orderBy(F.col("created_at").desc(), F.col("id").desc())
    distinct = kept.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1)
    return distinct.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(shown).select("id", mask_name(F.col("user_name")).alias("who"), "question", F.coalesce("answer", F.lit("")).alias("answer"))


def last_entries(logs: DataFrame, n: int = HISTORY) -> DataFrame:
    """``user_email, entry_no, entry``: each user's last n entries, a question and its reply being two.

    Only the newest n/2 turns of a user are kept in the running maximum, so a busy user is no large group.
    """
    turns = -(-n // 2)
    rank = Window.partitionBy("user_email").orderBy(F.col("created_at").desc(), F.col("id").desc())
    kept = logs.where(F.col("user_email").isNotNull()).select("user_email", "created_at", "id", "question", "answer").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= turns)
    pair = F.array(F.concat(F.lit("User: "), F.coalesce("question", F.lit(""))), F.concat(F.lit("Assistant: "), F.coalesce("answer", F.lit(""))))
    long = kept.select("user_email", "r", F.posexplode(pair).alias("part", "entry"))
    place = (F.col("r") - 1) * 2 + (1 - F.col("part"))
    return long.withColumn("back", place).where(F.col("back") < n).select("user_email", F.col("back").cast("int").alias("entries_back"), "entry")


def newest(df: DataFrame, order: str, key: str, n: int, condition=None) -> DataFrame:
    """The newest n rows under a condition."""
    return (df if condition is None else df.where(condition)).orderBy(F.col(order).desc(), F.col(key).desc()).limit(n)


def latest_version(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """One row per identity, the one loaded last: what an upsert leaves.  Pre-aggregated, so a hot identity is one row."""
    rest = [c for c in df.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(order, key))
    return df.groupBy(*by).agg(last.alias("_last")).select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])
