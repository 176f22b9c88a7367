"""Problem 5: lines repeated across the texts of one source, and the texts without them.

Per source, the share of rows with a line is held against its share among the rows outside by a log-likelihood ratio.
Every pair of a source and a line that stands in two of its rows is tested, and a Benjamini-Hochberg step over all of
them keeps the share of false discoveries at ``fdr``: it rejects chance repeats, about all that are two or three in a
large source.  Of the significant lines those that reach ``min_rows`` and ``min_share`` are taken.  Outside are the
sources that don't repeat the line themselves: boilerplate shared by many sites stays boilerplate in each of them.  The
rate outside is that of its rows with half a row added, so a line that stands nowhere else has a rate too; with no row
outside, the rate is that of a line in half a row of the source itself.

Counts are taken over all rows, pre-aggregated before each shuffle.  Keys are two 64-bit hashes instead of the lines,
and the lines of a hot source are spread over salts when they are looked up.

Null sources have no site; their lines are never cases.  Null and blank texts count as rows and hold no lines.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import send_small
from foliomine.session import cut

MIN_ROWS = 5
MIN_SHARE = 0.03
FDR = 0.05
SALTS = 16
#: Width of a bin of the natural logarithm of a p-value; the step is exact up to this width.
BIN = 0.01


def normal_line(line: Column) -> Column:
    """Lower case, digits 0-9 removed, runs of spaces and tabs one space, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", ""), "[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def _lines(df: DataFrame, source: str, text: str, row: str) -> DataFrame:
    """A row for each counted line: source, row, position and the line's key."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    long = df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(row).alias("row"), F.posexplode(lines).alias("pos", "line"))
    long = long.withColumn("line", normal_line(F.col("line"))).where(F.col("line").rlike(r"(?:\p{L}[^\p{L}]*){3}"))
    return long.select("source", "row", (F.col("pos") + 1).alias("line_no"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))


def _deviance(k: Column, n: Column, p: Column) -> Column:
    """Twice the log-likelihood that k of n gain over a rate p."""
    hit = F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    miss = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    return 2 * (hit + miss)


def excess_lines(df: DataFrame, source: str, text: str, row: str, fdr: float = FDR) -> DataFrame:
    """The significant pairs (source, h, g) with ``n`` rows, ``share`` of the source's rows and ``llr``.

    ``row`` must be unique.  An empty table gives no pairs.
    """
    total = df.where(F.col(source).isNotNull()).count()
    rows = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    # a line twice in a text is one row: the distinct keys are taken within the text, before the shuffle
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    normal = F.filter(F.transform(lines, normal_line), lambda x: x.rlike(r"(?:\p{L}[^\p{L}]*){3}"))
    keys = F.array_distinct(F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"))))
    counts = df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.explode(keys).alias("k")).groupBy("source", "k.h", "k.g").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.where(F.col("n") >= 2).join(rows, "source")
    # per line: rows in all sources, and those of the sources that repeat it
    heavy = repeated.groupBy("h", "g").agg(F.sum("n").alias("heavy_n"), F.sum("n_rows").alias("heavy_rows"))
    everywhere = counts.groupBy("h", "g").agg(F.sum("n").alias("all_n"))
    pairs = repeated.join(heavy, ["h", "g"]).join(everywhere, ["h", "g"])
    k, n = F.col("n").cast("double"), F.col("n_rows").cast("double")
    out_n, out_rows = (F.col("all_n") - F.col("heavy_n")).cast("double"), (F.lit(total) - F.col("heavy_rows")).cast("double")
    rate = F.when(out_rows > 0, (out_n + 0.5) / (out_rows + 1)).otherwise(0.5 / (n + 1))
    pairs = pairs.select("source", "h", "g", "n", (k / n).alias("share"), F.when(k / n > rate, F.greatest(_deviance(k, n, rate), F.lit(0.0))).otherwise(0.0).alias("llr"))
    # upper bound of the tail of chi-square with one degree of freedom, in logarithms
    half = F.col("llr") / 2
    pairs = pairs.withColumn("log_p", F.when(half > 1, -half - 0.5 * F.log(half * 3.141592653589793)).otherwise(0.0))
    # two passes read the pairs, so they are written once; they are few
    pairs = cut(pairs)
    # the step needs ranks: a histogram of fixed width gives them without sorting pairs in one task.  The least p of all
    # needs only log(fdr / m), so nothing below counts and the bins have a lower end
    m = pairs.count()
    floor = log(fdr / max(m, 1)) - BIN
    binned = F.floor(F.greatest(F.col("log_p"), F.lit(floor)) / BIN)
    limit, seen = None, 0
    for b in sorted(pairs.groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda x: x["bin"]):
        seen += b["n"]
        if (b["bin"] + 1) * BIN <= log(fdr * seen / m):
            limit = b["bin"]
    keep = F.lit(False) if limit is None else binned <= limit
    return pairs.where(keep).drop("log_p")


def marked_lines(df: DataFrame, source: str, text: str, row: str, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, fdr: float = FDR) -> DataFrame:
    """One row per case: ``row``, ``line_no``.  Significant lines in at least ``min_rows`` rows and ``min_share`` of the rows."""
    found = excess_lines(df, source, text, row, fdr).where((F.col("n") >= min_rows) & (F.col("share") >= min_share))
    found = found.select("source", "h", "g", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    lines = _lines(df, source, text, row).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return lines.join(found, ["source", "h", "g", "salt"], "left_semi").select(F.col("row").alias(row), "line_no")


def without_site_lines(df: DataFrame, source: str, text: str, row: str, **parameters) -> DataFrame:
    """All rows and columns, the text without the marked lines, plus ``removed_lines``, which replaces a column of that name.

    Texts without cases are unchanged, null texts stay null.
    """
    marks = marked_lines(df, source, text, row, **parameters).groupBy(F.col(row).alias("_row")).agg(F.collect_set("line_no").alias("_marks"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"), F.col(f"`{row}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    joined = own.join(send_small(marks), F.col("_key") == F.col("_row"), "left")
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains(F.col("_marks"), i + 1))
    clean = F.when(F.col("_marks").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(c) if c == text else F.col("_own")[c].alias(c) for c in df.columns if c != "removed_lines"]
    return joined.select(*columns, F.when(F.col("_marks").isNull(), 0).otherwise(F.size("_marks")).alias("removed_lines"))
