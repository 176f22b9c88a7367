"""Dictionary-guided repair of words that lost the i or l of a ligature after f."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_ZIPF, BEAT_BY = 2.0, 1.3


def zipf(words: DataFrame, word: str = "word", per_million: str = "per_million") -> DataFrame:
    """``word, zipf``: frequencies on the zipf scale, the largest of a word's languages."""
    return words.where(F.col(per_million) > 0).groupBy(F.lower(word).alias("word")).agg((F.log10(F.max(per_million)) + 3).alias("zipf"))


def inserted(word: Column) -> Column:
    """Every word made by putting i or l right after an f, in order."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)) == "f")
    return F.flatten(F.transform(places, lambda i: F.transform(F.array(F.lit("i"), F.lit("l")), lambda c: F.concat(F.substr(word, F.lit(1), i), c, F.substr(word, i + 1)))))


def repaired_words(words: DataFrame, freqs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``word, repaired`` of the lower-case words that change.

    One insertion is tried first, two only if none is more frequent than the word.  A repair must reach ``MIN_ZIPF``
    and beat the word by ``BEAT_BY``; ties go to the first made.  Overrides come before everything.
    """
    words = words.select("word").where(F.col("word").isNotNull()).distinct()
    fixed = F.create_map(*[F.lit(x) for p in (overrides or {"": ""}).items() for x in p])
    chosen = words.select("word", F.try_element_at(fixed, F.col("word")).alias("repaired")).where(F.col("repaired").isNotNull() & (F.col("word") != ""))
    plain = words.where(F.col("word").rlike("^[a-z]*f[a-z]*$")).join(chosen, "word", "left_anti")
    own = plain.join(freqs, "word", "left").select("word", F.coalesce("zipf", F.lit(0.0)).alias("own"))

    def best(candidates: DataFrame) -> DataFrame:
        known = candidates.join(freqs.select(F.col("word").alias("cand"), F.col("zipf").alias("z")), "cand")
        better = known.where(F.col("z") > F.col("own"))
        return better.groupBy("word", "own").agg(F.max(F.struct(F.col("z"), (-F.col("at")).alias("at"), F.col("cand"))).alias("b")).select("word", "own", F.col("b.cand").alias("repaired"), F.col("b.z").alias("z"))

    one = best(own.select("word", "own", F.posexplode(inserted(F.col("word"))).alias("at", "cand")))
    rest = own.join(one, "word", "left_anti")
    twice = F.flatten(F.transform(inserted(F.col("word")), inserted))
    two = best(rest.select("word", "own", F.posexplode(twice).alias("at", "cand")))
    accepted = one.unionByName(two).where((F.col("z") >= MIN_ZIPF) & (F.col("z") - F.col("own") >= BEAT_BY))
    return accepted.select("word", "repaired").unionByName(chosen)


def like(original: Column, repaired: Column) -> Column:
    """A repaired word in the original's capitals."""
    capital = F.concat(F.upper(F.substring(repaired, 1, 1)), F.substring(repaired, 2, 1 << 30))
    return F.when(original == F.upper(original), F.upper(repaired)).when(F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1)), capital).otherwise(repaired)


def repaired_texts(df: DataFrame, key: str, text: str, repairs: DataFrame) -> DataFrame:
    """``key, text``: each text with its words repaired; only texts that hold such a word are taken apart."""
    parts = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]*f[a-z]*"), F.lit(0)))).alias("word"))
    hits = words.join(repairs, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("_map"))
    joined = df.select(key, text).join(hits, key, "left")
    fix = F.transform(parts, lambda p: F.coalesce(like(p, F.try_element_at("_map", F.lower(p))), p))
    return joined.select(key, F.when(F.col("_map").isNull(), F.col(text)).otherwise(F.array_join(fix, "")).alias(text))


def repaired_file(spark: SparkSession, path: str, repairs: DataFrame, schema: str = "text string", text: str = "text") -> DataFrame:
    """A file repaired by its kind: of ``.jsonl`` the text of each record, of any other the whole text as one row.

    Record files are read by ``schema``; other fields stay as they are.
    """
    from foliomine.sources.records import read_jsonl, read_whole_texts

    df = read_jsonl(spark, path, schema) if path.endswith(".jsonl") else read_whole_texts(spark, path)
    df = df.withColumn("_row", F.xxhash64(*df.columns))
    # records without an id are told apart by their content: equal ones are repaired alike
    fixed = repaired_texts(df.select("_row", text).distinct(), "_row", text, repairs).withColumnRenamed(text, "_fixed")
    return df.join(fixed, "_row").select(*[F.col("_fixed").alias(c) if c == text else F.col(c) for c in df.columns if c != "_row"])
