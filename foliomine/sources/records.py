"""Readers and writers of record files, upserts and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Record schemas; fields a file lacks are null.
PAGES = "doc string, page int, text string"
BLOCKS = "doc string, page int, block_index int, bbox array<double>, column int, text string, is_heading boolean, is_figure boolean, section string"
TABLES = "doc string, page int, table_index int, bbox string, n_rows int, n_cols int, rows array<array<string>>, markdown string, caption string"
CHUNKS = "id string, doc_name string, display_text string, search_text string, embedding array<float>, source string, type string, page int, item_index int, section string, caption string, is_heading boolean, is_figure boolean, chunk_index int, n_chunks int"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON record a line, by an explicit schema; blank lines are no records, bells in table text go."""
    df = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    return df.withColumn("markdown", F.regexp_replace("markdown", "\x07", "")) if "markdown" in df.columns else df


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON record a line; null fields are left out, other scripts are kept as they are."""
    df.write.mode(mode).json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a file that holds one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")))


def write_page_markers(df: DataFrame, path: str, mode: str = "error") -> None:
    """Texts with a line naming the page before each, for reading by people."""
    df.orderBy("doc", "page").select(F.concat(F.lit("[[PAGE "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]]\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value")).write.mode(mode).text(path)


def write_previews(tables: DataFrame, path: str, mode: str = "error") -> None:
    """The markdown of each table as text, in a folder per page and table."""
    name = F.format_string("p%04d_t%d", F.coalesce("page", F.lit(0)), F.coalesce("table_index", F.lit(0)))
    tables.select(name.alias("preview"), F.col("markdown").alias("value")).where(F.col("value").isNotNull()).write.mode(mode).partitionBy("preview").text(path)


def scalar_fields(df: DataFrame) -> DataFrame:
    """Only columns that hold single values, as the metadata of a store does."""
    return df.select(*[c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))])


def find(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, or none."""
    return df.where(F.col(key) == value)


def has_source(df: DataFrame, source: str, column: str = "source") -> bool:
    """Whether any row is of a source; stops at the first."""
    return not df.where(F.col(column) == source).limit(1).isEmpty()


def may_load(chunks: DataFrame, source: str, manifest: DataFrame | None) -> bool:
    """A source is loaded if it isn't there, or if an earlier load left a manifest to go on from."""
    return not has_source(chunks, source) or (manifest is not None and not manifest.limit(1).isEmpty())


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: What a log record always has; usage may be missing.
LOG_USAGE = {"input_tokens": "int", "output_tokens": "int", "total_tokens": "int", "cost_usd": "double", "cost_breakdown": "string"}


def append_logs(logs: DataFrame, path: str) -> None:
    """Log records appended; a null answer is written as '', usage columns that aren't given are null."""
    for name, kind in LOG_USAGE.items():
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit(None).cast(kind))
    append(logs.withColumn("answer", F.coalesce("answer", F.lit(""))), path)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """What a store holds after an upsert: the new rows, and the old ones whose id isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_done(batches: DataFrame, manifest: DataFrame, batch: str = "batch") -> DataFrame:
    """The rows of batches that the manifest doesn't name."""
    return batches.join(manifest.select(batch).distinct(), batch, "left_anti")


def record_batch(spark: SparkSession, manifest: str, batch: int) -> None:
    """Name a batch in the manifest, after it was written: a batch may run twice, and an upsert makes that harmless."""
    spark.createDataFrame([(batch,)], "batch int").write.mode("append").parquet(manifest)
