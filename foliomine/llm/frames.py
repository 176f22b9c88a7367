"""What the operators of this subpackage share: reading tables, spreading work, Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomine.session import cut

#: Spaces other than the plain one, for Java's regular expressions.
JAVA_SPACES = r"\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
#: Zero-width characters, joiners, direction marks, soft hyphens.
JAVA_INVISIBLE = r"\u00AD\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF"


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share where the scan has fewer splits than cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of marks that are sent to every task.
MAX_SENT_ROWS = 300_000


def send_small(marks: DataFrame, rows: int = MAX_SENT_ROWS) -> DataFrame:
    """Marks that texts are joined to, written once; sent to every task if they are few, so that no text is shuffled."""
    marks = cut(marks)
    return F.broadcast(marks) if marks.count() <= rows else marks


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice: the optimizer can't push this below the projection."""
    return df.withColumn("_at", F.spark_partition_id()).where(condition & (F.col("_at") >= 0)).drop("_at")


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run a kernel over batches given as {column: list}; each batch it yields is such a dict in the order of schema."""
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema
    names = struct.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict]:
            for batch in batches:
                yield {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}

        for out in kernel(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(out[name], type=arrow_schema.field(name).type) for name in names], schema=arrow_schema)

    return df.mapInArrow(run, struct)


