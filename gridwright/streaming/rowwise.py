"""Row-local operators on streams.

Filters, column shaping, updates, cleaning, formulas and the row-local audit
rules look at one row at a time, so the same functions run on a streaming
frame. A lookup against a static table is a stream-static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators.shaping import chain
from ..session import shared_folder


def stream_folder(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """Files arriving in a folder as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def stream_steps(stream: DataFrame, *steps) -> DataFrame:
    return chain(stream, *steps)


def stream_to_folder(stream: DataFrame, path: str, name: str, fmt: str = "parquet", available_now: bool = True,
                     checkpoint: str | None = None):
    """Append a stream to a folder, exactly once; progress is kept in the shared folder."""
    where = checkpoint or shared_folder(stream.sparkSession, f"stream-{name}")
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", where).queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
