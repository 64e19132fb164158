"""Which operators may run on a stream."""

from pyspark.sql import DataFrame


class BatchOnly(TypeError):
    """Raised when an operator that needs the whole table gets a stream."""


def batch_only(df: DataFrame, name: str) -> None:
    if df.isStreaming:
        raise BatchOnly(f"{name} needs the whole table and does not run on a stream")
