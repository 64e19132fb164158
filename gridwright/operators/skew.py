"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col


def hot_keys(counts: DataFrame, keys: list[str], n: str = "_n", share: int = 500) -> DataFrame:
    """Keys that hold more than one ``share``-th of all rows.

    The counts add up to the row total, so there are always fewer than
    ``share`` such keys: the result is small by construction.
    """
    total = counts.agg(F.sum(col(n))).scalar()
    return counts.filter(col(n) * F.lit(share) > total).select(*[col(k) for k in keys])


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt_by: Column,
                counts: DataFrame | None = None, fan: int = 32, share: int = 500) -> DataFrame:
    """Join ``left`` to a side with one row per key; rows of hot keys are spread over ``fan`` tasks.

    ``how`` is ``inner`` or ``left``. ``counts`` holds the rows per key of the
    left side in ``_n`` and is computed when not given. Only the right rows of
    hot keys are repeated.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if counts is None:
        counts = left.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, keys, share=share)
    marks = F.broadcast(hot.select(*[col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)], F.lit(True).alias("_is_hot")))

    def marked(df: DataFrame) -> DataFrame:
        on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)])
        return df.join(marks, on, "left").drop(*[f"_hot_{i}" for i in range(len(keys))])

    salted_left = marked(left).withColumn(
        "_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(salt_by), F.lit(fan))).otherwise(F.lit(0)).cast("int")
    ).drop("_is_hot")
    copies = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    salted_right = marked(right).withColumn("_salt", F.explode(copies)).drop("_is_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
