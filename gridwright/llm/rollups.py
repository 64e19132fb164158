"""Token totals of a sheet, kept up to date from signed changes in idempotent batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import named

#: Columns of a change after the keys: +1, -1 or 0 rows, and signed tokens.
SIGNED = ("row_change", "token_change")


def inserts(rows: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    """Changes that add the given rows. A null count is 0."""
    return _signed(rows, keys, F.lit(1), F.coalesce(named(tokens), F.lit(0)))


def deletes(rows: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    """Changes that take the given rows out, with the counts they had."""
    return _signed(rows, keys, F.lit(-1), -F.coalesce(named(tokens), F.lit(0)))


def revisions(rows: DataFrame, old_keys: Sequence[str], old_tokens: str, new_keys: Sequence[str], new_tokens: str) -> DataFrame:
    """Changes that replace counts: the old ones leave their key, the new ones enter theirs."""
    renamed = rows.select(*[named(n).alias(o) for o, n in zip(old_keys, new_keys)], named(new_tokens).alias("_tokens"))
    return deletes(rows, old_keys, old_tokens).unionByName(inserts(renamed, old_keys, "_tokens"))


def _signed(rows: DataFrame, keys: Sequence[str], sign, tokens) -> DataFrame:
    return rows.select(*[named(k).alias(k) for k in keys], sign.cast("bigint").alias(SIGNED[0]), tokens.cast("bigint").alias(SIGNED[1]))


def _folder(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/batch-{quote(batch, safe='')}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the batch was written to its end: only then its folder has the commit mark."""
    return _exists(spark, f"{_folder(path, batch)}/_SUCCESS")


def commit(changes: DataFrame, path: str, batch: str, keys: Sequence[str]) -> bool:
    """Add a batch of changes to the ledger in ``path``; False if the batch is there already.

    The changes are summed by key, partly before the shuffle, so a hot key is
    one row per task; keys whose changes cancel are left out. A batch has its own
    folder and counts once it carries the commit mark, so the same batch given
    again changes nothing, and one that broke off is written anew. Null keys
    are keys of their own. An empty batch is committed too.
    """
    spark = changes.sparkSession
    if committed(spark, path, batch):
        return False
    sums = changes.groupBy(*[named(k) for k in keys]).agg(*[F.sum(c).alias(c) for c in SIGNED])
    sums.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in SIGNED])).write.mode("overwrite").parquet(_folder(path, batch))
    return True


def totals(spark: SparkSession, path: str, batches: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys``, ``n_rows`` and ``n_tokens`` after the given batches; those not committed add nothing.

    Totals are sums, so batches may come in any order. Keys without rows and
    tokens are left out. Reads a row per key and batch, never the sheet.
    """
    done = [_folder(path, b) for b in dict.fromkeys(batches) if committed(spark, path, b)]
    if not done:
        raise ValueError(f"none of {list(batches)} is committed in {path}")
    sums = spark.read.parquet(*done).groupBy(*[named(k) for k in keys]).agg(F.sum(SIGNED[0]).alias("n_rows"), F.sum(SIGNED[1]).alias("n_tokens"))
    return sums.filter((F.col("n_rows") != 0) | (F.col("n_tokens") != 0))
