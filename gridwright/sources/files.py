"""Delimited and JSON tables, and whole-column type inference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.cells import cell, col, isnull_empty, num, parse_date
from ..operators.shaping import title_of, with_titles
from ..streaming.guard import batch_only
from .csv_splits import read_split_csv

KEY_CHARACTERS = r"[^A-Za-z0-9一-鿿]"
# Marks missing fields while reading, so that a quoted empty field stays empty text.
MISSING = "\x01"
DATE_START = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"


def column_key(title: str, index: int) -> str:
    """Column name for a header: letters, digits and Han characters, no leading digit."""
    key = re.sub(KEY_CHARACTERS, "_", title)
    key = re.sub(r"^([0-9])", r"_\1", key)
    return key or f"col_{index}"


def name_columns(df: DataFrame, headers: list[str | None]) -> DataFrame:
    """Headers become column titles; blank ones are numbered, equal names get a number."""
    titles = [h if h not in (None, "") else f"列{i + 1}" for i, h in enumerate(headers)]
    keys: list[str] = []
    for i, t in enumerate(titles):
        key, n = column_key(t, i), 2
        base = key
        while key in keys:
            key, n = f"{base}_{n}", n + 1
        keys.append(key)
    return with_titles(df.toDF(*keys), dict(zip(keys, titles)))


def read_csv(spark: SparkSession, path, header: bool = True, multiline: bool = True, infer: bool = False, split: bool = False, **options) -> DataFrame:
    """Text table; every cell is text unless ``infer`` is set.

    Quoted line breaks are read by default, which keeps one file in one task.
    ``split=True`` reads them by as many tasks as a file has blocks, for cells
    quoted as :func:`write_table` does; other ``options`` do not go with it.
    ``multiline=False`` splits files that have no such cells.
    """
    if split and options:
        raise ValueError(f"split reading takes no options: {sorted(options)}")
    own = {"escape": '"', "nullValue": MISSING}
    raw = (
        spark.read.option("header", header).option("multiLine", multiline).option("inferSchema", False)
        .options(**own).options(**options).csv(path)
    )
    headers = [None if re.fullmatch(rf"_c{i}", n) else n for i, n in enumerate(raw.columns)]
    df = name_columns(read_split_csv(spark, path, raw.columns, header, own) if split else raw, headers)
    return infer_and_cast(df) if infer else df


def read_json(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


def type_facts(df: DataFrame, columns=None) -> DataFrame:
    """``column, type`` by all cells of each column: number, date or text. One scan."""
    batch_only(df, "type_facts")
    names = list(columns or df.columns)
    aggs, rows = [], []
    for i, n in enumerate(names):
        given = ~isnull_empty(cell(df, n))
        aggs += [
            F.count_if(given).alias(f"n{i}"), F.count_if(given & num(cell(df, n)).isNotNull()).alias(f"x{i}"),
            F.count_if(given & F.coalesce(col(n).cast("string").rlike(DATE_START), F.lit(False))).alias(f"d{i}"),
        ]
        kind = (
            F.when(F.col(f"n{i}") == 0, "text").when(F.col(f"x{i}") == F.col(f"n{i}"), "number")
            .when(F.col(f"d{i}") == F.col(f"n{i}"), "date").otherwise("text")
        )
        rows.append(F.struct(F.lit(n).alias("column"), kind.alias("type")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def cast_columns(df: DataFrame, types: dict[str, str], keep_date_text: bool = True) -> DataFrame:
    """Number columns to double; date columns to dates, or kept as text."""
    def typed(n: str) -> Column:
        if types.get(n) == "number" and isinstance(df.schema[n].dataType, T.StringType):
            out = num(cell(df, n))
        elif types.get(n) == "date" and not keep_date_text:
            out = parse_date(col(n))
        else:
            return col(n)
        return out.alias(n, metadata={**(df.schema[n].metadata or {}), "declared": types[n]})

    return df.select([typed(n) for n in df.columns])


def infer_and_cast(df: DataFrame, keep_date_text: bool = True) -> DataFrame:
    """Types from one pass over the data; one row per column reaches the driver."""
    types = {r["column"]: r["type"] for r in type_facts(df).collect()}
    return cast_columns(df, types, keep_date_text)


def _titled(df: DataFrame) -> DataFrame:
    return df.toDF(*[title_of(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", titles: bool = True) -> None:
    """Write one table to a folder as csv, json (one object per line) or parquet."""
    out = _titled(df) if titles else df
    if fmt == "csv":
        # Null is an empty field, empty text is a quoted empty field.
        out.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif fmt == "json":
        out.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        out.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per table."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt, mode)
