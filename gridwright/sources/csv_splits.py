"""Delimited files with line breaks in quoted cells, read by many tasks a file.

Whether a line break ends a record depends on the number of quotes before it.
Quotes are counted for every block of a scan; a running sum of the few counts
says which blocks begin inside a cell. With that, each task cuts its blocks
into records, and only records that cross a block's end are put together
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PIECES = "file string, block bigint, seq bigint, kind string, record string"


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with the file and the start of the block they are in; line ends inside a block keep their order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _open_blocks(lines: DataFrame) -> DataFrame:
    """Blocks that begin inside a quoted cell. One row per block of the scan at most, which the driver has listed already."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", before).filter("before % 2 = 1").select("file", "block", F.lit(True).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block: ``whole``, or the ``head``, ``tail`` or ``middle`` of one that crosses its ends."""
    key, inside, begun_before, held, seq = None, False, False, [], 0
    out: list[tuple] = []

    def end(kind: str) -> None:
        nonlocal seq, held
        record = "\n".join(held)
        held = []
        if kind != "whole" or record.rstrip("\r"):
            out.append((*key, seq, kind, record))
            seq += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "seq", "kind", "record"])

    for given in batches:
        for file, block, opened, line in zip(*(given.column(i).to_pylist() for i in range(4))):
            if (file, block) != key:
                if held:
                    end("middle" if begun_before else "tail")
                key, inside, begun_before, seq = (file, block), bool(opened), bool(opened), 0
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                end("head" if begun_before else "whole")
                begun_before = False
        yield batch()
    if held:
        end("middle" if begun_before else "tail")
        yield batch()


def split_records(spark: SparkSession, path) -> DataFrame:
    """``record`` and ``first`` (whether it is the first of its file) of all files under a path.

    Cells are quoted by ``"`` and quotes in them doubled; lines end in LF or
    CRLF. Empty lines between records are left out, as are empty files. Text
    after an opening quote that never closes is one record. A cell's text and the
    records themselves are never shuffled, but for those that cross a block.
    """
    lines = _lines(spark, path)
    pieces = lines.join(F.broadcast(_open_blocks(lines)), ["file", "block"], "left").select("file", "block", "inside", "value").mapInArrow(_cut, PIECES)
    first = (F.col("block") == 0) & (F.col("seq") == 0)
    whole = pieces.filter("kind = 'whole'").select("record", first.alias("first"))
    order = Window.partitionBy("file").orderBy("block", "seq")
    parts = pieces.filter("kind <> 'whole'").withColumn("number", F.count_if(F.col("kind") == "tail").over(order))
    joined = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "record"))).alias("parts"))
    crossing = joined.select(
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
        ((F.col("parts")[0]["block"] == 0) & (F.col("parts")[0]["seq"] == 0)).alias("first"))
    return whole.unionByName(crossing)


def read_split_csv(spark: SparkSession, path, columns: list[str], header: bool, options: dict[str, str]) -> DataFrame:
    """Text columns of all records; ``columns`` are names of the cells in their order."""
    records = split_records(spark, path)
    if header:
        records = records.filter("not first")
    schema = ", ".join(f"_{i} string" for i in range(len(columns)))
    line = F.regexp_replace("record", "\r$", "")
    parsed = records.select(F.from_csv(line, schema, options).alias("r")).select("r.*")
    return parsed.toDF(*columns)
