"""Dealing the rows of a sheet into shards on a hash ring with bounded loads."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from .frames import cells, stored

#: Places on the ring. Rows of one place stay together; the table of places bounds what the driver holds.
PLACES = 1 << 16


def ring_points(shards: int, points: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    marks = []
    for shard in range(shards):
        for k in range(points):
            digest = hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest()
            marks.append((int.from_bytes(digest, "big") % places, shard))
    return sorted(marks)


def place_loads(loads: dict[int, int], shards: int, points: int = 128, slack: float = 0.001, places: int = PLACES) -> dict[int, int]:
    """The shard of every loaded place, no shard above ``(1 + slack)`` times the mean load.

    A place belongs to the first virtual node clockwise. Places go in by
    falling load; one that finds its shard full continues clockwise to the
    next node whose shard has room. Only a place that fits in no shard at all
    raises the bound, by going to the least loaded shard.
    """
    ring = ring_points(shards, points, places)
    marks = [p for p, _ in ring]
    bound = sum(loads.values()) / shards * (1 + slack)
    held, out = [0] * shards, {}
    for place, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(marks, place)
        for step in range(len(ring)):
            shard = ring[(at + step) % len(ring)][1]
            if held[shard] + load <= bound:
                break
        else:
            shard = min(range(shards), key=lambda s: (held[s], s))
        held[shard] += load
        out[place] = shard
    return out


def shard_rows(sheet: DataFrame, shards: int = 8, row_id: str = "row_id", column: str = "value", points: int = 128, slack: float = 0.001) -> DataFrame:
    """Shard and slot of every row, by consistent hashing with bounded loads on bytes.

    The key of a row is its text, so rows of equal text share a shard (null
    counts as the empty text); its load is the UTF-8 length of the text plus
    one. Each shard holds at most ``1 + slack`` times the mean load, unless a
    single group of equal texts is larger than what is free anywhere.

    Returns per row ``row_id``, ``size``, ``text_crc32``, ``shard`` and
    ``slot``, which counts the rows of a shard from 0 without gaps. Repeated
    rows each get a slot; an empty sheet gives no rows.

    The loads are combined per ring place before anything moves, and at most
    ``PLACES`` of them reach the driver, however large the sheet is. Slots
    come from one offset per (input partition, shard), so no shard is ever
    sorted or numbered in one task.
    """
    text = F.coalesce(F.col("cell"), F.lit(""))
    rows = cells(sheet, row_id, column).select(
        "row_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(PLACES)).cast("int").alias("place"),
    )
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    loads = {r.place: r.load for r in rows.groupBy("place").agg(F.sum("size").alias("load")).collect()}
    placed = sorted(place_loads(loads, shards, points, slack).items())
    places = sheet.sparkSession.createDataFrame(placed, "place int, shard int")
    rows = rows.join(F.broadcast(places), "place").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at"))
    return (
        rows.withColumn("nth", nth).join(offsets, ["part", "shard"])
        .select("row_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("bigint").alias("slot"))
    )
