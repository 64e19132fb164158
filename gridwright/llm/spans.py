"""Byte strings that a sheet has more than once: bucket refinement of suffixes, as in suffix-array construction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .frames import bounded, cells, stored
from .hashing import Spans, chunks, mix

#: Starts of a suffix group that are refined together, per round. The first round has whole groups.
WIDTHS = (25, 5, 1)

NODE = "cell_key bigint, anchor bigint, low bigint, high bigint, core bigint, hull bigint, place bigint"
NAMES = ["cell_key", "anchor", "low", "high", "core", "hull", "place"]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` keys from every position that has them."""
    n = len(keys)
    if n < width:
        return keys[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, spans: Spans) -> tuple[np.ndarray, ...]:
    """Groups of starts: cell, anchor, first and last start, all as positions in ``data``.

    The anchor of a start is the place, in the first half of its string, whose
    half-length gram has the least hash, the first of equals. It depends on
    the string alone, so equal strings have their anchors at equal distance.
    """
    gram = length // 2
    grams = mix(spans.hash_all(gram)) if len(data) >= gram else np.zeros(0, np.uint64)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    able = np.flatnonzero(sizes >= length)
    counts = sizes[able] - length + 1
    cell = np.repeat(able, counts)
    start = np.arange(len(cell)) + np.repeat(offsets[able] - (np.cumsum(counts) - counts), counts)
    at = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[:len(first)] - 1
    return cell[first], at[first], start[first], start[last]


def node_batch(spans: Spans, base: np.ndarray, key: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, core_from: np.ndarray, core_to: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of suffix groups; positions are given in the chunk and written relative to their cell."""
    core = spans.hash(core_from, core_to)
    hull = mix(spans.hash(low, high + length) + (high - low).astype(np.uint64))
    place = mix(key.view(np.uint64) ^ mix((anchor - base).astype(np.uint64)))
    columns = [key, anchor - base, low - base, high - base, core.view(np.int64), hull.view(np.int64), place.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def _first_groups(keyed: DataFrame, length: int) -> DataFrame:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for chunk in chunks(batch.column(0)):
                spans = Spans(chunk.data)
                cell, anchor, low, high = anchors(chunk.data, chunk.offsets, length, spans)
                yield node_batch(spans, chunk.offsets[cell], keys[chunk.first + cell], anchor, low, high, anchor, anchor + length // 2, length)

    return keyed.select("cell", "cell_key").mapInArrow(group, NODE)


def _carried_lists(carried: DataFrame, length: int) -> DataFrame:
    """The groups of each text, one number a group: anchor, and distances from it to the first and last start."""
    step = F.lit(1 << (length // 2).bit_length())
    packed = (F.col("anchor") * step + F.col("anchor") - F.col("low")) * step + F.col("anchor") - F.col("high")
    return stored(carried.groupBy("cell_key").agg(F.collect_list(packed).alias("groups")), "carried")


def _finer_groups(texts: DataFrame, length: int, width: int) -> DataFrame:
    """The parts, ``width`` starts wide by distance to the anchor, of the groups listed with each text."""
    bits = (length // 2).bit_length()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(1).to_numpy(), batch.column(2)
            for chunk in chunks(batch.column(0)):
                own = lists.slice(chunk.first, chunk.last - chunk.first)
                packed = own.flatten().to_numpy()
                anchor, part = packed >> (2 * bits), (1 << bits) - 1
                to_low, to_high = packed >> bits & part, packed & part
                cell = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                near, far = to_high // width, to_low // width
                counts = far - near + 1
                again = np.repeat(np.arange(len(anchor)), counts)
                nearest = (near[again] + np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
                base = chunk.offsets[cell[again]]
                at = anchor[again] + base
                low = np.maximum(at - to_low[again], at - nearest - width + 1)
                high = np.minimum(at - to_high[again], at - nearest)
                core_to = at - nearest - width + 1 + length
                yield node_batch(Spans(chunk.data), base, keys[chunk.first + cell[again]], at, low, high, at - nearest, core_to, length)

    return texts.select("cell", "cell_key", "groups").mapInArrow(split, NODE)


def _several(nodes: DataFrame, bucket: str, name: str) -> DataFrame:
    """Buckets that stand at several places, with the least of these."""
    out = nodes.groupBy(bucket).agg(F.min("place").alias("least"), F.max("place").alias("most"))
    return bounded(stored(out.filter("least <> most").select(bucket, "least"), name), 24)


def _refine(nodes: DataFrame, cores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of starts that are repeated as a whole, and the groups to be split further.

    A group whose common bytes (core) stand nowhere else holds no repeated
    string. One whose bytes altogether (hull) stand elsewhere too has only
    repeated ones. The others are split; with them goes one group of every
    repeated hull of the same core, as what they may be equal to.
    """
    alive = stored(nodes.join(cores.select("core"), "core", "left_semi").distinct(), "suffix-groups")
    hulls = _several(alive, "hull", "hulls")
    marked = alive.join(hulls, "hull", "left")
    whole = marked.filter("least is not null").select("cell_key", "low", "high")
    open_groups = marked.filter("least is null")
    open_cores = bounded(stored(open_groups.select("core").distinct(), "open-cores"), 16)
    like = marked.filter("least = place").join(open_cores, "core", "left_semi")
    carried = open_groups.select("cell_key", "anchor", "low", "high").unionByName(like.select("cell_key", "anchor", "low", "high"))
    return whole, carried


def repeated_spans(sheet: DataFrame, row_id: str = "row_id", column: str = "value", length: int = 400) -> DataFrame:
    """Remove every byte of a cell that a string of ``length`` bytes covers which the sheet has elsewhere too.

    Cells are taken as UTF-8 bytes, null as empty. A string counts as repeated
    if it also starts at another place of any cell, its own included;
    overlapping places count; strings never cross cells and are judged on the
    input. Returns per row ``row_id``, ``n_bytes``, ``spans`` (start and end
    of the maximal removed runs) and ``kept`` (binary, the other bytes).
    Cells shorter than ``length`` keep all; equal cells, repeated rows too,
    are each other's copies and lose all bytes if they have ``length`` of them.

    How: suffixes are sorted into buckets as in bucket-pointer refinement.
    Starts whose string has its anchor, the half-length gram of least hash, at
    one place form a group; that gram is the group's first bucket. Buckets of
    one place are done. The others are refined by the bucket identifiers
    (hashes) of longer strings at later offsets, for parts of ``WIDTHS``
    starts, down to single starts. A group repeated as a whole leaves the
    recursion at once, and one example of it serves the rest of its bucket, so
    a passage with thousands of places is compared by counts, never in pairs.

    Buckets are identified by 64-bit hashes and combined before each shuffle to
    the least and greatest place; no bucket is ever gathered. What goes back
    to the texts are groups still open, broadcast only while small; else the
    texts that have some are taken out once and joined in each round.
    """
    source = cells(sheet, row_id, column)
    keyed = source.select(F.coalesce("cell", F.lit("")).alias("cell"), F.xxhash64(F.coalesce("cell", F.lit(""))).alias("cell_key"))
    nodes, texts = _first_groups(keyed, length), keyed
    whole, carried = _refine(nodes, _several(nodes, "core", "cores"))
    spans = whole
    # A part of more starts than half a string would have no bytes in common.
    for width in (w for w in WIDTHS if w <= max(1, length // 2)):
        lists = _carried_lists(carried, length)
        joined = bounded(lists, 48 + 8 * F.size("groups"))
        if joined is lists and texts is keyed:
            # Too many to broadcast: the texts concerned are taken out once, not in every round.
            texts = stored(keyed.join(lists.select("cell_key"), "cell_key", "left_semi"), "open-texts")
        nodes = stored(_finer_groups(texts.join(joined, "cell_key"), length, width).distinct(), "finer-groups")
        whole, carried = _refine(nodes, _several(nodes, "core", "cores"))
        spans = spans.unionByName(whole)

    by_start = Window.partitionBy("cell_key").orderBy("low", "end")
    ends = spans.select("cell_key", "low", (F.col("high") + length).alias("end")).distinct()
    ends = ends.withColumn("reach", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("run", F.count_if(F.coalesce(F.col("low") > F.col("reach"), F.lit(True))).over(by_start))
    runs = runs.groupBy("cell_key", "run").agg(F.min("low").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("cell_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    runs = bounded(stored(runs, "runs"), 64 + 32 * F.size("spans"))

    size = F.octet_length("cell")
    digest = F.unhex(F.md5(F.col("cell").cast("binary")))
    copies = source.select(F.coalesce("cell", F.lit("")).alias("cell")).filter(size >= length).groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    copies = bounded(stored(copies.filter("n > 1").select("digest"), "copies"), 48)

    rows = source.select("row_id", F.coalesce("cell", F.lit("")).alias("cell")).withColumn("cell_key", F.xxhash64("cell")).withColumn("own_digest", digest)
    rows = rows.join(runs, "cell_key", "left").join(copies, F.col("own_digest") == F.col("digest"), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.cast("bigint").alias("end")))
    found = F.when(F.col("digest").isNotNull(), all_of_it).otherwise(F.coalesce("spans", none))
    rows = rows.select("row_id", F.col("cell").cast("binary").alias("bytes"), found.alias("spans"))
    # Bytes from the end of a span (or 0) to the start of the next (or the end).
    end_before = lambda i: F.coalesce(F.get("spans", i - 1)["end"], F.lit(0).cast("bigint"))
    start_after = lambda i: F.coalesce(F.get("spans", i)["start"], F.octet_length("bytes").cast("bigint"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring("bytes", (end_before(i) + 1).cast("int"), (start_after(i) - end_before(i)).cast("int")))
    kept = F.when(F.size("spans") == 0, F.col("bytes")).otherwise(F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x)))
    return rows.select("row_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"), "spans", kept.alias("kept"))
