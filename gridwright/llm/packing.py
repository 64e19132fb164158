"""Packing the texts of a sheet into near-equal training windows by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .frames import cells
from .tokenizers import byte_pair_encoder

#: Longest piece that is left to be combined with others.
LONGEST_PIECE = 128
#: Windows that are balanced together. Bounds the memory of a task.
WAYS = 64
#: Tokens of a full group of windows that stay free, so that balance suffices.
FREE = 448


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``ways`` groups of near-equal sums.

    A partial partition is a list of (sum, members) by falling sum; groups not
    listed are empty. The two with the largest imbalance are merged, large
    groups of one with small groups of the other, until one is left.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - ways
        if over > 0:
            # The smallest groups of both meet the largest of the other.
            joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over:], reversed(b[len(b) - over:]))]
            a, b = a[:len(a) - over], b[:len(b) - over]
        else:
            joined = []
        merged = sorted(a + b + joined, key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    groups = [members for _, members in heap[0][2]] if heap else []
    return groups + [[] for _ in range(ways - len(groups))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest near-equal windows: their number rises while one exceeds the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, ways)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        ways += 1


SCHEMA = "row_id {}, start bigint, length bigint, ids binary, cell_tokens bigint, window_id bigint, offset bigint"


def pack_cells(
    sheet: DataFrame, tokenizer: str, pattern: str, row_id: str = "row_id", column: str = "value",
    capacity: int = 1024, end_id: int = 0, added_tokens: bool = False,
) -> DataFrame:
    """Cut the cells of a text column into pieces and lay them into windows of ``capacity`` tokens.

    Every row of the sheet gives the token ids of its cell followed by
    ``end_id``; null and empty cells give ``end_id`` alone. With
    ``added_tokens`` a cell's strings of the tokenizer's added tokens count as
    these tokens, else as ordinary text. Whole windows are
    cut off from the front of a cell; the rest, in pieces of at most
    ``LONGEST_PIECE`` tokens, is balanced over ``WAYS`` windows at a time by
    Karmarkar-Karp differencing. Each id lies in exactly one piece.

    Returns one row per piece: ``row_id``, ``start`` and ``length`` (tokens
    within the row), ``ids`` (little-endian unsigned 32-bit), ``cell_tokens``,
    ``window_id`` and ``offset`` (position in the window, without gaps).

    One narrow stage: a task packs the rows of its own partition, in their
    order, and prefixes its window ids with the partition's number. Nothing is
    shuffled, a task holds one group of windows, and a partition computed
    again on another executor gives the same pieces. Repeated rows and row ids
    are packed once per row; an empty sheet gives no pieces.
    """
    source = cells(sheet, row_id, column)
    kind = source.schema["row_id"].dataType.simpleString()
    key_type = pa.field("row_id", _arrow_type(source)).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_pair_encoder(tokenizer, pattern, added_tokens)
        number = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple] = []
        open_tokens = 0
        full = capacity * WAYS - FREE
        out: list[tuple] = []
        held = 0

        def balance() -> None:
            nonlocal open_pieces, open_tokens, number
            for group in windows([p[2] for p in open_pieces], capacity):
                at = 0
                for i in sorted(group):
                    out.append((*open_pieces[i], number, at))
                    at += open_pieces[i][2]
                number += 1
            open_pieces, open_tokens = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out))
            out.clear()
            held = 0
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["row_id", "start", "length", "ids", "cell_tokens", "window_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for given in batches:
            for key, cell in zip(given.column(0).to_pylist(), given.column(1)):
                ids = np.array([*encode(cell.as_py() or ""), end_id], dtype="<u4")
                total, at = len(ids), 0
                while total - at >= capacity:
                    out.append((key, at, capacity, ids[at:at + capacity].tobytes(), total, number, 0))
                    number += 1
                    at += capacity
                while at < total:
                    size = min(total - at, LONGEST_PIECE, full - open_tokens)
                    open_pieces.append((key, at, size, ids[at:at + size].tobytes(), total))
                    open_tokens += size
                    at += size
                    if open_tokens == full:
                        balance()
                held += total
                if held > 1 << 20 and out:
                    yield batch()
        if open_pieces:
            balance()
        if out:
            yield batch()

    return source.mapInArrow(pack, SCHEMA.format(kind))


def _arrow_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["row_id"].dataType)
