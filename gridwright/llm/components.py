"""Connected components of a table of links, without any node's links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import stored


def local_roots(links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node each node is connected to by these links alone."""
    root: dict[int, int] = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for x in sorted(root):  # a root is smaller, so it has its own already
        root[x] = root[root[x]]
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    root = local_roots(links)
    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (root.keys(), root.values())], ["node", "root"])


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for every other node of ``links`` (``a``, ``b``: bigint).

    Rounds of contraction: each partition connects its own links; a node met
    in several partitions links the roots it has there, and these links are
    the next, smaller round. A node has at most one row per partition, so hubs
    are no larger than others, and a round moves each node once per partition. When no roots are left to link, the
    rounds are followed back. Every round is written to the shared folder.
    """
    rounds = []
    while True:
        stars = links.mapInArrow(_stars, "node bigint, root bigint")
        nodes = stored(stars.groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")), "contraction")
        rounds.append(nodes.select("node", "least"))
        between = nodes.filter(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("least").alias("b")).filter("a <> b")
        links = stored(between.distinct(), "root-links")
        if links.isEmpty():
            break
    out = rounds.pop()
    while rounds:
        above = out.select(F.col("node").alias("least"), F.col("least").alias("top"))
        out = rounds.pop().join(above, "least", "left").select("node", F.coalesce("top", "least").alias("least"))
    return stored(out.filter("node <> least").select("node", F.col("least").alias("root")), "roots")
