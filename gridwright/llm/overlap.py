"""Near-duplicate cells: exact Jaccard join of word n-gram sets, candidates from R-trees over count vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected
from .frames import bounded, cells, stored
from .hashing import FOLDED_VALUES, NOT_SPACE, Spans, chunks, mix, rolled, word_bounds
from .packing import _arrow_type

#: Groups that tokens are hashed into, the dimensions of a count vector, for sets of
#: up to so many tokens. Unrelated sets have vectors apart only while counts are low.
GROUPS = ((700, 64), (2800, 256), (11200, 1024), (None, 4096))
#: Points under one leaf of a tree, and children under one node.
FANOUT = 16
#: Points of a block in one task; larger blocks are joined as pairs of parts.
BLOCK_POINTS = 2048
#: Tokens of a cluster in one part when it is verified.
PART_TOKENS = 1 << 20
#: A count that is stored as this says "at least".
MOST = np.iinfo(np.uint8).max


def token_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct hashes of its ``size``-word n-grams, for rows with words.

    Words are runs of what is no ASCII white space, A-Z lower-cased; a row of
    fewer words has its whole sequence as the one n-gram.
    """
    for chunk in chunks(column):
        starts, ends, before = word_bounds(chunk, NOT_SPACE)
        words = mix(Spans(chunk.data, FOLDED_VALUES).hash(starts, ends))
        grams = rolled(words, size)
        for i in range(chunk.last - chunk.first):
            lo, hi = before[i], before[i + 1]
            if hi - lo >= size:
                yield chunk.first + i, np.unique(grams[lo:hi - size + 1])
            elif hi > lo:
                yield chunk.first + i, rolled(words[lo:hi], int(hi - lo))


def least_overlap(a, b, similarity: int):
    """Smallest intersection of sets of sizes a and b whose Jaccard reaches ``similarity`` percent."""
    return -(-similarity * (a + b) // (100 + similarity))


def prefix_length(n: int, similarity: int) -> int:
    """Of two sets that are similar enough, the first so many tokens in hash order share one."""
    return n - -(-similarity * n // 100) + 1


def size_class(n: int) -> int:
    return next(k for k, (most, _) in enumerate(GROUPS) if most is None or n <= most)


def count_vector(tokens: np.ndarray) -> np.ndarray:
    groups = GROUPS[size_class(len(tokens))][1]
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(counts, MOST).astype(np.uint8)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A count vector with its groups joined to fewer."""
    return np.minimum(point.reshape(-1, groups).sum(axis=0), MOST).astype(np.uint8)


def overlap_bound(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Summed coordinate minima: no smaller than the overlap of the sets."""
    least = np.minimum(points, point)
    bound = least.sum(axis=1, dtype=np.int64)
    if least.max(initial=0) == MOST:
        bound[(least == MOST).any(axis=1)] = np.iinfo(np.int64).max
    return bound


class CountTree:
    """A packed R-tree over count vectors in order of set size; nodes keep the upper corner and the sizes below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        top, low, high = points, sizes, sizes
        while len(top) > FANOUT:
            cuts = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound and size allow the similarity, and their bounds."""
        at = None
        for top, low, high in reversed(self.levels):
            at = np.arange(len(top)) if at is None else self._below(at, len(top))
            at = at[(100 * high[at] >= similarity * size) & (100 * size >= similarity * low[at])]
            at = at[overlap_bound(top[at], point) >= least_overlap(size, low[at], similarity)]
        at = np.arange(len(self.points)) if at is None else self._below(at, len(self.points))
        at = at[(100 * self.sizes[at] >= similarity * size) & (100 * size >= similarity * self.sizes[at])]
        bounds = overlap_bound(self.points[at], point)
        fits = bounds >= least_overlap(size, self.sizes[at], similarity)
        return at[fits], bounds[fits]

    @staticmethod
    def _below(at: np.ndarray, n: int) -> np.ndarray:
        children = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return children[children < n]


def spanning(points: list[np.ndarray], sizes: np.ndarray, part: np.ndarray | None, similarity: int, linked=None) -> list[tuple[int, int]]:
    """Links that connect all points the trees find near each other (and ``linked`` confirms).

    There is a tree for every size class. A point is compared with smaller
    ones of its class, and of the class below in that class's groups. Points
    already connected are not compared again. With ``part``, only pairs of
    different parts count.
    """
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    part = None if part is None else part[order]
    classes = np.array([size_class(n) for n in sizes.tolist()])
    first = np.searchsorted(classes, np.arange(len(GROUPS) + 1))
    trees = [CountTree(np.stack([points[i] for i in order[a:b]]), sizes[a:b]) if b > a else None for a, b in zip(first, first[1:])]
    root, links = np.arange(len(order)), []
    for x in range(len(order)):
        own, size, found = classes[x], int(sizes[x]), []
        for k in (own, own - 1):
            most = GROUPS[k][0] if k >= 0 else 0
            if k < 0 or trees[k] is None or (k < own and similarity * size > 100 * most):
                continue
            point = points[order[x]]
            at, bounds = trees[k].near(point if k == own else folded(point, GROUPS[k][1]), size, similarity)
            found.append((at + first[k], bounds))
        at, bounds = (np.concatenate(c) for c in zip(*found))
        keep = at < x if part is None else (at < x) & (part[at] != part[x])
        at, bounds = at[keep], bounds[keep]
        at = at[np.argsort(-bounds, kind="stable")]
        while len(at := at[root[at] != root[x]]):
            y = at[0]
            if linked is None or linked(int(order[x]), int(order[y])):
                links.append((int(order[x]), int(order[y])))
                root[root == root[x]] = root[y]
            at = at[1:]
    return links


def _signatures(source: DataFrame, size: int, similarity: int) -> DataFrame:
    """Per row with words: set id, set size, prefix tokens and count vector; other rows have a null set id."""
    kind, key_type = source.schema["row_id"].dataType.simpleString(), _arrow_type(source)
    schema = f"row_id {kind}, cell_key bigint, node bigint, n bigint, prefix array<bigint>, counts binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            node, n, prefix, counts = [None] * rows, [0] * rows, [None] * rows, [None] * rows
            for i, tokens in token_sets(batch.column(1), size):
                every = mix(np.bitwise_xor.reduce(mix(tokens), keepdims=True) ^ np.add.reduce(mix(~tokens), keepdims=True) + np.uint64(len(tokens)))
                node[i], n[i] = int(every.view(np.int64)[0]), len(tokens)
                prefix[i] = tokens[:prefix_length(len(tokens), similarity)].view(np.int64)
                counts[i] = count_vector(tokens).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(key_type), batch.column(2), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                ["row_id", "cell_key", "node", "n", "prefix", "counts"])

    return source.select("row_id", "cell", F.xxhash64("cell").alias("cell_key")).mapInArrow(sign, schema)


def _parts(df: DataFrame, parts: str) -> DataFrame:
    """Rows with ``part`` and ``tile``: every pair of parts meets in a tile; with one part, all rows in tile 0."""
    # Tile (i, j), i <= j, is numbered i * parts + j; a row of part k is in the tiles of k and every other part.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col(parts))
    df = df.withColumn("part", part).withColumn("other", other)
    return df.withColumn("tile", F.least("part", "other") * F.col(parts) + F.greatest("part", "other")).drop("other")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` (bigint) columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(values[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


LINK_NAMES = ["a", "b"]


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], LINK_NAMES)


def _vectors(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _candidates(members: DataFrame, similarity: int) -> DataFrame:
    """Links between sets of one block whose count vectors allow the similarity; enough to connect all such sets."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, 2):
            nodes, sizes = group["node"].to_numpy(), group["n"].to_numpy()
            part = group["part"].to_numpy() if group["tile_pair"][0].as_py() else None
            found = spanning(_vectors(group["counts"]), sizes, part, similarity)
            out += [(int(nodes[i]), int(nodes[j])) for i, j in found]
            if len(out) > 50_000:
                yield _links_batch(out)
                out = []
        yield _links_batch(out)

    tiled = _parts(members, "parts").withColumn("tile_pair", F.col("tile") % (F.col("parts") + 1) != 0)
    tiled = tiled.select("token", "tile", "part", "tile_pair", "node", "n", "counts")
    return tiled.repartition("token", "tile").sortWithinPartitions("token", "tile").mapInArrow(join, "a bigint, b bigint").distinct()


def _verified(texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """True links within clusters; enough to connect what they connect."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, 2):
            nodes = group["node"].to_numpy()
            _, once = np.unique(nodes, return_index=True)
            group, nodes = group.take(once), nodes[once]
            tokens = dict(token_sets(group["cell"].combine_chunks(), size))
            sets = [tokens[i] for i in range(len(nodes))]
            sizes = np.array([len(s) for s in sets])
            vectors = [count_vector(s) for s in sets]
            part = group["part"].to_numpy() if group["tile_pair"][0].as_py() else None

            def linked(i: int, j: int) -> bool:
                a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                return 100 * both >= similarity * (len(a) + len(b) - both)

            found = spanning(vectors, sizes, part, similarity, linked)
            out += [(int(nodes[i]), int(nodes[j])) for i, j in found]
            if len(out) > 50_000:
                yield _links_batch(out)
                out = []
        yield _links_batch(out)

    tiled = _parts(texts, "parts").withColumn("tile_pair", F.col("tile") % (F.col("parts") + 1) != 0)
    tiled = tiled.select("root", "tile", "part", "tile_pair", "node", "cell")
    return tiled.repartition("root", "tile").sortWithinPartitions("root", "tile").mapInArrow(verify, "a bigint, b bigint").distinct()


def similar_rows(sheet: DataFrame, row_id: str = "row_id", column: str = "value", size: int = 5, similarity: int = 80) -> DataFrame:
    """Groups of rows whose cells have similar sets of word n-grams.

    A cell's set are its distinct runs of ``size`` words (white-space separated,
    A-Z lower-cased); with fewer words the whole sequence is its one member,
    without words it is empty and similar to nothing, as for null. Two rows are
    linked when the Jaccard similarity of their sets is at least
    ``similarity`` percent. Returns per row ``row_id``, ``cell_key`` (hash of the
    cell), ``n_ngrams``, ``component_id``, the smallest row id reachable over
    links, its own included, and ``is_first`` for one row of every component,
    one with that id. Rows without words are components of their own. Repeated
    rows with words are one component; a null id is smaller than any other.

    How: rows with equal sets become one set. A set is posted under its prefix
    tokens, those first in hash order that two similar sets must share. In each
    block of sets with a common token R-trees over count vectors (tokens
    hashed into groups, more for larger sets, and counted) find the sets whose summed
    coordinate minima allow the similarity, also for whole subtrees. What it
    connects is a cluster, inside which surviving pairs are verified on the
    full sets. Blocks with the same members are joined once; sets already
    connected are not compared again, so a group of near copies costs about
    one comparison a member and no pair list.

    Tokens and sets are told apart by 64-bit hashes. Blocks over
    ``BLOCK_POINTS`` sets and clusters over ``PART_TOKENS`` tokens are joined
    as pairs of parts in several tasks. Nothing is cut off, and no fingerprints, links or
    components reach the driver.
    """
    source = cells(sheet, row_id, column)
    signed = stored(_signatures(source, size, similarity).withColumn("at", F.monotonically_increasing_id()), "signatures")
    sets = signed.filter("node is not null")
    owners = stored(sets.groupBy("node").agg(F.min("at").alias("at"), F.min(F.struct("row_id", "at")).alias("first"), F.count(F.lit(1)).alias("copies")), "sets")
    later = sets.join(owners.filter("copies > 1").select("node", F.col("at").alias("kept")), "node").filter("at <> kept").select("at")
    own = sets.join(bounded(stored(later, "later-copies"), 16), "at", "left_anti")

    posted = own.select("node", F.explode("prefix").alias("token"))
    tokens = posted.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    blocks = tokens.filter("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token"))
    blocks = stored(blocks.select("token", F.ceil(F.col("m") / F.lit(BLOCK_POINTS)).cast("bigint").alias("parts")), "blocks")
    members = own.select("node", "n", "counts", F.explode("prefix").alias("token")).join(bounded(blocks, 24), "token")
    clusters = connected(_candidates(members, similarity))
    clusters = stored(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()), "clusters")

    sized = clusters.join(own.select("node", "n", "row_id", "cell_key"), "node")
    parts = sized.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(PART_TOKENS)).cast("bigint").alias("parts"))
    wanted = stored(sized.join(parts, "root").select("node", "root", "parts", F.col("row_id").alias("own_id"), F.col("cell_key").alias("own_key")), "wanted")
    keyed = source.withColumn("cell_key", F.xxhash64("cell"))
    wanted = bounded(wanted, 64)
    texts = keyed.join(wanted, keyed.row_id.eqNullSafe(wanted.own_id) & (keyed.cell_key == wanted.own_key)).select("root", "node", "parts", "cell")
    roots = connected(_verified(texts, size, similarity))
    roots = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")

    firsts = owners.select("node", "first")
    named_roots = roots.join(firsts, "node").groupBy("root").agg(F.min("first").alias("group"))
    groups = firsts.join(roots.join(named_roots, "root").select("node", "group"), "node", "left")
    groups = bounded(stored(groups.select("node", F.coalesce("group", "first").alias("group")), "groups"), 40)
    out = signed.join(groups, "node", "left")
    return out.select(
        "row_id", "cell_key", F.col("n").alias("n_ngrams"), F.coalesce("group.row_id", "row_id").alias("component_id"),
        F.coalesce(F.col("group.at") == F.col("at"), F.lit(True)).alias("is_first"))


def first_of_similar(sheet: DataFrame, row_id: str = "row_id", column: str = "value", size: int = 5, similarity: int = 80) -> DataFrame:
    """The sheet with one row of every group of similar rows: the one with the smallest row id.

    Rows without words are similar to none and all stay. Of rows equal in id
    and cell one stays; other columns of theirs that differ go with the others.
    """
    rows = stored(similar_rows(sheet, row_id, column, size, similarity), "similar-rows").groupBy("row_id", "cell_key").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("is_first").alias("stay"))
    changed = bounded(stored(rows.filter("copies <> stay").withColumnRenamed("row_id", "other_id").withColumnRenamed("cell_key", "other_key"), "similar-later"), 64)
    source = cells(sheet, row_id, column, carry=True).select("row_id", F.xxhash64("cell").alias("cell_key"), "row")
    joined = source.join(changed, source.row_id.eqNullSafe(changed.other_id) & (source.cell_key == changed.other_key), "left")
    alone = joined.filter("stay is null").select("row.*")
    # Equal rows of which one is the group's first: few, and combined before they move.
    repeated = joined.filter("stay > 0").groupBy("row_id", "cell_key").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(repeated)
