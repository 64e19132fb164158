"""Merkle manifest of a sheet: one digest for all its rows, proofs for each, and the version that editing a row makes.

The tree has eight children a node. Aligned blocks of 8^4 nodes are folded
four levels at a time, each block in one task; the blocks' digests are the
nodes of the next round. An edited row makes a version of its block that
copies the ancestors of its leaf only and shares all other nodes; the version
goes on through the rounds above with the siblings that all versions of the
block share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import with_row_number
from .frames import bounded, named, stored
from .packing import _arrow_type

#: Children of a node, and levels that are folded in one block.
WIDTH, LEVELS = 8, 4
BLOCK = WIDTH ** LEVELS

Path = list[tuple[int, list[str]]]


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Tree:
    """The nodes of one block by level; never changed once built."""

    def __init__(self, leaves: list[str], levels: int | None = None):
        """``levels`` says how many to fold; without it, until one node is left."""
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if levels is None else len(self.levels) <= levels:
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + WIDTH]) for i in range(0, len(below), WIDTH)])

    def node(self, level: int, i: int) -> str:
        return self.levels[level][i]

    def run(self, level: int, i: int) -> range:
        """Indexes of a node and its siblings."""
        start = i - i % WIDTH
        return range(start, min(start + WIDTH, len(self.levels[level])))

    def path(self, i: int) -> Path:
        """For each level above a leaf: the place among the siblings, and the siblings."""
        out = []
        for level in range(len(self.levels) - 1):
            out.append((i % WIDTH, [self.node(level, k) for k in self.run(level, i) if k != i]))
            i //= WIDTH
        return out

    def edited(self, i: int, leaf: str) -> "Version":
        return Version(self, i, leaf)

    @property
    def root(self) -> str:
        return self.levels[-1][0]


class Version(Tree):
    """A tree with one other leaf: the copied ancestors are its own, all other nodes are those of the tree it was made from."""

    def __init__(self, base: Tree, i: int, leaf: str):
        self.base, self.levels = base, base.levels
        self.copied = {(0, i): leaf}
        for level in range(len(base.levels) - 1):
            self.copied[level + 1, i // WIDTH] = digest([self.node(level, k) for k in self.run(level, i)])
            i //= WIDTH

    def node(self, level: int, i: int) -> str:
        own = self.copied.get((level, i))
        return self.base.node(level, i) if own is None else own

    @property
    def root(self) -> str:
        return self.node(len(self.levels) - 1, 0)


def folded(node: str, path: Path) -> str:
    """The digest at the top of a path that starts at ``node``."""
    for at, siblings in path:
        node = digest([*siblings[:at], node, *siblings[at:]])
    return node


def row_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of cells as text, each led by its byte count and a colon; a null is a hyphen."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


NODE = "part string, place bigint, digest string, n bigint"
PATH = "part string, place bigint, ats array<int>, counts array<int>, siblings array<string>, subroot string, root string"
_PATH = pa.schema([("part", pa.string()), ("place", pa.int64()), ("ats", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
                   ("siblings", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])


def _block_tree(nodes: pa.Table) -> tuple[Tree, pa.Table]:
    """The tree of one block's rows, and the rows in the order of its leaves."""
    nodes = nodes.sort_by("place")
    return Tree(nodes.column("digest").to_pylist(), LEVELS if nodes.column("n")[0].as_py() > BLOCK else None), nodes


def _block() -> Column:
    return F.floor(F.col("place") / BLOCK).cast("bigint").alias("block")


def _fold_block(nodes: pa.Table) -> pa.Table:
    tree, nodes = _block_tree(nodes)
    n = -(-nodes.column("n")[0].as_py() // BLOCK)
    columns = [nodes.column("part")[:1], pa.array([nodes.column("place")[0].as_py() // BLOCK], pa.int64()), pa.array([tree.root]), pa.array([n], pa.int64())]
    return pa.table(dict(zip(("part", "place", "digest", "n"), columns)))


def _ascend(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes and, round by round, the blocks above them until every part is one node; ``most`` is the largest part's size."""
    rounds = [nodes]
    while len(rounds) == 1 or most > 1:
        most = -(-most // BLOCK)
        rounds.append(stored(rounds[-1].select("part", "place", "digest", "n").groupBy("part", _block()).applyInArrow(_fold_block, NODE), "manifest-nodes"))
    return rounds


def _path_of(row: dict) -> Path:
    out, start = [], 0
    for at, count in zip(row["ats"], row["counts"]):
        out.append((at, row["siblings"][start:start + count]))
        start += count
    return out


def _continue_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of a block's nodes: their own within the block, then their block's."""
    tree, nodes = _block_tree(nodes)
    parent = above.to_pylist()[0]
    rows = []
    for i, (part, place) in enumerate(zip(nodes.column("part").to_pylist(), nodes.column("place").to_pylist())):
        path = tree.path(i) + _path_of(parent)
        rows.append({"part": part, "place": place, "ats": [a for a, _ in path], "counts": [len(s) for _, s in path],
                     "siblings": [x for _, s in path for x in s], "subroot": parent["subroot"], "root": parent["root"]})
    return pa.Table.from_pylist(rows, _PATH)


def _together(nodes: DataFrame, paths: DataFrame):
    return nodes.groupBy("part", _block()).cogroup(paths.groupBy("part", F.col("place").alias("block")))


def _descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the first round's nodes from those of the last."""
    for nodes in reversed(rounds[:-1]):
        paths = stored(_together(nodes, paths).applyInArrow(_continue_paths, PATH), "manifest-paths")
    return paths


def sheet_manifest(
    sheet: DataFrame, columns: Sequence[str], row_id: str = "row_id", group: str = "category",
    edits: Mapping[str, Column] | None = None, edited: Column | None = None,
) -> DataFrame:
    """Digest every row of a sheet, every group of rows and the whole sheet, and check the version each edited row makes.

    A leaf is the SHA-256 of a row's ``columns``. In each ``group`` leaves
    ascend by ``row_id``; while several nodes remain, every eight neighbours
    become their digest. What remains is the group's ``subroot``; subroots in
    the order of the groups give ``root`` alike. ``edits`` are cells by column
    as they would be after an edit, for rows where ``edited`` is true.

    Returns per row ``row_id``, ``leaf``, ``subroot``, ``root``, ``siblings``
    (digests beside the path to the root, level by level, left to right),
    ``version_root`` (of the version of the manifest in which only this row
    has its edited cells; without an edit the root, folded anew) and
    ``verified`` (whether that is ``root``).

    Null groups form the first group, null row ids come first in theirs; rows
    of equal id stand in the order of their digests, so copies have equal
    leaves and each its own proof. An empty sheet gives no rows. Texts are
    digested before anything is shuffled; then a row is some 200 bytes. A task
    holds one block of at most 4,096 nodes, whatever the size of a group.
    """
    edits = dict(edits or {})
    unknown = set(edits) - set(columns)
    if unknown:
        raise ValueError(f"edited columns must be among the digested ones: {sorted(unknown)}")
    cell = [named(c) for c in columns]
    after = row_digest([edits.get(c, named(c)) for c in columns])
    changed = F.coalesce(edited, F.lit(False)) if edited is not None and edits else F.lit(False)
    leaves = sheet.select(
        F.coalesce(F.concat(F.lit("+"), named(group).cast("string")), F.lit("")).alias("part"), named(row_id).alias("row_id"),
        row_digest(cell).alias("digest"), F.when(changed, after).alias("edited"))
    kind, key_type = leaves.schema["row_id"].dataType.simpleString(), _arrow_type(leaves)
    numbered = with_row_number(leaves, [F.col("part").asc(), F.col("row_id").asc_nulls_first(), F.col("digest").asc(), F.col("edited").asc_nulls_first()], name="number")
    parts = stored(numbered.groupBy("part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "manifest-parts")
    most = parts.agg(F.max("n")).first()[0] or 0
    placed = numbered.join(bounded(parts, F.octet_length("part") + 32), "part")
    nodes = placed.select("part", (F.col("number") - F.col("first")).alias("place"), "digest", "n", "row_id", "edited")
    nodes = stored(nodes, "manifest-leaves")
    rounds = _ascend(nodes, most)
    tops = with_row_number(rounds[-1].select(F.col("part").alias("own"), "digest"), ["own"], name="place")
    count = tops.count()
    tops = tops.withColumn("part", F.lit("")).withColumn("n", F.lit(count).cast("bigint"))
    tops = stored(tops, "manifest-parts")
    above = _ascend(tops, count)
    start = above[-1].select(
        "part", "place", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("ats", "int"), ("counts", "int"), ("siblings", "string"))],
        F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    start = _descend(above, start).drop("part", "subroot").join(tops.select("place", "own", F.col("digest").alias("subroot")), "place")
    empty = start.select(F.col("own").alias("part"), F.lit(0).cast("bigint").alias("place"), "ats", "counts", "siblings", "subroot", "root")
    paths = _descend(rounds[1:], empty)

    def prove(block: pa.Table, block_path: pa.Table) -> pa.Table:
        tree, block = _block_tree(block)
        parent = block_path.to_pylist()[0]
        shared = _path_of(parent)
        higher = [x for _, s in shared for x in s]
        out: dict[str, list] = {"siblings": [], "version_root": []}
        for i, leaf in enumerate(block.column("edited").to_pylist()):
            out["siblings"].append([x for _, s in tree.path(i) for x in s] + higher)
            version = tree.edited(i, tree.node(0, i) if leaf is None else leaf)
            out["version_root"].append(folded(version.root, shared))
        n = block.num_rows
        return pa.table({
            "row_id": block.column("row_id").cast(key_type), "leaf": block.column("digest"), "subroot": pa.array([parent["subroot"]] * n, pa.string()),
            "root": pa.array([parent["root"]] * n, pa.string()), "siblings": pa.array(out["siblings"], pa.list_(pa.string())),
            "version_root": pa.array(out["version_root"], pa.string()), "verified": pa.array([x == parent["root"] for x in out["version_root"]], pa.bool_())})

    schema = f"row_id {kind}, leaf string, subroot string, root string, siblings array<string>, version_root string, verified boolean"
    return _together(nodes, paths).applyInArrow(prove, schema)
