"""Byte-pair token ids of cells by replaying merges over a corpus of words, and cells back from ids.

A block of different words is one corpus: an inverted index leads from each
pair of neighbouring tokens, by the token it makes, to the places where the
pair stands. Merges are replayed in rank order over the whole corpus; each
visits its places only and updates the index for the two new neighbours.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gc
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .frames import cells, named
from .packing import _arrow_type

#: Bytes of words whose merges are replayed together; a longer word is a block of its own.
BLOCK_BYTES = 1 << 15
#: Different words a worker remembers with their ids before it begins anew; the ones before are kept once more.
HELD_WORDS = 3 << 17
#: Token ids are smaller; this one marks the ends of words and is in no pair.
END = (1 << 20) - 1


@dataclass
class Vocabulary:
    """Ids of tokens, and by two neighbouring ids (first << 20 | second) the token they make."""

    ids: dict[bytes, int]
    made: dict[int, int]

    def __post_init__(self):
        size = max(self.ids.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i], self.lengths[i] = token, len(token)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([self.ids[bytes([b])] for b in range(256)])
        self.pairs = np.array(sorted(self.made), np.int64)
        self.makes = np.array([self.made[x] for x in self.pairs.tolist()], np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[at + np.arange(len(at))], ends


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of base64 tokens and their ranks."""
    with open(path, "rb") as file:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    made = {}
    for token, i in ids.items():
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                made[left << 20 | right] = i
    return Vocabulary(ids, made)


def inverted_index(words: list[bytes], known: Vocabulary) -> tuple[dict[int, list[int]], list[int], list[int], list[int]]:
    """The corpus of some words: places by the token that the pair there makes; tokens, ranks, and the words' first places."""
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes
    tokens = np.full(len(data) + len(words) + 1, END, np.int64)
    tokens[np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), sizes)] = known.single[data]
    pairs = tokens[:-1] << 20 | tokens[1:]
    at = np.minimum(np.searchsorted(known.pairs, pairs), max(0, len(known.pairs) - 1))
    made = np.where(known.pairs[at] == pairs, known.makes[at], -1) if len(known.pairs) else np.full(len(pairs), -1)
    there = np.flatnonzero(made >= 0)
    there = there[np.argsort(made[there], kind="stable")]
    ranks, first = np.unique(made[there], return_index=True)
    places, first = there.tolist(), [*first.tolist(), len(there)]
    index = {r: places[a:b] for r, a, b in zip(ranks.tolist(), first, first[1:])}
    return index, tokens.tolist(), [*made.tolist(), -1], starts.tolist()


def replay(words: list[bytes], known: Vocabulary) -> list[list[int]]:
    """Token ids of each word after all merges of the vocabulary.

    In every word the pair of lowest rank merges first, the leftmost of equal
    ones. ``rank[i]`` is the token that the pair at place ``i`` makes; an entry
    of the index counts only while it agrees with it. Should a merge make a
    pair of a still lower rank, the word's later places wait for that pair.
    """
    made = known.made.get
    index, tokens, rank, starts = inverted_index(words, known)
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = sorted(index)

    def enter(new: int, at: int) -> None:
        held = index.get(new)
        if held is None:
            index[new] = [at]
            heapq.heappush(heap, new)
        else:
            held.append(at)

    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        places.sort()
        waiting, wait_to = [], -1
        for i in places:
            if rank[i] != r:
                continue
            if i < wait_to:
                waiting.append(i)
                continue
            gone, left = after[i], before[i]
            right = after[gone]
            tokens[i] = r
            after[i] = right
            before[right] = i
            rank[gone] = -1
            rank[i] = ahead = made(r << 20 | tokens[right], -1)
            rank[left] = behind = made(tokens[left] << 20 | r, -1)
            if ahead >= 0:
                enter(ahead, i)
            if behind >= 0:
                enter(behind, left)
            if 0 <= ahead < r or 0 <= behind < r:
                k = bisect.bisect(starts, i)
                wait_to = starts[k] if k < len(starts) else n
        for i in waiting:
            enter(r, i)
    out = []
    for i in starts:
        own = []
        while (token := tokens[i]) != END:
            own.append(token)
            i = after[i]
        out.append(own)
    return out


@functools.lru_cache(maxsize=2)
def splitter(pattern: str):
    """A function from a text to the matches of a pattern, as the rank-file library finds them.

    ``regex`` and that library may know different versions of Unicode. Where
    the two tables at hand (``regex`` and ``unicodedata``) differ about letters
    and numbers, the library itself is asked, and what it takes for neither is
    left out of the classes.
    """
    points = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    first = [unicodedata.category(c)[0] for c in points]
    doubtful = []
    for name in ("L", "N"):
        has = set(regex.findall(rf"\p{{{name}}}", points))
        doubtful += [(name, c) for c, kind in zip(points, first) if (kind == name) != (c in has)]
    lead = {"L": "a", "N": "1"}
    whole = dict.fromkeys((lead[name] + c).encode() for name, c in doubtful)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(whole)}
    asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact = pattern
    for name in ("L", "N"):
        own = {c for kind, c in doubtful if kind == name and len(asked.encode_ordinary(lead[name] + c)) == 1}
        out = "".join(rf"\U{ord(c):08x}" for kind, c in doubtful if kind == name and c not in own)
        more = "".join(rf"\U{ord(c):08x}" for c in sorted(own))
        exact = exact.replace(rf"\p{{{name}}}", rf"[[\p{{{name}}}{more}]--[{out}]]" if out else rf"[\p{{{name}}}{more}]")
    plain, checked = regex.compile(pattern), regex.compile(exact, regex.V1)
    odd = regex.compile("[" + "".join(rf"\U{ord(c):08x}" for c in sorted({c for _, c in doubtful})) + "]") if doubtful else None
    above = regex.compile(rf"[\U{min(ord(c) for _, c in doubtful):08x}-\U0010ffff]") if doubtful else None

    def split(text: str) -> list[str]:
        return (checked if above and above.search(text) and odd.search(text) else plain).findall(text)

    return split


class Held:
    """Words with their ids (little-endian 32 bits, which join without a loop) that a worker has met.

    When there are too many, those asked for again since the last such moment stay.
    """

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, words: list[list[str]]) -> set[str]:
        """The words whose ids are yet to be found."""
        if len(self.now) > HELD_WORDS:
            self.now, self.before = {}, self.now
        asked = set().union(*words).difference(self.now)
        self.now.update((word, self.before[word]) for word in asked if word in self.before)
        return asked.difference(self.now)


@functools.lru_cache(maxsize=2)
def held_words(ranks: str, pattern: str) -> Held:
    """What all tasks of a worker have found so far."""
    return Held()


def encode_cells(sheet: DataFrame, ranks: str, pattern: str, row_id: str = "row_id", column: str = "value") -> DataFrame:
    """``row_id`` and ``token_ids`` of every row's whole cell.

    ``ranks`` is a vocabulary file of base64 tokens and their ranks, readable
    on every worker; ``pattern`` cuts a cell into words, each encoded on its
    own; special tokens are ordinary text. Ids are those that ``tiktoken``
    gives with the same file and pattern: a word that is a token is that
    token, all others follow the merges.

    Null and empty cells have no ids, repeated rows are encoded each time, and
    an empty sheet gives no rows. One narrow stage: a task replays the merges
    over the words its worker has not seen yet, block by block; a worker
    remembers a bounded number of them from task to task.
    """
    source = cells(sheet, row_id, column)
    kind, key_type = source.schema["row_id"].dataType.simpleString(), _arrow_type(source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split, held = vocabulary(ranks), splitter(pattern), held_words(ranks, pattern)

        def learn(words: list[list[str]]) -> None:
            missing, ids_of = held.missing(words), held.now
            block: list[tuple[str, bytes]] = []
            size = 0

            def finish() -> None:
                for (word, _), ids in zip(block, replay([text for _, text in block], known)):
                    ids_of[word] = struct.pack(f"<{len(ids)}i", *ids)
                block.clear()

            for word in missing:
                text = word.encode()
                whole = known.ids.get(text)
                if whole is not None:
                    ids_of[word] = struct.pack("<i", whole)
                    continue
                block.append((word, text))
                size += len(text)
                if size > BLOCK_BYTES:
                    finish()
                    size = 0
            finish()

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                words = [split(cell) if cell else [] for cell in part.column(1).to_pylist()]
                gc.disable()  # nothing here refers to itself, and each pass would visit all words
                learn(words)
                gc.enable()
                rows = [b"".join(map(held.now.__getitem__, own)) for own in words]
                offsets = np.cumsum([0, *map(len, rows)]) // 4
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(key_type), lists], ["row_id", "token_ids"])

    return source.mapInArrow(encode, f"row_id {kind}, token_ids array<int>")


def decode_cells(encoded: DataFrame, ranks: str, row_id: str = "row_id", token_ids: str = "token_ids", carry: bool = False) -> DataFrame:
    """``row_id`` and ``cell`` (UTF-8 bytes) from token ids; with ``carry`` the ids come along as ``token_ids``.

    Null ids and no ids are an empty cell; an id that the vocabulary does not have is an error.
    """
    source = encoded.select(named(row_id).alias("row_id"), named(token_ids).cast("array<int>").alias("token_ids"))
    kind, key_type = source.schema["row_id"].dataType.simpleString(), _arrow_type(source)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                given = part.column(1)
                data, ends = known.decode(given.flatten().to_numpy(zero_copy_only=False))
                ids_before = np.cumsum([0, *pc.fill_null(pc.list_value_length(given), 0).to_pylist()])
                offsets = np.concatenate(([0], ends))[ids_before]
                found = pa.Array.from_buffers(pa.large_binary(), len(given), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                columns = [part.column(0).cast(key_type), found.cast(pa.binary()), *([given] if carry else [])]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "cell", *(["token_ids"] if carry else [])])

    return source.mapInArrow(decode, f"row_id {kind}, cell binary" + (", token_ids array<int>" if carry else ""))
