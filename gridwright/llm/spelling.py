"""Spelling variants of the words in a column's cells: near words by pivotal bigrams, and the form each stands for.

Two words are near if one inserted, deleted or replaced character turns one
into the other. With bigrams ordered from rare to frequent, the first three of
a word are its prefix; two of them that do not overlap are its pivots. One
edit leaves a pivot of at least one of two near words whole, and it stands in
the other word's prefix (*pivotal prefix filter*): pivots are looked up among
prefixes. As the edit lies on one side of the pivot, the other side is the same
text, and of the edited side one half is; place, length and the halves that
must be equal are part of the looked-up key, so a rare pair of words meets.
Every pair that meets is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .frames import cells, named, stored

#: Maximal runs of these letters are words; in UTF-8 the last 64 of them are the byte C3 and one more.
LETTERS = rb"(?:[a-z]|\xC3[\x80-\xBF])+"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Different words a task counts before it hands them on. Bounds its memory.
HELD_WORDS = 1 << 18
#: Bigrams are ordered by how often their bucket occurs, then by themselves.
BUCKETS = 1 << 16
#: Bigrams in a prefix, and of these how many pivots, for one edit.
PREFIX, PIVOTS = 3, 2


def column_words(sheet: DataFrame, row_id: str = "row_id", column: str = "value", slip: int | None = None) -> DataFrame:
    """``word`` and ``n``: how often each word stands in the cells of a text column.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are
    folded. With ``slip`` typing slips are simulated: where ``slip`` divides
    the crc32 of ``<row id>:<word>``, the word lacks the character at that
    crc32 modulo its length (a word of one letter becomes empty). Null and empty cells have no words; a null row id
    counts as empty text; repeated rows count each time. Counts are summed in
    every task first, a bounded number of words at a time.
    """
    source = cells(sheet, row_id, column).select(F.coalesce(F.col("row_id").cast("string"), F.lit("")).alias("row_id"), "cell")
    find = re.compile(LETTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            columns = [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for given in batches:
            for key, cell in zip(given.column(0), given.column(1)):
                found = find.findall((cell.as_py() or "").encode().translate(FOLD))
                held.update(found)
                if slip and found:
                    seed = zlib.crc32(f"{key.as_py()}:".encode())
                    for word in found:
                        h = zlib.crc32(word, seed)
                        if h % slip == 0:
                            text = word.decode()
                            at = h % len(text)
                            held[word] -= 1
                            held[(text[:at] + text[at + 1:]).encode()] += 1
                if len(held) > HELD_WORDS:
                    yield batch()
        if held:
            yield batch()

    counted = source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter("n > 0")


def _bucket(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B >> 13) & (BUCKETS - 1)


def bigram_order(words: DataFrame) -> np.ndarray:
    """Rank of every bucket of bigrams by its occurrences in different words, from rare to frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for pair in zip(word, word[1:]):
                    seen[_bucket(*pair)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "n"])

    seen = words.select("word").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(BUCKETS)
    return rank


def prefix(word: str, rank) -> list[tuple[int, int]]:
    """(order, position) of the rarest bigrams of a word, with all positions of the last of them."""
    grams = sorted((int(rank[_bucket(a, b)]) << 42 | ord(a) << 21 | ord(b), i) for i, (a, b) in enumerate(zip(word, word[1:])))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]], number: int = PIVOTS) -> list[int]:
    """Positions of ``number`` bigrams of a prefix that do not overlap, with the smallest sum of orders.

    Dynamic programming along the positions: ``best[k]`` is the cheapest choice
    of ``k`` bigrams among those passed, ``before`` the choices that ended
    early enough for the next bigram not to overlap.
    """
    by_place = sorted((i, order) for order, i in grams)
    best: list = [(0, [])] + [None] * number
    ended: list[tuple[int, list]] = []
    before = list(best)
    for i, order in by_place:
        while ended and ended[0][0] <= i - 2:
            before = ended.pop(0)[1]
        for k in range(number, 0, -1):
            if before[k - 1] is not None:
                choice = (before[k - 1][0] + order, before[k - 1][1] + [i])
                best[k] = choice if best[k] is None else min(best[k], choice)
        ended.append((i, list(best)))
    return best[number][1]


def _keys(word: str, places, lengths, own: bool) -> set[tuple]:
    """Looked-up keys of bigrams at ``places``: what a near word of a length in ``lengths`` has in common with this one.

    A key holds the pivot's place, counted from the end that is the same in
    both, the length of the word whose pivot it is, and the text around the
    edit: all of the unedited side with the pivot, and one half of the edited
    side. ``own`` says that the pivots are this word's.
    """
    n, keys = len(word), set()
    for p in places:
        for length in lengths:
            rest = length - p - 2  # edited side after the pivot
            if rest >= 0:
                m = rest // 2
                keys.add(("a", length, p, word[:p + 2 + m], ""))
                keys.add(("b", length, p, word[:p + 2], word[p + 2 + m:] if own else word[max(p + 2, n - rest + m):]))
            ahead = p + length - n  # edited side before the pivot
            if ahead >= 0:
                m = ahead // 2
                keys.add(("c", length, n - p, word[:min(m, p)], word[p:]))
                keys.add(("d", length, n - p, word[m if own else max(0, p - ahead + m):], ""))
    return keys


POSTING = "key bigint, {0} string, {0}_n bigint, {0}_last bigint"


def _postings(words: DataFrame, rank: np.ndarray, name: str, own: bool) -> DataFrame:
    """Keys of every word: of its pivots (``own``), or of its prefix for pivots of words one longer, one shorter or as long."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                hashes, at, lasts = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    grams = prefix(word, rank)
                    n = len(word)
                    if own:
                        keys = _keys(word, pivots(grams), (n,), True)
                    else:
                        keys = _keys(word, [p for _, p in grams], (n - 1, n, n + 1), False)
                    for kind, length, place, one, two in keys:
                        hashes.append(xxhash.xxh64_intdigest(f"{kind}{length}:{place}:{one}\0{two}"))
                        at.append(i)
                    lasts.append(grams[-1][0])
                index = pa.array(at, pa.int32())
                keys = pa.array(np.array(hashes, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [keys, part.column(0).take(index), part.column(1).take(index), pa.array(lasts, pa.int64()).take(index)], ["key", name, f"{name}_n", f"{name}_last"])

    return words.select("word", "n").mapInArrow(post, POSTING.format(name))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``n`` and ``near_n`` for both orders of all pairs of near words among the different words of a stored table."""
    rank = bigram_order(words)
    a, b = _postings(words, rank, "a", True), _postings(words, rank, "b", False)
    met = (F.col("a") != F.col("b")) & (F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", 1) == 1)
    # Spark takes the postings for as large as the words' file, though a word has dozens; it must not broadcast them.
    pairs = a.hint("merge").join(b.hint("merge"), "key").filter(met)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(both)).distinct()


def spelling_variants(words: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """Group the spellings in a table of words (``word``, ``n``), such as :func:`column_words` gives.

    Only words of at least ``least_length`` characters that occur at least
    ``least_count`` times count. Returns per such word ``word``, ``n``,
    ``n_near`` (number of near words), ``form`` and ``form_n`` (its near word
    that occurs most, the smallest in code point order among equals, if that
    is at least ``ratio`` times as often; else null) and ``root`` (the last
    word reached by following forms; the word itself without one).

    Rows of the same word are added up; null words are left out; an empty
    table gives no rows. Words need four characters to have two pivots.
    Postings grow with the words and not with their pairs; a key shared by many words is
    split by the skew join. Forms at least multiply the count, so the longest
    chain, and with it the number of doubling rounds, follows from the
    largest count.
    """
    if least_length < 4 or ratio < 2:
        raise ValueError("words need at least four characters, and ratio must be at least 2")
    counted = words.select(named("word").cast("string").alias("word"), named("n").cast("bigint").alias("n"))
    counted = counted.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    counted = stored(counted, "words")
    near = near_words(counted)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    known = counted.join(best, "word", "left").withColumn("enough", -F.col("best.minus") >= ratio * F.col("n"))
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("enough"), F.col("best.near")).alias("form"),
        F.when(F.col("enough"), -F.col("best.minus")).alias("form_n"))
    known = stored(known, "forms")
    most = known.agg(F.max("form_n")).first()[0] or 1
    longest = max(1, math.floor(math.log(max(1, most / max(1, least_count)), ratio) + 1e-9))
    up = known.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = stored(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root")), "roots")
    return known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
