"""Passages of a lookup sheet inside the cells of a main sheet: a prefix-filtered containment join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .frames import BROADCAST_BYTES, bounded, cells, stored

#: Everything that is no word, of ASCII; other code points are word characters. Single
#: characters, not ranges: Java then tests a bit map, in half the time.
SEPARATORS = "[" + "".join(f"\\x{p:02X}" for p in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))) + "]+"
#: Words in a shingle.
SHINGLE = 3


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that to pure ASCII, at less cost."""
    spelled = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(spelled)


def words_of(c: Column) -> Column:
    """Words of a cell; none for null."""
    text = lower_ascii(F.coalesce(c, F.lit("")))
    return F.array_remove(F.split(text, SEPARATORS), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at`` (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def _positions(sheet: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per word position and shingle size, with the shingle's hash.

    ``words`` stays a reference to the row's array while positions stream
    through the broadcast join; only matches become rows of their own. The
    outer form keeps Spark from inferring a filter that would split the text
    a second time; a row without words gives one position that fits nowhere.
    """
    at = sheet.select("row_id", "cell_key", "words", F.posexplode_outer("words").alias("at", "word"))
    if len(sizes) == 1:
        return at.withColumn("token", _shingle(F.col("words"), F.col("at"), sizes[0]))
    every = F.array(*[_shingle(F.col("words"), F.col("at"), n) for n in sizes])
    return at.withColumn("token", F.explode(every))


def lookup_windows(lookup: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the lookup cells: ``pattern`` (words), ``lookup_ids``, ``tokens`` (shingle, offset)."""
    words = lookup.select("row_id", words_of(F.col("cell")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = words.select("row_id", "words", F.explode(starts).alias("start"))
    pattern = F.slice("words", F.col("start") + 1, window)
    return windows.select("row_id", pattern.alias("pattern")).groupBy("pattern").agg(F.collect_set("row_id").alias("lookup_ids"))


def _with_shingles(windows: DataFrame) -> DataFrame:
    size = F.least(F.size("pattern"), F.lit(SHINGLE))
    offsets = F.sequence(F.lit(0), F.size("pattern") - size)
    hashes = [F.when(size == n, _shingle(F.col("pattern"), F.col("offset"), n)) for n in range(1, SHINGLE + 1)]
    return windows.withColumn("size", size).withColumn("offset", F.explode(offsets)).withColumn("token", F.coalesce(*hashes))


def lookup_passages(
    sheet: DataFrame, lookup: DataFrame, row_id: str = "row_id", column: str = "value",
    lookup_id: str = "row_id", lookup_column: str = "value", window: int = 10, carry: bool = False,
) -> DataFrame:
    """Which words of every row's cell belong to a passage of the lookup sheet.

    A passage is ``window`` consecutive words of a lookup cell; a cell with
    fewer words, but not none, is one passage as a whole. ``A-Z`` are
    lower-cased and words are runs of digits, letters and non-ASCII characters.

    Returns one row per row of ``sheet``: ``row_id``, ``n_words``, ``n_hit``
    (words inside an occurrence of a passage), ``hit_spans`` (first word and
    end of every maximal run) and ``lookup_ids`` (sorted ids, as text, of the lookup rows
    with an occurring passage). Null and empty cells have no words; repeated
    rows each get their result; an empty lookup sheet hits nothing. Null
    lookup ids are left out of ``lookup_ids``, their passages still hit.

    The join is a prefix-filtered set join for full containment. Every passage
    is the set of its word shingles. They are ordered by how often the main
    sheet has them, so the necessary prefix is the rarest one alone. A word
    position of the sheet with that shingle gives a candidate, which must fit
    between the first and the last word of the row (length and position) and
    is verified word by word.

    The sheet is never shuffled for the join: passages go to the executors in
    blocks of at most ``BROADCAST_BYTES``, one pass over the sheet per block,
    and only verified hits are grouped by row. With ``carry`` the input row
    comes along as ``row``.
    """
    source = cells(sheet, row_id, column)
    # Rows are told apart by id and content, so a repeated id mixes no texts.
    rows = source.select("row_id", F.xxhash64("cell").alias("cell_key"), words_of(F.col("cell")).alias("words"))
    windows = stored(_with_shingles(lookup_windows(cells(lookup, lookup_id, lookup_column), window)), "passages")
    facts = windows.agg(F.collect_set("size").alias("sizes"), F.count(F.lit(1)).alias("n"), F.max(F.size("pattern")).alias("longest")).first()
    sizes = sorted(facts.sizes)

    key = ["row_id", "cell_key"]
    if sizes:
        # Each passage word as one array element, and its row's overhead.
        blocks = -(-facts.n * (64 * facts.longest + 96) // BROADCAST_BYTES)
        block = F.pmod(F.hash("pattern"), F.lit(blocks))
        found = []
        for b in range(blocks):
            tokens = windows.filter(block == b)
            found.append(_block_hits(rows, tokens, sizes))
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy(*key).agg(
            F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("passage").alias("passages"))
    else:
        nothing = rows.filter(F.lit(False))
        hits = nothing.select(*key, F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<bigint>)").alias("passages"))
    hits = stored(hits, "passage-hits")
    names = windows.select(F.xxhash64("pattern").alias("passage"), F.explode("lookup_ids").alias("lookup_id")).distinct()
    ids = (
        hits.select(*key, F.explode("passages").alias("passage")).join(names, "passage")
        .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("lookup_id").cast("string"))).alias("lookup_ids"))
    )
    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)"), _merge)
    spans = hits.select(*key, merged.alias("hit_spans"))
    spans = spans.join(ids, _same(spans, ids), "left").select(spans.row_id, spans.cell_key, "hit_spans", "lookup_ids")
    counted = cells(sheet, row_id, column, carry).withColumn("cell_key", F.xxhash64("cell"))
    counted = counted.withColumn("n_words", F.size(words_of(F.col("cell"))).cast("bigint")).drop("cell")
    spans = bounded(stored(spans, "passage-spans"), 128 + 24 * F.size("hit_spans") + 40 * F.coalesce(F.size("lookup_ids"), F.lit(0)))
    out = counted.join(spans, _same(counted, spans), "left")
    length = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        *["row"] * carry, counted.row_id, "n_words", F.coalesce(length, F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("hit_spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("hit_spans"),
        F.coalesce("lookup_ids", F.expr("cast(array() as array<string>)")).alias("lookup_ids"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.row_id.eqNullSafe(b.row_id) & (a.cell_key == b.cell_key)


def _merge(runs: Column, span: Column) -> Column:
    """Add a span, in order of starts, to maximal runs."""
    before = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
    last = F.try_element_at(runs, F.lit(-1))
    joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    return F.when(last["end"] >= span["start"], F.concat(before, F.array(joined))).otherwise(F.concat(runs, F.array(span)))


def _block_hits(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Verified occurrences of one block of passages: row, first word, end, passage."""
    every = F.broadcast(windows.select("token").distinct())
    counts = _positions(rows, sizes).select("token").join(every, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = windows.join(counts, "token", "left")
    prefix = ranked.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
    # A shingle the sheet does not have at all rules its passage out.
    prefix = prefix.filter("rarest.n > 0").select("rarest.token", "rarest.offset", "pattern", F.xxhash64("pattern").alias("passage"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("pattern") <= F.size("words"))
    same = F.slice("words", start + 1, F.size("pattern")) == F.col("pattern")
    found = _positions(rows, sizes).join(F.broadcast(stored(prefix, "passage-prefixes")), "token")
    return found.filter(F.when(fits, same).otherwise(False)).select(
        "row_id", "cell_key", start.alias("start"), (start + F.size("pattern")).alias("end"), "passage")
