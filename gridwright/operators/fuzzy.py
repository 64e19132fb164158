"""Approximate matching of keys between tables.

Keys are compared by ``1 - edit distance / longer length``. Candidates come
from equality joins on signatures, never from comparing all pairs:

* distance 1 - two keys that differ in one character share a text that is left
  after deleting at most one character from each (deletion neighbourhood);
* thresholds from 0.75 on - a key is cut into one segment more than it can
  have edits. An edit touches one segment at most, so a similar key holds a
  segment unchanged; the edits left and right of it bound its place. Segments
  are as long as ``1 / (1 - threshold)`` characters, whatever the key's length.
  Lengths are put into narrow classes that share their cuts, so that a key is
  looked up in few of them;
* lower thresholds - two keys within ``k`` edits share at least
  ``longer length - k`` characters, counted with repetition. With characters
  ordered from rare to frequent, their first ``k + m`` characters have ``m`` in
  common (prefix filter), so they share a signature of ``m`` rare characters.

Signatures that many keys have, such as the common head of numbered names, are
spread over many tasks and, from 0.75 on, lead to groups of keys with one head
first; pairs whose characters alone tell them apart end in the join. Every other candidate is checked with ``levenshtein``; the result is complete.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import cell, col, norm_key
from ..functions.standardize import edit_similarity, std_text
from ..session import checkpointed
from ..streaming.guard import batch_only
from .lookups import PREFIX, _free_names, first_per_key
from .ordering import first_rows
from .skew import join_salted

CHARACTER_BUCKETS = 4096
GRAM_BUCKETS = 1 << 14
EPS = 1e-9
#: From this threshold on segments are long enough to tell keys apart.
SEGMENTS_FROM = 0.75
#: Up to so many keys no signature can be hot, and the plain join has fewer stages.
SALT_FROM = 20_000
#: Options that are assigned one by one in a single task.
SEQUENTIAL_ROWS = 100_000


def _allowed(x: Column, y: Column, threshold: float) -> Column:
    """Largest distance at which two keys are still similar enough."""
    longer = F.greatest(F.char_length(x), F.char_length(y))
    return F.floor(longer * F.lit(1 - threshold) + F.lit(EPS)).cast("int")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or above the threshold with their score; a bounded distance stops early."""
    x, y = col("lkey"), col("rkey")
    most = _allowed(x, y, threshold)
    distance = F.levenshtein(x, y)
    for bound in (16, 6, 2):
        distance = F.when(most <= bound, F.levenshtein(x, y, bound)).otherwise(distance)
    longer = F.greatest(F.char_length(x), F.char_length(y))
    score = F.when(distance >= 0, F.when(longer == 0, F.lit(1.0)).otherwise(1 - distance / longer))
    return pairs.withColumn("score", score).filter(F.col("score") >= F.lit(threshold - EPS))


def _width(n: Column) -> Column:
    """Lengths in the class of length ``n``: one below 32, then at most a sixteenth of it."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(n)) - 5)).cast("int")


def _class_of(n: Column) -> Column:
    """The shortest length of the class of ``n``."""
    return n - n % _width(n)


def _class_edits(low: Column, threshold: float) -> Column:
    """Most edits between a key whose length class starts at ``low`` and any similar key."""
    longest = F.floor((low + _width(low) - 1) / F.lit(threshold) + F.lit(EPS))
    return F.floor(longest * F.lit(1 - threshold) + F.lit(EPS)).cast("int")


def _cut(low: Column, edits: Column, i: Column) -> Column:
    """Where segment ``i`` of a class starts; the one behind the last is the end of the shortest key."""
    return F.floor(i * low / (edits + 1)).cast("int")


def _segments(key: Column, threshold: float) -> Column:
    """Signatures of a key's own segments."""
    low = _class_of(F.char_length(key))

    def cut_up(at: Column) -> Column:
        a, edits = at["a"], at["e"]
        return F.transform(F.sequence(F.lit(0), edits), lambda i: F.xxhash64(
            a, i, F.substring(key, _cut(a, edits, i) + 1, _cut(a, edits, i + 1) - _cut(a, edits, i))))

    # The class is bound once, so that it is not computed again for each segment.
    bound = F.transform(F.array(F.struct(low.alias("a"), _class_edits(low, threshold).alias("e"))), cut_up)
    return F.flatten(bound)


def _segment_probes(key: Column, threshold: float) -> Column:
    """Signatures of all parts of a key that may be a segment of a similar key.

    Segment ``i`` of a key with ``e + 1`` segments can be asked for with
    exactly ``i`` edits before it and at most ``e - i`` behind it.
    """
    n = F.char_length(key)
    shortest = F.greatest(F.lit(1), F.ceil(n * F.lit(threshold) - F.lit(EPS)).cast("int"))
    longest = F.floor(n / F.lit(threshold) + F.lit(EPS)).cast("int")
    lows = F.array_distinct(F.transform(F.sequence(shortest, longest), _class_of))

    def of_class(at: Column) -> Column:
        a, w, edits = at["a"], at["w"], at["e"]

        def of_segment(i: Column) -> Column:
            start, size = _cut(a, edits, i), _cut(a, edits, i + 1) - _cut(a, edits, i)
            first = F.greatest(-i, n - (a + w - 1) - (edits - i), -start)
            last = F.least(i, n - a + edits - i, n - size - start)
            shifts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(shifts, lambda d: F.xxhash64(a, i, F.substring(key, start + d + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_segment))

    classes = F.transform(lows, lambda a: F.struct(a.alias("a"), _width(a).alias("w"), _class_edits(a, threshold).alias("e")))
    return F.array_distinct(F.flatten(F.transform(classes, of_class)))


def _joined(probes: DataFrame, index: DataFrame, keys: list[str], probe: str, salted: bool) -> DataFrame:
    """Equality join of signatures; with ``salted`` those with a large share of the probes are spread by the probing key."""
    return join_salted(probes, index, keys, "inner", col(probe)) if salted else probes.join(index, keys)


def _characters(key: Column) -> Column:
    """64 bits that say which (hashed) characters a key has; an edit changes two at most."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseOR(bit(c)))


def _head(key: Column) -> Column:
    """The first two thirds of a key."""
    return F.substring(key, F.lit(1), F.floor(F.char_length(key) * 2 / 3).cast("int"))


def _head_allows(key: Column, head: Column, n: Column, threshold: float) -> Column:
    """Whether a key may be similar to one of ``n`` characters that begins with ``head``.

    In the cheapest edits of the whole keys some beginning of one becomes the
    head; what is left of both differs by its length at least.
    """
    size, h = F.char_length(key), F.char_length(head)
    most = F.floor(F.greatest(size, n) * F.lit(1 - threshold) + F.lit(EPS)).cast("int")
    ends = F.sequence(F.greatest(F.lit(0), h - most), F.least(size, h + most))
    allowed = F.exists(ends, lambda j: F.levenshtein(F.substring(key, F.lit(1), j), head) + F.abs(size - j - n + h) <= most)
    return (F.abs(size - n) <= most) & allowed


def _segment_candidates(left: DataFrame, right: DataFrame, threshold: float, salted: bool) -> DataFrame:
    """Pairs that share a segment signature and differ little enough in length and characters.

    With ``salted`` a signature leads to groups of keys with the same head and
    length first, and to the keys of those groups only that a key may be
    similar to: keys with a long common head are told apart from another head at once.
    """
    a = left.filter(F.char_length("lkey") > 0).select("lkey", _characters(col("lkey")).alias("_lbits"), F.explode(_segment_probes(col("lkey"), threshold)).alias("sig"))
    b = right.filter(F.char_length("rkey") > 0).select("rkey", _characters(col("rkey")).alias("_rbits"), F.explode(_segments(col("rkey"), threshold)).alias("sig"))
    gap = F.abs(F.char_length("lkey") - F.char_length("rkey"))
    most = _allowed(col("lkey"), col("rkey"), threshold)
    close = (gap <= most) & (F.bit_count(F.col("_lbits").bitwiseXOR(F.col("_rbits"))) <= 2 * most) & (F.col("lkey") != F.col("rkey"))
    if not salted:
        return a.join(b, "sig").filter(close).select("lkey", "rkey").distinct()
    b = b.withColumn("_head", _head(col("rkey"))).withColumn("_n", F.char_length("rkey")).withColumn("_group", F.xxhash64("_head", "_n"))
    met = join_salted(a, b.select("sig", "_group", "_head", "_n").distinct(), ["sig"], "inner", col("lkey"))
    met = checkpointed(met.filter(_head_allows(col("lkey"), col("_head"), col("_n"), threshold)).select("lkey", "_lbits", "sig", "_group"))
    pairs = join_salted(met, b.select("sig", "_group", "rkey", "_rbits"), ["sig", "_group"], "inner", col("lkey"))
    return pairs.filter(close).select("lkey", "rkey").distinct()


def _deletions(key: Column) -> Column:
    """Hashes of a key and of all texts with one of its characters removed."""
    n = F.char_length(key)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n))))
    return F.array_distinct(F.array_append(cut, F.xxhash64(key)))


def _one_edit(left: DataFrame, right: DataFrame, threshold: float, salted: bool) -> DataFrame:
    """All pairs at distance 1 that meet the threshold."""
    long = lambda c: F.char_length(c) >= F.lit(threshold / (1 - threshold) - EPS)
    a = left.filter(long("lkey")).select("lkey", F.explode(_deletions(col("lkey"))).alias("sig"))
    b = right.filter(long("rkey")).select("rkey", F.explode(_deletions(col("rkey"))).alias("sig"))
    met = (F.abs(F.char_length("lkey") - F.char_length("rkey")) <= 1) & (F.levenshtein("lkey", "rkey", 1) == 1)
    return _verified(_joined(a, b, ["sig"], "lkey", salted).filter(met).select("lkey", "rkey").distinct(), threshold)


def _marked_characters(s: Column) -> Column:
    """Characters with their occurrence number, so that repeats count."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda o: o == c)).cast("string")),
    )


def _bucket(mark: Column) -> Column:
    return F.pmod(F.xxhash64(mark), F.lit(CHARACTER_BUCKETS)).cast("int")


def _bucket_counts(items: DataFrame, buckets: int) -> DataFrame:
    """One row: how often each hashed item of the column ``m`` occurs; the array has a fixed size."""
    seen = items.groupBy(F.pmod(F.xxhash64("m"), F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = items.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    dense = every.join(seen, "b", "left").select(F.struct("b", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["n"]).alias("rarity"))


def _rarity(right: DataFrame) -> DataFrame:
    return _bucket_counts(right.select(F.explode(_marked_characters(col("rkey"))).alias("m")), CHARACTER_BUCKETS)


def _subsets(items: Column, size: int) -> Column:
    """Hashes of all ordered subsets of the given size."""
    def grow(prefix: list[Column], last: Column | None, depth: int) -> Column:
        n = F.size(items)
        begin = F.lit(1) if last is None else last + 1
        stop = n - F.lit(size - depth - 1)
        span = F.when(begin <= stop, F.sequence(begin, stop)).otherwise(F.array().cast("array<int>"))
        if depth == size - 1:
            return F.transform(span, lambda i: F.xxhash64(*prefix, F.element_at(items, i)))
        return F.flatten(F.transform(span, lambda i: grow([*prefix, F.element_at(items, i)], i, depth + 1)))

    return grow([], None, 0)


# Bands of the longer key's length, each with the number of shared characters
# its signatures hold. A pair falls in exactly one band.
_BANDS = ((3, 5, 2), (6, 24, 4), (25, 60, 3), (61, None, 2))


def _band_signatures(key: Column, ranked: Column, threshold: float, band: tuple) -> Column:
    """Hashes of the rare character subsets of a key in one band; none when it has no partner there."""
    low, high, shared = band
    n = F.char_length(key)
    longer = F.greatest(n, F.lit(low))
    common = longer - F.floor(longer * F.lit(1 - threshold) + F.lit(EPS)).cast("int")
    fits = F.floor(n / F.lit(threshold) + F.lit(EPS)) >= low
    if high is not None:
        fits = fits & (n <= high)
    head = F.slice(ranked, F.lit(1), F.greatest(n - common + F.lit(shared), F.lit(0)))
    # The head is bound once, so that it is not computed again for each subset.
    subsets = F.flatten(F.transform(F.array(head), lambda h: _subsets(h, shared)))
    tagged = F.transform(F.array_distinct(subsets), lambda s: F.struct(F.lit(low).alias("band"), s.alias("sig")))
    return F.when(fits, tagged).otherwise(F.array().cast("array<struct<band:int,sig:bigint>>"))


def _rare_signatures(df: DataFrame, key: str, rarity: DataFrame, threshold: float, bands) -> DataFrame:
    """``key, band, sig`` for all bands, from one pass over the keys."""
    marks = df.select(key, rarity.scalar().alias("_rarity"), _marked_characters(col(key)).alias("_marks"))
    rank = F.transform("_marks", lambda m: F.struct(F.element_at(F.col("_rarity"), _bucket(m) + 1).alias("n"), m.alias("m")))
    ranked = marks.select(key, F.transform(F.sort_array(rank), lambda s: s["m"]).alias("_ranked"))
    arrays = [_band_signatures(col(key), F.col("_ranked"), threshold, b) for b in bands]
    return ranked.select(key, F.inline(F.concat(*arrays) if len(arrays) > 1 else arrays[0]))


def _character_candidates(left: DataFrame, right: DataFrame, threshold: float, salted: bool) -> DataFrame:
    """Pairs that share a signature of rare characters and differ little enough in length."""
    rarity = _rarity(right)
    a = _rare_signatures(left, "lkey", rarity, threshold, _BANDS)
    b = _rare_signatures(right, "rkey", rarity, threshold, _BANDS)
    longer = F.greatest(F.char_length("lkey"), F.char_length("rkey"))
    gap = F.abs(F.char_length("lkey") - F.char_length("rkey"))
    in_band = reduce(lambda x, y: x | y, [
        (F.col("band") == low) & (longer >= low) & (F.lit(True) if high is None else longer <= high) for low, high, _ in _BANDS
    ])
    close = in_band & (gap <= _allowed(col("lkey"), col("rkey"), threshold)) & (F.col("lkey") != F.col("rkey"))
    return _joined(a, b, ["band", "sig"], "lkey", salted).filter(close).select("lkey", "rkey").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, salted: bool = True) -> DataFrame:
    """All pairs ``(lkey, rkey, score)`` of distinct keys with similarity at or above the threshold.

    Equal keys are left out. ``salted`` spreads hot signatures over tasks; it
    changes the plan, not the pairs.
    """
    if not 0.6 <= threshold < 1:
        raise ValueError("the threshold must be at least 0.6 and below 1")
    candidates = _segment_candidates if threshold >= SEGMENTS_FROM else _character_candidates
    return _verified(candidates(left, right, threshold, salted), threshold)


def best_similar(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Best partner per left key: highest score, then smallest right order.

    ``left`` has ``lkey``; ``right`` has ``rkey`` and ``rorder``. A key of more
    than two characters with a partner at distance 1 has no better one further
    away; only the others are searched further.
    """
    left, right = checkpointed(left.select("lkey")), checkpointed(right.select("rkey", "rorder"))
    keys = right.select("rkey")
    salted = left.count() + right.count() > SALT_FROM
    near = checkpointed(_one_edit(left, keys, threshold, salted))
    settled = near.filter(F.char_length("lkey") > 2).select("lkey").distinct()
    pairs = near.unionByName(similar_pairs(left.join(settled, "lkey", "left_anti"), keys, threshold, salted)).distinct()
    ranked = pairs.join(right, "rkey")
    return first_rows(ranked, [col("lkey")], [F.col("score").desc(), F.col("rorder").asc()]).select("lkey", "rkey", "score")


def fuzzy_lookup(left: DataFrame, right: DataFrame, on, order_by=(), threshold: float = 0.85,
                 prefix: str = PREFIX, score: str | None = None) -> DataFrame:
    """Left lookup on one key; a key without an equal partner takes the most similar one.

    Only distinct keys without an exact partner are compared. ``score`` adds a
    column with 1.0 for exact, the similarity for approximate matches.
    """
    batch_only(left, "fuzzy_lookup")
    a, b = (on, on) if isinstance(on, str) else on
    keyed = first_per_key(right, [norm_key(cell(right, b))], order_by)
    order = [col(c) for c in (order_by or right.columns)]
    right_keys = keyed.select(F.col("_k0").alias("rkey"), F.struct(*order).alias("rorder"))
    probe = left.withColumn("_lkey", norm_key(cell(left, a)))
    wanted = probe.filter("_lkey <> ''").select(F.col("_lkey").alias("lkey")).distinct()
    unmatched = wanted.join(right_keys.select(F.col("rkey").alias("lkey")), "lkey", "left_anti")
    mapping = best_similar(unmatched, right_keys, threshold).select(
        F.col("lkey").alias("_lkey"), F.col("rkey").alias("_near"), F.col("score").alias("_near_score")
    )
    routed = probe.join(mapping, "_lkey", "left").withColumn("_k0", F.coalesce("_near", "_lkey"))
    carried = [c for c in right.columns if c != b]
    names = _free_names(left.columns, carried, prefix)
    lean = keyed.select("_k0", *[col(c).alias(n) for c, n in zip(carried, names)], F.lit(True).alias("_hit"))
    joined = routed.join(lean, "_k0", "left")
    extra = [F.when(F.col("_hit"), F.coalesce("_near_score", F.lit(1.0))).alias(score)] if score else []
    return joined.select(*[col(c) for c in left.columns], *[col(n) for n in names], *extra)


def fuzzy_find(df: DataFrame, column: str, wanted: str, order_by=(), threshold: float = 0.85) -> DataFrame:
    """The row of a table whose key is the best match for one value: exact first, then most similar."""
    target = norm_key(F.lit(wanted))
    key = norm_key(cell(df, column))
    scored = df.withColumn("_exact", key == target).withColumn("_score", edit_similarity(key, target))
    scored = scored.filter((key != "") & (F.col("_exact") | (F.col("_score") >= F.lit(threshold - EPS))))
    order = [F.col("_exact").desc(), F.col("_score").desc(), *[col(c) for c in (order_by or df.columns)]]
    return scored.orderBy(*order).limit(1).drop("_exact", "_score")


# --- key mapping ---------------------------------------------------------------

def _ordered_keys(df: DataFrame, column: str, order_by, nkey: str, raw: str, order: str) -> DataFrame:
    """Distinct raw values with their normal form and the place of their first row."""
    place = F.struct(*[col(c) for c in (order_by or [column])])
    grouped = df.filter(col(column).isNotNull()).groupBy(col(column).cast("string").alias(raw)).agg(F.min(place).alias(order))
    return grouped.withColumn(nkey, std_text(col(raw))).filter(col(nkey) != "")


# Lengths of the grams by which a contained key is looked up; a key uses the longest it has.
_GRAM_SIZES = (6, 3, 2, 1)


def _grams(key: Column, size: int) -> Column:
    n = F.char_length(key)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(key, i, F.lit(size)))


def _contained(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str, salted: bool) -> DataFrame:
    """Pairs in which one key is a proper part of the other.

    The inner key is looked up by its rarest gram only, the outer one has a row
    for each of its different grams: four times its length at most. Grams that
    very many outer keys have, such as single letters, are spread over tasks.
    """
    k, o = col(inner_key), col(outer_key)
    grams = F.array_distinct(F.concat(*[_grams(o, q) for q in _GRAM_SIZES]))
    posted = outer.filter(F.char_length(o) > 1).select(outer_key, F.explode(grams).alias("_gram"))
    counts = _bucket_counts(posted.select(F.col("_gram").alias("m")), GRAM_BUCKETS)
    n = F.char_length(k)
    own = reduce(lambda rest, q: F.when(n >= q, _grams(k, q)).otherwise(rest), reversed(_GRAM_SIZES), F.array().cast("array<string>"))
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(GRAM_BUCKETS)).cast("int") + 1
    rated = inner.filter(n > 0).select(inner_key, own.alias("_own"), counts.scalar().alias("_counts"))
    rarest = F.array_min(F.transform("_own", lambda g: F.struct(F.element_at("_counts", bucket(g)).alias("n"), g.alias("g"))))
    anchored = rated.select(inner_key, rarest["g"].alias("_gram"))
    found = _joined(posted, anchored, ["_gram"], outer_key, salted)
    return found.filter(F.contains(o, k) & (k != o)).select(inner_key, outer_key)


def _mapping_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate pairs of normal forms with phase and confidence."""
    ln, rn = left.select("lkey").distinct(), right.select("rkey").distinct()
    salted = left.count() + right.count() > SALT_FROM
    exact = ln.join(rn, col("lkey") == col("rkey")).select("lkey", "rkey", F.lit(1).alias("phase"), F.lit(1.0).alias("confidence"))
    rest = checkpointed(ln.join(rn.select(F.col("rkey").alias("lkey")), "lkey", "left_anti"))
    inside = _contained(rn, "rkey", rest, "lkey", salted).select("lkey", "rkey")
    around = _contained(rest, "lkey", rn, "rkey", salted).select("lkey", "rkey")
    part = inside.unionByName(around)
    shorter = F.least(F.char_length("lkey"), F.char_length("rkey"))
    longer = F.greatest(F.char_length("lkey"), F.char_length("rkey"))
    part = part.select("lkey", "rkey", F.lit(2).alias("phase"), (F.lit(0.7) + shorter / longer * 0.15).alias("confidence"))
    near = similar_pairs(rest, rn, 0.6, salted)
    near = near.select("lkey", "rkey", F.lit(3).alias("phase"), F.col("score").alias("confidence"))
    return exact.unionByName(part).unionByName(near)


def key_mapping(left: DataFrame, left_column: str, right: DataFrame, right_column: str,
                left_order=(), right_order=(), one_to_one: bool = False) -> DataFrame:
    """Map values of one column to values of another: equal, then contained, then similar.

    Result: one row per distinct left value with ``source``, ``target``,
    ``phase`` (1 equal, 2 contained, 3 similar, null without a partner) and
    ``confidence``. With ``one_to_one`` a right value is taken once, in left
    order, except by an equal key that finds all its partners taken.
    """
    batch_only(left, "key_mapping")
    lv = checkpointed(_ordered_keys(left, left_column, left_order, "lkey", "source", "lorder"))
    rv = checkpointed(_ordered_keys(right, right_column, right_order, "rkey", "target", "rorder"))
    found = _mapping_candidates(lv, rv)
    wide = lv.join(found, "lkey").join(rv, "rkey")
    similar = F.when(F.col("phase") == 3, -F.col("confidence")).otherwise(F.lit(0.0))
    preference = F.struct(F.col("phase"), similar.alias("s"), F.col("rorder"), F.col("target"))
    options = wide.select("source", "lorder", "target", "phase", "confidence", preference.alias("pref"))
    if one_to_one:
        chosen = _assign(options)
    else:
        chosen = first_rows(options, [col("source")], [col("pref").asc()])
    shown = F.when(F.col("phase") == 3, F.least(F.lit(0.8), F.col("confidence"))).otherwise(F.col("confidence"))
    result = lv.select("source").join(chosen.select("source", "target", "phase", shown.alias("confidence")), "source", "left")
    return result.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def _one_by_one(options: DataFrame) -> DataFrame:
    """``source`` and ``target`` of a bounded number of options, left values in turn, in one task."""
    def go(batches):
        used, current, open_ = set(), None, False
        for batch in batches:
            sources, targets = [], []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source != current:
                    current, open_ = source, True
                if open_ and target not in used:
                    used.add(target)
                    open_ = False
                    sources.append(source)
                    targets.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(targets, pa.string())], ["source", "target"])

    ordered = options.repartition(1).sortWithinPartitions("lorder", "source", "pref").select("source", "target")
    return ordered.mapInArrow(go, "source string, target string")


def _assign(options: DataFrame) -> DataFrame:
    """Each left value in turn takes its best free right value.

    Computed by rounds of proposals: every left value proposes to its best
    remaining partner, every right value keeps the earliest proposer, and all
    later left values lose that partner at once, whether they proposed or not.
    As all right values rank the left side alike, the outcome is that of going
    through the left values one by one. A round without a loser ends it.

    The number of rounds is bounded by measured progress. Whatever fits into
    one task is assigned there one by one; a round in which fewer options were
    lost is followed by assigning the first left values that way, which
    settles about ``SEQUENTIAL_ROWS`` options. So there are no more than
    ``options / SEQUENTIAL_ROWS`` such rounds for any order of the values.
    """
    options = checkpointed(options)
    remaining, n, decided = options, options.count(), []
    place = F.struct("lorder", "source")
    while n > SEQUENTIAL_ROWS:
        best = first_rows(remaining, [col("source")], [col("pref").asc()])
        kept = best.groupBy(F.col("target").alias("_held")).agg(F.min(place).alias("_first"))
        left = remaining.join(kept, F.col("target") == F.col("_held"), "left")
        after = checkpointed(left.filter(F.col("_held").isNull() | (place <= F.col("_first"))).drop("_held", "_first"))
        left_over = after.count()
        if left_over == n:
            decided.append(best.select("source", "target"))
            n = 0
            break
        slow, remaining, n = n - left_over < SEQUENTIAL_ROWS, after, left_over
        if slow and n > SEQUENTIAL_ROWS:
            first = checkpointed(remaining.orderBy("lorder", "source", "pref").limit(SEQUENTIAL_ROWS))
            edge = first.agg(F.max(place).alias("p")).scalar()
            head = first.filter(place < edge)  # the last left value may have more options
            whole = not head.isEmpty()
            # A single value with so many options is the first of all and takes its best one.
            chosen = checkpointed(_one_by_one(head if whole else first))
            decided.append(chosen)
            rest = remaining.filter(place >= edge if whole else place > edge)
            remaining = checkpointed(rest.join(chosen.select("target"), "target", "left_anti").select(*options.columns))
            n = remaining.count()
    if n:
        decided.append(_one_by_one(remaining))
    if not decided:
        return options.filter("false")
    pairs = checkpointed(reduce(lambda a, b: a.unionByName(b), decided))
    judged = first_rows(options.join(pairs, ["source", "target"], "left_semi"), [col("source")], [col("pref").asc()])
    equal = first_rows(options.filter("phase = 1"), [col("source")], [col("pref").asc()])
    shared = equal.join(pairs.select("source"), "source", "left_anti")
    return judged.unionByName(shared)


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """One row: total, matched, unmatched and match rate."""
    hit = F.count_if(F.col("target").isNotNull())
    total = F.count(F.lit(1))
    return mapping.agg(
        total.alias("total"), hit.alias("matched"), (total - hit).alias("unmatched"),
        F.coalesce(F.try_divide(hit.cast("double"), total), F.lit(0.0)).alias("match_rate"),
    )
