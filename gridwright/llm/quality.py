"""Quality of a sheet's cells: counts of what is wrong in them, and a likelihood ratio against trusted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import bounded, cells, named, shuffles_removed, stored

#: White space; a class of single characters, which Java tests as a bit map.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09\x0A\x0B\x0C\x0D]+"
NOT_SPACE = r"[^\x20\x09\x0A\x0B\x0C\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Occurrences, at the share all n-grams have in trusted rows, that are added to every n-gram. One that occurs once
#: and in no trusted row so counts -0.06, and a text of nothing else is not kept.
BACK_OFF = 16
#: Log ratios are kept as whole multiples of 1 / SCALE, so that sums do not depend on their order.
SCALE = 1_000_000
#: N-grams of more than one in so many occurrences are hot; there are fewer hot ones than this.
HOT = 1 << 17
#: Hot n-grams are looked for in one row of so many.
HOT_PART = 16
#: Ranges of hashes that the other n-grams are dealt to, a pass over the rows each, and up to how many n-grams one pass takes all.
RANGES, ONE_PASS = 5, 1 << 21
#: Mean log ratio per n-gram from which a row is kept.
THRESHOLD = -0.05


def words_of(text: Column) -> Column:
    """Runs of what is no white space."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """Hashes of all words and word pairs of ``cell``, one row each, with the columns to keep."""
    # Trimmed, only an empty text has an empty word.
    words = rows.select(*keep, F.split(F.btrim("cell", F.lit(SPACES)), SPACE_CLASS).alias("words"))
    follow = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    # The outer form adds no filter that would split everything twice; rows are hashed by generated code, arrays are not.
    pairs = words.select(*keep, F.inline_outer(F.arrays_zip(F.col("words").alias("a"), follow.alias("b"))).alias("a", "b"))
    single, pair = F.when(F.col("a") != "", F.xxhash64("a")), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))
    return pairs.select(*keep, F.explode(F.array(single, pair)).alias("gram")).filter("gram is not null")


def _likely_hot(rows: DataFrame) -> DataFrame:
    """``gram`` of fewer than ``HOT`` n-grams: those of more than one in ``HOT`` occurrences in a part of the rows.

    They only decide which n-grams take the way of the hot ones; counts and scores are exact on either way.
    """
    seen = _grams(rows.filter(F.rand(0) * HOT_PART < 1)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = stored(seen, "gram-sample")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return seen.filter(F.col("n") * F.lit(HOT) > F.lit(total)).select("gram")


def scores(rows: DataFrame) -> DataFrame:
    """``cell_key`` and the mean log ratio of the n-grams of all cells with that key (``cell``, ``cell_key``, ``trusted``).

    The ratio of an n-gram is the log of its share in trusted rows over that in
    all rows, both backed off to the share of all n-grams. It is 0 for all if
    trusted rows have no words.

    Hot n-grams are counted first, and their ratios come to the rows. The
    others are shuffled once, with the key of their cell, and counted where
    they meet; ``RANGES`` passes over the rows take one range of hashes each,
    so that the shuffle on disk is that part of the whole. Sums are kept as
    differences to the ratio of an n-gram that occurs once and in no trusted
    row, the most frequent kind, which so needs no row on the way back.
    """
    likely = F.broadcast(_likely_hot(rows).withColumnRenamed("gram", "hot"))
    grams = _grams(rows, "trusted")
    hot = grams.join(likely, grams.gram == likely.hot, "left").groupBy("hot").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good"))
    hot = stored(hot, "hot-grams")
    total = hot.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = total.raw / total.good if total.good else None

    def ratio(raw: Column, good: Column) -> Column:
        more = good * share if share else raw.cast("double")
        return F.round(F.log((more + BACK_OFF) / (raw + BACK_OFF)) * SCALE).cast("bigint")

    rare = ratio(F.lit(1), F.lit(0))
    beyond = ratio(F.col("raw"), F.col("good")) - rare
    known = F.broadcast(hot.filter("hot is not null").select("hot", beyond.alias("beyond")))
    grams = _grams(rows, "cell_key")
    parts = grams.join(known, grams.gram == known.hot, "left").groupBy("cell_key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("beyond"), F.lit(0)).alias("beyond"))
    parts = stored(parts, "score-parts")
    same = Window.partitionBy("gram")
    passes = RANGES if total.raw > ONE_PASS else 1
    for k in range(passes):
        cold = _grams(rows, "cell_key", "trusted")
        cold = cold.filter(F.pmod("gram", F.lit(passes)) == k) if passes > 1 else cold
        cold = cold.join(known, cold.gram == known.hot, "left_anti")
        cold = cold.select("cell_key", F.count(F.lit(1)).over(same).alias("raw"), F.count_if("trusted").over(same).alias("good"))
        cold = cold.select("cell_key", beyond.alias("beyond")).filter("beyond <> 0").groupBy("cell_key").agg(F.lit(0).cast("bigint").alias("n"), F.sum("beyond").alias("beyond"))
        parts = parts.unionByName(stored(cold, "score-parts"))
    return parts.groupBy("cell_key").agg(((F.sum("beyond") + rare * F.sum("n")) / F.sum("n") / SCALE).alias("score"))


def quality_rules(sheet: DataFrame, trusted: str, row_id: str = "row_id", column: str = "value", threshold: float = THRESHOLD, least_words: int = 50, carry: bool = False) -> DataFrame:
    """Counts and verdict for every row's cell; ``trusted`` names a boolean column that marks the target rows.

    Words are runs of what is no ASCII white space. Returns per row ``row_id``,
    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
    (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words inside a window of three
    that the cell has more than once), ``base_failed`` (fewer than
    ``least_words`` words, or more than half of them repeated), ``score`` and
    ``kept``.

    ``score`` is the log-likelihood ratio of the cell's words and word pairs
    between the multinomial of the trusted rows and that of all rows, divided
    by their number; a row is kept if it did not fail the base rules and its
    score is at least ``threshold``. Every row is decided by the same rule,
    none by a draw. Null and empty cells have no words and a score of 0, and
    fail. Repeated rows are decided alike. If no row is trusted, all scores
    are 0. With ``carry`` the input row comes along as ``row``.

    All statistics cover all rows, and every n-gram (by its 64-bit hash) has
    its own counts. The driver gets their two totals, the occurrences in the
    part of the rows that proposes hot n-grams, and the measured size of the
    scores.
    """
    source = cells(sheet, row_id, column, carry).withColumn("cell", F.coalesce("cell", F.lit(""))).withColumn("cell_key", F.xxhash64("cell"))
    row = ["row"] if carry else []
    rows = source.withColumn("words", words_of(F.col("cell")))
    n = F.size("words")
    # Words are hashed once; each window is hashed from three of these.
    words = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("hashes", words)
    part = lambda k: F.slice("hashes", k, F.greatest(n - 2, F.lit(0)))
    triples = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda ab, c: F.xxhash64(ab, c))
    lines = F.filter(F.split("cell", "\n"), lambda line: line.rlike(NOT_SPACE))
    marked = sheet.select(F.coalesce(named(column).cast("string"), F.lit("")).alias("cell"), F.coalesce(named(trusted).cast("boolean"), F.lit(False)).alias("trusted"))
    with shuffles_removed(sheet.sparkSession):
        found = bounded(stored(scores(marked.withColumn("cell_key", F.xxhash64("cell"))), "scores"), 32)
    rows = rows.select(
        *row, "row_id", "cell_key", n.cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("cell", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), lines.alias("lines"),
        triples.alias("triples"),
    )
    # Only cells with a window twice need the places of their windows.
    places = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("triples")) < F.size("triples"), places))
    same = lambda x, k: x["h"] == F.get("windows", k)["h"]
    twice = F.filter("windows", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce(same(x, k - 1), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    rows = rows.select(
        *row, "row_id", "cell_key", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), starts.alias("starts"),
    )
    step = lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3)))
    covered = F.aggregate(F.transform("starts", step), F.lit(0), lambda a, x: a + x)
    rows = rows.select(
        *row, "row_id", "cell_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    rows = rows.join(found, "cell_key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    # As a generator's output the verdict can not be pushed down with its whole
    # expression, which would split the text again for every word.
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    return rows.select(*row, "row_id", F.inline(F.array(F.struct(*facts))))
