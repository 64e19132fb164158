"""Each operator against its plain version, on texts with nulls, ties, repeats and clashing columns."""

import collections
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import (
    first_of_similar, fit, lookup_passages, pack_cells, quality_rules, read_archives, repeated_lines, repeated_spans, shard_rows, similar_rows,
    toxicity_scores, write_archives,
)
from gridwright.llm import lines as line_module, overlap as overlap_module, rollups
from gridwright.llm.components import connected
from gridwright.llm.packing import differencing, windows
from gridwright.llm.shards import place_loads
from gridwright.llm.warc import parse_record, records_of

from . import brute

ODD = [None, "", " \n\t ", "one", "Two words", "É é\u00a0x", "\n\nlast line\n"]


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"w{rng.randrange(vocabulary)}", f"W{rng.randrange(30)}.", "the", "of\n"]) for _ in range(n))


def edited(text, seed, every):
    rng, w = random.Random(seed), text.split(" ")
    for i in range(rng.randrange(every), len(w), every):
        w[i] = f"new{rng.randrange(1000)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    base = [prose(i, n) for i, n in enumerate((3, 4, 5, 6, 60, 120, 300, 900))]
    near = [edited(base[k], 10 * k + j, every) for k in (4, 5, 6, 7) for j, every in enumerate((30, 60, 200, 400))]
    shared = prose(99, 120)
    mixed = [prose(50 + i, 40) + " " + shared + " " + prose(60 + i, 40) for i in range(5)]
    return ODD + base + near + mixed + [base[6], base[6], base[2], "a " * 400, "ab" * 500, shared.upper()]


def test_passages(sheet, corpus):
    items = [(1, prose(99, 120)[200:420]), (2, "two words"), (3, None), (4, ""), (5, "the"), (6, corpus[12][:80]), (6, "É"), (None, "one")]
    lookup = sheet(items, clash=True)
    got = lookup_passages(sheet(corpus, clash=True), lookup).collect()
    assert len(got) == len(corpus)
    named = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, ids = brute.passage_hits(corpus[r.row_id], items)
        assert (r.n_words, r.n_hit) == (n, hit)
        assert r.lookup_ids == brute.passage_hits(corpus[r.row_id], named)[2]
        assert sum(s.end - s.start for s in r.hit_spans) == hit


def test_passages_in_blocks(sheet, corpus, monkeypatch):
    import gridwright.llm.passages as passages

    items = [(1, prose(99, 120)), (2, "two words"), (3, corpus[13])]
    whole = sorted(map(str, lookup_passages(sheet(corpus), sheet(items)).collect()))
    monkeypatch.setattr(passages, "BROADCAST_BYTES", 60_000)
    assert sorted(map(str, lookup_passages(sheet(corpus), sheet(items)).collect())) == whole


def test_passages_of_empty_sheets(sheet):
    assert [(r.n_words, r.n_hit) for r in lookup_passages(sheet(["a b"]), sheet([])).collect()] == [(2, 0)]
    assert lookup_passages(sheet([]), sheet(["a"])).collect() == []


@pytest.mark.parametrize("length", [20, 64])
def test_spans(sheet, corpus, length):
    got = {r.row_id: r for r in repeated_spans(sheet(corpus, clash=True), length=length).collect()}
    for i, (n, kept) in enumerate(brute.removed_bytes([(t or "").encode() for t in corpus], length)):
        assert (sum(s.end - s.start for s in got[i].spans), bytes(got[i].kept)) == (n, kept), i
        assert all(a.end < b.start for a, b in zip(got[i].spans, got[i].spans[1:]))


def test_spans_without_broadcast(sheet, corpus, monkeypatch):
    from gridwright.llm import frames

    monkeypatch.setattr(frames, "BROADCAST_BYTES", 0)
    got = {r.row_id: bytes(r.kept) for r in repeated_spans(sheet(corpus), length=64).collect()}
    assert got == {i: kept for i, (_, kept) in enumerate(brute.removed_bytes([(t or "").encode() for t in corpus], 64))}


def test_spans_of_an_empty_sheet(sheet):
    assert repeated_spans(sheet([])).collect() == []


def test_lines(sheet, corpus):
    rows = list(enumerate(corpus))
    want = brute.removed_lines(rows)
    got = repeated_lines(sheet(corpus, clash=True)).collect()
    assert {r.row_id: list(r.removed_lines) for r in got} == want
    for r in got:
        lines = (corpus[r.row_id] or "").split("\n")
        assert r.n_lines == len(lines)
        assert r.kept == "\n".join(x for i, x in enumerate(lines) if i not in want[r.row_id])


def test_lines_in_parts(sheet, corpus, monkeypatch):
    monkeypatch.setattr(line_module, "BLOCK_LINES", 3)
    monkeypatch.setattr(line_module, "PART_LINES", 2)
    assert {r.row_id: list(r.removed_lines) for r in repeated_lines(sheet(corpus)).collect()} == brute.removed_lines(list(enumerate(corpus)))


def test_lines_in_many_places(sheet, corpus, monkeypatch):
    monkeypatch.setattr(line_module, "BATCH_POSTINGS", 7)
    monkeypatch.setattr(line_module, "BLOCK_LINES", 4)
    long = [" ".join(f"w{(i * k) % 997}" for i in range(1, 150)) for k in (3, 5, 7)]
    texts = corpus + long + [t + " more words" for t in long]
    got = {r.row_id: list(r.removed_lines) for r in repeated_lines(sheet(texts), least_tokens=1).collect()}
    assert got == brute.removed_lines(list(enumerate(texts)), least=1)
    assert [got[len(corpus) + i] for i in range(6)] == [[], [], [], [0], [0], [0]]


def test_tasks_of_the_line_join_have_equally_many_places(spark):
    postings = spark.range(40).selectExpr("id AS place", "CAST('' AS binary) AS rows", "CAST('' AS binary) AS wide")
    for most, want in ((20_000, [1] * 40), (8, [5] * 8)):
        line_module.MOST_TASKS, before = most, line_module.MOST_TASKS
        try:
            placed = line_module._placed(postings, 40).groupBy(F.spark_partition_id().alias("task")).count()
            assert sorted(r["count"] for r in placed.collect()) == want
        finally:
            line_module.MOST_TASKS = before


def test_postings_are_gathered_in_bounded_cells(sheet, spark, monkeypatch):
    """However many words the lines of one batch have, a cell holds few more postings than ``BATCH_POSTINGS``."""
    monkeypatch.setattr(line_module, "BATCH_POSTINGS", 50)
    rows = [(line_module._packed(np.arange(1, 8, dtype=np.uint64) << np.uint64(45), np.array([7]))[0].as_py(), i, 9, 0, None) for i in range(100)]
    sets = spark.createDataFrame(rows, "prefix binary, node bigint, size int, parity bigint, wide binary").coalesce(1)
    loads, parts = np.full(line_module.BUCKETS, 9), np.ones(line_module.BUCKETS, np.int64)
    cells = [len(r.rows) // line_module.POSTING.itemsize for r in line_module._postings(sets, loads, parts, 1).collect()]
    assert sum(cells) == 700 and max(cells) <= 2 * 50 + 7


def test_a_set_is_posted_once_however_many_tasks_meet_it(sheet, monkeypatch):
    """Copies of a sheet post no more than the sheet itself; else each pair of sets is compared once for every two copies."""
    texts = [f"w{i % 97} w{i % 89} w{i % 83} w{i} v{i % 7} v{i % 5} u" for i in range(300)]
    posted = []
    monkeypatch.setattr(line_module, "places_of", lambda loads, parts, f=line_module.places_of: posted.append(int(loads.sum())) or f(loads, parts))
    for copies in (1, 6):
        rows = [(1000 * k + i, t) for k in range(copies) for i, t in enumerate(texts)]
        got = {r.row_id: list(r.removed_lines) for r in repeated_lines(sheet(rows).repartition(copies, F.floor(F.col("row_id") / 1000)), least_tokens=1).collect()}
        assert got == brute.removed_lines(rows, least=1)
    assert posted[0] == posted[1] > 0


def test_sets_posted_once_by_bitmaps(spark):
    rng = random.Random(4)
    at = [k * (1 << 33) + i for k in (0, 1, 7, 30_000) for i in (*range(40), *range((1 << 15) - 9, (1 << 15) + 9), 99_999)]
    rows = [(rng.randrange(-60, 60), b"12345678" if rng.random() < 0.9 else None, i) for i in at]
    got = line_module._posted_once(spark.createDataFrame(rows, "node bigint, prefix binary, at bigint").repartition(5)).collect()
    first = {}
    for node, prefix, i in rows:
        if prefix:
            first[node] = min(i, first.get(node, i))
    assert {(r.node, r.at) for r in got} == set(first.items()) and len(got) == len(first)
    alone = line_module._posted_once(spark.createDataFrame([(1, b"12345678", 5), (2, b"12345678", 6)], "node bigint, prefix binary, at bigint"))
    assert alone.count() == 2


@pytest.mark.parametrize("similarity", [0, 50, 80, 100])
def test_near_pairs_compares_few_pairs_that_can_not_fit(monkeypatch, similarity):
    rng = np.random.default_rng(similarity)
    n, compared = 400, []
    size = np.sort(rng.integers(15, 25, n))
    position, parity, node = rng.integers(0, 5, n), rng.integers(0, 1 << 8, n).astype(np.uint64), rng.permutation(n)
    monkeypatch.setattr(line_module, "least_overlap", lambda a, b, s, f=line_module.least_overlap: compared.append(len(a)) or f(a, b, s))
    links = line_module.near_pairs(np.zeros(n, np.int64), np.full(n, -1), node, size, position, parity, [None] * n, similarity)
    joined, want = {int(x): int(x) for x in node}, {int(x): int(x) for x in node}

    def join(root, a, b):
        old, new = root[a], root[b]
        root.update({k: new for k, v in root.items() if v == old})

    for a, b in links:
        join(joined, a, b)
    for i in range(n):
        for j in range(i):
            need = overlap_module.least_overlap(int(size[i]), int(size[j]), similarity)
            if min(size[i] - position[i], size[j] - position[j]) >= need and int(parity[i] ^ parity[j]).bit_count() <= size[i] + size[j] - 2 * need and 100 * size[j] >= similarity * size[i]:
                join(want, int(node[i]), int(node[j]))
    groups = lambda root: {frozenset(k for k in root if root[k] == r) for r in root.values()}
    assert groups(joined) == groups(want)
    compared.clear()
    apart = rng.integers(0, 1 << 63, n).astype(np.uint64)
    line_module.near_pairs(np.zeros(n, np.int64), np.full(n, -1), node, size, position, apart, [None] * n, similarity)
    if similarity == 80:
        assert sum(compared) < n * (n - 1) / 5


def test_near_pairs_of_connected_lines_are_not_enumerated():
    """A block of near copies and some other lines: pairs within the copies' cluster are not even looked at."""
    n, looked = 3000, []
    node, size = np.arange(n), np.sort(np.r_[np.full(n - 50, 20), np.full(50, 24)])
    parity = np.where(np.arange(n) < n - 50, np.uint64(0), np.uint64((1 << 60) - 1))

    class Parts(np.ndarray):
        def __getitem__(self, i):
            looked.append(np.size(i))
            return np.asarray(self)[i]

    links = line_module.near_pairs(np.zeros(n, np.int64), np.full(n, -1).view(Parts), node, size, np.zeros(n, np.int64), parity, [None] * n, 80)
    assert sum(looked) < n * n / 10
    assert len(links) == n - 2 and not any((a < n - 50) != (b < n - 50) for a, b in links)


def test_whole_groups_of_batches():
    import pyarrow as pa

    keys = [0, 0, 1, 1, 1, 1, 1, 2, 3, 3, 4]
    for step in (1, 2, 3, 4, 11):
        batches = [pa.RecordBatch.from_pydict({"root": keys[i:i + step], "tile": [0] * len(keys[i:i + step])}) for i in range(0, len(keys), step)]
        tables = [t["root"].to_pylist() for t in line_module._whole_groups(iter(batches), ["root", "tile"])]
        assert sum(tables, []) == keys and all(tables)
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
    assert list(line_module._whole_groups(iter([]), ["root"])) == []


def test_order_of_tokens_and_their_cells():
    rng = np.random.default_rng(5)
    rank = line_module.by_rarity(rng.integers(0, 9, line_module.BUCKETS))
    # Words that differ in low bits only are ordered, too.
    words = (rng.integers(0, 1 << 12, 5000).astype(np.uint64) << np.uint64(50)) + rng.integers(0, 3, 5000).astype(np.uint64)
    line = np.sort(rng.integers(0, 40, 5000))
    for r in (rank, None):
        order = line_module._token_order(line, words, 1 << 20, r)
        ranks = np.zeros(5000, np.uint64) if r is None else r[line_module.bucket_of(words)]
        want = np.lexsort((words, ranks, line))
        assert (words[order] == words[want]).all() and (line[order] == line[want]).all()
    lengths = np.array([0, 3, 0, 2])
    cells = line_module._packed(words[:5], lengths)
    for part, tokens, n in ((cells, words[:5], lengths), (cells.slice(1), words[:5], lengths[1:]), (cells.slice(2), words[3:5], lengths[2:]), (cells.slice(4), words[:0], lengths[4:])):
        got = line_module._unpacked(part)
        assert got[0].tolist() == tokens.tolist() and got[1].tolist() == n.tolist()


def test_lines_of_any_length(sheet, corpus):
    short = ["Menu\nHome page\nA title", "menu\nHOME  page\na b c d", "a b c d e\ntitle a\n" + "word " * 40, "word\n\na b c e\nb c d a\na b c"]
    texts = corpus + short
    want = brute.removed_lines(list(enumerate(texts)), least=1)
    got = {r.row_id: list(r.removed_lines) for r in repeated_lines(sheet(texts), least_tokens=1).collect()}
    assert got == want
    assert [want[len(corpus) + i] for i in (1, 2, 3)] == [[0, 1], [0, 1], [0, 2, 3]]


@pytest.mark.parametrize("similarity", [50, 75, 100])
def test_short_lines_at_other_similarities(sheet, similarity):
    rng = random.Random(similarity)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    got = {r.row_id: list(r.removed_lines) for r in repeated_lines(sheet(texts), similarity=similarity, least_tokens=1).collect()}
    assert got == brute.removed_lines(list(enumerate(texts)), similarity, 1)


def test_parity_never_rules_out_similar_lines():
    rng = np.random.default_rng(2)
    for n in (90, 101, 130, 399, 401, 900, 1700, 7000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for cut in (1, 2, n // 20, n // 9):
            b = np.union1d(a[cut:], rng.integers(0, 1 << 63, cut).astype(np.uint64))
            apart = len(np.setxor1d(a, b))
            wa, wb = (line_module.wide_parity(x) if len(x) > line_module.LONG else None for x in (a, b))
            assert line_module.wide_apart(wa, wb) <= apart
    other = np.unique(rng.integers(0, 1 << 63, 1700).astype(np.uint64))
    assert line_module.wide_apart(line_module.wide_parity(np.unique(rng.integers(0, 1 << 63, 1700).astype(np.uint64))), line_module.wide_parity(other)) > 1700 * 2 / 9


def test_lines_of_repeated_and_missing_rows(sheet):
    line = "a line of some six words"
    rows = [(1, line), (1, line), (None, line + " more"), (2, line + "\n" + line)]
    got = {(r.row_id, r.kept) for r in repeated_lines(sheet(rows)).collect()}
    assert got == {(None, line + " more"), (1, ""), (2, "")}
    assert repeated_lines(sheet([])).collect() == []


def test_similar_rows(sheet, corpus):
    got = similar_rows(sheet(corpus, clash=True)).collect()
    assert {r.row_id: (r.n_ngrams, r.component_id) for r in got} == brute.groups(list(enumerate(corpus)))
    assert sum(r.is_first for r in got) == len({r.component_id for r in got})


def test_similar_rows_in_parts(sheet, corpus, monkeypatch):
    monkeypatch.setattr(overlap_module, "BLOCK_POINTS", 2)
    monkeypatch.setattr(overlap_module, "PART_TOKENS", 300)
    got = similar_rows(sheet(corpus)).collect()
    assert {r.row_id: (r.n_ngrams, r.component_id) for r in got} == brute.groups(list(enumerate(corpus)))


def test_first_of_similar(sheet):
    text = "one two three four five six"
    rows = [(3, text), (2, text.upper()), (2, text.upper()), (None, None), (5, ""), (5, ""), (7, "alone")]
    got = first_of_similar(sheet(rows, clash=True))
    assert sorted((r.row_id or -1, r.value or "") for r in got.collect()) == [(-1, ""), (2, text.upper()), (5, ""), (5, ""), (7, "alone")]
    assert first_of_similar(sheet([])).collect() == []


def test_trees_find_every_similar_pair(monkeypatch):
    monkeypatch.setattr(overlap_module, "GROUPS", ((20, 8), (60, 32), (None, 128)))
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in [*rng.integers(1, 80, 60), 19, 21, 22, 58, 62, 300]]
    sets += [np.union1d(s[: len(s) * 9 // 10], sets[0][:2]) for s in sets] + [s[1:] for s in sets if len(s) > 6]
    vectors, sizes = [overlap_module.count_vector(s) for s in sets], np.array([len(s) for s in sets])
    compared = set()
    overlap_module.spanning(vectors, sizes, None, 80, lambda i, j: compared.add(frozenset((i, j))))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in compared
    assert len(compared) < len(sets) ** 2 / 4


def test_full_counts_never_bound_too_low():
    full, some = np.full(8, 255, np.uint8), np.full(8, 3, np.uint8)
    assert overlap_module.overlap_bound(np.stack([full, some]), full).tolist() == [np.iinfo(np.int64).max, 24]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)]
    root = {x: x for e in edges for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_quality_counts_and_verdict(sheet, corpus):
    junk = ["&&& ".join(prose(i, 80).split()) for i in range(4)]
    marked = sheet(corpus + junk, clash=True).withColumn("trusted", F.col("row_id").between(10, 30))
    got = {r.row_id: r for r in quality_rules(marked, "trusted").collect()}
    for i, text in enumerate(corpus + junk):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality_counts(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert not any(got[len(corpus) + i].kept for i in range(4))
    assert got[13].kept and got[14].kept
    empty = quality_rules(sheet([]).withColumn("trusted", F.lit(True)), "trusted", carry=True)
    assert empty.collect() == []


def test_quality_ratios_are_those_of_the_words(sheet, monkeypatch):
    """Scores by exact counts: no word shares its counts with another, however many there are."""
    from gridwright.llm import frames, quality

    # Over 40,000 distinct words and pairs; trusted rows are 0 to 99.
    texts = [" ".join(f"{'ok' if i < 100 or i > 180 else 'no'}{(7 * i + j) % 900 if j % 2 else 1000 * i + j}" for j in range(150)) for i in range(200)] + [None, "one"]
    counts, good = collections.Counter(), collections.Counter()
    grams = [[*w, *zip(w, w[1:])] for w in ((t or "").split() for t in texts)]
    for i, g in enumerate(grams):
        counts.update(g)
        good.update(g if i < 100 else ())
    share = good.total() / counts.total()
    want = [np.mean([np.log((good[x] / share + 16) / (counts[x] + 16)) for x in g]) if g else 0 for g in grams]
    marked = sheet(texts, clash=True).withColumn("trusted", F.col("row_id") < 100)
    for limit in (32 << 20, 0):
        monkeypatch.setattr(frames, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(quality, "HOT", 1 << 12)
        got = {r.row_id: r for r in quality_rules(marked, "trusted").collect()}
        assert len(counts) > 2 * (1 << 14) and len(got) == len(texts)
        assert np.allclose([got[i].score for i in range(len(texts))], want, atol=1e-5)
    assert {r.score for r in quality_rules(marked.withColumn("trusted", F.lit(None)), "trusted").collect()} == {0.0}


def test_quality_scores_keep_no_row_per_gram(sheet, monkeypatch):
    """Hot n-grams and every range of the others give the scores of exact counts; what is stored grows with the cells, not with their n-grams."""
    from gridwright.llm import quality

    texts = [" ".join(f"{'ok' if i < 30 else 'no'}{(7 * i + j) % 90 if j % 2 else 1000 * i + j}" for j in range(150)) for i in range(80)] + [None, " \n", "one", " two\n", "two"]
    trusted = [i < 30 or i == 83 for i in range(len(texts))]
    grams = [[*w, *zip(w, w[1:])] for w in ((t or "").split() for t in texts)]
    counts, good = collections.Counter(x for g in grams for x in g), collections.Counter(x for g, t in zip(grams, trusted) if t for x in g)
    share = good.total() / counts.total()
    want = [np.mean([np.log((good[x] / share + 16) / (counts[x] + 16)) for x in g]) if g else 0 for g in grams]
    stored, kept = quality.stored, []
    monkeypatch.setattr(quality, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    monkeypatch.setattr(quality, "HOT", 1 << 10)
    marked = sheet(texts, clash=True).withColumn("trusted", F.col("row_id").isin([i for i, t in enumerate(trusted) if t]))
    for part, one_pass in ((1, 0), (1, 1 << 21), (1 << 40, 0)):
        monkeypatch.setattr(quality, "HOT_PART", part, raising=False)
        monkeypatch.setattr(quality, "ONE_PASS", one_pass, raising=False)
        kept.clear()
        got = {r.row_id: r.score for r in quality_rules(marked, "trusted").collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-5)
        assert len(counts) > 10_000 and max(df.count() for df in kept) < 2_000


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    from gridwright.llm import frames

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")

    before, key = set(files().split("\n")), spark.conf.get(frames.CLEANUP_KEY, None)
    with frames.shuffles_removed(spark):
        spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{tmp_path}/out")
    assert spark.conf.get(frames.CLEANUP_KEY, None) == key
    for _ in range(100):
        left = [x for x in set(files().split("\n")) - before if "shuffle" in x]
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_differencing_is_near_even():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 129) for _ in range(500)]
    groups = differencing(sizes, 32)
    assert sorted(i for g in groups for i in g) == list(range(500))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 4
    assert differencing([], 3) == [[], [], []]
    # More windows than the sum needs, as two large ones do not fit together.
    assert len(windows([700, 700, 700], 1024)) == 3


def test_packing_round_trip(sheet, corpus):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    texts = corpus + [prose(5, 4000), "<|endoftext|> emoji 🎉 naïve"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    pieces = pack_cells(sheet(texts, clash=True), path, public_tokenizers.PATTERN).collect()
    ids = {i: [] for i in range(len(texts))}
    for p in sorted(pieces, key=lambda p: (p.row_id, p.start)):
        assert len(ids[p.row_id]) == p.start
        ids[p.row_id] += np.frombuffer(p.ids, "<u4").tolist()
        assert p.length * 4 == len(p.ids)
    for i, text in enumerate(texts):
        assert ids[i] == other.encode(text or "", add_special_tokens=False).ids + [0]
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.window_id, p.offset)):
        assert filled.get(p.window_id, 0) == p.offset
        filled[p.window_id] = p.offset + p.length
    assert max(filled.values()) <= 1024
    assert pack_cells(sheet([]), path, public_tokenizers.PATTERN).collect() == []


def test_ids_of_added_tokens_and_very_long_runs(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from gridwright.llm.queries import op5_packing

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "x" + " " * 1_200_000 + "y", "a" * 130_000 + " \n" * 70_000, " " * 131_000 + "z", "plain 1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tokenizers.Tokenizer.from_file(path)
    want = {i: np.array([*other.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert want[0].tolist() == [64, 220, 50256, 275, 0]
    pieces = op5_packing(spark, str(tmp_path)).collect()
    for p in pieces:
        assert p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start:p.start + p.length].tobytes())
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in want} == {i: len(x) for i, x in want.items()}


def test_packing_leaves_little_padding(sheet):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = [prose(i, 50 + 37 * (i % 40)) for i in range(400)]
    pieces = pack_cells(sheet(texts).coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    tokens, count = sum(p.length for p in pieces), len({p.window_id for p in pieces})
    assert tokens / (1024 * count) > 0.98


def test_shards(sheet, corpus):
    texts = corpus + [prose(i, 80) for i in range(300)]
    rows = shard_rows(sheet(texts, clash=True), 4).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    by_text, loads = {}, [0] * 4
    for r in rows:
        assert (r.size, r.text_crc32) == (size[r.row_id], zlib.crc32((texts[r.row_id] or "").encode()))
        assert by_text.setdefault(texts[r.row_id] or "", r.shard) == r.shard
        loads[r.shard] += r.size
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert max(loads) <= 1.01 * sum(loads) / 4
    assert shard_rows(sheet([]), 4).collect() == []


def test_a_new_shard_moves_little():
    rng = random.Random(3)
    loads = {rng.randrange(1 << 16): rng.randrange(1, 100) for _ in range(20_000)}
    before, after = place_loads(loads, 8), place_loads(loads, 9)
    moved = sum(loads[p] for p in loads if before[p] != after[p]) / sum(loads.values())
    assert moved < 0.35  # dealt anew at random, 8/9 would move
    held = [sum(loads[p] for p in loads if after[p] == s) for s in range(9)]
    assert max(held) <= 1.01 * sum(held) / 9
    assert place_loads({5: 1000, 9: 1}, 2) and place_loads({}, 3) == {}


def test_toxicity_on_held_out_rows(sheet, spark):
    rng = random.Random(8)
    texts = [prose(i, 60) + (" " + rng.choice(["vile", "nasty", "awful"]) + rng.choice(["", "ly", "ness"]) if i % 4 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "row_id bigint, label int")
    weights = fit(sheet(texts, clash=True), labels)
    assert len(weights[0]) < 2000
    scores = {r.row_id: r.score for r in toxicity_scores(sheet(texts + [None, ""], clash=True), weights).collect()}
    right = [(scores[i] >= 0.3) == (i % 4 == 0) for i in range(400, 600)]
    assert np.mean(right) > 0.97
    assert scores[600] == scores[601] < 0.3
    none = fit(sheet(texts), labels.filter("row_id < 0"))
    assert {r.score for r in toxicity_scores(sheet(["a", None]), none).collect()} == {0.5}
    assert toxicity_scores(sheet([]), weights).collect() == []


def test_fit_reads_the_sheet_in_parallel(sheet, spark, monkeypatch):
    import gridwright.llm.toxicity as toxicity

    parts, real = [], toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or real(df, name))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id bigint, label int")
    toxicity.fit(sheet([f"text {i}" for i in range(40)]).repartition(4), labels)
    assert parts == [("fit-rows", 4)]


def test_archives_round_trip(sheet, spark, tmp_path):
    rows = [(i, f"http://a.example/{i} ü", "<p>" + prose(i % 7, 50) + "</p>") for i in range(40)]
    rows += [(50, None, None), (51, "x", ""), (None, "x", rows[0][2]), (60, "y", "P*M\x18\0\0\0\0 ü 🎉")]
    df = spark.createDataFrame(rows, "row_id bigint, url string, value string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    write_archives(df.repartition(3), str(tmp_path / "a"))
    got = read_archives(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    holder = {}
    for key, _, html in rows:
        if key is not None:
            holder[html or ""] = max(key, holder.get(html or "", -1))
    for r in got:
        key = None if r.row_id is None else int(r.row_id)
        html = next(h or "" for k, _, h in rows if k == key)
        if key is None or holder[html] == key:
            assert (r.record_type, r.refers_to, bytes(r.payload).decode()) == ("response", None, html)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", str(holder[html]), None)
        assert r.payload_bytes == len(html.encode())
    whole = next((tmp_path / "a").glob("part-*"))
    data = whole.read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    with pytest.raises(ValueError):
        list(records_of(data[:-20]))
    record = next(records_of(data))
    assert parse_record(record)
    with pytest.raises(ValueError):
        parse_record(record.replace(b"<p>", b"<q>") if b"<p>" in record else record + b"x")


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "row_id bigint, url string, value string")
    write_archives(df, str(tmp_path / "b"), least_bytes=5)
    assert {r.record_type for r in read_archives(spark, str(tmp_path / "b")).collect()} == {"response"}


def test_ledger(spark, tmp_path):
    keys, path = ["source", "lang", "version"], str(tmp_path)
    rows = spark.createDataFrame([("a", "en", "v1", 3, "v2", 4), ("a", "en", "v1", 5, "v2", 5), (None, "de", "v1", None, "v2", 1)], "source string, lang string, version string, tokens int, new_version string, new_tokens int")
    assert rollups.commit(rollups.inserts(rows, keys, "tokens"), path, "load/1", keys)
    assert not rollups.commit(rollups.inserts(rows, keys, "tokens"), path, "load/1", keys)
    first = {tuple(r) for r in rollups.totals(spark, path, ["load/1"], keys).collect()}
    assert first == {("a", "en", "v1", 2, 8), (None, "de", "v1", 1, 0)}
    rollups.commit(rollups.deletes(rows.filter("tokens = 3"), keys, "tokens"), path, "out", keys)
    rollups.commit(rollups.revisions(rows.filter("tokens = 5"), keys, "tokens", ["source", "lang", "new_version"], "new_tokens"), path, "again", keys)
    rollups.commit(rollups.inserts(rows.limit(0), keys, "tokens"), path, "nothing", keys)
    for order in (["load/1", "out", "again", "nothing"], ["again", "nothing", "out", "load/1", "out"]):
        assert {tuple(r) for r in rollups.totals(spark, path, order, keys).collect()} == {("a", "en", "v2", 1, 5), (None, "de", "v1", 1, 0)}


def test_an_unfinished_batch_is_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3)], "source string, tokens int")
    broken = tmp_path / "batch-x"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("cut off")
    with pytest.raises(ValueError):
        rollups.totals(spark, str(tmp_path), ["x"], ["source"])
    assert rollups.commit(rollups.inserts(rows, ["source"], "tokens"), str(tmp_path), "x", ["source"])
    assert [tuple(r) for r in rollups.totals(spark, str(tmp_path), ["x"], ["source"]).collect()] == [("a", 1, 3)]


