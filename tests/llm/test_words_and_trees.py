"""Spelling variants, byte-pair ids and manifests against plain versions, on cells with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridwright.llm import column_words, decode_cells, encode_cells, sheet_manifest, spelling_variants
from gridwright.llm import bytepairs, manifest, spelling
from gridwright.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants -----------------------------------------------------------

def plain_words(cells, slip=None):
    seen = collections.Counter()
    for key, cell in cells:
        for word in re.findall("[A-Za-zÀ-ÿ]+", cell or ""):
            word = word.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and h % slip == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            seen[word] += 1
    return dict(seen)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(words, length=6, count=5, ratio=5):
    words = {w: n for w, n in words.items() if len(w) >= length and n >= count}
    out = {}
    for w, n in words.items():
        beside = sorted(((-m, x) for x, m in words.items() if near(w, x)))
        form = beside[0][1] if beside and -beside[0][0] >= ratio * n else None
        out[w] = [form, n, len(beside), words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def test_words_of_cells(sheet):
    cells = [(1, "Élan élan ÉLAN élan"), (1, "Élan élan ÉLAN élan"), (2, None), (3, ""), (4, "x×y÷z a-b_c9d ＡＢ"), (None, "Only Ascii folds: ÀÉ àé"), (5, "word " * 5000)]
    got = {r.word: r.n for r in column_words(sheet(cells, clash=True)).collect()}
    assert got == plain_words(cells)
    slipped = {r.word: r.n for r in column_words(sheet(cells, clash=True), slip=3).collect()}
    assert slipped == plain_words(cells, 3) and slipped != got
    assert column_words(sheet([])).collect() == []


def variant_words(seed, alphabet, n):
    """Words with variants in all places, at all ratios of counts, in chains of several steps."""
    rng, words = random.Random(seed), {}
    for _ in range(n):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 12)))
        count = rng.choice([1, 4, 5, 6, 30, 700, 4000])
        for _ in range(rng.randrange(1, 6)):
            words[word] = count
            i, how = rng.randrange(len(word) + 1), rng.randrange(3)
            word = word[:i] + ("" if how == 0 else rng.choice(alphabet)) + word[i + (how != 2):]
            count = max(1, count // rng.choice([1, 4, 5, 6]))
    return words


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdeé"), (3, "abcdefghijklmnopqrstuvwxyzçñ"), (4, "a")])
def test_variants_are_complete(spark, seed, alphabet):
    words = variant_words(seed, alphabet, 220)
    words.update({"ÿ" * (6 + k): 10 * 5 ** k for k in range(5)})
    rows = [(w, n, "x", 1) for w, n in words.items()]
    split = [(w, n - n // 2, "x", 1) for w, n, *_ in rows] + [(w, n // 2, "x", 1) for w, n, *_ in rows] + [(None, 9, "x", 1)]
    df = spark.createDataFrame(split, "word string, n bigint, near string, key int")
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling_variants(df).collect()}
    assert got == plain_variants(words)
    assert got["ÿ" * 6][4] == "ÿ" * 10


def test_variants_of_no_words_and_bounds(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n bigint")).collect() == []
    for bad in ({"least_length": 3}, {"ratio": 1}):
        with pytest.raises(ValueError):
            spelling_variants(spark.createDataFrame([], "word string, n bigint"), **bad)


def test_postings_are_not_broadcast(spark, tmp_path):
    """Spark sizes the postings by the file of words; measured by rows they are dozens of times as many."""
    spark.createDataFrame([(w, 9) for w in ("abcdefgh", "abcdefgi", "bcdefgh", "zyxwvuts")], "word string, n bigint").write.parquet(str(tmp_path / "words"))
    found = spelling.near_words(spark.read.parquet(str(tmp_path / "words")))
    pairs = {(r.word, r.near) for r in found.collect()}
    assert pairs == {p for a, b in (("abcdefgh", "abcdefgi"), ("abcdefgh", "bcdefgh")) for p in ((a, b), (b, a))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pivots_are_the_cheapest_pair_that_does_not_overlap():
    rng = random.Random(6)
    for _ in range(300):
        grams = sorted((rng.randrange(9), i) for i in rng.sample(range(12), rng.randrange(3, 9)))
        chosen = spelling.pivots(grams)
        cost = {i: o for o, i in grams}
        assert chosen[1] - chosen[0] >= 2
        assert sum(cost[i] for i in chosen) == min(cost[i] + cost[j] for i in cost for j in cost if j - i >= 2)


# --- byte pairs ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {bytepairs.base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "Hello world's 123,456 don't\n\n  x\t", "naïve Straße œuvre", "日本語のテキスト 東京 1２３", "emoji 👩‍👩‍👧 🏳️‍🌈 é é", "<|endoftext|> is text",
    "a b c　​d", "ⅷ ½ ² ١٢٣ กำ", "\x00\x01\x1f\x7f", "x" * 5000, "ab" * 3000, "\r\n \r\n", "the " * 3000, "\U00031350 \U0001e4d0 \U000323b0\U0002ebf0 Ᲊ Ɤ",
]


def test_ids_are_those_of_the_library(sheet, library):
    rng = random.Random(4)
    letters = "aeiou tns.,'\n é ß 1 中文 ж"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + ["aaaa", "aaaa"]
    encoded = encode_cells(sheet(texts, clash=True), RANKS, public_tokenizers.PATTERN)
    rows = {r.row_id: list(r.token_ids) for r in encoded.collect()}
    assert rows == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.row_id: bytes(r.cell).decode() for r in decode_cells(encoded, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    empty = decode_cells(encoded.limit(1).select("row_id", F.lit(None).cast("array<int>").alias("token_ids")), RANKS).collect()
    assert [bytes(r.cell) for r in empty] == [b""]
    assert encode_cells(sheet([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_a_million_spaces_make_one_word(sheet):
    text = "a" + " " * 1_000_000 + "b"
    encoded = encode_cells(sheet([text]), RANKS, public_tokenizers.PATTERN)
    assert bytes(decode_cells(encoded, RANKS).first().cell).decode() == text


def test_classes_of_code_points_are_those_of_the_library():
    """A letter joins a letter before it, a number a number, and nothing else joins either."""
    split = bytepairs.splitter(public_tokenizers.PATTERN)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for lead in "a1":
        ranks = dict.fromkeys([bytes([b]) for b in range(256)] + [(lead + c).encode() for c in points])
        asked = tiktoken.Encoding("classes" + lead, pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
        found = asked.encode_ordinary_batch([lead + c for c in points], num_threads=4)
        wrong = [hex(ord(c)) for c, ids in zip(points, found) if (len(ids) == 1) != (len(split(lead + c)) == 1)]
        assert wrong == []


def plain_merges(word, ids):
    """The lowest rank first, the leftmost of equal ones, one merge at a time."""
    parts = [bytes([b]) for b in word]
    while True:
        ranked = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not ranked:
            return tuple(ids[p] for p in parts)
        _, i = min(ranked)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_replay_with_any_ranks(seed):
    """Ranks in no order of training: a merge may make a pair that comes earlier."""
    rng = random.Random(seed)
    tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
    rng.shuffle(tokens)
    ids = {bytes([b]): i for i, b in enumerate(range(256))} | {t: 256 + i for i, t in enumerate(tokens)}
    made = {ids[t[:k]] << 20 | ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [b"a" * 40]
    got = bytepairs.replay(words, bytepairs.Vocabulary(ids, made))
    assert list(map(tuple, got)) == [plain_merges(w, ids) for w in words]


def test_query_of_byte_pairs(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS cell", "2 AS token_ids").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_byte_pairs"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


# --- manifest ------------------------------------------------------------------------

def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest(levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_digest(cells):
    return manifest.digest(["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])


def plain_manifest(rows, edit):
    """Whole trees, built anew for every edited row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, plain_digest(r)))

    def roots(leaves):
        groups = {}
        for r, leaf in zip(rows, leaves):
            groups.setdefault(r[1], []).append(leaf)
        trees = {g: plain_tree(x) for g, x in groups.items()}
        return trees, plain_tree([t[-1][0] for t in trees.values()])

    leaves = [plain_digest(r) for r in rows]
    trees, top = roots(leaves)
    out, place = [], collections.Counter()
    for k, r in enumerate(rows):
        siblings, i = [], place[r[1]]
        place[r[1]] += 1
        for tree, start in ((trees[r[1]], i), (top, list(trees).index(r[1]))):
            for level in tree[:-1]:
                first = start // 8 * 8
                siblings += [x for j, x in enumerate(level[first:first + 8], first) if j != start]
                start //= 8
        other = edit(r)
        version = top[-1][0] if other is None else roots([*leaves[:k], plain_digest(other), *leaves[k + 1:]])[1][-1][0]
        out.append((r[0], leaves[k], trees[r[1]][-1][0], top[-1][0], siblings, version, version == top[-1][0]))
    return out


@pytest.mark.parametrize("block", [(8, 1), (8, 4)])
def test_manifest_against_whole_trees(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block[0] ** block[1])
    monkeypatch.setattr(manifest, "LEVELS", block[1])
    rng = random.Random(3)
    sizes = {None: 3, "": 1, "Z": 8, "a": 9, "é": 1, "hot": 150, **{f"g{i:02}": 1 for i in range(12)}}
    rows = [(None if rng.random() < 0.03 else i, g, rng.choice([None, "", "Same", "É x", "Text " * 50])) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    rows += [rows[30], rows[30], (rows[40][0], rows[40][1], "other")]
    rng.shuffle(rows)

    def edit(r):
        if r[0] is None or r[0] % 3:
            return None
        return (*r[:2], r[2] and r[2].translate(FOLD))

    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "row_id bigint, category string, value string, place int, part string, n int")
    got = sheet_manifest(df, ["row_id", "category", "value"], edits={"value": F.translate("value", "TSE", "tse")}, edited=F.col("row_id") % 3 == 0)
    got = [(r.row_id, r.leaf, r.subroot, r.root, list(r.siblings), r.version_root, r.verified) for r in got.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows, edit)))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_no_rows_and_of_one(spark):
    schema = "row_id bigint, category string, value string"
    assert sheet_manifest(spark.createDataFrame([], schema), ["row_id", "value"]).collect() == []
    one = sheet_manifest(spark.createDataFrame([(7, None, "x")], schema), ["row_id", "value"]).collect()
    assert [(r.leaf == r.subroot == r.root == r.version_root, r.siblings, r.verified) for r in one] == [(True, [], True)]
    with pytest.raises(ValueError):
        sheet_manifest(spark.createDataFrame([], schema), ["value"], edits={"category": F.lit("x")}, edited=F.lit(True))


def test_a_version_copies_the_ancestors_only():
    leaves = [manifest.digest([str(i)]) for i in range(500)]
    tree = manifest.Tree(leaves)
    version = tree.edited(77, "other")
    assert sorted(version.copied) == [(0, 77), (1, 9), (2, 1), (3, 0)]
    again = version.edited(400, "third")
    assert again.levels is tree.levels
    for made, changed in ((version, {77: "other"}), (again, {77: "other", 400: "third"})):
        whole = manifest.Tree([changed.get(i, x) for i, x in enumerate(leaves)])
        assert all(made.node(level, i) == x for level, nodes in enumerate(whole.levels) for i, x in enumerate(nodes))
        assert made.root == whole.root != tree.root
    assert manifest.folded("other", tree.path(77)) == version.root


def test_a_workers_tasks_share_the_words_they_found(monkeypatch):
    """Each task found the ids of all its words anew."""
    held = bytepairs.held_words("ranks of this test", "pattern")
    assert held is bytepairs.held_words("ranks of this test", "pattern")
    monkeypatch.setattr(bytepairs, "HELD_WORDS", 2)
    assert held.missing([["a", "b", "a"], []]) == {"a", "b"}
    held.now.update(a=b"1", b=b"2")
    assert held.missing([["a", "b", "c"]]) == {"c"}
    held.now.update(c=b"3")
    assert held.missing([["b", "d"]]) == {"d"} and held.now == {"b": b"2"}
    held.now.update(d=b"4", e=b"5")
    assert held.missing([["a", "b", "d"]]) == {"a"} and held.now == {"b": b"2", "d": b"4"}
