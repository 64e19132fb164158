"""Approximate keys against brute force: all lengths, shared heads, hot signatures, slow assignments."""

import random

import pytest
from pyspark.sql import functions as F

from gridwright.operators import fuzzy as Z

from .test_operators import one_by_one, score, values


def changed(rng, key, edits, letters):
    key = list(key)
    for _ in range(edits):
        i = rng.randrange(len(key) + 1)
        if rng.random() < 0.4 and i < len(key):
            key[i] = rng.choice(letters)
        elif rng.random() < 0.5 and i < len(key) and len(key) > 2:
            del key[i]
        else:
            key.insert(i, rng.choice(letters))
    return "".join(key)


def one_column(spark, keys, name):
    return spark.createDataFrame([(k,) for k in keys], f"{name} string")


@pytest.fixture(scope="module", params=["ab", "acgtéü", "abcdefghijklmnopqrstuvwxyz0123456789"])
def long_keys(request):
    """Lengths 3 to 200 with all numbers of edits up to twice what the threshold allows."""
    rng, letters = random.Random(len(request.param)), request.param
    sizes = [3, 4, 6, 7, 8, 13, 14, 20, 31, 32, 33, 47, 63, 64, 65, 90, 128, 200]
    right = sorted({"".join(rng.choice(letters) for _ in range(n)) for n in sizes for _ in range(2)})
    right += [right[-1][:25] + str(i) for i in range(30)]
    left = {changed(rng, k, rng.randrange(0, max(2, len(k) // 3)), letters) for k in right for _ in range(2)}
    return sorted(left), right


@pytest.mark.parametrize("threshold,salted", [(0.75, False), (0.85, True), (0.95, False)])
def test_segments_find_every_similar_pair(spark, long_keys, threshold, salted):
    left, right = long_keys
    got = Z.similar_pairs(one_column(spark, left, "lkey"), one_column(spark, right, "rkey"), threshold, salted)
    want = {(a, b): score(a, b) for a in left for b in right if a != b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and score(a, b) >= threshold - 1e-9}
    assert {(a, b): pytest.approx(s) for a, b, s in values(got, "lkey", "rkey", "score")} == want
    assert want


def test_characters_find_every_similar_pair_of_long_keys(spark, long_keys):
    left, right = ([k for k in keys if len(k) < 66][::2] for keys in long_keys)
    got = Z.similar_pairs(one_column(spark, left, "lkey"), one_column(spark, right, "rkey"), 0.6)
    want = {(a, b) for a in left for b in right if a != b and score(a, b) >= 0.6 - 1e-9}
    assert set(values(got, "lkey", "rkey")) == want


def test_few_candidates_among_long_unrelated_keys(spark):
    rng = random.Random(9)
    draw = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(110, 131)))
    right = [draw() for _ in range(300)]
    left = [changed(rng, k, 9, "xyz") for k in right[:60]] + [draw() for _ in range(240)]
    pairs = Z._segment_candidates(one_column(spark, left, "lkey"), one_column(spark, right, "rkey"), 0.85, False)
    assert 60 <= pairs.count() < 0.01 * len(left) * len(right)


def test_hot_signatures_are_salted_and_lose_nothing(spark):
    keys = spark.range(800).select(F.format_string("north depot shelf %04d", "id").alias("rkey"))
    probes = spark.range(60).select(F.format_string("north depot shelf %04dx", F.col("id") * 13).alias("lkey"))
    plain, salted = (Z.similar_pairs(probes, keys, 0.9, s) for s in (False, True))
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


@pytest.mark.parametrize("threshold", [0.75, 0.95])
def test_groups_of_one_head_lose_no_similar_pair(spark, long_keys, threshold):
    left, right = (one_column(spark, keys, name) for keys, name in zip(long_keys, ("lkey", "rkey")))
    plain, grouped = (Z.similar_pairs(left, right, threshold, s) for s in (False, True))
    assert set(values(grouped, "lkey", "rkey")) == set(values(plain, "lkey", "rkey"))


def test_keys_of_another_head_meet_no_key_of_a_common_one(spark):
    """Their shared middle made every pair a candidate."""
    keys = spark.range(500).select(F.format_string("supplier#%09d", "id").alias("rkey"))
    probes = spark.range(500).select(F.format_string("zzpplier#%09dzz", "id").alias("lkey"))
    near = probes.limit(20).unionByName(spark.createDataFrame([("supplier#000000007zz",)], "lkey string"))
    assert Z._segment_candidates(probes, keys, 0.85, True).count() == 0
    assert Z.similar_pairs(near, keys, 0.85, True).filter("lkey = 'supplier#000000007zz' AND rkey = 'supplier#000000007'").count() == 1


def test_best_similar_prefers_one_edit_and_earlier_rows(spark):
    right = [("abcdefghij", 3), ("abcdefghik", 1), ("abcdefgh", 2), ("xy", 4), ("abcdefghijkl", 5)]
    got = Z.best_similar(one_column(spark, ["abcdefghix", "abcdefghi", "zz", "", "bcdefghijkl"], "lkey"), spark.createDataFrame(right, "rkey string, rorder int"))
    assert dict(values(got, "lkey", "rkey")) == {"abcdefghix": "abcdefghik", "abcdefghi": "abcdefghik", "bcdefghijkl": "abcdefghijkl"}


@pytest.mark.parametrize("salted", [False, True])
def test_contained_keys_against_brute_force(spark, salted):
    rng = random.Random(17)
    outer = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 30))) for _ in range(120)})
    inner = sorted({k[i:i + n] for k in outer for i, n in ((rng.randrange(20), rng.randrange(1, 9)),)} | {"a", "é", "zz", ""})
    got = Z._contained(one_column(spark, inner, "rkey"), "rkey", one_column(spark, outer, "lkey"), "lkey", salted)
    want = sorted((a, b) for a in inner for b in outer if a and a != b and a in b)
    assert sorted(values(got, "rkey", "lkey")) == want


def test_contained_in_keys_of_ten_thousand_characters(spark):
    rng = random.Random(18)
    long = ["".join(rng.choice("abcdefgh") for _ in range(10_000)) for _ in range(3)]
    inner = [long[0][5000:5040], long[1][-12:], long[2][:7000], "h", "nowhere"]
    got = Z._contained(one_column(spark, inner, "rkey"), "rkey", one_column(spark, long, "lkey"), "lkey", True)
    assert sorted(values(got, "rkey", "lkey")) == sorted((a, b) for a in inner for b in long if a in b)


@pytest.mark.parametrize("size", [1, 4, 30])
def test_assignment_in_blocks_equals_going_through_the_values(spark, monkeypatch, size):
    """Every block size gives the sequential outcome, for values that all contend for the same targets, too."""
    monkeypatch.setattr(Z, "SEQUENTIAL_ROWS", size)
    rng = random.Random(size)
    right = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(18)))
    left = list(dict.fromkeys([changed(rng, rng.choice(right), rng.randrange(0, 2), "ab") for _ in range(14)]))
    lf, rf = (spark.createDataFrame(list(enumerate(x)), "o int, k string") for x in (left, right))
    got = Z.key_mapping(lf, "k", rf, "k", ["o"], ["o"], one_to_one=True).collect()
    assert len(got) == len(left)
    assert {r.source: r.target for r in got} == one_by_one(left, right)


def test_assignment_of_equal_values_shares_its_target(spark):
    lf = spark.createDataFrame([(1, "Steel rod"), (2, "STEEL ROD"), (3, "steel")], "o int, k string")
    rf = spark.createDataFrame([(1, "steel rod")], "o int, k string")
    got = {r.source: (r.target, r.phase) for r in Z.key_mapping(lf, "k", rf, "k", ["o"], ["o"], one_to_one=True).collect()}
    assert got == {"Steel rod": ("steel rod", 1), "STEEL ROD": ("steel rod", 1), "steel": (None, None)}
