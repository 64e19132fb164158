"""Operators on small literal tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F, types as T

from gridwright.operators import audit as A
from gridwright.operators import checks as C
from gridwright.operators import findings as R
from gridwright.operators import fuzzy as Z
from gridwright.operators import quality as Q
from gridwright.operators.aggregates import aggregate, column_total, with_countif, with_sumif
from gridwright.operators.cleaning import clean, clean_counts
from gridwright.operators.duplicates import duplicate_rows
from gridwright.operators.lookups import lookup, lookup_chain, lookup_stats, stack_tables, zip_tables
from gridwright.operators.ordering import dedup, dedup_counts, duplicate_report, sort_rows, with_row_number
from gridwright.operators.pivots import TooManyColumns, pivot_table
from gridwright.operators.predicates import cond, delete_where, filter_date_range, filter_rows
from gridwright.operators.profiling import column_samples, profile, profile_globals
from gridwright.operators.shaping import chain, rename_columns, shape, with_titles
from gridwright.operators.skew import hot_keys
from gridwright.operators.updates import apply_edits, set_where


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


#: Wells: id, name, field, depth in metres (whole, negative, huge, missing), flow (text, as logged).
WELLS = [
    (10, "Anna-1", "north", 120.5, "7"), (11, "anna-2", "NORTH", 0.0, "7.0"), (12, "Bora 3", "delta", -4.25, "n/a"),
    (13, "", "delta", 9e15, "12"), (14, "Cleo", "", 120.5, ""), (15, None, None, None, None), (16, "Ánna-3", "north ridge", 33.0, "-3"),
    (17, "Dirk_9%", "delta", 120.5, " 8 "), (18, "Eve", "south", 2.0, "1e2"), (19, "Faye", "south", 4.0, "70"), (20, "Gus", "South", 8.0, "700"),
]


@pytest.fixture(scope="module")
def wells(spark):
    return spark.createDataFrame(WELLS, "id int, name string, field string, depth double, flow string")


def test_conditions(wells):
    ids = lambda *c, **k: sorted(r.id for r in filter_rows(wells, list(c), **k).collect())
    plain = lambda rule: sorted(w[0] for w in WELLS if rule(w))
    assert ids(cond("field", "EQ", "north")) == [10, 11]  # case is folded, parts do not count
    assert ids(cond("field", "CONTAINS", "north")) == [10, 11, 16]
    assert ids(cond("name", "STARTS_WITH", "ANNA")) == [10, 11]
    assert ids(cond("name", "ENDS_WITH", "9%")) == [17]
    assert ids(cond("depth", "GTE", 120.5)) == plain(lambda w: w[3] is not None and w[3] >= 120.5)
    assert ids(cond("depth", "LT", 0)) == [12]
    assert ids(cond("depth", "BETWEEN", (0, 33))) == plain(lambda w: w[3] is not None and 0 <= w[3] <= 33)
    assert ids(cond("flow", "GT", 7)) == [12, 13, 17, 18, 19, 20]  # by number where both are numbers, else by text
    assert ids(cond("id", "GT", other="depth")) == plain(lambda w: w[3] is not None and w[0] > w[3])
    assert ids(cond("name", "IS_NULL")) == [13, 15] and ids(cond("name", "NOT_NULL")) == plain(lambda w: w[1])
    assert 15 not in ids(cond("field", "NE", "south")) and len(ids(cond("field", "NE", "south"))) == 7
    many = [f"field {i}" for i in range(3000)]
    assert ids(cond("field", "IN", ["DELTA", *many])) == ids(cond("field", "IN", ["delta"])) == [12, 13, 17]
    assert ids(cond("field", "NOT_IN", ["delta", *many])) == ids(cond("field", "NOT_IN", ["delta"]))
    assert ids(cond("depth", "IN", ["8", 2, "4.0"])) == [18, 19, 20]


def test_first_logic_word_is_ignored_and_modes_differ(wells):
    """deep OR (south AND id over 18), against (deep OR south) AND id over 18."""
    conds = [cond("depth", "GT", 1e6, logic="AND"), cond("field", "EQ", "south", logic="OR"), cond("id", "GT", 18)]
    for first in ("AND", "OR"):
        conds[0] = cond("depth", "GT", 1e6, logic=first)
        assert sorted(values(filter_rows(wells, conds), "id")) == [19, 20]
        assert sorted(values(filter_rows(wells, conds, mode="groups"), "id")) == [13, 19, 20]


def test_delete_keeps_rows_that_can_not_be_compared(wells):
    left = values(delete_where(wells, [cond("depth", "GT", -100)]), "id")
    assert left == [15]


def test_date_range_on_text(frame):
    df = frame([("2024-01-05",), ("2024-01-15",), ("2024-02-01",), (None,)], "d string")
    assert values(filter_date_range(df, "d", "2024-01-01", "2024-01-31"), "d") == ["2024-01-05", "2024-01-15"]


def test_number_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filter_rows(orders, [cond("o_totalprice", "GT", 1000), cond("o_orderdate", "LT", "1999-01-01")]).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in text and "LessThan(o_or" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_titles_and_shape(wells):
    titled = with_titles(wells, {"depth": "Depth (m)", "field": "Oil field"})
    assert shape(titled, include=["Oil field", "id", "Depth (m)"], reorder=["depth"]).columns == ["depth", "id", "field"]
    assert rename_columns(titled, {"Depth (m)": "metres", "flow": "yield"}).columns == ["id", "name", "field", "metres", "yield"]
    out = chain(wells, lambda d: d.withColumn("_temp_depth", F.col("depth") * 2), (lambda d: d, {"exclude": ["NAME", "flow"]}))
    assert out.columns == ["id", "field", "depth"]


def test_sort_nulls_last_both_ways(frame):
    df = frame([(300.0,), (100.0,), (200.0,), (None,)], "v double")
    assert values(sort_rows(df, [("v", True)]), "v") == [100.0, 200.0, 300.0, None]
    assert values(sort_rows(df, [("v", False)]), "v") == [300.0, 200.0, 100.0, None]
    names = frame([("张",), ("阿",), ("李",)], "n string")
    assert values(sort_rows(names, [("n", True)], collation="zh"), "n") == ["阿", "李", "张"]


def test_totals(frame, wells):
    """Text that is no number takes no part in a column total, and all of it in none."""
    cells = ["3.5", "-1", "oil", None, "", "1e1"]
    assert column_total(frame([(c,) for c in cells], "v string"), "v").first()[:] == (12.5, 3)
    assert column_total(frame([("oil",), (None,)], "v string"), "v").first()[:] == (0.0, 0)
    got = aggregate(wells, [("depth", "SUM"), ("depth", "MAX", "deepest"), ("depth", "AVG", "mean"), ("id", "COUNT", "n")], ["field"])
    want = {}
    for _, _, field, depth, _ in WELLS:
        want.setdefault(field, []).append(depth)
    assert {r["field"]: (r["depth_合计"], r["deepest"], r["mean"], r["n"]) for r in got.collect() if r["field"]} == {
        k: (sum(v), max(v), sum(v) / len(v), len(v)) for k, v in want.items() if k}
    assert {r["n"] for r in got.collect() if not r["field"]} <= {1, 2}
    deep = with_countif(with_sumif(wells, "total", F.col("field") == "delta", "depth"), "dry", F.col("flow").isin("n/a", ""))
    assert {(r["total"], r["dry"]) for r in deep.collect()} == {(9e15 + 120.5 - 4.25, 2)}


def test_pivot(frame):
    df = frame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", None), ("b", "y", 4.0)], "r string, c string, v double")
    rows = {r["r"]: (r["_pvt_(blank)"], r["_pvt_x"], r["_pvt_y"]) for r in pivot_table(df, ["r"], "v", "AVG", "c").collect()}
    assert rows == {"a": (2.0, 1.0, 0.0), "b": (0.0, 0.0, 4.0), "合计": (2.0, 1.0, 4.0)}
    with pytest.raises(TooManyColumns):
        pivot_table(df, ["r"], "v", "SUM", "c", max_columns=2)


def test_lookup(frame):
    left = frame([(1, " Ａ1"), (2, "b2"), (3, ""), (4, None)], "id int, k string")
    right = frame([(9, "a1", "late"), (1, "A 1", "first"), (2, "", "blank")], "o int, k string, v string")
    out = lookup(left, right, "k", ["o"], flag="hit")
    assert sorted(values(out, "id", "_lkp_v", "hit")) == [(1, "first", True), (2, None, False), (3, None, False), (4, None, False)]
    assert lookup_stats(out, "hit").first()[:] == ("hit", 1, 3, 0.25)


def test_composite_keys_of_blanks_do_not_match(frame):
    left = frame([(1, "", ""), (2, "x", "")], "id int, a string, b string")
    right = frame([("", "", "no"), ("X", " ", "yes")], "a string, b string, v string")
    assert dict(values(lookup(left, right, ["a", "b"]), "id", "_lkp_v")) == {1: None, 2: "yes"}


def test_chain_numbers_equal_names(frame):
    main, one, two = frame([(1,)], "id int"), frame([(1, "a")], "id int, v string"), frame([(1, "b")], "id int, v string")
    out = lookup_chain(main, [(one, None, ["v"]), (two, "id", ["v"]), (frame([(1,)], "z int"), None, ["z"])])
    assert out.first().asDict() == {"id": 1, "_lkp_v": "a", "_lkp_v_2": "b"}


def test_zip_and_stack(frame):
    a, b = frame([("x", 1), ("y", 2), ("z", 3)], "n string, o int"), frame([("p", 2), ("q", 1)], "n string, o int")
    out = zip_tables([a, b], [["o"], ["o"]]).orderBy("_row")
    assert values(out, "n", "n_2") == [("x", "q"), ("y", "p"), ("z", None)]
    assert stack_tables(frame([(1, "a")], "i int, s string"), frame([(2.0,)], "f double")).count() == 2


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    out = with_row_number(df, ["v"])
    assert out.filter("v <> _row").count() == 0 and out.count() == 5000


def test_dedup(frame):
    df = frame([(1, "a", "1"), (2, "b", "2"), (3, "c", "1"), (4, "d", None), (5, "e", "")], "id int, n string, phone string")
    assert sorted(values(dedup(df, ["phone"], ["id"]), "id")) == [1, 2, 4]
    assert sorted(values(duplicate_report(df, ["phone"]), "phone", "row_count")) == [("", 2), ("1", 2)]
    assert dedup_counts(df, ["phone"]).first()[:] == (5, 3, 2)


def test_clean(frame):
    df = frame([("a", "1"), (None, " "), ("b", "不是数字"), ("-", "N/A")], "t string, n string")
    assert sorted(values(clean(df, numeric=["n"]), "t", "n"), key=str) == [("a", 1.0), ("b", None)]
    assert clean_counts(df, numeric=["n"]).first()[:] == (4, 2, 2, 2)


def test_update_and_edits(wells, frame):
    out = set_where(wells, "depth", F.col("depth") / 2, cond("field", "EQ", "south"))
    assert {r.id: r.depth for r in out.collect()} == {w[0]: w[3] / 2 if w[2] and w[2].lower() == "south" else w[3] for w in WELLS}
    assert set_where(wells, "no such column", 1).columns == wells.columns
    edits = frame([(12, "name", "Bora-3"), (12, "depth", "17"), (18, "depth", "deep"), (99, "name", "nobody")], "id int, column string, value string")
    got = {r.id: (r.name, r.depth, r.flow) for r in apply_edits(wells, edits, "id").collect()}
    assert got.pop(12) == ("Bora-3", 17.0, "n/a") and got.pop(18) == ("Eve", None, "1e2")
    assert got == {w[0]: (w[1], w[3], w[4]) for w in WELLS if w[0] not in (12, 18)}


# --- skew ------------------------------------------------------------------------------

def test_hot_keys_are_bounded_and_salted_join_is_whole(spark):
    n = 3000
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.upper("k"))
    counts = left.groupBy("k").agg(F.count("*").alias("_n"))
    assert values(hot_keys(counts, ["k"], share=100), "k") == ["hot"]
    out = lookup(left, right, "k", skew="salt")
    assert out.count() == n and out.filter("_lkp_v is null").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_duplicates_with_a_large_group_of_copies(spark):
    rows = spark.range(2000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("t"))
    out = duplicate_rows(rows, "row")
    assert out.count() == 666 and out.filter("duplicate_of <> 0").count() == 0


def test_first_rows_limit_each_group_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    assert dedup(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


# --- approximate matching ------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def score(a, b):
    return 1 - distance(a, b) / max(len(a), len(b))


def _mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        how = rng.random()
        if how < 0.33 and i < len(s):
            s[i] = rng.choice("abcd")
        elif how < 0.66 and i < len(s) and len(s) > 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcd"))
    return "".join(s)


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(11)
    right = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 4, 5, 7, 9, 13, 19, 24, 40]))) for _ in range(90)})
    # Many keys share a long head, as names with a running number do.
    right += [f"warehouse-north-{i:04d}" for i in range(0, 400, 9)]
    left = sorted({_mutate(rng, rng.choice(right), rng.randrange(1, 6)) for _ in range(90)} - set(right))
    return left, right


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_similar_pairs_are_complete(spark, keys, threshold):
    left, right = keys
    got = Z.similar_pairs(spark.createDataFrame([(k,) for k in left], "lkey string"), spark.createDataFrame([(k,) for k in right], "rkey string"), threshold)
    want = {(a, b) for a in left for b in right if score(a, b) >= threshold - 1e-9}
    assert set(values(got, "lkey", "rkey")) == want


def test_best_similar_is_the_first_of_the_best(spark, keys):
    left, right = keys
    got = Z.best_similar(spark.createDataFrame([(k,) for k in left], "lkey string"), spark.createDataFrame([(k, i) for i, k in enumerate(right)], "rkey string, rorder int"))
    want = {}
    for a in left:
        s, i = max((score(a, b), -i) for i, b in enumerate(right))
        if s >= 0.85 - 1e-9:
            want[a] = right[-i]
    assert dict(values(got, "lkey", "rkey")) == want


def one_by_one(left, right):
    """Left values in turn: equal, then contained in right order, then most similar; each right value once."""
    used, out = set(), {}
    for a in left:
        n = a.lower()
        equal = [b for b in right if b.lower() == n]
        if equal:
            out[a] = next((b for b in equal if b not in used), equal[0])
        else:
            free = [b for b in right if b not in used]
            inside = next((b for b in free if n in b.lower() or b.lower() in n), None)
            best = max(free, key=lambda b: (score(n, b.lower()), -right.index(b)), default=None)
            out[a] = inside or (best if best is not None and score(n, best.lower()) >= 0.6 - 1e-9 else None)
        if out[a] is not None:
            used.add(out[a])
    return out


def test_one_to_one_mapping_equals_going_through_the_values(spark):
    rng = random.Random(5)
    right = list(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) for _ in range(40)))
    right += [right[3].upper(), right[7].upper()]
    left = list(dict.fromkeys([_mutate(rng, rng.choice(right).lower(), rng.randrange(0, 3)) for _ in range(40)]))
    lf = spark.createDataFrame(list(enumerate(left)), "o int, k string")
    rf = spark.createDataFrame(list(enumerate(right)), "o int, k string")
    got = dict(values(Z.key_mapping(lf, "k", rf, "k", ["o"], ["o"], one_to_one=True), "source", "target"))
    assert got == one_by_one(left, right)


def test_key_mapping_phases(frame):
    """One key for each phase, and those that only look alike."""
    left = frame([("pump A-7",), ("Valve",), ("gasket ring",), ("sensor",)], "k string")
    right = frame([("PUMP A-7",), ("valve, brass",), ("gaskat rings",), ("rotor",)], "k string")
    got = {r.source: (r.target, r.phase) for r in Z.key_mapping(left, "k", right, "k").collect()}
    assert got == {"pump A-7": ("PUMP A-7", 1), "Valve": ("valve, brass", 2), "gasket ring": ("gaskat rings", 3), "sensor": (None, None)}
    stats = Z.mapping_stats(Z.key_mapping(left, "k", right, "k")).first()
    assert stats[:] == (4, 3, 1, 0.75)
    assert Z.mapping_stats(Z.key_mapping(frame([], "k string"), "k", right, "k")).first()[:] == (0, 0, 0, 0.0)


# --- profile, audit, quality, checks ------------------------------------------------------------

def test_profile(frame):
    df = frame([(1, "5"), (2, "x"), (3, "7"), (4, ""), (5, "7"), (6, "8")], "id int, v string")
    row = profile(df, ["v"], order="id").first()
    assert (row["null_count"], row["unique_count"], row["inferred_type"], row["confidence"], row["avg_value"]) == (1, 4, "number", 0.8, 6.75)
    assert row["sample_values"] == ["5", "x", "7", "8"]
    assert column_samples(df, 2, "id", ["v"]).first()["values"] == ["5", "x"]
    assert profile_globals(df, ["v"]).first()["duplicate_row_rate"] == pytest.approx(1 / 6)


def test_audit(frame):
    df = frame([(1, "￥1,200", "a@b.c", "1"), (2, "-50", "invalid-email", "2"), (3, "7", "a @b.c", "三"), (4, "7", "", "4"), (5, "7", "a@b.c", "5"), (6, "7", "a@b.c", "5")],
               "id int, `金额` string, `邮箱` string, n string")
    found = A.audit(df, "id")
    got = {(r["row_id"], r["column"], r["rule"]): r["suggested_value"] for r in found.collect()}
    assert got[(1, "金额", "amount_format")] == "1200" and (2, "金额", "amount_negative") in got
    assert got[(2, "邮箱", "email_format")] is None and got[(3, "邮箱", "email_format")] == "a@b.c"
    assert got[(3, "n", "format_mismatch")] == "3" and (6, None, "duplicate_row") in got and (4, "邮箱", "blank_cell") in got
    fixed = {r["id"]: (r["金额"], r["邮箱"], r["n"]) for r in R.apply_fixes(df, found, "id").collect()}
    assert fixed[1][0] == "1200" and fixed[3] == ("7", "a @b.c", "3")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recheck_of_all_rules_equals_a_full_audit(spark, seed):
    """Random edits make and break copies, and tip a column to numbers or away from them."""
    rng = random.Random(seed)
    cell = lambda: rng.choice(["1", "2", "3", "x", "", "三", "a@b", None])
    rows = [(i, cell(), rng.choice(["1", "2", "w"]), cell()) for i in range(60)]
    schema = "id int, a string, b string, email string"
    edits = [(rng.randrange(70), rng.choice(["a", "b", "email"]), cell() or "9") for _ in range(35)]
    edits = list({(i, c): (i, c, v) for i, c, v in edits}.values())
    df, changes = spark.createDataFrame(rows, schema), spark.createDataFrame(edits, "id int, column string, value string")
    old = A.audit(df, "id")
    dirty = {r.row_id for r in A.audit(apply_edits(df, changes, "id"), "id").collect()}
    want = {r.row_id for r in old.collect()} - dirty
    assert {r.id for r in A.recheck_all(df, old, changes, "id").collect()} == want
    kept = A.number_counts(df, ["a", "b", "email"])
    assert {r.id for r in A.recheck_all(df, old, changes, "id", counts=kept).collect()} == want


def test_counts_are_carried_on_by_edits(frame):
    before, after = frame([("1", 1), ("x", 2), ("", 3)], "v string, n int"), frame([("2", 1), ("3", 2), (None, 3)], "v string, n int")
    whole = frame([("column", 9, 4)], "column string, filled bigint, numeric bigint").replace("column", "v")
    assert A.counts_after(whole, before, after).collect() == [("v", 9, 5)]
    assert A.number_counts(before.select("n")).collect() == []


def test_perfect_score(frame):
    df = frame([(i, str(i)) for i in range(5)], "id int, v string")
    assert A.audit_score(df, A.audit(df, "id", {}), "id").first()[:] == (100.0, "优秀")


def test_rules_and_types(frame):
    df = frame([(1, "2", "3", "6"), (2, "2", "3", "7"), (3, "x", "3", "7")], "id int, a string, b string, c string")
    out = Q.run_rules(df, "id", [("product", {"factor_a": "a", "factor_b": "b", "product": "c"})])
    assert values(out, "row_id", "suggested_value") == [(2, "6.00")]
    phones = frame([(str(13800000000 + i),) for i in range(9)] + [("bad",)], "mobile string")
    assert Q.infer_semantic_types(phones).first()["type"] == "phone"


def test_checks_and_diff(spark, wells):
    passed = lambda df, sorts: {r["check"]: r["passed"] for r in C.check_sort(df, sorts).collect()}["sorted"]
    assert passed(sort_rows(wells, [("depth", True)]), [("depth", True)])
    steps = spark.createDataFrame([(v,) for v in (5, 4, 6, 6, 1, None, 2)], "v int").coalesce(1)
    assert C.sort_violations(steps, [("v", True)]).first()["violations"] == 3  # 5 4, 6 1, null 2
    gone, other, more = F.col("id") == 14, F.col("id") == 16, [(21, "Hal", "north", 1.0, "1"), (22, "Ida", "north", 1.0, "1")]
    after = wells.filter(~gone).withColumn("depth", F.when(other, 34.0).otherwise(F.col("depth"))).unionByName(spark.createDataFrame(more, wells.schema))
    diff = C.table_diff(wells, after, ["id"]).first()
    assert (diff["rows_added"], diff["rows_removed"], diff["rows_updated"]) == (2, 1, 1)
    repeated = wells.union(wells.filter("id in (17, 20)"))
    assert C.table_diff(wells, repeated).first()["rows_added"] == 2
    assert {i: s for i, s in values(C.row_changes(wells, repeated, ["id"]), "id", "status") if s != "unchanged"} == {17: "updated", 20: "updated"}


def test_sort_check_is_exact(spark):
    from decimal import Decimal

    big = 2 ** 53
    rows = spark.createDataFrame([(big + 1,), (big,), (None,)], "k bigint").coalesce(1)
    assert check_sort_rows(rows, [("k", True)]) == (3, 1)
    fine = [(Decimal("1.00000000000000000002"),), (Decimal("1.00000000000000000001"),)]
    assert check_sort_rows(spark.createDataFrame(fine, "k decimal(38,20)").coalesce(1), [("k", True)]) == (2, 1)
    assert check_sort_rows(spark.createDataFrame(fine, "k decimal(38,20)").coalesce(1), [("k", False)]) == (2, 0)
    floats = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "k double").coalesce(1)
    assert check_sort_rows(floats, [("k", True)]) == (3, 1)
    assert check_sort_rows(floats, [("k", False)]) == (3, 0)


def check_sort_rows(df, sorts):
    from gridwright.operators.checks import sort_violations

    row = sort_violations(df, sorts).first()
    return row["row_count"], row["violations"]


def test_one_to_one_mapping_with_many_contenders(spark):
    """Every left value prefers the same targets; the longest chain of rounds is no limit."""
    from gridwright.operators.fuzzy import key_mapping

    left = spark.createDataFrame([(f"item{i:02d}", i) for i in range(12)], "a string, o int")
    right = spark.createDataFrame([(f"item{i:02d}x", i) for i in range(12)], "b string, o int")
    got = {r["source"]: r["target"] for r in key_mapping(left, "a", right, "b", ["o"], ["o"], one_to_one=True).collect()}
    assert got == {f"item{i:02d}": f"item{i:02d}x" for i in range(12)}


def test_tall_pivot_has_no_width(spark):
    from gridwright.operators.pivots import pivot_cells

    df = spark.range(3000).selectExpr("id % 2 AS r", "cast(id AS string) AS c", "cast(id AS double) AS v")
    got = pivot_cells(df, ["r"], "v", "SUM", "c")
    assert got.count() == 3000 and got.agg({"value": "sum"}).first()[0] == 2999 * 1500.0


def test_cross_tab_scans_its_table_once(spark, tmp_path):
    """Column values, cells and totals come from one checkpointed aggregate."""
    df = spark.range(400).selectExpr("cast(id % 3 AS string) AS r", "cast(id % 7 AS string) AS c", "cast(id AS double) AS v")
    df.write.parquet(f"{tmp_path}/t")
    out = pivot_table(spark.read.parquet(f"{tmp_path}/t"), ["r"], "v", "MAX", "c")
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["r"]: [r[f"_pvt_{c}"] for c in range(7)] for r in out.collect()}
    want = {str(r): [float(max(i for i in range(400) if i % 3 == r and i % 7 == c)) for c in range(7)] for r in range(3)}
    assert got == {**want, "合计": [float(max(i for i in range(400) if i % 7 == c)) for c in range(7)]}


def test_audit_of_a_wide_table(spark):
    """Every column is audited, however many have a role."""
    kinds = ("手机", "邮箱", "金额", "读数")
    names = [f"{kinds[i % 4]}.{i}" for i in range(60)]

    def value(row, i):
        if row == i % 9:
            return None
        bad = {"手机": "110", "邮箱": "nobody", "金额": "￥1,250", "读数": "about 3"}
        good = {"手机": "13812345678", "邮箱": "a@example.org", "金额": str(row + 1), "读数": str(row * i)}
        return (bad if row == 10 + i % 3 else good)[kinds[i % 4]]

    rows = [(r, *[value(r, i) for i in range(60)]) for r in range(20)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]]))
    found = A.audit(df, "id")
    got = collections.Counter((r.row_id, r.column, r.rule) for r in found.collect())
    rule = {"手机": "phone_format", "邮箱": "email_format", "金额": "amount_format", "读数": "format_mismatch"}
    want = collections.Counter()
    for i, n in enumerate(names):
        want[(i % 9, n, "blank_cell")] += 1
        want[(10 + i % 3, n, rule[kinds[i % 4]])] += 1
        if kinds[i % 4] == "金额":  # a marked amount is no plain number in a number column either
            want[(10 + i % 3, n, "format_mismatch")] += 1
    assert got == want
