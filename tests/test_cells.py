"""Cell semantics and formulas on small literal tables."""

import pytest
from pyspark.sql import functions as F

from gridwright.functions import fx
from gridwright.functions import standardize as S
from gridwright.functions.cells import (
    WIDE_PLACEHOLDERS, isnull_blank, isnull_empty, isnull_like, norm_key, num, parse_date, round_half_up, text,
)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("12", 12.0), (" 12　", 12.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("-3", -3.0),
    ("", None), ("  ", None), ("12d", None), ("NaN", None), ("0x10", None), ("abc", None), (None, None),
])
def test_num(spark, raw, want):
    assert one(spark, num(F.lit(raw).cast("string"))) == want


def test_num_of_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.5, float("nan"))], "a int, b double, c double")
    assert df.select(num("a"), num("b"), num("c")).first()[:] == (1.0, 2.5, None)


@pytest.mark.parametrize("raw, empty, blank, like, wide", [
    (None, True, True, True, True), ("", True, True, True, True), (" 　", False, True, True, True),
    ("N/A", False, False, True, True), (" - ", False, False, True, True), ("na", False, False, False, True),
    ("杭州", False, False, False, False), ("0", False, False, False, False),
])
def test_four_kinds_of_null(spark, raw, empty, blank, like, wide):
    c = F.lit(raw).cast("string")
    got = spark.range(1).select(isnull_empty(c), isnull_blank(c), isnull_like(c), isnull_like(c, WIDE_PLACEHOLDERS)).first()
    assert tuple(got) == (empty, blank, like, wide)


def test_text_of_numbers(spark):
    assert [one(spark, text(F.lit(v))) for v in (100.0, 2.5, 1e7, 7)] == ["100", "2.5", "10000000", "7"]


@pytest.mark.parametrize("raw, want", [("' 张 三 '", "'张三'"), ("Ｈｅｌｌｏ", "hello"), ("A　b", "ab")])
def test_norm_key(spark, raw, want):
    assert one(spark, norm_key(F.lit(raw))) == want


def test_rounding_goes_up_at_half(spark):
    assert [one(spark, round_half_up(F.lit(v), 0)) for v in (2.5, -2.5, 1e17)] == [3.0, -2.0, 1e17]


@pytest.mark.parametrize("raw, want", [
    ("2024-1-5", "2024-01-05"), ("2024/01/15 10:00", "2024-01-15"), ("2024年3月1日", "2024-03-01"), ("2024-13-01", "None"), ("2024", "None"), ("x", "None"),
])
def test_parse_date(spark, raw, want):
    assert str(one(spark, parse_date(F.lit(raw)))) == want


def test_arithmetic(spark):
    lit = F.lit
    assert one(spark, fx.add(lit(0.1), lit(0.2))) == 0.3
    assert one(spark, fx.add(lit("x"), lit("5"))) == 5.0
    assert one(spark, fx.divide(lit(10), lit(0))) is None
    assert one(spark, fx.divide(lit(10), lit(0), on_zero="inf")) == float("inf")
    assert one(spark, fx.modulo(lit(-7), lit(3))) == -1.0
    assert one(spark, fx.modulo(lit(7), lit(0))) == 0.0
    assert one(spark, fx.negate(lit("abc"))) is None
    assert one(spark, fx.fold("*", lit(3), lit(4), lit(0.9))) == 10.8
    assert [one(spark, fx.round_(lit(v), 2)) for v in (3.14159, 2.71828)] == [3.14, 2.72]


def test_row_functions(spark):
    none = F.lit(None).cast("double")
    assert one(spark, fx.row_avg(F.lit(6), none)) == 3.0
    assert one(spark, fx.row_min(F.lit(6), none)) == 0.0
    assert one(spark, fx.row_max(F.lit("6"), F.lit(9))) == 9.0
    assert one(spark, fx.abs_(F.lit(-4))) == 4.0


def test_logic(spark):
    lit = F.lit
    assert [one(spark, fx.not_(lit(v))) for v in ("", "0", "false", "a", 0, 3)] == [1, 1, 1, 0, 1, 0]
    assert one(spark, fx.eq(lit("5"), lit(5))) == 1
    assert one(spark, fx.lt(lit("9"), lit("10"))) == 1
    assert one(spark, fx.lt(lit(None).cast("string"), lit("10"))) == 0
    assert one(spark, fx.if_(lit(True), lit("a"), lit("b"))) == "a"
    assert one(spark, fx.if_all([lit(True), lit(None).cast("boolean")], lit("a"), lit("b"))) == "b"
    assert one(spark, fx.and_value(lit("x"), lit("y"))) == "y"
    assert one(spark, fx.or_value(lit(""), lit("y"))) == "y"


def test_text_functions(spark):
    lit = F.lit
    none = lit(None).cast("string")
    assert one(spark, fx.left(lit("hello"), 2)) == "he"
    assert one(spark, fx.left(lit("hello"), -1)) == ""
    assert one(spark, fx.right(lit("hello"), 0)) == ""
    assert one(spark, fx.mid(lit("hello"), 2, 3)) == "ell"
    assert one(spark, fx.mid(lit("hello"), 2)) == "ello"
    assert one(spark, fx.length(none)) == 0
    assert one(spark, fx.concat(lit("a"), none, lit(2.0))) == "a2"
    assert one(spark, fx.textjoin("-", lit("a"), none, lit("b"))) == "a--b"
    assert one(spark, fx.trim(lit("  a \t b　"))) == "a b"
    assert one(spark, fx.substitute(lit("a.b.c"), ".", "-")) == "a-b-c"
    assert one(spark, fx.substitute(lit("abc"), "", "-")) == "abc"


def test_dates(spark):
    lit = F.lit
    assert one(spark, fx.years_between(lit("2020-01-01"), lit("2026-07-01"))) == 6
    assert one(spark, fx.years_between(lit("2020-01-01"), as_of="2026-07-01")) == 6
    assert (one(spark, fx.year(lit("2024年3月9日"))), one(spark, fx.month(lit("2024/3/9"))), one(spark, fx.day(lit("2024-3-9")))) == (2024, 3, 9)
    assert str(one(spark, parse_date(lit(45292), kind="serial"))) == "2024-01-01"
    assert len(one(spark, fx.today())) == 10


@pytest.mark.parametrize("raw, want", [("hello　world", "hello world"), ("a\t\tb", "a b"), ("①", "1"), ("㍿", "株式会社"), (" 杭州 ", "杭州"), (None, None)])
def test_std_text(spark, raw, want):
    assert one(spark, S.std_text(F.lit(raw).cast("string"))) == want


def test_std_text_switches(spark):
    assert one(spark, S.std_text(F.lit(" A  ｂ "), nfkc_form=False, lower=False)) == "A b"
    assert one(spark, S.std_text(F.lit(" A "), nfkc_form=False, trim=False, spaces=False)) == " a "


@pytest.mark.parametrize("raw, want, confidence", [
    ("100", 100.0, 1.0), ("￥100", 100.0, 0.9), ("100元", 100.0, 0.9), ("$100", 100.0, 0.9), ("1,234,567", 1234567.0, 0.95),
    ("50％", 0.5, 0.95), ("100%", 1.0, 0.95), ("(100)", -100.0, 1.0), ("abc", None, 0.0), ("", None, 0.0),
])
def test_std_number(spark, raw, want, confidence):
    assert tuple(one(spark, S.std_number(F.lit(raw)))) == (want, confidence)


@pytest.mark.parametrize("raw, want", [
    ("2024/1/1", "2024-01-01"), ("2024年1月1日", "2024-01-01"), ("01/15/2024", "2024-01-15"), ("2024.1.1", "2024-01-01"),
    ("20240101", "2024-01-01"), ("45292", "45292"), ("not a date", None), ("2024-02-31", None),
])
def test_std_date(spark, raw, want):
    assert one(spark, S.std_date(F.lit(raw)))["value"] == want


@pytest.mark.parametrize("raw, want", [("是", True), ("TRUE", True), ("1", True), ("Y", True), ("否", False), ("0", False), ("n", False), ("maybe", None)])
def test_std_bool(spark, raw, want):
    assert one(spark, S.std_bool(F.lit(raw))) is want


@pytest.mark.parametrize("raw, want", [
    ("三百二十", 320.0), ("三百五", 350.0), ("三百零五", 305.0), ("一万五", 15000.0), ("十五", 15.0), ("两", 2.0), ("两百", 200.0), ("廿五", 25.0), ("-三百", -300.0), ("五元五分", 5.05), ("五元零五厘", 5.005), ("大约三百左右", 300.0), ("九元一角二分三厘", 9.123), ("三元五", 3.5), ("五角五分", 0.55), ("负二十", -20.0),
    ("三万五千亿", 3.5e12), ("一亿三千万", 1.3e8), ("壹佰贰拾元", 120.0), ("五元三角二分", 5.32), ("3千5", 3500.0), ("约三十", 30.0),
    ("零", None), ("many", None), ("123-456", None), (None, None),
])
def test_cn_number(spark, raw, want):
    assert one(spark, S.cn_number(F.lit(raw).cast("string"))) == want


def test_similarity(spark):
    lit = F.lit
    assert one(spark, F.levenshtein(lit("张三"), lit("张 三"))) == 1
    assert one(spark, S.similarity(lit("Ａbc"), lit("abd"))) == pytest.approx(2 / 3)
    assert one(spark, S.similarity(lit(" "), lit(""))) == 1.0
    assert one(spark, S.dice(lit("night"), lit("nacht"))) == 0.25
    assert (one(spark, S.dice(lit("a"), lit("b"))), one(spark, S.dice(lit("a"), lit("bc")))) == (1.0, 0.0)


def test_formats(spark):
    lit = F.lit
    assert one(spark, S.phone_valid(lit("138-0013 8000")))
    assert not one(spark, S.phone_valid(lit("1380013800")))
    assert not one(spark, S.email_valid(lit("invalid-email")))
    assert one(spark, S.id_card_valid(lit("11010119900307123X"))) and not one(spark, S.id_card_valid(lit("123")))
    assert str(one(spark, S.id_card_birth(lit("110101900307123")))) == "1990-03-07"
    assert one(spark, S.date_valid(lit("2024/2/29"))) and not one(spark, S.date_valid(lit("2023-02-29")))
    assert one(spark, S.amount_value(lit("￥1,200.5元"))) == 1200.5
