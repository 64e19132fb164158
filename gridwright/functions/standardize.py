"""Value standardisation and similarity, applied to whole columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .cells import NUMBER_PATTERN, SPACE_RUN, bind, half_width, mark, num, strip, text, value, without_spaces

# Words read as booleans.
TRUE_WORDS = ("是", "true", "yes", "y", "t", "1", "对", "正确", "通过", "完成", "成功")
FALSE_WORDS = ("否", "false", "no", "n", "f", "0", "错", "错误", "不通过", "未完成", "失败")

# Currency marks before and after an amount.
CURRENCY_PREFIX = r"^[￥¥$€£]"
CURRENCY_SUFFIX = r"(美元|欧元|英镑|元)$"
AMOUNT_MARKS = "￥¥$,，"

# Chinese digits, both everyday and formal forms.
CN_DIGIT_FORMS = "零一二三四五六七八九壹贰叁肆伍陆柒捌玖貳參"
CN_DIGIT_VALUES = "012345678912345678923"
CN_UNIT_FORMS = "拾佰仟萬億"
CN_UNIT_VALUES = "十百千万亿"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c) -> Column:
    """Unicode NFKC. Plain ASCII cells never leave the JVM side as payload."""
    c = value(c)
    wide = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc(wide), c)


def std_text(c, nfkc_form: bool = True, width: bool = True, trim: bool = True,
             spaces: bool = True, lower: bool = True) -> Column:
    """Text in one form; each switch turns one step off. ``nfkc_form=False`` is built-ins only."""
    out = value(c)
    if nfkc_form:
        out = nfkc(out)
    if width:
        out = half_width(out)
    if trim:
        out = strip(out)
    if spaces:
        out = F.regexp_replace(out, SPACE_RUN, " ")
    if lower:
        out = F.lower(out)
    return out


def std_equal(a, b, nfkc_form: bool = True) -> Column:
    return std_text(a, nfkc_form) == std_text(b, nfkc_form)


def edit_similarity(x: Column, y: Column) -> Column:
    """``1 - distance / longer length``; two empty texts are alike."""
    longer = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def similarity(a, b, nfkc_form: bool = True) -> Column:
    return edit_similarity(std_text(a, nfkc_form), std_text(b, nfkc_form))


def bigrams(x: Column) -> Column:
    """Distinct character pairs; the look-ahead finds overlapping pairs without a lambda."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit("(?s)(?=(..))"), 1))


def dice(a, b, nfkc_form: bool = True) -> Column:
    """Dice coefficient on distinct character pairs."""
    x, y = bigrams(std_text(a, nfkc_form)), bigrams(std_text(b, nfkc_form))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / total)


def _result(val: Column, confidence: Column) -> Column:
    return F.struct(val.alias("value"), F.when(val.isNull(), F.lit(0.0)).otherwise(confidence).alias("confidence"))


def std_number(c) -> Column:
    """Number written as dirty text, as ``struct(value, confidence)``.

    Parentheses are a minus sign, percent divides by 100, currency marks and
    thousands commas are dropped.
    """
    def parsed(t: Column) -> Column:
        inner = F.regexp_extract(t, r"^\((.+)\)$", 1)
        return bind(inner, lambda i: F.when(i != "", _negated(bind(strip(i), _dirty_number))).otherwise(_dirty_number(t)))

    return bind(strip(c), parsed)


def _negated(r: Column) -> Column:
    return F.struct((-r["value"]).alias("value"), r["confidence"].alias("confidence"))


def _dirty_number(t: Column) -> Column:
    """Number without parentheses, from stripped text."""
    percent = t.rlike("[%％]$")
    bare = F.regexp_replace(t, f"{CURRENCY_PREFIX}|{CURRENCY_SUFFIX}|,", "")
    money = F.when(bare == t, 1.0).when(t.rlike(f"{CURRENCY_PREFIX}|{CURRENCY_SUFFIX}"), 0.9).otherwise(0.95)
    return F.when(percent, _result(num(mark(F.regexp_replace(t, "[%％]$", ""), "text")) / 100, F.lit(0.95))).otherwise(
        _result(num(mark(bare, "text")), money))


def std_date(c) -> Column:
    """Date text in ISO form as ``struct(value, confidence)``; spreadsheet serials are kept and marked 0.7."""
    t = strip(c)
    serial = num(t)
    is_serial = (serial > 59) & (serial < 2_000_000)
    ymd = F.regexp_extract(t, r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)$", 1)
    ymd = F.translate(ymd, "/.年月日", "----")
    mdy = F.regexp_replace(
        F.regexp_extract(t, r"^([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})$", 1),
        r"^([0-9]+)[-/]([0-9]+)[-/]([0-9]+)$", "$3-$1-$2",
    )
    packed = F.regexp_replace(F.regexp_extract(t, r"^([0-9]{8})$", 1), r"^(....)(..)(..)$", "$1-$2-$3")
    found = F.coalesce(*[p.try_cast("date") for p in (ymd, mdy, packed)])
    out = F.when(is_serial, t).otherwise(F.date_format(found, "yyyy-MM-dd"))
    return _result(out, F.when(is_serial, 0.7).otherwise(0.95))


def std_bool(c) -> Column:
    w = F.lower(strip(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


# --- Chinese numerals --------------------------------------------------------

_UNITS = {"十": 10.0, "百": 100.0, "千": 1000.0, "万": 1e4, "亿": 1e8}
_SMALL_UNITS = {"角": 0.1, "毛": 0.1, "分": 0.01, "厘": 0.001}
_PLACED = "[0-9][毛角分厘]?"
# Words around a numeral that say it is not exact.
_MINUS = "^[负負−－-]"
_ABOUT = "大约|大概|左右|约|多|余|来"
_NUMERAL = r"([0-9]+(?:\.[0-9]+)?|[十百千万亿])"


def _cn_state(high, mid, low, digit, unit) -> Column:
    named = zip(("high", "mid", "low", "digit", "unit"), (high, mid, low, digit, unit))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in named])


def _cn_step(s: Column, token: Column) -> Column:
    """Sections below 万, below 亿 and above are kept apart; a unit without a digit counts once.

    ``unit`` is the unit right before a digit, 0 when a zero stands between.
    """
    weights = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    unit, zero = F.coalesce(F.try_element_at(weights, token), F.lit(0.0)), F.lit(0.0)
    below = s["low"] + s["digit"]
    return (
        F.when(unit == 0, _cn_state(s["high"], s["mid"], s["low"], token.try_cast("double"),
                                    F.when(F.startswith(token, F.lit("0")) | (F.char_length(token) > 1), zero).otherwise(s["unit"])))
        .when(unit < 1e4, _cn_state(s["high"], s["mid"], s["low"] + F.greatest(s["digit"], F.lit(1.0)) * unit, zero, unit))
        .when(unit < 1e8, _cn_state(s["high"], F.greatest(below, F.lit(1.0)) * unit, zero, zero, unit))
        .otherwise(_cn_state(F.greatest(s["mid"] + below, F.lit(1.0)) * unit, zero, zero, zero, unit))
    )


def _cn_total(s: Column) -> Column:
    """A final digit right after a unit is one place below it: ``三百五`` is 350."""
    place = F.when(s["unit"] >= 100, s["unit"] / 10).otherwise(1.0)
    return s["high"] + s["mid"] + s["low"] + s["digit"] * place


def _cn_place(total, place) -> Column:
    named = (("sum", total), ("place", place))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in named])


def _cn_place_step(s: Column, token: Column) -> Column:
    """A digit counts by the unit behind it, without one as the next place after the digit before."""
    worth = F.create_map(*[F.lit(x) for pair in _SMALL_UNITS.items() for x in pair])
    place = F.coalesce(F.try_element_at(worth, F.substring(token, 2, 1)), s["place"])
    return _cn_place(s["sum"] + F.left(token, F.lit(1)).cast("double") * place, place / 10)


def _cn_plain(plain: Column) -> Column:
    """Value of a numeral written with plain digits and units, null when it is none."""
    small_only = plain.rlike("^[^块元圆]*[毛角分厘]")
    whole = F.when(small_only, "").otherwise(F.regexp_extract(plain, "^([^块元圆钱]*)", 1))
    small = F.when(small_only, plain).otherwise(F.regexp_extract(plain, "[块元圆](.*)$", 1))
    fraction = F.aggregate(F.regexp_extract_all(small, F.lit(_PLACED), 0), _cn_place(0.0, 0.1), _cn_place_step, lambda x: x["sum"])
    tokens = F.regexp_extract_all(whole, F.lit(_NUMERAL), 1)
    total = F.round(F.aggregate(tokens, _cn_state(0.0, 0.0, 0.0, 0.0, 0.0), _cn_step, _cn_total) + fraction, 4)
    shape = plain.rlike("^[0-9.十百千万亿]*[块元圆钱]?[0-9毛角分厘]*$") & plain.rlike("[0-9十百千万亿]")
    return F.when(shape, F.nullif(total, F.lit(0.0)))


def _cn_signed(raw: Column) -> Column:
    written = raw.rlike(f"[{CN_DIGIT_FORMS}{CN_UNIT_FORMS}{CN_UNIT_VALUES}两兩廿.]")
    spelt = F.regexp_replace(raw, "廿", "二十")
    unsigned = F.regexp_replace(F.translate(spelt, CN_DIGIT_FORMS + CN_UNIT_FORMS + "两兩", CN_DIGIT_VALUES + CN_UNIT_VALUES + "22"), _MINUS, "")
    sign = F.when(raw.rlike(_MINUS), -1.0).otherwise(1.0)
    return F.when(written, bind(unsigned, _cn_plain) * sign)


def cn_number(c) -> Column:
    """Chinese or mixed numeral as a number, null when there is none or the value is 0.

    Digit and unit forms are translated, the whole part is split into tokens
    and folded; digits after 元 count by the unit behind them (角, 分, 厘), bare
    ones place by place. A leading minus sign or 负 is kept, words such as 大约
    are passed over.
    """
    return bind(F.regexp_replace(without_spaces(c), _ABOUT, ""), _cn_signed)


def cn_number_text(c) -> Column:
    """``cn_number`` as text without a trailing ``.0``."""
    return mark(bind(cn_number(c), lambda n: text(mark(n, "double"))), "text")


# --- formats -----------------------------------------------------------------

EMAIL = r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$"


def phone_digits(c) -> Column:
    """Phone number without blanks, hyphens and brackets."""
    return F.translate(without_spaces(c), "-()（）", "")


def phone_valid(c) -> Column:
    return phone_digits(c).rlike("^1[0-9]{10}$")


def email_valid(c) -> Column:
    return strip(c).rlike(EMAIL)


def email_fixed(c) -> Column:
    return without_spaces(c)


def id_card_valid(c) -> Column:
    return without_spaces(c).rlike("^[0-9]{17}[0-9Xx]$")


def id_card_acceptable(c) -> Column:
    """Looser audit form: 17 digits with or without the check character."""
    return without_spaces(c).rlike("^[0-9]{17}[0-9Xx]?$")


def id_card_birth(c) -> Column:
    """Birth date inside an 18- or 15-digit ID card number, as a date."""
    s = without_spaces(c)
    long_form = F.regexp_replace(F.regexp_extract(s, "^[0-9]{6}([0-9]{8})[0-9]{3}[0-9Xx]$", 1), "^(....)(..)(..)$", "$1-$2-$3")
    short_form = F.regexp_replace(F.regexp_extract(s, "^[0-9]{6}([0-9]{6})[0-9]{3}$", 1), "^(..)(..)(..)$", "19$1-$2-$3")
    return F.coalesce(long_form.try_cast("date"), short_form.try_cast("date"))


DATE_EXACT = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"
DATE_HEAD = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"


def date_valid(c) -> Column:
    c = value(c)
    return c.rlike(DATE_EXACT) & F.translate(c, "/", "-").try_cast("date").isNotNull()


def amount_bare(c) -> Column:
    return F.translate(without_spaces(c), AMOUNT_MARKS, "")


def amount_value(c) -> Column:
    """Leading number of an amount after currency marks and commas are dropped."""
    return F.regexp_extract(amount_bare(c), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def amount_valid(c) -> Column:
    v = amount_value(c)
    return (amount_bare(c) == "") | F.coalesce(v >= 0, F.lit(False))


def numeric_valid(c) -> Column:
    return num(c).isNotNull()
