"""Row formulas, value standardisation and similarity."""

from pyspark.sql import functions as F

from ..functions import fx
from ..functions.cells import FULL_WIDTH, HALF_WIDTH
from ..functions.standardize import (
    cn_number, dice, id_card_birth, similarity, std_bool, std_date, std_equal, std_number, std_text,
)
from ..operators.profiling import column_of_value, columns_containing, value_index
from ..operators.shaping import add_column
from .dirt import CONTACTS, DIRTY_LINEITEM, DIRTY_ORDERS, contacts, dirty_lineitem, dirty_orders, norm_sql
from .registry import half_up, query, tidy

KEY = ["l_orderkey", "l_linenumber"]
Q = "coalesce(l_quantity, 0)"


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_orderkey, l_linenumber,
  {tidy(Q + " + l_tax")} AS added, {tidy(Q + " - l_discount")} AS taken, {tidy(Q + " * l_extendedprice")} AS product,
  CASE WHEN {Q} = 0 THEN NULL ELSE {tidy("l_extendedprice / nullif(" + Q + ", 0)")} END AS ratio,
  CASE WHEN {Q} = 0 THEN 'Infinity'::DOUBLE ELSE {tidy("l_extendedprice / nullif(" + Q + ", 0)")} END AS ratio_inf,
  CASE WHEN l_linenumber = 0 THEN 0 ELSE {tidy("fmod(" + Q + ", l_linenumber)")} END AS rest, -l_quantity AS negative,
  {tidy(tidy(Q + " * l_extendedprice") + " * 0.9")} AS folded FROM dirty_lineitem""")
def fx_arithmetic(t):
    rows = dirty_lineitem(t)
    return rows.select(
        *KEY, fx.add("l_quantity", "l_tax").alias("added"), fx.subtract("l_quantity", "l_discount").alias("taken"),
        fx.multiply("l_quantity", "l_extendedprice").alias("product"), fx.divide("l_extendedprice", "l_quantity").alias("ratio"),
        fx.divide("l_extendedprice", "l_quantity", on_zero="inf").alias("ratio_inf"), fx.modulo("l_quantity", "l_linenumber").alias("rest"),
        fx.negate("l_quantity").alias("negative"), fx.fold("*", "l_quantity", "l_extendedprice", F.lit(0.9)).alias("folded"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 60000 THEN 'high' WHEN l_extendedprice > 30000 THEN 'middle' ELSE 'low' END AS band,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 10 THEN l_extendedprice ELSE 0 END AS returned FROM lineitem""")
def fx_if_nested(t):
    price = F.col("l_extendedprice")
    band = fx.if_(fx.gt(price, F.lit(60000)), F.lit("high"), fx.if_(price > 30000, F.lit("middle"), F.lit("low")))
    returned = fx.if_all([F.col("l_returnflag") == "R", F.col("l_quantity") >= 10], "l_extendedprice", F.lit(0.0))
    return t.lineitem.select(*KEY, band.alias("band"), returned.alias("returned"))


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_orderkey, l_linenumber, (l_quantity IS NOT DISTINCT FROM 10)::INT AS is_ten, (l_quantity IS DISTINCT FROM 10)::INT AS not_ten,
  coalesce(l_quantity < 10, false)::INT AS less, coalesce(l_quantity <= 10, false)::INT AS at_most, coalesce(l_quantity > 10, false)::INT AS more,
  coalesce(l_quantity >= 10, false)::INT AS at_least, (l_quantity IS NULL)::INT AS missing, (l_quantity IS NOT NULL AND l_tax <> 0)::INT AS both_set,
  CASE WHEN l_quantity IS NOT NULL THEN l_tax ELSE l_quantity END AS and_cell, CASE WHEN l_quantity IS NOT NULL THEN l_quantity ELSE l_tax END AS or_cell
  FROM dirty_lineitem""")
def fx_logic(t):
    q, ten = F.col("l_quantity"), F.lit(10)
    return dirty_lineitem(t).select(
        *KEY, fx.eq(q, ten).alias("is_ten"), fx.ne(q, ten).alias("not_ten"), fx.lt(q, ten).alias("less"), fx.le(q, ten).alias("at_most"),
        fx.gt(q, ten).alias("more"), fx.ge(q, ten).alias("at_least"), fx.not_(q).alias("missing"), fx.all_true(q, "l_tax").alias("both_set"),
        fx.and_value(q, "l_tax").alias("and_cell"), fx.or_value(q, "l_tax").alias("or_cell"),
    )


@query(f"""SELECT s_suppkey, floor(s_acctbal + 0.5) AS whole, {half_up("s_acctbal / 7", 2)} AS cents, {half_up("-s_acctbal", 1)} AS negative,
  abs(s_acctbal) AS size FROM supplier""")
def fx_round(t):
    b = F.col("s_acctbal")
    return t.supplier.select(
        "s_suppkey", fx.round_(b).alias("whole"), fx.round_(b / 7, 2).alias("cents"), fx.round_(-b, 1).alias("negative"), fx.abs_(b).alias("size"))


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_orderkey, l_linenumber, {tidy(Q + " + l_tax + l_discount")} AS row_total, {tidy("(" + Q + " + l_tax + l_discount) / 3.0::DOUBLE")} AS row_mean,
  least({Q}, l_tax, l_discount) AS smallest, greatest({Q}, l_tax, l_discount) AS largest FROM dirty_lineitem""")
def fx_row_stats(t):
    cells = ("l_quantity", "l_tax", "l_discount")
    return dirty_lineitem(t).select(
        *KEY, fx.row_sum(*cells).alias("row_total"), fx.row_avg(*cells).alias("row_mean"), fx.row_min(*cells).alias("smallest"), fx.row_max(*cells).alias("largest"))


@query("""SELECT p_partkey, left(p_name, 3) AS head, right(p_name, 4) AS tail, '' AS no_tail, substr(p_name, 2, 3) AS middle, length(p_name)::INT AS size,
  p_brand || '/' || p_size::VARCHAR || '/' || p_type AS joined, p_brand || '-' || '' || '-' || p_type AS listed, upper(p_name) AS loud, lower(p_brand) AS quiet,
  p_size::VARCHAR AS size_text FROM part""")
def fx_text(t):
    none = F.lit(None).cast("string")
    return t.part.select(
        "p_partkey", fx.left("p_name", 3).alias("head"), fx.right("p_name", 4).alias("tail"), fx.right("p_name", 0).alias("no_tail"),
        fx.mid("p_name", 2, 3).alias("middle"), fx.length("p_name").alias("size"),
        fx.concat("p_brand", F.lit("/"), "p_size", F.lit("/"), "p_type").alias("joined"), fx.textjoin("-", "p_brand", none, "p_type").alias("listed"),
        fx.upper("p_name").alias("loud"), fx.lower("p_brand").alias("quiet"), fx.concat(F.col("p_size").cast("double")).alias("size_text"),
    )


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS trimmed, md5(replace(text, 'e', '')) AS without_e,
  md5(replace(text, 'on', 'ON')) AS replaced, length(text)::INT AS characters FROM documents""")
def fx_substitute_trim(t):
    digest = lambda c: F.md5(c.cast("binary"))
    return t.documents.select(
        "doc_id", digest(fx.trim("text")).alias("trimmed"), digest(fx.substitute("text", "e")).alias("without_e"),
        digest(fx.substitute("text", "on", "ON")).alias("replaced"), fx.length("text").alias("characters"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, year(o_orderdate)::INT AS typed_y FROM orders""")
def fx_date_parts(t):
    rows = dirty_orders(t)
    return rows.select("o_orderkey", fx.year("day").alias("y"), fx.month("day").alias("m"), fx.day("day").alias("d"), fx.year("o_orderdate", kind="date").alias("typed_y"))


@query("""SELECT o_orderkey, 10 AS width, true AS later, floor(abs(datediff('day', o_orderdate::DATE, DATE '2026-07-01')) / 365)::INT AS years_to_date FROM orders""")
def fx_today(t):
    """Today is a text of ten characters behind every order; a given date takes its place where results must repeat."""
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return rows.select("o_orderkey", F.char_length(fx.today()).alias("width"), (fx.today() > F.col("day")).alias("later"),
                       fx.years_between("day", as_of="2026-07-01").alias("years_to_date"))


@query("""SELECT o_orderkey, floor(abs(datediff('day', o_orderdate::DATE, DATE '2026-07-01')) / 365)::INT AS years,
            floor(abs(datediff('day', o_orderdate::DATE, l.d)) / 365)::INT AS to_last FROM orders, (SELECT max(o_orderdate)::DATE AS d FROM orders) l""")
def fx_years_between(t):
    last = t.orders.agg(F.max("o_orderdate")).scalar()
    rows = dirty_orders(t).withColumn("last", last)
    days = F.col("last").cast("date")
    return rows.select("o_orderkey", fx.years_between("day", as_of="2026-07-01").alias("years"),
                       fx.years_between(F.col("o_orderdate"), days, kind="date").alias("to_last"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS d FROM orders""")
def fx_serial_dates(t):
    """Spreadsheet day numbers back to dates."""
    from ..functions.cells import parse_date

    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    rows = t.orders.select("o_orderkey", serial.alias("n"))
    return rows.select("o_orderkey", parse_date("n", kind="serial").alias("d"))


@query(f"""SELECT o_orderkey, o_custkey, {half_up("o_totalprice * 0.9", 1)} AS discounted, o_totalprice FROM orders""")
def fx_add_column(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return add_column(rows, "discounted", F.col("o_totalprice") * 0.9, decimals=1, after="o_custkey")


# --- standardisation -----------------------------------------------------------------

@query("""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents""")
def std_text_documents(t):
    return t.documents.select("doc_id", F.md5(std_text("text").cast("binary")).alias("digest"))


@query(f"""SELECT c_custkey, lower(c_name) || ' 1' AS name, true AS same FROM customer""")
def std_text_width(t):
    """Full-width names with wide blanks and a circled digit."""
    wide = F.concat(F.lit("　"), F.translate("c_name", HALF_WIDTH, FULL_WIDTH), F.lit("　\t ①"))
    rows = t.customer.select("c_custkey", wide.alias("w"), F.concat("c_name", F.lit(" 1")).alias("plain"))
    return rows.select("c_custkey", std_text("w").alias("name"), std_equal("w", "plain").alias("same"))


@query(f"""WITH {DIRTY_ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN -floor(o_totalprice) ELSE floor(o_totalprice) END AS amount,
  CASE WHEN o_orderkey % 4 < 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50) / 100.0::DOUBLE END AS share FROM dirty_orders""")
def std_numbers(t):
    k = F.col("o_orderkey")
    percent = F.when(k % 2 == 0, F.concat((k % 50).cast("string"), F.lit("％"))).otherwise("abc")
    rows = dirty_orders(t).select("o_orderkey", std_number("amount").alias("a"), std_number(percent).alias("p"))
    return rows.select("o_orderkey", F.col("a.value").alias("amount"), F.col("a.confidence").alias("confidence"), F.col("p.value").alias("share"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 6 THEN datediff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE o_orderkey % 7 WHEN 5 THEN 0.0 WHEN 6 THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence FROM orders""")
def std_dates(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    serial = F.date_diff(d.cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    shapes = F.when(k % 7 == 0, F.date_format(d, "yyyy/M/d")).when(k % 7 == 1, F.date_format(d, "yyyy年M月d日")).when(
        k % 7 == 2, F.date_format(d, "MM/dd/yyyy")).when(k % 7 == 3, F.date_format(d, "yyyy.M.d")).when(
        k % 7 == 4, F.date_format(d, "yyyy-MM-dd")).when(k % 7 == 5, "not a date").otherwise(serial)
    rows = t.orders.select("o_orderkey", std_date(shapes).alias("s"))
    return rows.select("o_orderkey", F.col("s.value").alias("d"), F.col("s.confidence").alias("confidence"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS flag FROM customer""")
def std_booleans(t):
    words = F.array(*[F.lit(w) for w in ("是", " No ", "Y", "0", "TRUE", "maybe")])
    return t.customer.select("c_custkey", std_bool(F.get(words, (F.col("c_custkey") % 6).cast("int"))).alias("flag"))


DIGITS = "零一二三四五六七八九"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10000 = 0 THEN NULL ELSE (c_custkey % 10000)::DOUBLE END AS n,
  CASE WHEN c_custkey % 10000 = 0 THEN NULL ELSE -(c_custkey % 10000) * 10000.0::DOUBLE END AS wan FROM customer""")
def std_chinese_numbers(t):
    """Each key written with 千 百 十 and read back."""
    n = (F.col("c_custkey") % 10000).cast("int")
    digit = lambda x: F.substring(F.lit(DIGITS), x.cast("int") + 1, F.lit(1))
    q, b, s, g = F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10
    gap = lambda here, lower: F.when((here == 0) & (lower > 0), "零").otherwise("")
    written = F.concat(
        F.when(q > 0, F.concat(digit(q), F.lit("千"))).otherwise(""),
        F.when(b > 0, F.concat(digit(b), F.lit("百"))).otherwise(F.when(q > 0, gap(b, s + g)).otherwise("")),
        F.when(s > 0, F.concat(digit(s), F.lit("十"))).otherwise(F.when((b > 0), gap(s, g)).otherwise("")),
        F.when(g > 0, digit(g)).otherwise(""),
    )
    rows = t.customer.select("c_custkey", written.alias("w"))
    return rows.select("c_custkey", cn_number("w").alias("n"), cn_number(F.when(F.col("w") != "", F.concat(F.lit("负"), "w", F.lit("万")))).alias("wan"))


@query(f"""WITH {CONTACTS} SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN NULL ELSE DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER) END AS born FROM contacts""")
def std_birth_dates(t):
    return contacts(t).select("c_custkey", id_card_birth("card").alias("born"))


PAIR = "lower(trim(a)) AS a, lower(trim(b)) AS b"


@query("""SELECT p_partkey, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) AS sim FROM (
  SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || p_brand) AS b FROM part)""")
def similarity_edit(t):
    rows = t.part.select("p_partkey", F.upper("p_name").alias("a"), F.concat_ws(" ", "p_type", "p_brand").alias("b"))
    return rows.select("p_partkey", F.round(similarity("a", "b"), 9).alias("sim"))


@query("""SELECT p_partkey, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) END::DOUBLE AS sim FROM (
  SELECT p_partkey, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i+1])) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i:i+1])) AS y
  FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || p_name) AS b FROM part))""")
def similarity_dice(t):
    rows = t.part.select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_name").alias("b"))
    return rows.select("p_partkey", F.round(dice("p_name", "b"), 9).alias("sim"))


VALUES = """vals AS (SELECT DISTINCT 'p_name' AS c, lower(p_name) AS v FROM part UNION SELECT DISTINCT 'p_brand', lower(p_brand) FROM part
  UNION SELECT DISTINCT 'p_type', lower(p_type) FROM part UNION SELECT DISTINCT 'p_size', p_size::VARCHAR FROM part),
 hits AS (SELECT c, max(CASE WHEN v = 'brand#1' THEN 0.95 WHEN contains(v, 'brand#1') OR contains('brand#1', v)
   THEN 0.6 + least(length(v), 7)::DOUBLE / greatest(length(v), 7) * 0.25 END) AS conf FROM vals GROUP BY 1)"""


@query(f'WITH {VALUES} SELECT c AS "column", round(conf, 9)::DOUBLE AS confidence FROM hits WHERE conf IS NOT NULL')
def value_to_columns(t):
    index = value_index(t.part.select("p_name", "p_brand", "p_type", "p_size"))
    return columns_containing(index, " Brand#1").withColumn("confidence", F.round("confidence", 9))


@query(f'WITH {VALUES} SELECT c AS "column", round(conf, 9)::DOUBLE AS confidence FROM hits WHERE conf IS NOT NULL ORDER BY conf DESC, c LIMIT 1')
def value_to_best_column(t):
    index = value_index(t.part.select("p_name", "p_brand", "p_type", "p_size"))
    return column_of_value(index, " Brand#1").withColumn("confidence", F.round("confidence", 9))
