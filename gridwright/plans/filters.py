"""Filters."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators.predicates import (
    cond, delete_where, filter_by_table, filter_date_range, filter_month, filter_rows, filter_summary,
)
from .dirt import DIRTY_LINEITEM, DIRTY_ORDERS, dirty_lineitem, dirty_orders
from .registry import query

LINE = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]
LINE_SQL = "l_orderkey, l_linenumber, l_returnflag, l_quantity"


@query("SELECT * FROM orders WHERE lower(o_orderstatus) = 'f'")
def filter_eq_ci(t):
    return filter_rows(t.orders, [cond("o_orderstatus", "EQ", "f")])


@query(f"WITH {DIRTY_LINEITEM} SELECT {LINE_SQL} FROM dirty_lineitem WHERE lower(l_returnflag) <> 'n'")
def filter_ne_null(t):
    return filter_rows(dirty_lineitem(t).select(LINE), [cond("l_returnflag", "NE", "n")])


@query("""SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a'
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS v FROM orders)
          WHERE CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN try_cast(v AS DOUBLE) > 100000 ELSE v > '100000' END""")
def filter_cmp_numeric_first(t):
    v = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("string"))
    return filter_rows(t.orders.select("o_orderkey", v.alias("v")), [cond("v", "GT", 100000)])


@query("""SELECT l_orderkey, l_linenumber, l_discount, l_quantity FROM lineitem
          WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24""")
def filter_gte_lte_lt(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    return filter_rows(rows, [cond("l_discount", "GTE", 0.05), cond("l_discount", "LTE", 0.07), cond("l_quantity", "LT", 24)])


@query("""SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
          WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-06-30'""")
def filter_between_dates(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return filter_rows(rows, [cond("l_shipdate", "BETWEEN", ("1998-01-01", "1999-06-30"))])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low')")
def filter_in(t):
    return filter_rows(t.orders.select("o_orderkey", "o_orderpriority"), [cond("o_orderpriority", "IN", ["1-URGENT", "5-low"])])


@query(f"WITH {DIRTY_LINEITEM} SELECT {LINE_SQL} FROM dirty_lineitem WHERE lower(l_returnflag) NOT IN ('a', 'x')")
def filter_not_in(t):
    return filter_rows(dirty_lineitem(t).select(LINE), [cond("l_returnflag", "NOT_IN", ["A", "x"])])


@query("SELECT * FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(t):
    return filter_rows(t.part, [cond("p_name", "CONTAINS", "RING")])


@query("SELECT * FROM part WHERE starts_with(lower(p_name), 'red') OR ends_with(lower(p_type), 'y')")
def filter_prefix_suffix(t):
    return filter_rows(t.part, [cond("p_name", "STARTS_WITH", "Red"), cond("p_type", "ENDS_WITH", "y", logic="OR")])


@query(f"WITH {DIRTY_ORDERS} SELECT o_orderkey, state FROM dirty_orders WHERE state IS NULL OR trim(state) = ''")
def filter_is_blank(t):
    return filter_rows(dirty_orders(t).select("o_orderkey", "state"), [cond("state", "IS_NULL")])


@query(f"WITH {DIRTY_ORDERS} SELECT o_orderkey, state FROM dirty_orders WHERE state IS NOT NULL AND trim(state) <> ''")
def filter_not_blank(t):
    return filter_rows(dirty_orders(t).select("o_orderkey", "state"), [cond("state", "NOT_NULL")])


@query("""SELECT l_orderkey, l_linenumber, l_tax, d FROM (SELECT *, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem)
          WHERE l_tax > d""")
def filter_col_vs_col(t):
    d = F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount"))
    return filter_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", d.alias("d")), [cond("l_tax", "GT", other="d")])


MIXED = [
    cond("l_returnflag", "EQ", "R"), cond("l_quantity", "GT", 45, logic="OR"), cond("l_discount", "LT", 0.03, logic="AND"),
]


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount FROM lineitem
          WHERE (l_returnflag = 'R' OR l_quantity > 45) AND l_discount < 0.03""")
def filter_fold_and_or(t):
    return filter_rows(t.lineitem.select(*LINE, "l_discount"), MIXED)


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount FROM lineitem
          WHERE l_returnflag = 'R' OR (l_quantity > 45 AND l_discount < 0.03)""")
def filter_or_groups(t):
    return filter_rows(t.lineitem.select(*LINE, "l_discount"), MIXED, mode="groups")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1997-05-01'")
def filter_by_month(t):
    return filter_month(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 1997, 5)


@query(f"""WITH {DIRTY_ORDERS} SELECT o_orderkey, day FROM dirty_orders
           WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""")
def filter_text_dates(t):
    return filter_date_range(dirty_orders(t).select("o_orderkey", "day"), "day", "1997-01-01", "1997-03-31")


@query("""SELECT count(*) AS before_rows, count(*) FILTER (o_totalprice > 200000) AS after_rows,
                 count(*) FILTER (NOT (o_totalprice > 200000)) AS removed_rows FROM orders""")
def filter_counts(t):
    return filter_summary(t.orders, [cond("o_totalprice", "GT", 200000)])


@query(f"""WITH {DIRTY_LINEITEM} SELECT {LINE_SQL} FROM dirty_lineitem
           WHERE NOT coalesce(l_returnflag = 'N' AND l_quantity > 10, false)""")
def delete_rows_where(t):
    return delete_where(dirty_lineitem(t).select(LINE), [cond("l_returnflag", "EQ", "N"), cond("l_quantity", "GT", 10)])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
          (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def filter_in_table(t):
    listed = filter_rows(t.customer, [cond("c_mktsegment", "EQ", "machinery")])
    return filter_by_table(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", listed, "c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN
          (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def filter_not_in_table(t):
    listed = filter_rows(t.customer, [cond("c_mktsegment", "EQ", "machinery")])
    return filter_by_table(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", listed, "c_custkey", keep=False)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT 4 * i FROM range(1500) t(i))""")
def filter_in_long_integers(t):
    """1,500 values written as floats on an integer column."""
    return filter_rows(t.orders.select("o_orderkey", "o_totalprice"), [cond("o_orderkey", "IN", [4.0 * i for i in range(1500)])])


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE floor(l_extendedprice) NOT IN (SELECT 3 * i FROM range(20000) t(i))""")
def filter_not_in_long_doubles(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.floor("l_extendedprice").cast("double").alias("whole"))
    return filter_rows(rows, [cond("whole", "NOT_IN", [3 * i for i in range(20000)])]).drop("whole")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
          WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(DATE '1992-01-01' + CAST(2 * i AS INTEGER) AS DATE) FROM range(1200) t(i)) OR o_orderkey < 100""")
def filter_in_long_dates_folded(t):
    """1,200 days as text on a date column, joined to another condition."""
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    start = dt.date(1992, 1, 1)
    days = [str(start + dt.timedelta(days=2 * i)) for i in range(1200)]
    return filter_rows(rows, [cond("day", "IN", days), cond("o_orderkey", "LT", 100, logic="OR")])


@query("""SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN (SELECT 'customer#' || lpad(CAST(2 * i AS VARCHAR), 9, '0') FROM range(1100) t(i)) AND c_custkey > 10""")
def filter_not_in_long_texts_folded(t):
    names = [f"CUSTOMER#{2 * i:09d}" for i in range(1100)]
    return filter_rows(t.customer.select("c_custkey", "c_name"), [cond("c_name", "NOT_IN", names), cond("c_custkey", "GT", 10)])
