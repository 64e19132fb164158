"""Column shaping, updates and chained steps."""

from pyspark.sql import functions as F

from ..functions import fx
from ..operators.aggregates import aggregate
from ..operators.ordering import sort_rows
from ..operators.predicates import cond, filter_rows
from ..operators.shaping import (
    add_blank_row, add_column, add_constant, chain, keep_columns, limit_rows, remove_row, shape,
)
from ..operators.updates import apply_edits, cast_numbers, fill_blank, modified_count, set_where
from .dirt import DIRTY_ORDERS, dirty_orders
from .registry import half_up, query, tidy


@query("""SELECT o_orderpriority AS priority, o_orderkey, o_custkey, o_orderstatus AS state FROM orders
          ORDER BY o_orderkey LIMIT 500""")
def shape_keep_drop_rename_reorder(t):
    return shape(
        t.orders, include=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "unknown"],
        exclude=["O_ORDERDATE"], rename={"o_orderpriority": "priority", "o_orderstatus": "state"}, reorder=["priority"],
        limit=500, order_by=["o_orderkey"],
    )


@query("SELECT n_nationkey, n_name FROM nation")
def keep_listed_columns(t):
    return keep_columns(t.nation, ["n_name", "n_nationkey"])


@query("""SELECT r_regionkey, r_name, '' AS note FROM region WHERE r_regionkey <> 2
          UNION ALL SELECT NULL, '', NULL""")
def edit_rows_and_columns(t):
    noted = add_constant(t.region, "note")
    return remove_row(add_blank_row(noted, {"r_name": ""}), "r_regionkey", 2)


@query("SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def first_rows_in_order(t):
    return limit_rows(t.lineitem, 100, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"])


def _priced(df):
    return add_column(df, "_temp_net", fx.multiply("l_extendedprice", fx.subtract(F.lit(1), "l_discount")), decimals=2)


@query(f"""SELECT l_returnflag, SUM(CAST(net AS DECIMAL(18,2)))::DOUBLE AS revenue, count(*) AS line_count FROM (
             SELECT l_returnflag, {half_up(tidy("l_extendedprice * (" + tidy("1 - l_discount") + ")"))} AS net
             FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.05)
           GROUP BY l_returnflag ORDER BY revenue DESC""")
def chained_steps(t):
    """Filter, formula, aggregate and sort as one lazy plan."""
    return chain(
        t.lineitem,
        lambda d: filter_rows(d, [cond("l_linestatus", "EQ", "f"), cond("l_discount", "GTE", 0.05)]),
        _priced,
        lambda d: d.withColumn("net", F.col("_temp_net").cast("decimal(18,2)")),
        lambda d: aggregate(d, [("net", "SUM", "revenue"), ("l_returnflag", "COUNT", "line_count")], ["l_returnflag"]),
        lambda d: sort_rows(d, [("revenue", False)]),
    )


@query("""SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total
          FROM orders GROUP BY ALL""")
def chained_quarter_totals(t):
    return chain(
        t.orders,
        lambda d: add_column(d, "y", fx.year("o_orderdate", kind="date")),
        lambda d: add_column(d, "q", F.quarter("o_orderdate")),
        lambda d: d.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")),
        lambda d: aggregate(d, [("o_totalprice", "SUM", "total")], ["y", "q"]),
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'ALL' AS c_mktsegment FROM customer")
def update_constant(t):
    return set_where(t.customer, "c_mktsegment", "ALL")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
                 c_mktsegment FROM customer""")
def update_where(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return set_where(rows, "c_acctbal", 0, [cond("c_acctbal", "LT", 0), cond("c_mktsegment", "EQ", "building")])


@query(f"""SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN {tidy("s_acctbal + 1000")} ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier""")
def update_expr(t):
    rows = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey")
    return set_where(rows, "s_acctbal", fx.add("s_acctbal", F.lit(1000)), cond("s_nationkey", "LT", 10))


@query(f"WITH {DIRTY_ORDERS} SELECT o_orderkey, CASE WHEN trim(state) = '' THEN 'UNKNOWN' ELSE state END AS state FROM dirty_orders")
def fill_blank_cells(t):
    return fill_blank(dirty_orders(t).select("o_orderkey", "state"), "state", "UNKNOWN")


@query(f"WITH {DIRTY_ORDERS} SELECT o_orderkey, try_cast(amount AS DOUBLE) AS amount FROM dirty_orders")
def update_cast_numbers(t):
    return cast_numbers(dirty_orders(t).select("o_orderkey", "amount"), "amount")


@query(f"""WITH {DIRTY_ORDERS} SELECT o_orderkey, try_cast(amount AS DOUBLE) AS amount,
             CASE WHEN try_cast(amount AS DOUBLE) IS NULL THEN amount END AS amount_text FROM dirty_orders""")
def update_cast_keeping_text(t):
    """What is no number is not lost: its text stays beside it."""
    return cast_numbers(dirty_orders(t).select("o_orderkey", "amount"), "amount", unreadable="amount_text")


@query("SELECT count(*) FILTER (c_acctbal < 0) AS modified_rows FROM customer")
def update_count(t):
    return modified_count(t.customer, cond("c_acctbal", "LT", 0))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'edited' ELSE c_name END AS c_name, c_nationkey,
                 CASE WHEN c_custkey % 15 = 0 THEN c_custkey::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def apply_cell_edits(t):
    """Two batches of edits; the later edit of a cell wins."""
    c = t.customer
    k = F.col("c_custkey")
    names = c.filter(k % 10 == 3)
    edits = (
        names.select("c_custkey", F.lit("c_name").alias("column"), F.lit("draft").alias("value"), F.lit(1).alias("seq"))
        .unionByName(names.select("c_custkey", F.lit("c_name").alias("column"), F.lit("edited").alias("value"), F.lit(2).alias("seq")))
        .unionByName(c.filter(k % 15 == 0).select("c_custkey", F.lit("c_acctbal").alias("column"), k.cast("string").alias("value"), F.lit(1).alias("seq")))
    )
    return apply_edits(c, edits, "c_custkey", "seq")
