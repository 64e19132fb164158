"""Checks of results and table differences."""

from pyspark.sql import functions as F

from ..functions import fx
from ..operators import checks as C
from ..operators.aggregates import aggregate
from ..operators.cleaning import clean
from ..operators.lookups import lookup
from ..operators.ordering import dedup, sort_rows
from ..operators.predicates import cond, filter_rows
from ..operators.shaping import add_column
from ..operators.updates import set_where
from .dirt import DIRTY_LINEITEM, dirty_lineitem
from .registry import query, tidy


def _tests(*rows: str) -> str:
    """``name, passed, value, weight`` per row."""
    out = []
    for r in rows:
        name, passed, value, weight, source = r
        out.append(f"SELECT '{name}' AS \"check\", {passed} AS passed, ({value})::DOUBLE AS value, {weight}::DOUBLE AS weight FROM {source}")
    return " UNION ALL ".join(out)


PRICES = [cond("o_totalprice", "GT", 460000)]


@query("WITH x AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 460000) AS m FROM orders) "
       + _tests(("conditions_hold", "true", "0", 1, "x"), ("removed_share", "true", "(n - m)::DOUBLE / n", 1, "x"),
                ("removed_at_most_95_percent", "false", "(n - m)::DOUBLE / n", 0.6, "x WHERE (n - m)::DOUBLE / n > 0.95")))
def check_filter(t):
    return C.check_filter(t.orders, filter_rows(t.orders, PRICES), PRICES)


@query("WITH x AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 460000) AS m FROM orders) SELECT 2::BIGINT + 0 AS passed_checks, CASE WHEN (n - m)::DOUBLE / n > 0.95 THEN 3 ELSE 2 END::BIGINT AS all_checks, "
       "2.0::DOUBLE / CASE WHEN (n - m)::DOUBLE / n > 0.95 THEN 3 ELSE 2 END AS confidence FROM x")
def check_confidence(t):
    return C.confidence(check_filter(t))


TOTALS = [("l_quantity", "SUM", "quantity"), ("l_extendedprice", "MAX", "highest")]


@query("WITH x AS (SELECT count(DISTINCT l_returnflag) AS g FROM lineitem) " + _tests(
    ("column_count", "true", "3", 1, "x"), ("groups", "true", "0", 1, "x"), ("values", "false", "1", 1, "x")))
def check_aggregate(t):
    """One of the group values is off by one."""
    out = aggregate(t.lineitem, TOTALS, ["l_returnflag"])
    wrong = out.withColumn("quantity", F.col("quantity") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return C.check_aggregate(t.lineitem, wrong, TOTALS, ["l_returnflag"])


@query("WITH x AS (SELECT count(*) AS n, count(*) FILTER (o_custkey % 4 = 0) AS m, count(*) - count(DISTINCT o_custkey) AS d FROM orders) " + _tests(
    ("match_rate", "m::DOUBLE / n >= 0.5", "m::DOUBLE / n", 1, "x"), ("unmatched", "true", "n - m", 1, "x"),
    ("match_rate_very_low", "false", "m::DOUBLE / n", 0.4, "x WHERE m::DOUBLE / n < 0.3"), ("repeated_keys", "true", "d", 1, "x WHERE d > 0")))
def check_lookup(t):
    left = t.orders.select("o_orderkey", "o_custkey")
    k = F.col("c_custkey")
    other = t.customer.select(F.when(k % 4 == 0, k).otherwise(-1 - k).alias("c_custkey"), "c_name")
    return C.check_lookup(left, lookup(left, other, [("o_custkey", "c_custkey")], ["c_custkey"]), ["o_custkey"])


@query(f"WITH {DIRTY_LINEITEM}, x AS (SELECT count(*) FILTER (l_quantity IS NULL) AS z, min({tidy('l_extendedprice / l_quantity')}) AS lo, max({tidy('l_extendedprice / l_quantity')}) AS hi FROM dirty_lineitem) " + _tests(
    ("target_exists", "true", "1", 1, "x"), ("null_cells", "true", "z", 1, "x WHERE z > 0"), ("smallest", "true", "lo", 1, "x"), ("largest", "true", "hi", 1, "x")))
def check_formula(t):
    out = add_column(dirty_lineitem(t), "unit", fx.divide("l_extendedprice", "l_quantity"))
    return C.check_formula(out, "unit", ["l_extendedprice", "l_quantity"])


@query("WITH x AS (SELECT count(*) FILTER (c_acctbal < 1000) AS m, count(*) FILTER (c_custkey = 7 AND c_acctbal >= 1000) AS bad FROM customer) " + _tests(
    ("same_rows", "true", "0", 1, "x"), ("same_columns", "true", "5", 1, "x"), ("values", "bad = 0", "bad", 1, "x"), ("modified_rows", "true", "m", 1, "x")))
def check_update(t):
    """One row outside the condition was changed too."""
    where = cond("c_acctbal", "LT", 1000)
    after = set_where(t.customer, "c_mktsegment", "LOW", where)
    after = set_where(after, "c_mktsegment", "OTHER", (F.col("c_custkey") == 7) & (F.col("c_acctbal") >= 1000))
    return C.check_update(t.customer, after, "c_custkey", "c_mktsegment", "LOW", where)


@query("WITH x AS (SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS k FROM events) " + _tests(
    ("no_duplicates", "true", "0", 1, "x"), ("removed_rows", "true", "n - k", 1, "x")))
def check_dedup(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return C.check_dedup(e, dedup(e, ["user_id", "event_type"], ["event_id"]), ["user_id", "event_type"])


@query(f"WITH {DIRTY_LINEITEM}, x AS (SELECT count(*) AS n, 2 * count(*) FILTER (l_linenumber % 7 = 0) AS z FROM dirty_lineitem) " + _tests(
    ("nulls_not_increased", "true", "z", 1, "x"), ("removed_rows", "true", "z / 2", 1, "x"), ("same_columns", "true", "2", 1, "x"), ("null_rate", "true", "0", 0.6, "x")))
def check_clean(t):
    rows = dirty_lineitem(t).select("l_returnflag", "l_quantity")
    return C.check_clean(rows, clean(rows))


@query("SELECT 'not_empty' AS \"check\", true AS passed, count(*)::DOUBLE AS value, 0.3::DOUBLE AS weight FROM orders WHERE o_totalprice > 100000")
def check_chain(t):
    return C.check_chain(t.orders, filter_rows(t.orders, [cond("o_totalprice", "GT", 100000)]))


@query("""SELECT count(*) AS row_count, count(*) FILTER (d < p) AS violations FROM (
  SELECT o_orderdate AS d, lag(o_orderdate) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)""")
def check_sort_violations(t):
    """Rows sorted by price, checked against an ascending date order."""
    return C.sort_violations(sort_rows(t.orders, [("o_totalprice", False)], tie="o_orderkey"), [("o_orderdate", True)])


@query(_tests(("sorted", "true", "0", 1, "(SELECT 1)")))
def check_sort(t):
    sorts = [("o_orderpriority", False), ("o_totalprice", True)]
    return C.check_sort(sort_rows(t.orders, sorts, tie="o_orderkey"), sorts)


def _changed(t):
    c, k = t.customer, F.col("c_custkey")
    kept = c.filter(k % 20 != 0).withColumn("c_acctbal", F.when(k % 30 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = c.filter(k % 50 == 3).withColumn("c_custkey", k + 1_000_000_000)
    return kept.unionByName(new)


CHANGED = """added AS (SELECT c_custkey + 1000000000 AS k, 'added' AS status FROM customer WHERE c_custkey % 50 = 3),
  old AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 20 = 0 THEN 'removed' WHEN c_custkey % 30 = 1 THEN 'updated' ELSE 'unchanged' END AS status FROM customer)"""


@query(f"WITH {CHANGED} SELECT k AS c_custkey, status FROM added UNION ALL SELECT * FROM old")
def diff_row_changes(t):
    return C.row_changes(t.customer, _changed(t), ["c_custkey"])


@query(f"""WITH {CHANGED} SELECT (SELECT count(*) FROM added) AS rows_added, count(*) FILTER (status = 'removed') AS rows_removed, count(*) FILTER (status = 'updated') AS rows_updated,
  1 AS columns_added, 1 AS columns_removed, 0 AS columns_renamed FROM old""")
def diff_by_key(t):
    after = _changed(t).drop("c_name").withColumn("note", F.lit(""))
    return C.table_diff(t.customer, after, ["c_custkey"])


@query(f"""WITH {CHANGED} SELECT (SELECT count(*) FROM added) + count(*) FILTER (status = 'updated') AS rows_added, count(*) FILTER (status IN ('removed', 'updated')) AS rows_removed, 0::BIGINT AS rows_updated,
  0 AS columns_added, 0 AS columns_removed, 0 AS columns_renamed FROM old""")
def diff_whole_rows(t):
    return C.table_diff(t.customer, _changed(t))
