"""Aggregation, cross-tabs, conditional sums."""

from pyspark.sql import functions as F

from ..operators.aggregates import (
    aggregate, column_total, extreme_rows, summary_strip, totals_row, with_averageif, with_countif, with_sumif, with_sumif_by,
)
from ..operators.pivots import pivot_table
from .dirt import DIRTY_LINEITEM, dirty_lineitem
from .registry import half_up, query, tidy


def _money(df, *names):
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


M = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_returnflag, l_linestatus, coalesce(SUM({M}), 0)::DOUBLE AS total,
             {tidy("AVG(l_quantity)")} AS mean_quantity, count(l_quantity) AS quantities, max(l_quantity) AS largest, min(l_quantity) AS smallest
           FROM dirty_lineitem GROUP BY ALL""")
def agg_multi(t):
    rows = _money(dirty_lineitem(t), "l_extendedprice")
    return aggregate(rows, [
        ("l_extendedprice", "SUM", "total"), ("l_quantity", "AVG", "mean_quantity"), ("l_quantity", "COUNT", "quantities"),
        ("l_quantity", "MAX", "largest"), ("l_quantity", "MIN", "smallest"),
    ], ["l_returnflag", "l_linestatus"])


@query("""SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total, count(*) AS order_count, max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders""")
def agg_global(t):
    total = _money(t.orders, "o_totalprice")
    return aggregate(total, [("o_totalprice", "SUM", "total"), ("o_orderkey", "COUNT", "order_count"),
                             ("o_totalprice", "MAX", "largest"), ("o_totalprice", "MIN", "smallest")])


@query(f"""SELECT c_mktsegment, {half_up("SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*)")} AS mean_balance FROM customer GROUP BY ALL""")
def agg_two_decimals(t):
    return aggregate(_money(t.customer, "c_acctbal"), [("c_acctbal", "AVG", "mean_balance")], ["c_mktsegment"], decimals=2)


@query("""SELECT SUM(try_cast(v AS DOUBLE)) AS total, count(try_cast(v AS DOUBLE)) AS cells FROM (
            SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'xx' ELSE o_orderkey::VARCHAR END AS v FROM orders)""")
def agg_column_total(t):
    v = F.when(F.col("o_orderkey") % 3 == 0, "xx").otherwise(F.col("o_orderkey").cast("string"))
    return column_total(t.orders.select(v.alias("v")), "v")


@query("""SELECT s_suppkey, s_name, s_acctbal, 'data' AS _row_kind FROM supplier
          UNION ALL SELECT NULL, NULL, SUM(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE, 'total' FROM supplier""")
def agg_totals_row(t):
    rows = _money(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal")
    return totals_row(rows, [("s_acctbal", "SUM")]).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query("SELECT * FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def agg_extreme_rows(t):
    return extreme_rows(t.part, "p_size", "MAX")


@query("""SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r FROM part) WHERE r = 1""")
def agg_extreme_rows_by_group(t):
    return extreme_rows(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", "MIN", ["p_brand"])


@query("""SELECT c_custkey, (SELECT SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING') AS building_total FROM customer""")
def agg_sumif(t):
    rows = _money(t.customer, "c_acctbal")
    return with_sumif(rows, "building_total", F.col("c_mktsegment") == "BUILDING", "c_acctbal").select("c_custkey", "building_total")


@query("""SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 25) AS large_parts FROM part""")
def agg_countif(t):
    return with_countif(t.part, "large_parts", F.col("p_size") > 25).select("p_partkey", "large_parts")


@query(f"""SELECT c_custkey, (SELECT {tidy("SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*)")} FROM customer WHERE c_nationkey < 5) AS mean_balance FROM customer""")
def agg_averageif(t):
    rows = _money(t.customer, "c_acctbal")
    return with_averageif(rows, "mean_balance", F.col("c_nationkey") < 5, "c_acctbal").select("c_custkey", "mean_balance")


@query("""SELECT o.o_orderkey, coalesce(s.total, 0)::DOUBLE AS customer_total FROM orders o LEFT JOIN (
            SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1) s USING (o_custkey)""")
def agg_sumif_by_row(t):
    rows = _money(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice")
    return with_sumif_by(rows, "customer_total", "o_custkey", "o_custkey", "o_totalprice").select("o_orderkey", "customer_total")


@query("""SELECT n.n_nationkey, count(c.c_custkey) AS customers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_regionkey GROUP BY 1""")
def agg_countif_by_row(t):
    """COUNTIF over another column of a joined table: criterion and matched column differ."""
    both = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("criterion"), F.lit(None).cast("int").alias("match")).unionByName(
        t.customer.select(F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("criterion"), F.col("c_nationkey").alias("match")))
    counted = with_sumif_by(both, "customers", "match", "criterion", None, "COUNT")
    return counted.filter("k is not null").select(F.col("k").alias("n_nationkey"), "customers")


@query("""SELECT p_brand, SUM(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE AS p_retailprice FROM part GROUP BY ALL""")
def pivot_rows(t):
    return pivot_table(_money(t.part, "p_retailprice"), ["p_brand"], "p_retailprice", "SUM")


FLAGS = ("A", "N", "R")


def _cross(agg, total=True):
    cells = ", ".join(f"coalesce({agg.format(f=f)}, 0)::DOUBLE AS \"_pvt_{f}\"" for f in FLAGS)
    body = f"SELECT l_linestatus, {cells} FROM lineitem GROUP BY 1"
    return body + (f" UNION ALL SELECT '合计', {cells} FROM lineitem" if total else "")


@query(_cross("SUM(" + M + ") FILTER (l_returnflag = '{f}')"))
def pivot_cross_sum(t):
    rows = _money(t.lineitem.select("l_linestatus", "l_returnflag", "l_extendedprice"), "l_extendedprice")
    return pivot_table(rows, ["l_linestatus"], "l_extendedprice", "SUM", "l_returnflag")


@query(_cross("count(*) FILTER (l_returnflag = '{f}')"))
def pivot_cross_count(t):
    return pivot_table(t.lineitem.select("l_linestatus", "l_returnflag", "l_shipdate"), ["l_linestatus"], "l_shipdate", "COUNT", "l_returnflag")


@query(_cross("max(l_quantity) FILTER (l_returnflag = '{f}')", total=False))
def pivot_cross_max(t):
    rows = t.lineitem.select("l_linestatus", "l_returnflag", "l_quantity")
    return pivot_table(rows, ["l_linestatus"], "l_quantity", "MAX", "l_returnflag", total=False)


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_linestatus,
             count(*) FILTER (l_returnflag IS NULL)::DOUBLE AS "_pvt_(blank)",
             count(*) FILTER (l_returnflag = 'A')::DOUBLE AS "_pvt_A", count(*) FILTER (l_returnflag = 'N')::DOUBLE AS "_pvt_N",
             count(*) FILTER (l_returnflag = 'R')::DOUBLE AS "_pvt_R" FROM dirty_lineitem GROUP BY 1""")
def pivot_blank_column(t):
    rows = dirty_lineitem(t).select("l_linestatus", "l_returnflag", "l_orderkey")
    return pivot_table(rows, ["l_linestatus"], "l_orderkey", "COUNT", "l_returnflag", total=False)


@query("""SELECT max(c_acctbal) AS max_value, min(c_acctbal) AS min_value, SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*) AS avg_value,
                 SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS total_value FROM customer""")
def chart_summary(t):
    return summary_strip(_money(t.customer, "c_acctbal"), "c_acctbal")
