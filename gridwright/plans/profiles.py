"""Profiles, table statistics and checks before an operation."""

from pyspark.sql import functions as F

from ..operators.profiling import (
    column_samples, column_stats, distinct_estimates, group_key_count, null_strategy, preflight, profile, profile_globals, profile_warnings,
    table_sizes, table_stats, top_values, total_size,
)
from ..sources.files import type_facts
from .dirt import CONTACTS, COPIED_EVENTS, DIRTY_ORDERS, contacts, copied_events, dirty_orders
from .registry import half_up, query

SHAPES = ("'^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$'", "'^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$'", "'^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}$'", "'^[0-9]{4}[-/][0-9]{1,2}$'")
NUMBER = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _facts(table: str, columns: dict[str, str]) -> str:
    """One row of facts per column; kind is text, number or date."""
    parts = []
    for c, kind in columns.items():
        if kind == "number":
            empty, number, dated = f"{c} IS NULL", f"{c}::DOUBLE", "false"
        elif kind == "date":
            empty, number, dated = f"{c} IS NULL", "NULL::DOUBLE", "true"
        else:
            empty = f"({c} IS NULL OR {c} = '')"
            number = f"CASE WHEN regexp_matches(trim({c}), {NUMBER}) THEN try_cast(trim({c}) AS DOUBLE) END"
            dated = "(" + " OR ".join(f"regexp_matches(trim({c}), {s})" for s in SHAPES) + ")"
        parts.append(f"""SELECT '{c}' AS c, count(*) AS n, count(*) FILTER ({empty}) AS nulls, count(DISTINCT {c}) FILTER (NOT {empty}) AS uniq,
          count(*) FILTER (NOT {empty} AND {number} IS NOT NULL) AS nums, count(*) FILTER (NOT {empty} AND {number} IS NULL AND {dated}) AS dates,
          min({number}) AS lo, max({number}) AS hi, sum(({number})::DECIMAL(18,2))::DOUBLE AS total, '{"text" if kind == "text" else kind}' AS declared FROM {table}""")
    return " UNION ALL ".join(parts)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return f"""facts AS ({_facts(table, columns)}), shares AS (SELECT *, n - nulls AS filled, coalesce(nums::DOUBLE / nullif(n - nulls, 0), 0) AS ns, coalesce(dates::DOUBLE / nullif(n - nulls, 0), 0) AS ds FROM facts),
      prof AS (SELECT c, n, nulls, nulls::DOUBLE / n AS null_rate, uniq, uniq::DOUBLE / n AS unique_rate,
        CASE WHEN filled = 0 THEN 'string' WHEN ns >= 0.8 THEN 'number' WHEN ds >= 0.8 THEN 'date' WHEN ns > 0 OR ds > 0 THEN 'unknown' ELSE 'string' END AS kind,
        CASE WHEN filled = 0 THEN 0.3 WHEN ns >= 0.8 THEN ns WHEN ds >= 0.8 THEN ds WHEN ns > 0 OR ds > 0 THEN greatest(ns, ds) ELSE 0.9 END::DOUBLE AS conf,
        CASE WHEN ns >= 0.8 THEN lo END AS lo, CASE WHEN ns >= 0.8 THEN hi END AS hi, CASE WHEN ns >= 0.8 THEN {half_up("total / nums")} END AS mean, declared FROM shares)"""


CONTACT_COLUMNS = {"c_custkey": "number", "phone": "text", "card": "text", "birth": "text", "joined": "text", "points": "text"}


def _contact_profile(t):
    return profile(contacts(t).select(*CONTACT_COLUMNS))


@query(f"""WITH {CONTACTS}, {_profile_sql("contacts", CONTACT_COLUMNS)}
  SELECT c AS "column", n AS row_count, nulls AS null_count, null_rate, uniq AS unique_count, unique_rate, kind AS inferred_type, conf AS confidence,
    lo AS min_value, hi AS max_value, mean AS avg_value, declared AS declared_type FROM prof""")
def profile_contacts(t):
    return _contact_profile(t)


ORDER_COLUMNS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"}


@query(f"""WITH {_profile_sql("orders", ORDER_COLUMNS)}
  SELECT c AS "column", n AS row_count, nulls AS null_count, null_rate, uniq AS unique_count, unique_rate, kind AS inferred_type, conf AS confidence,
    lo AS min_value, hi AS max_value, round(mean, 1) AS avg_value, declared AS declared_type FROM prof""")
def profile_orders(t):
    return profile(t.orders).withColumn("avg_value", F.round("avg_value", 1))


GLOBALS = """globals AS (SELECT sum(k)::BIGINT AS n, count(*) AS d, sum(k * e)::BIGINT AS nulls FROM (
  SELECT count(*) AS k, any_value((state = '')::INT + (priority = '')::INT) AS e FROM placed GROUP BY state, priority))"""
PLACED = f"{DIRTY_ORDERS}, placed AS (SELECT state, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS priority FROM dirty_orders)"


def _placed(t):
    return dirty_orders(t).select("state", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"))


@query(f"""WITH {PLACED}, {GLOBALS} SELECT n AS row_count, 2 AS column_count, nulls AS null_cells, nulls::DOUBLE / (n * 2) AS null_rate,
             (n - d)::DOUBLE / n AS duplicate_row_rate FROM globals""")
def profile_global_figures(t):
    return profile_globals(_placed(t))


@query(f"""WITH {PLACED}, {_profile_sql("placed", {"state": "text", "priority": "text"})}, {GLOBALS},
  w AS (SELECT c AS "column", CASE WHEN null_rate > 0.3 THEN 'high_null_rate' ELSE 'nulls_present' END AS code, CASE WHEN null_rate > 0.3 THEN 'warning' ELSE 'info' END AS severity FROM prof WHERE null_rate > 0.1
    UNION ALL SELECT c, 'low_type_confidence', 'warning' FROM prof WHERE conf < 0.6
    UNION ALL SELECT c, 'type_mismatch', 'info' FROM prof WHERE CASE declared WHEN 'text' THEN 'string' ELSE declared END <> kind AND kind <> 'unknown' AND conf >= 0.7
    UNION ALL SELECT '*', 'high_duplicate_rate', 'warning' FROM globals WHERE (n - d)::DOUBLE / n > 0.3
    UNION ALL SELECT '*', 'high_global_null_rate', 'warning' FROM globals WHERE nulls::DOUBLE / (n * 2) > 0.2) SELECT * FROM w""")
def profile_warning_list(t):
    rows = _placed(t)
    return profile_warnings(profile(rows), profile_globals(rows))


@query("""SELECT 'orders' AS "table", count(*) AS row_count, 6 AS column_count FROM orders UNION ALL SELECT 'nation', count(*), 3 FROM nation""")
def table_size_list(t):
    return table_sizes({"orders": t.orders, "nation": t.nation})


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) AS row_count, 6 AS column_count")
def table_size_total(t):
    return total_size({"orders": t.orders, "nation": t.nation})


@query(f"""WITH {PLACED}, g AS (SELECT count(*) AS k, any_value((lower(trim(state)) IN ('', 'n/a', '-'))::INT + (priority = '')::INT) AS z FROM placed GROUP BY state, priority)
  SELECT sum(k)::BIGINT AS row_count, 2 AS column_count, sum(k * z)::BIGINT AS null_cells, coalesce(sum(k) FILTER (z = 2), 0)::BIGINT AS empty_rows, sum(k - 1)::BIGINT AS duplicate_rows FROM g""")
def table_statistics(t):
    return table_stats(_placed(t))


@query(f"""WITH {DIRTY_ORDERS}, v AS (SELECT 'state' AS c, CASE WHEN lower(trim(state)) NOT IN ('', 'n/a', '-') THEN state END AS x, NULL::DOUBLE AS num FROM dirty_orders
    UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, o_custkey::DOUBLE FROM dirty_orders)
  SELECT c AS "column", count(*) - count(x) AS null_count, (count(*) - count(x))::DOUBLE / count(*) AS null_rate, count(DISTINCT x) AS unique_count,
    count(DISTINCT x)::DOUBLE / count(x) AS unique_rate, min(num) AS min_value, max(num) AS max_value, round(sum(num::DECIMAL(18,2))::DOUBLE / count(num), 6) AS avg_value FROM v GROUP BY 1""")
def column_statistics(t):
    return column_stats(dirty_orders(t).select("state", "o_custkey")).withColumn("avg_value", F.round("avg_value", 6))


@query("""SELECT count(*) AS group_keys FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)""")
def group_key_number(t):
    return group_key_count(t.customer, ["c_nationkey", "c_mktsegment"])


@query("""WITH v AS (SELECT 'p_name' AS c, p_name AS x, p_partkey AS o FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR, p_partkey FROM part),
  f AS (SELECT c, trim(x) AS x, min(o) AS o FROM v WHERE trim(x) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) AS k FROM f)
  SELECT c AS "column", string_agg(x, '|' ORDER BY k) AS samples FROM r WHERE k <= 10 GROUP BY 1""")
def column_sample_values(t):
    out = column_samples(t.part, 10, "p_partkey", ["p_name", "p_brand", "p_size"])
    return out.select("column", F.array_join("values", "|").alias("samples"))


@query("""WITH v AS (SELECT 'event_type' AS c, event_type AS x FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events),
  g AS (SELECT c, x, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, x) AS k FROM g)
  SELECT c AS "column", k::INT AS rank, x AS value, n AS row_count FROM r WHERE k <= 5""")
def most_frequent_values(t):
    return top_values(t.events, 5, ["event_type", "user_id"])


@query(f"""WITH {CONTACTS}, t AS (SELECT 'c_custkey' AS "column", 'number' AS type UNION ALL SELECT 'birth', 'date' UNION ALL SELECT 'joined', 'text' UNION ALL SELECT 'points', 'text')
  SELECT "column", CASE "column" WHEN 'birth' THEN (SELECT CASE WHEN bool_and(regexp_matches(birth, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}')) THEN 'date' ELSE 'text' END FROM contacts) ELSE type END AS type FROM t""")
def whole_column_types(t):
    return type_facts(contacts(t), ["c_custkey", "birth", "joined", "points"])


def _preflight_sql(where: str, code: str, severity: str = "warning") -> str:
    return f"SELECT c AS \"column\", '{code}' AS code, '{severity}' AS severity FROM prof WHERE {where}"


BASE = f"WITH {CONTACTS}, {_profile_sql('contacts', CONTACT_COLUMNS)} "


@query(BASE + _preflight_sql("c IN ('points', 'c_custkey') AND null_rate > 0.5", "mostly_null") + " UNION ALL "
       + _preflight_sql("c IN ('points', 'c_custkey') AND kind = 'number'", "text_match_on_number"))
def preflight_filter(t):
    return preflight(_contact_profile(t), "filter", ["points", "c_custkey"], text_match=True)


@query(BASE + _preflight_sql("c = 'points' AND kind <> 'number'", "not_numeric", "error") + " UNION ALL "
       + _preflight_sql("c = 'points' AND null_rate > 0.1", "nulls_skipped") + " UNION ALL "
       + _preflight_sql("c = 'phone' AND unique_rate > 0.5 AND n > 100", "too_many_groups"))
def preflight_aggregate(t):
    return preflight(_contact_profile(t), "aggregate", ["points"], method="SUM", group_by=["phone"])


@query(BASE + _preflight_sql("c IN ('joined', 'points') AND unique_rate < 0.2", "repeated_key") + " UNION ALL "
       + _preflight_sql("c IN ('joined', 'points') AND null_rate > 0.1", "null_keys"))
def preflight_lookup_keys(t):
    return preflight(_contact_profile(t), "lookup", ["joined", "points"])


@query(f"""WITH {PLACED}, {_profile_sql("placed", {"state": "text", "priority": "text"})}, {GLOBALS}
  {_preflight_sql("null_rate > 0.2", "null_keys")} UNION ALL SELECT '*', 'many_duplicates', 'warning' FROM globals WHERE (n - d)::DOUBLE / n > 0.3""")
def preflight_dedup(t):
    rows = _placed(t)
    return preflight(profile(rows), "dedup", ["state", "priority"], profile_globals(rows))


@query(BASE + _preflight_sql("c IN ('points', 'c_custkey') AND kind <> 'number'", "not_numeric"))
def preflight_formula(t):
    return preflight(_contact_profile(t), "formula", ["points", "c_custkey"], method="ROUND")


@query(BASE + """SELECT c AS "column", CASE WHEN null_rate > 0.5 THEN 'warn' ELSE 'treat_as_zero' END AS strategy,
  CASE WHEN null_rate > 0.5 THEN 0.6 WHEN null_rate < 0.05 THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM prof""")
def null_strategies(t):
    return null_strategy(_contact_profile(t), "formula")


@query("""WITH v AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 2
            UNION ALL SELECT 'o_orderstatus', o_orderstatus, min(o_orderkey) FROM orders GROUP BY 2),
          r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f, v) AS n FROM v)
          SELECT "column", string_agg(v, '|' ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY 1""")
def profile_samples(t):
    """First five distinct values of each column, in row order."""
    out = profile(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], order="o_orderkey")
    return out.select("column", F.array_join("sample_values", "|").alias("samples"))


@query("""SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS unique_count, true AS near FROM orders
          UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), true FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), true FROM orders""")
def distinct_estimates_near(t):
    """Estimates are within a fifth of the exact counts of the whole table."""
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    exact = profile(t.orders, names).select("column", "unique_count")
    near = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= F.col("unique_count") * 0.2
    return distinct_estimates(t.orders, names).join(exact, "column").select("column", "unique_count", near.alias("near"))
