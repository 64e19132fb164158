"""Sorting, first rows, de-duplication and cleaning."""

from pyspark.sql import functions as F

from ..operators.cleaning import blank_to_null, clean, clean_counts, drop_empty, drop_null_like, placeholders_to_null
from ..operators.ordering import (
    dedup, dedup_counts, duplicate_report, first_per_group, sort_rows, top_n, with_row_number,
)
from .dirt import COPIED_EVENTS, DIRTY_LINEITEM, DIRTY_ORDERS, copied_events, dirty_lineitem, dirty_orders
from .registry import query


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM dirty_lineitem
           ORDER BY l_quantity DESC NULLS LAST, l_extendedprice ASC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 1000""")
def sort_nulls_last_top_rows(t):
    rows = dirty_lineitem(t).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    return sort_rows(rows, [("l_quantity", False), ("l_extendedprice", True), ("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True)], limit=1000)


@query(f"""WITH {DIRTY_LINEITEM} SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM dirty_lineitem""")
def sort_whole_table(t):
    rows = dirty_lineitem(t).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return sort_rows(rows, [("l_returnflag", False), ("l_quantity", True)], tie="l_orderkey")


@query("""SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey::VARCHAR ELSE o_orderpriority END AS v FROM orders)
          ORDER BY v IS NULL, try_cast(v AS DOUBLE) IS NULL, try_cast(v AS DOUBLE), v, o_orderkey""")
def sort_mixed_cells(t):
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, F.col("o_orderpriority"))
    return sort_rows(t.orders.select("o_orderkey", v.alias("v")), [("v", True)], tie="o_orderkey")


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_rows_by_value(t):
    return top_n(t.events.select("event_id", "user_id", "value"), "value", 50, "event_id")


@query("""SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_row_per_group(t):
    return first_per_group(t.events.select("event_id", "ts", "user_id", "event_type", "value"), "event_type", ["ts", "event_id"])


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _row FROM orders")
def dense_row_numbers(t):
    return with_row_number(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def dedup_first(t):
    return dedup(t.events.select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"])


@query(f"WITH {COPIED_EVENTS} SELECT DISTINCT ts, user_id, event_type, value, props FROM copied_events")
def dedup_whole_rows(t):
    return dedup(copied_events(t).drop("row_id"))


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text""")
def dedup_documents(t):
    return dedup(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT user_id, event_type, count(*) AS row_count FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return duplicate_report(t.events, ["user_id", "event_type"])


@query(f"""WITH {COPIED_EVENTS}, g AS (SELECT count(*) AS n FROM copied_events GROUP BY ts, user_id, event_type, value, props)
           SELECT sum(n)::BIGINT AS input_rows, count(*) AS kept_rows, sum(n - 1)::BIGINT AS deleted_rows FROM g""")
def duplicate_counts(t):
    return dedup_counts(copied_events(t), ["ts", "user_id", "event_type", "value", "props"])


def _sparse(t):
    k = F.col("o_orderkey")
    return dirty_orders(t).select(
        "state", F.when(k % 5 == 0, " ").when(k % 5 == 1, "bad").otherwise(k.cast("string")).alias("quantity"),
        F.when(k % 2 == 0, "-").otherwise(F.col("o_orderpriority")).alias("priority"))


SPARSE = f"""{DIRTY_ORDERS}, sparse AS (SELECT state, CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'bad' ELSE o_orderkey::VARCHAR END AS quantity,
  CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE o_orderpriority END AS priority FROM dirty_orders)"""
LIKE = "(trim({c}) = '' OR lower(trim({c})) IN ('n/a', '-', 'null', 'nan', 'none'))"
S, P = LIKE.format(c="state"), LIKE.format(c="priority")


@query(f"""WITH {SPARSE} SELECT CASE WHEN trim(state) <> '' THEN state END AS state, try_cast(quantity AS DOUBLE) AS quantity, priority FROM sparse
           WHERE NOT ({S} AND {P} AND try_cast(quantity AS DOUBLE) IS NULL)""")
def clean_cells(t):
    return clean(_sparse(t), numeric=["quantity"])


@query(f"""WITH {SPARSE} SELECT CASE WHEN trim(state) <> '' THEN state END AS state, try_cast(quantity AS DOUBLE) AS quantity, priority FROM sparse
           WHERE trim(state) <> '' AND NOT ({S} AND {P} AND try_cast(quantity AS DOUBLE) IS NULL)""")
def clean_target_columns(t):
    return clean(_sparse(t), numeric=["quantity"], subset=["state"])


@query(f"""WITH {SPARSE}, x AS (SELECT {S} AND {P} AND try_cast(quantity AS DOUBLE) IS NULL AS gone, quantity FROM sparse)
           SELECT count(*) AS before_rows, count(*) FILTER (NOT gone) AS after_rows, count(*) FILTER (gone) AS deleted_rows,
             count(*) FILTER (trim(quantity) <> '' AND try_cast(quantity AS DOUBLE) IS NULL) AS invalid_cells FROM x""")
def clean_counters(t):
    return clean_counts(_sparse(t), numeric=["quantity"])


@query(f"WITH {SPARSE} SELECT CASE WHEN trim(state) <> '' THEN state END AS state, CASE WHEN trim(quantity) <> '' THEN quantity END AS quantity FROM sparse WHERE trim(state) <> '' OR trim(quantity) <> ''")
def drop_empty_rows(t):
    return drop_empty(blank_to_null(_sparse(t).select("state", "quantity")))


@query(f"WITH {SPARSE} SELECT state, priority FROM sparse WHERE NOT ({S} AND {P})")
def drop_placeholder_rows(t):
    return drop_null_like(_sparse(t).select("state", "priority"))


@query(f"WITH {SPARSE} SELECT CASE WHEN NOT {S} THEN state END AS state, CASE WHEN NOT {P} THEN priority END AS priority FROM sparse")
def nullify_placeholders(t):
    return placeholders_to_null(_sparse(t).select("state", "priority"))
