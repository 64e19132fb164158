"""Dirty variants of the test tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .registry import Tables

FULL = "".join(chr(p) for p in range(0xFF01, 0xFF5F))
HALF = "".join(chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F))
SQL_FULL, SQL_HALF = FULL, HALF.replace("'", "''")


def norm_sql(x: str) -> str:
    return f"lower(translate(regexp_replace({x}, '[\\s　]+', '', 'g'), '{SQL_FULL}', '{SQL_HALF}'))"


def _pick(key: Column, *cases, other) -> Column:
    n = len(cases) + 1
    out = F.when(F.lit(False), other)
    for i, c in enumerate(cases):
        out = out.when(key % n == i, c)
    return out.otherwise(other)


def dirty_orders(t: Tables) -> DataFrame:
    """Orders with placeholder states, amounts as dirty text and dates in three shapes."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.floor("o_totalprice").cast("string")
    state = (
        F.when(k % 6 == 0, "").when(k % 6 == 1, "  ").when(k % 6 == 2, "N/A").when(k % 6 == 3, "-").otherwise(F.col("o_orderstatus"))
    )
    amount = F.when(k % 4 == 0, F.concat(F.lit("￥"), x)).when(k % 4 == 1, F.concat(x, F.lit("元"))).when(
        k % 4 == 2, F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    date = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "yyyy/MM/dd")).otherwise(
        F.date_format(d, "yyyy年MM月dd日"))
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        state.alias("state"), amount.alias("amount"), date.alias("day"),
    )


DIRTY_ORDERS = """dirty_orders AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
    CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'N/A' WHEN 3 THEN '-' ELSE o_orderstatus END AS state,
    CASE o_orderkey % 4 WHEN 0 THEN '￥' || x WHEN 1 THEN x || '元' WHEN 2 THEN '(' || x || ')' ELSE x END AS amount,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
      ELSE strftime(o_orderdate, '%Y年%m月%d日') END AS day
  FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS x FROM orders))"""


def dirty_lineitem(t: Tables) -> DataFrame:
    """Line items with null quantities and null flags."""
    gap = F.col("l_linenumber") % 7 == 0
    return t.lineitem.withColumn("l_quantity", F.when(~gap, F.col("l_quantity"))).withColumn(
        "l_returnflag", F.when(~gap, F.col("l_returnflag")))


DIRTY_LINEITEM = """dirty_lineitem AS (
  SELECT * REPLACE (CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
                    CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag)
  FROM lineitem)"""


def contacts(t: Tables) -> DataFrame:
    """Customers with phone, e-mail, ID card, dates and balance as partly broken text."""
    k = F.col("c_custkey")
    ks = k.cast("string")
    phone = F.concat(F.lit("1"), F.lpad(ks, 10, "3"))
    phone = F.when(k % 5 == 0, F.concat(F.left(phone, F.lit(3)), F.lit("-"), F.substring(phone, 4, 8))).when(
        k % 5 == 1, F.left(phone, F.lit(10))).otherwise(phone)
    email = F.when(k % 7 == 0, F.concat(F.lit("user "), ks, F.lit("@mail.com"))).when(
        k % 7 == 1, F.concat(F.lit("user"), ks)).otherwise(F.concat(F.lit("user"), ks, F.lit("@mail.com")))
    born = F.date_add(F.lit("1950-01-01").cast("date"), (k % 15000).cast("int"))
    tail = F.lpad((k % 1000).cast("string"), 3, "0")
    card = F.when(k % 9 == 0, F.concat(F.lit("110101"), F.date_format(born, "yyMMdd"), tail)).when(
        k % 9 == 1, F.concat(F.lit("110101"), F.date_format(born, "yyyyMMdd"))).otherwise(
        F.concat(F.lit("110101"), F.date_format(born, "yyyyMMdd"), tail, F.lit("X")))
    birth = F.date_format(F.when(k % 11 == 0, F.date_add(born, 1)).otherwise(born), "yyyy-MM-dd")
    joined = F.when(k % 13 == 0, "2024年1月5日").when(k % 17 == 0, "2099-01-01").when(k % 19 == 0, " ").otherwise("2024/3/5")
    x = F.abs(F.floor("c_acctbal")).cast("string")
    balance = F.when(k % 4 == 0, F.concat(F.lit("￥"), x)).when(k % 4 == 1, F.concat(x, F.lit(",000"))).when(
        k % 4 == 2, F.concat(F.lit("-"), x)).otherwise(x)
    points = F.when(k % 10 == 0, "三百二十").when(k % 10 == 1, "many").when(k % 10 == 2, "").otherwise(ks)
    return t.customer.select(
        "c_custkey", "c_name", phone.alias("phone"), email.alias("email"), card.alias("card"), birth.alias("birth"),
        joined.alias("joined"), balance.alias("balance"), points.alias("points"),
    )


CONTACTS = """contacts AS (
  SELECT c_custkey, c_name,
    CASE c_custkey % 5 WHEN 0 THEN substr(p, 1, 3) || '-' || substr(p, 4) WHEN 1 THEN substr(p, 1, 10) ELSE p END AS phone,
    CASE c_custkey % 7 WHEN 0 THEN 'user ' || ks || '@mail.com' WHEN 1 THEN 'user' || ks ELSE 'user' || ks || '@mail.com' END AS email,
    CASE c_custkey % 9 WHEN 0 THEN '110101' || strftime(born, '%y%m%d') || tail
      WHEN 1 THEN '110101' || strftime(born, '%Y%m%d') ELSE '110101' || strftime(born, '%Y%m%d') || tail || 'X' END AS card,
    strftime(CASE WHEN c_custkey % 11 = 0 THEN born + 1 ELSE born END, '%Y-%m-%d') AS birth,
    CASE WHEN c_custkey % 13 = 0 THEN '2024年1月5日' WHEN c_custkey % 17 = 0 THEN '2099-01-01'
      WHEN c_custkey % 19 = 0 THEN ' ' ELSE '2024/3/5' END AS joined,
    CASE c_custkey % 4 WHEN 0 THEN '￥' || x WHEN 1 THEN x || ',000' WHEN 2 THEN '-' || x ELSE x END AS balance,
    CASE c_custkey % 10 WHEN 0 THEN '三百二十' WHEN 1 THEN 'many' WHEN 2 THEN '' ELSE ks END AS points
  FROM (SELECT *, c_custkey::VARCHAR AS ks, '1' || lpad(c_custkey::VARCHAR, 10, '3') AS p,
          DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER) AS born,
          lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS tail,
          CAST(CAST(abs(floor(c_acctbal)) AS BIGINT) AS VARCHAR) AS x
        FROM customer))"""
ROLES = {"phone": ["phone"], "id_card": ["card"], "email": ["email"], "date": ["joined"], "amount": ["balance"]}


def copied_events(t: Tables) -> DataFrame:
    """Events with every fiftieth row repeated under a new row id."""
    e = t.events
    body = ["ts", "user_id", "event_type", "value", "props"]
    return e.select(F.col("event_id").alias("row_id"), *body).unionByName(
        e.filter(F.col("event_id") % 50 == 0).select((F.col("event_id") + 1_000_000_000_000).alias("row_id"), *body))


COPIED_EVENTS = """copied_events AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value, props FROM events
  UNION ALL
  SELECT event_id + 1000000000000, ts, user_id, event_type, value, props FROM events WHERE event_id % 50 = 0)"""
