"""Audit findings, fixes and scores; quality rules."""

from pyspark.sql import functions as F

from ..functions.cells import text
from ..operators import audit as A
from ..operators import findings as R
from ..operators import quality as Q
from ..operators.duplicates import duplicate_rows, duplicate_samples
from .dirt import CONTACTS, COPIED_EVENTS, DIRTY_ORDERS, ROLES, contacts, copied_events, dirty_orders
from .registry import query

AS_OF = "2026-01-01"
FIELDS = ["row_id", "column", "rule", "original_value", "suggested_value", "can_auto_fix"]


def _found(*parts: str) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS row_id, {c} AS \"column\", '{rule}' AS rule, {original} AS original_value, {fix} AS suggested_value, {can} AS can_auto_fix FROM contacts WHERE {where}"
        for c, rule, original, fix, can, where in parts)


PHONE = ("'phone'", "phone_format", "phone", "NULL", "false", "NOT regexp_matches(replace(phone, '-', ''), '^1[0-9]{10}$')")
CARD = ("'card'", "id_card_format", "card", "NULL", "false", "NOT regexp_matches(card, '^[0-9]{17}[0-9X]?$')")
GOOD = "regexp_matches(replace(email, ' ', ''), '^[^ @]+@[^ @]+\\.[^ @]+$')"
EMAIL = ("'email'", "email_format", "email", f"CASE WHEN {GOOD} THEN replace(email, ' ', '') END", GOOD, "NOT regexp_matches(email, '^[^ @]+@[^ @]+\\.[^ @]+$')")
DATE = ("'joined'", "date_invalid", "joined", "NULL", "false", "trim(joined) <> '' AND NOT regexp_matches(joined, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$')")
FUTURE = ("'joined'", "date_future", "joined", "NULL", "false", "joined = '2099-01-01'")
BARE = "replace(replace(balance, '￥', ''), ',', '')"
AMOUNT = ("'balance'", "amount_format", "balance", BARE, "true", "contains(balance, '￥') OR contains(balance, ',')")
NEGATIVE = ("'balance'", "amount_negative", f"{BARE}", "NULL", "false", f"try_cast({BARE} AS DOUBLE) < 0")
MISMATCH = ("'points'", "format_mismatch", "points", "CASE WHEN points = 'many' THEN NULL ELSE '320' END", "points <> 'many'", "points <> '' AND try_cast(points AS DOUBLE) IS NULL")
DASHED = ("'phone'", "format_mismatch", "phone", "NULL", "false", "contains(phone, '-')")
BLANK = ("'joined'", "blank_cell", "NULL", "NULL", "false", "trim(joined) = ''")
BLANK_POINTS = ("'points'", "blank_cell", "NULL", "NULL", "false", "points = ''")
ALL = _found(BLANK, BLANK_POINTS, PHONE, CARD, EMAIL, DATE, FUTURE, AMOUNT, NEGATIVE, MISMATCH, DASHED)
WITH = f"WITH {CONTACTS}, found AS ({ALL}) "


def _audit(t):
    return A.audit(contacts(t), "c_custkey", ROLES, as_of=AS_OF, duplicates=False)


@query(WITH + "SELECT * FROM found")
def audit_findings(t):
    return _audit(t).select(FIELDS)


@query(f"""WITH {CONTACTS} SELECT count(*) AS row_count, 9 AS column_count, (count(*) FILTER (trim(joined) = '') + count(*) FILTER (points = '')) AS blank_cells,
  0::BIGINT AS blank_rows, 1 AS numeric_columns, 0 AS date_columns, 8 AS text_columns FROM contacts""")
def audit_table_stats(t):
    return A.audit_stats(contacts(t))


@query("""SELECT * FROM (SELECT conv_id * 1000 + turn AS row_id, min(conv_id * 1000 + turn) OVER (PARTITION BY role, text) AS duplicate_of FROM conversations) WHERE row_id > duplicate_of""")
def audit_duplicate_turns(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", "text")
    return duplicate_rows(rows, "row_id")


@query(f"""WITH {COPIED_EVENTS} SELECT row_id, duplicate_of FROM (SELECT row_id, min(row_id) OVER (PARTITION BY ts, user_id, event_type, value, props) AS duplicate_of FROM copied_events) WHERE row_id > duplicate_of""")
def audit_duplicate_events(t):
    return duplicate_rows(copied_events(t), "row_id")


@query("""WITH g AS (SELECT user_id, event_type, min(event_id) AS first, count(*) - 1 AS copies FROM events GROUP BY ALL HAVING count(*) > 1 ORDER BY first LIMIT 3)
  SELECT e.event_id, e.user_id, e.event_type, g.copies FROM g JOIN events e ON e.event_id = g.first""")
def audit_duplicate_samples(t):
    return duplicate_samples(t.events.select("event_id", "user_id", "event_type"), "event_id", n=3)


@query(WITH + """, per AS (SELECT row_id, count(DISTINCT "column" || '|' || rule) AS n, string_agg(DISTINCT "column" || '|' || rule, ',' ORDER BY "column" || '|' || rule) AS issues FROM found GROUP BY 1)
  SELECT row_id, issues, n::INT AS issue_count, CASE WHEN n >= 3 THEN 'severe' WHEN n = 2 THEN 'medium' ELSE 'light' END AS level FROM per""")
def audit_findings_per_row(t):
    return R.findings_per_row(_audit(t)).withColumn("issues", F.array_join("issues", ","))


@query(WITH + """SELECT "column", rule, count(*) AS finding_count, CASE WHEN bool_and(can_auto_fix) THEN 'format' ELSE 'clean' END AS fix_type FROM found GROUP BY ALL""")
def audit_suggestions(t):
    return R.suggestions(_audit(t))


@query(WITH + f""", k AS (SELECT DISTINCT "column", rule FROM found),
  p AS (SELECT (SELECT count(*) FROM found WHERE rule = 'blank_cell')::DOUBLE / ((SELECT count(*) FROM contacts) * 8) AS share, count(*) FILTER (rule = 'blank_cell') AS b, count(*) FILTER (rule <> 'blank_cell') AS o FROM k),
  s AS (SELECT greatest(0.0, floor(100 - least(30, share * 80) - 3 * b - 5 * o + 0.5))::DOUBLE AS score FROM p)
  SELECT score, CASE WHEN score >= 95 THEN '优秀' WHEN score >= 80 THEN '良好' WHEN score >= 60 THEN '一般' ELSE '需处理' END AS grade FROM s""")
def audit_quality_score(t):
    c = contacts(t)
    return A.audit_score(c, _audit(t), "c_custkey")


FIXED = """fixed AS (SELECT c_custkey, phone, email, CASE WHEN contains(balance, '￥') OR contains(balance, ',') THEN replace(replace(balance, '￥', ''), ',', '') ELSE balance END AS balance, points FROM contacts)"""


@query(WITH + f", {FIXED} SELECT * FROM fixed")
def audit_apply_fixes(t):
    """Only rules whose findings can all be fixed are applied: amounts, not e-mails."""
    return R.apply_fixes(contacts(t), _audit(t), "c_custkey").select("c_custkey", "phone", "email", "balance", "points")


@query(WITH + """SELECT "column", rule, count(suggested_value) AS fixed_cells FROM found GROUP BY ALL HAVING bool_and(can_auto_fix) AND count(suggested_value) > 0""")
def audit_fix_summary(t):
    return R.fix_summary(_audit(t))


@query(WITH + """, cells AS (SELECT DISTINCT row_id, "column", rule FROM found WHERE rule <> 'format_mismatch')
  SELECT row_id AS c_custkey FROM cells GROUP BY 1 HAVING bool_and("column" = 'phone')""")
def audit_recheck_after_edits(t):
    """All broken phones are corrected; rows whose only finding was the phone are clean."""
    c = contacts(t)
    old = _audit(t)
    edits = c.select("c_custkey", F.lit("phone").alias("column"), F.lit("13900000000").alias("value"))
    return A.recheck(c, old, edits, "c_custkey", ROLES, AS_OF)


STOCK = """stock AS (SELECT c_custkey, 'bin ' || (c_custkey % 61) AS bin,
    CASE WHEN c_custkey % 90 = 7 THEN 'many' ELSE (c_custkey % 4)::VARCHAR END AS pieces FROM customer),
  edited AS (SELECT c_custkey, bin, CASE WHEN c_custkey % 90 = 7 AND c_custkey % 4 > 0 THEN '2' WHEN c_custkey < 200 THEN 'n' || c_custkey ELSE pieces END AS pieces FROM stock)"""
DIRTY = """SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY bin, pieces ORDER BY c_custkey) AS n, try_cast(pieces AS DOUBLE) IS NULL AS word FROM {}) WHERE n > 1 OR word"""


@query(f"WITH {STOCK} {DIRTY.format('stock')} EXCEPT {DIRTY.format('edited')}")
def audit_recheck_whole(t):
    """Words among numbers are corrected and first copies changed; rows that were copies of those alone are clean, too."""
    key = F.col("c_custkey")
    pieces = F.when(key % 90 == 7, "many").otherwise((key % 4).cast("string"))
    stock = t.customer.select("c_custkey", F.concat(F.lit("bin "), (key % 61).cast("string")).alias("bin"), pieces.alias("pieces"))
    value = F.when((key % 90 == 7) & (key % 4 > 0), "2").when(key < 200, F.concat(F.lit("n"), key.cast("string")))
    edits = stock.select("c_custkey", F.lit("pieces").alias("column"), value.alias("value")).filter("value is not null")
    old = A.audit(stock, "c_custkey", {}, as_of=AS_OF)
    return A.recheck_all(stock, old, edits, "c_custkey", {}, AS_OF, counts=A.number_counts(stock, ["bin", "pieces"]))


@query(f"WITH {CONTACTS} SELECT c_custkey, CASE WHEN points = '三百二十' THEN '320' ELSE points END AS points FROM contacts")
def audit_convert_numerals(t):
    return A.convert_cn_numbers(contacts(t).select("c_custkey", "points"), ["points"])


# --- quality ----------------------------------------------------------------------------

@query(f"""WITH {DIRTY_ORDERS}, k AS (SELECT CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'number' WHEN regexp_matches(v, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}') THEN 'date' ELSE 'text' END AS kind, c
    FROM (SELECT 'amount' AS c, amount AS v FROM dirty_orders UNION ALL SELECT 'day', day FROM dirty_orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM dirty_orders))
  SELECT c AS "column", string_agg(DISTINCT kind, ', ' ORDER BY kind) AS detail FROM k GROUP BY 1 HAVING count(DISTINCT kind) > 1""")
def quality_mixed_types(t):
    return Q.mixed_types(dirty_orders(t), "o_orderkey", ["amount", "day", "o_orderpriority"]).select("column", "detail")


@query(f"""WITH {DIRTY_ORDERS} SELECT 'day' AS "column", CASE WHEN regexp_matches(day, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN 'YYYY-MM-DD' WHEN regexp_matches(day, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN 'YYYY/MM/DD'
   ELSE '其他' END AS format, count(*) AS row_count FROM dirty_orders GROUP BY ALL""")
def quality_date_formats(t):
    return Q.date_format_counts(dirty_orders(t), ["day"])


@query(f"""WITH {DIRTY_ORDERS}, f AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'YYYY-MM-DD' WHEN o_orderkey % 3 = 1 THEN 'YYYY/MM/DD' ELSE '其他' END AS s, count(*) AS n FROM dirty_orders GROUP BY 1)
  SELECT 'day' AS "column", 'date_formats' AS rule, 'suggestion' AS severity, string_agg(s || '(' || n || ')', ', ' ORDER BY n DESC, s || '(' || n || ')') AS detail FROM f""")
def quality_date_format_finding(t):
    return Q.date_formats(dirty_orders(t), "o_orderkey", ["day"]).select("column", "rule", "severity", "detail")


@query("""WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id AS row_id, 'value' AS "column", 'outlier' AS rule FROM events, f WHERE abs(value - m) > 3 * s""")
def quality_outliers(t):
    return Q.outliers(t.events, "event_id", ["value"]).select("row_id", "column", "rule")


def _valid_share(c: str, valid: str) -> str:
    return f"(SELECT count(*) FILTER ({valid})::DOUBLE / count(*) FROM contacts WHERE {c} IS NOT NULL AND {c} <> '')"


@query(f"""WITH {CONTACTS}, s AS (
   SELECT 'phone' AS c, 'phone' AS t, {_valid_share("phone", "regexp_matches(replace(phone, '-', ''), '^1[0-9]{10}$')")} * 0.7 + 0.075 AS a,
          {_valid_share("phone", "true")} * 0.7 AS amount_score
   UNION ALL SELECT 'email', 'email', {_valid_share("email", "regexp_matches(email, '^[^ @]+@[^ @]+\\.[^ @]+$')")} * 0.7 + 0.075, 0
   UNION ALL SELECT 'birth', 'date', 0.7, 0.69
   UNION ALL SELECT 'c_mobile', 'phone', 0.0, 0.0)
  SELECT c AS "column", CASE WHEN a >= amount_score THEN t ELSE 'amount' END AS type, floor(greatest(a, amount_score) * 100 + 0.5) / 100 AS confidence FROM s WHERE c <> 'c_mobile'""")
def quality_semantic_types(t):
    return Q.infer_semantic_types(contacts(t), ["phone", "email", "birth"])


TYPE_OF = {"phone": "phone", "email": "email", "card": "id_card", "joined": "date", "balance": "amount", "points": "numeric"}


@query(f"""WITH {CONTACTS},
  f AS (SELECT c_custkey AS row_id, 'phone' AS "column", 'error' AS severity, phone AS original_value, phone AS suggested_value FROM contacts WHERE NOT regexp_matches(replace(phone, '-', ''), '^1[0-9]{{10}}$')
   UNION ALL SELECT c_custkey, 'email', 'error', email, NULL FROM contacts WHERE NOT regexp_matches(email, '^[^ @]+@[^ @]+\\.[^ @]+$')
   UNION ALL SELECT c_custkey, 'card', CASE WHEN length(card) = 15 THEN 'warning' ELSE 'error' END, card, NULL FROM contacts WHERE NOT regexp_matches(card, '^[0-9]{{17}}[0-9X]$')
   UNION ALL SELECT c_custkey, 'joined', 'error', joined, joined FROM contacts WHERE joined = '2024年1月5日'
   UNION ALL SELECT c_custkey, 'balance', 'warning', balance, balance FROM contacts WHERE try_cast({BARE} AS DOUBLE) < 0
   UNION ALL SELECT c_custkey, 'points', 'error', points, NULL FROM contacts WHERE points <> '' AND try_cast(points AS DOUBLE) IS NULL) SELECT * FROM f""")
def quality_cell_validity(t):
    found = R.row_findings(contacts(t), "c_custkey", Q.type_items(contacts(t), TYPE_OF))
    return found.select("row_id", "column", "severity", "original_value", "suggested_value")


@query("""SELECT l_orderkey * 100 + l_linenumber AS row_id, 'gross' AS "column", 'product' AS rule, 'error' AS severity FROM lineitem WHERE l_discount > 0.01 AND l_quantity * l_extendedprice > 0
  AND abs(l_quantity * l_extendedprice - l_quantity * l_extendedprice * (1 - l_discount)) / greatest(abs(l_quantity * l_extendedprice), 1.0) > 0.01""")
def quality_rule_product(t):
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    rows = t.lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", F.when(d > 0.01, q * p * (1 - d)).otherwise(q * p).alias("gross"))
    found = Q.run_rules(rows, "id", [("product", {"factor_a": "l_quantity", "factor_b": "l_extendedprice", "product": "gross"})])
    return found.select("row_id", "column", "rule", "severity")


@query("""SELECT l_orderkey * 100 + l_linenumber AS row_id, 'shipped' AS "column", strftime(l_shipdate, '%Y-%m-%d') AS original_value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate::DATE > l_shipdate::DATE""")
def quality_rule_date_order(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("ordered"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    return Q.run_rules(rows, "id", [("date_order", {"start": "ordered", "end": "shipped"})]).select("row_id", "column", "original_value")


@query(f"""WITH {CONTACTS} SELECT c_custkey AS row_id, 'birth' AS "column", birth AS original_value, strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER), '%Y-%m-%d') AS suggested_value
  FROM contacts WHERE c_custkey % 11 = 0 AND c_custkey % 9 <> 1""")
def quality_rule_birth_date(t):
    found = Q.run_rules(contacts(t), "c_custkey", [("id_card_birth", {"id_card": "card", "birth": "birth"}), ("product", {"factor_a": "phone"})])
    return found.select("row_id", "column", "original_value", "suggested_value")


@query(f"""WITH {CONTACTS}, dup AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY joined, points) AS f FROM contacts WHERE trim(joined) <> '' OR points <> ''),
  u AS (SELECT 'blank_row' AS rule, count(*) AS n FROM contacts WHERE trim(joined) = '' AND points = '' UNION ALL SELECT 'blank_cell', count(*) FROM contacts WHERE trim(joined) = '' UNION ALL SELECT 'blank_cell', count(*) FROM contacts WHERE points = ''
    UNION ALL SELECT 'duplicate_row', count(*) FROM dup WHERE c_custkey > f
    UNION ALL SELECT 'date_invalid', count(*) FROM contacts WHERE joined = '2024年1月5日'
    UNION ALL SELECT 'mixed_types', count(*) FROM (SELECT 1 FROM contacts WHERE trim(joined) <> '' HAVING count(DISTINCT joined = '2024年1月5日') > 1)
    UNION ALL SELECT 'mixed_types', 1 UNION ALL SELECT 'date_formats', 1
    UNION ALL SELECT 'id_card_birth', count(*) FROM contacts WHERE c_custkey % 11 = 0 AND c_custkey % 9 <> 1)
  SELECT rule, sum(n)::BIGINT AS finding_count FROM u GROUP BY 1 HAVING sum(n) > 0""")
def quality_combined_report(t):
    """Counts per rule of the combined report over dates and points of the contacts."""
    c = contacts(t)
    found = Q.quality_findings(
        c, "c_custkey", {"joined": "date"}, [("id_card_birth", {"id_card": "card", "birth": "birth"})],
        columns=["joined", "points"], key_columns=["joined", "points"], date_columns=["joined"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("finding_count"))


@query(f"""WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_extendedprice, l_tax, l_shipdate FROM lineitem),
  p AS (SELECT id, 'product' AS rule, '总金额' AS "column" FROM o WHERE id % 9 = 0 AND abs(l_quantity * l_extendedprice * 0.5) / greatest(abs(l_quantity * l_extendedprice), abs(l_quantity * l_extendedprice * 1.5), 1) > 0.01),
  d AS (SELECT id, 'date_order', 'end date' FROM o WHERE id % 7 = 0),
  b AS (SELECT id, 'id_card_birth', '生日' FROM o WHERE id % 5 = 0)
  SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM b""")
def quality_rules_by_title(t):
    """Each rule finds its columns by their titles: products, date order, birth dates."""
    day, k = F.to_date("l_shipdate"), F.col("id")
    rows = t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    total = F.col("l_quantity") * F.col("l_extendedprice")
    sheet = rows.select(
        "id", F.col("l_quantity").alias("Qty"), F.col("l_extendedprice").alias("单价(元)"), F.when(k % 9 == 0, total * 1.5).otherwise(total).alias("总金额"),
        day.alias("Start Date"), F.date_add(day, F.when(k % 7 == 0, -1).otherwise(1)).alias("end date"),
        F.concat(F.lit("110101"), F.date_format(day, "yyyyMMdd"), F.lit("001X")).alias("身份证号"),
        F.date_add(day, F.when(k % 5 == 0, 1).otherwise(0)).alias("生日"),
    )
    return Q.run_rules(sheet, "id", Q.match_rules(sheet)).select(F.col("row_id").alias("id"), "rule", "column")
