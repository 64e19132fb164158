"""Lookups, positional merge, stacking, approximate matching."""

from pyspark.sql import functions as F

from ..functions.cells import FULL_WIDTH, HALF_WIDTH
from ..operators.fuzzy import fuzzy_find, fuzzy_lookup, key_mapping, mapping_stats
from ..operators.lookups import lookup, lookup_chain, lookup_stats, stack_tables, zip_tables
from .dirt import SQL_FULL, SQL_HALF, norm_sql
from .registry import query


@query("""SELECT o_orderkey, o_custkey, c_name AS "_lkp_c_name", c_mktsegment AS "_lkp_c_mktsegment"
          FROM orders LEFT JOIN customer ON CASE WHEN c_custkey % 3 = 0 THEN -1 - c_custkey ELSE c_custkey END = o_custkey""")
def lookup_single_key(t):
    k = F.col("c_custkey")
    other = t.customer.select(F.when(k % 3 == 0, -1 - k).otherwise(k).alias("c_custkey"), "c_name", "c_mktsegment")
    return lookup(t.orders.select("o_orderkey", "o_custkey"), other, [("o_custkey", "c_custkey")], ["c_custkey"])


@query("""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1)
          SELECT n_nationkey, n_name, c_name AS "_lkp_c_name" FROM nation LEFT JOIN r ON c_nationkey = n_nationkey""")
def lookup_first_match(t):
    return lookup(t.nation.select("n_nationkey", "n_name"), t.customer.select("c_nationkey", "c_custkey", "c_name"),
                  [("n_nationkey", "c_nationkey")], ["c_custkey"]).drop("_lkp_c_custkey")


def _wide(name: str):
    return F.translate(name, HALF_WIDTH, FULL_WIDTH)


@query(f"""WITH l AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' ' || upper(s_name) WHEN 1 THEN translate(s_name, '{SQL_HALF}', '{SQL_FULL}')
              ELSE '' END AS k FROM supplier)
           SELECT l.s_suppkey, l.k, r.s_acctbal AS "_lkp_s_acctbal" FROM l LEFT JOIN supplier r ON {norm_sql("l.k")} = lower(r.s_name) AND l.k <> ''""")
def lookup_normalised_text(t):
    m = F.col("s_suppkey") % 3
    k = F.when(m == 0, F.concat(F.lit(" "), F.upper("s_name"))).when(m == 1, _wide("s_name")).otherwise("")
    left = t.supplier.select("s_suppkey", k.alias("k"))
    return lookup(left, t.supplier.select("s_name", "s_acctbal"), [("k", "s_name")], ["s_acctbal"])


@query("""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1)
          SELECT p.p_partkey, p.sk, r.l_orderkey AS "_lkp_l_orderkey" FROM (SELECT p_partkey, p_partkey % 100 AS sk FROM part) p
          LEFT JOIN r ON r.l_partkey = p.p_partkey AND r.l_suppkey = p.sk""")
def lookup_composite_key(t):
    left = t.part.select("p_partkey", (F.col("p_partkey") % 100).alias("sk"))
    right = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = lookup(left, right, [("p_partkey", "l_partkey"), ("sk", "l_suppkey")], ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return out.select("p_partkey", "sk", "_lkp_l_orderkey")


def _chain(t, flags=False):
    k = F.col("n_nationkey")
    n = t.nation.withColumn("n_nationkey", F.when(k % 4 == 0, -1 - k).otherwise(k))
    return lookup_chain(t.orders.select("o_orderkey", "o_custkey"), [
        (t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), None, ["c_nationkey"]),
        (n, [("_lkp_c_nationkey", "n_nationkey")], ["n_name"]),
        (t.region, [("_lkp_n_regionkey", "r_regionkey")], ["r_name"]),
    ], flags)


CHAIN = """FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON CASE WHEN n_nationkey % 4 = 0 THEN -1 - n_nationkey ELSE n_nationkey END = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""


@query(f"""SELECT o_orderkey, o_custkey, c_nationkey AS "_lkp_c_nationkey", n_name AS "_lkp_n_name",
             n_regionkey AS "_lkp_n_regionkey", r_name AS "_lkp_r_name" {CHAIN}""")
def lookup_chained_tables(t):
    return _chain(t)


@query(f"""WITH x AS (SELECT c_custkey IS NOT NULL AS a, n_nationkey IS NOT NULL AS b, r_regionkey IS NOT NULL AS c {CHAIN})
           SELECT '_hit_1' AS lookup, count(*) FILTER (a) AS matched, count(*) FILTER (NOT a) AS unmatched, count(*) FILTER (a)::DOUBLE / count(*) AS match_rate FROM x
           UNION ALL SELECT '_hit_2', count(*) FILTER (b), count(*) FILTER (NOT b), count(*) FILTER (b)::DOUBLE / count(*) FROM x
           UNION ALL SELECT '_hit_3', count(*) FILTER (c), count(*) FILTER (NOT c), count(*) FILTER (c)::DOUBLE / count(*) FROM x""")
def lookup_match_stats(t):
    return lookup_stats(_chain(t, flags=True), ["_hit_1", "_hit_2", "_hit_3"])


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, r.c_name AS "_lkp_c_name" FROM lineitem
          LEFT JOIN (SELECT CASE c_custkey WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE c_name END AS flag, c_name FROM customer) r ON r.flag = l_returnflag""")
def lookup_hot_key(t):
    """Three left keys in all, each with about a third of the rows: hot keys are salted."""
    k = F.col("c_custkey")
    right = t.customer.select(F.when(k == 0, "a").when(k == 1, "n").otherwise(F.col("c_name")).alias("flag"), "c_name")
    return lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), right, [("l_returnflag", "flag")], ["c_name"], skew="salt")


@query("""WITH a AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r FROM customer),
               b AS (SELECT s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r FROM supplier)
          SELECT coalesce(a.r, b.r) AS _row, c_custkey, c_name, s_name, s_acctbal FROM a FULL JOIN b ON a.r = b.r""")
def zip_tables_by_position(t):
    out = zip_tables([t.customer, t.supplier], [["c_acctbal", "c_custkey"], [F.col("s_acctbal").desc(), "s_suppkey"]])
    return out.select("_row", "c_custkey", "c_name", "s_name", "s_acctbal")


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
          UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def stack_tables_by_name(t):
    return stack_tables(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )


def _misspelt(t):
    """Supplier names with a dropped or replaced character, in another case, or padded."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    out = F.when(k % 4 == 0, F.concat(F.left(n, F.lit(4)), F.substring(n, 6, 100))).when(
        k % 4 == 1, F.concat(F.left(n, F.lit(10)), F.lit("x"), F.substring(n, 12, 100))).when(
        k % 4 == 2, F.upper(n)).otherwise(F.concat(F.lit("zz"), F.substring(n, 3, 100), F.lit("zz")))
    return t.supplier.select("s_suppkey", out.alias("name"))


MISSPELT = """misspelt AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN substr(s_name, 1, 4) || substr(s_name, 6)
  WHEN 1 THEN substr(s_name, 1, 10) || 'x' || substr(s_name, 12) WHEN 2 THEN upper(s_name) ELSE 'zz' || substr(s_name, 3) || 'zz' END AS name FROM supplier)"""


@query(f"""WITH {MISSPELT}, p AS (
  SELECT l.s_suppkey, l.name, r.s_acctbal, r.s_suppkey AS rk, lower(l.name) AS a, lower(r.s_name) AS b FROM misspelt l, supplier r),
 s AS (SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS sim FROM p),
 w AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY sim DESC, rk) AS n FROM s WHERE sim >= 0.85)
 SELECT l.s_suppkey, l.name, w.s_acctbal AS "_lkp_s_acctbal", w.rk AS "_lkp_s_suppkey", round(w.sim, 6) AS score
 FROM misspelt l LEFT JOIN w ON w.s_suppkey = l.s_suppkey AND w.n = 1""")
def fuzzy_lookup_suppliers(t):
    right = t.supplier.select("s_name", "s_acctbal", "s_suppkey")
    return fuzzy_lookup(_misspelt(t), right, ("name", "s_name"), ["s_suppkey"], score="score").withColumn("score", F.round("score", 6))


@query(f"""WITH d AS (SELECT DISTINCT p_name, substr(p_name, 1, 2) || substr(p_name, 4) AS k FROM part),
  r AS (SELECT p_name, min(p_partkey) AS o FROM part GROUP BY 1),
  s AS (SELECT d.k, r.p_name, r.o, CASE WHEN {norm_sql("d.k")} = {norm_sql("r.p_name")} THEN 1.0::DOUBLE ELSE
          1 - levenshtein({norm_sql("d.k")}, {norm_sql("r.p_name")})::DOUBLE / greatest(length({norm_sql("d.k")}), length({norm_sql("r.p_name")})) END AS sim FROM d, r),
  w AS (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY sim DESC, o) AS n FROM (SELECT DISTINCT * FROM s) WHERE sim >= 0.85)
  SELECT p.p_partkey, substr(p_name, 1, 2) || substr(p_name, 4) AS k, w.o AS "_lkp_first_part" FROM part p LEFT JOIN w ON w.k = substr(p.p_name, 1, 2) || substr(p.p_name, 4) AND w.n = 1""")
def fuzzy_lookup_parts(t):
    """Few distinct keys, many rows: only distinct keys are compared."""
    k = F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 100))
    left = t.part.select("p_partkey", k.alias("k"))
    right = t.part.select("p_name", F.col("p_partkey").alias("first_part"))
    return fuzzy_lookup(left, right, ("k", "p_name"), ["first_part"])


@query("""SELECT p_partkey, p_name FROM (SELECT *, 1 - levenshtein(replace(p_name, ' ', ''), 'smalring')::DOUBLE / greatest(length(replace(p_name, ' ', '')), 8) AS sim FROM part)
          WHERE sim >= 0.85 ORDER BY sim DESC, p_partkey LIMIT 1""")
def fuzzy_find_one(t):
    return fuzzy_find(t.part.select("p_partkey", "p_name"), "p_name", "Smal Ring", ["p_partkey"])


def _names(t):
    return t.part.select(F.col("p_name").alias("src"), F.col("p_partkey").alias("lo"))


def _targets(t):
    k, n = F.col("p_partkey"), F.col("p_name")
    first = F.substring_index(n, " ", 1)
    out = F.when(k % 3 == 0, first).when(k % 3 == 1, F.concat(n, F.lit(" set"))).otherwise(F.concat(F.lit("X"), F.substring(n, 2, 100)))
    return t.part.select(out.alias("dst"), F.col("p_partkey").alias("ro"))


KEYS = """l AS (SELECT p_name AS src, min(p_partkey) AS lo FROM part GROUP BY 1),
 r AS (SELECT dst, min(p_partkey) AS ro FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name || ' set'
         ELSE 'X' || substr(p_name, 2) END AS dst FROM part) GROUP BY 1),
 c AS (SELECT src, lo, dst, ro, lower(src) AS a, lower(dst) AS b, levenshtein(lower(src), lower(dst))::DOUBLE AS d,
         greatest(length(src), length(dst))::DOUBLE AS mx, least(length(src), length(dst))::DOUBLE AS mn FROM l, r),
 s AS (SELECT *, CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2 WHEN 1 - d / mx >= 0.6 THEN 3 END AS phase,
         CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.7 + mn / mx * 0.15 ELSE least(0.8, 1 - d / mx) END AS conf FROM c),
 w AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY phase, CASE WHEN phase = 3 THEN -(1 - d / mx) ELSE 0 END, ro, dst) AS n FROM s WHERE phase IS NOT NULL),
 m AS (SELECT l.src AS source, w.dst AS target, w.phase, round(coalesce(w.conf, 0), 6) AS confidence FROM l LEFT JOIN w ON w.src = l.src AND w.n = 1)"""


@query(f"WITH {KEYS} SELECT * FROM m")
def key_mapping_best(t):
    out = key_mapping(_names(t), "src", _targets(t), "dst", ["lo"], ["ro"])
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {KEYS} SELECT count(*) AS total, count(target) AS matched, count(*) - count(target) AS unmatched,
             count(target)::DOUBLE / count(*) AS match_rate FROM m""")
def key_mapping_stats(t):
    return mapping_stats(key_mapping(_names(t), "src", _targets(t), "dst", ["lo"], ["ro"]))


@query(f"""WITH RECURSIVE {KEYS},
 o AS (SELECT src, dst, phase, conf, row_number() OVER (PARTITION BY src ORDER BY phase, CASE WHEN phase = 3 THEN -(1 - d / mx) ELSE 0 END, ro, dst) AS pref,
         min(phase) OVER (PARTITION BY src) AS least FROM s WHERE phase IS NOT NULL),
 options AS (SELECT src, list(struct_pack(pref := pref, dst := dst, phase := phase, conf := conf) ORDER BY pref) AS offers FROM o WHERE least > 1 OR phase = 1 GROUP BY src),
 turns AS (SELECT l.src, row_number() OVER (ORDER BY lo, l.src) AS i, offers FROM l LEFT JOIN options ON options.src = l.src),
 g AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, NULL::STRUCT(pref BIGINT, dst VARCHAR, phase INTEGER, conf DOUBLE) AS pick, []::VARCHAR[] AS used
   UNION ALL
   SELECT t.i, t.src, pick, CASE WHEN pick.dst IS NULL THEN used ELSE list_append(used, pick.dst) END
   FROM (SELECT t.i, t.src, used, coalesce(list_filter(offers, lambda x: NOT list_contains(used, x.dst))[1], CASE WHEN offers[1].phase = 1 THEN offers[1] END) AS pick
         FROM g JOIN turns t ON t.i = g.i + 1) t)
 SELECT source, pick.dst AS target, pick.phase AS phase, round(coalesce(pick.conf, 0), 6) AS confidence FROM g WHERE i > 0""")
def key_mapping_one_to_one(t):
    """Each left value in turn takes its best free right value."""
    out = key_mapping(_names(t), "src", _targets(t), "dst", ["lo"], ["ro"], one_to_one=True)
    return out.withColumn("confidence", F.round("confidence", 6))
