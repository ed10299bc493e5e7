"""Spark SQL over the given tables."""

from pyspark.sql import functions as F

from checks.common import check, rounded, table
from sparktidy.operators.query import asof_join, range_join, sql, to_records


def _both(key, tables, spark_sql, duck_sql=None, digits=6):
    """A query whose text runs on both engines, apart from dialect."""

    @check(key, duck_sql or spark_sql)
    def run(spark, d):
        return rounded(sql({t: table(spark, d, t) for t in tables.split()}, spark_sql), digits)


_both("sql_project", "lineitem", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
  l_quantity + 1 AS quantity_plus FROM lineitem""")
_both("sql_filter", "orders", """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000
  AND (o_orderstatus IN ('F', 'O') OR o_orderpriority LIKE '1%') AND o_custkey BETWEEN 10 AND 100000 AND o_orderkey IS NOT NULL""")
_both("sql_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_both("sql_group", "lineitem", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
  count(*) AS n, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
_both("sql_count", "events", """SELECT count(*) AS n, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
  count(*) FILTER (WHERE value > 100) AS large FROM events""")
_both("sql_distinct", "events", """SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types,
  count(DISTINCT user_id, event_type) AS pairs FROM events""",
      """SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types,
  (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS pairs FROM events""")
for _kind, _text in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"),
                     ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _both(f"sql_{_kind}", "lineitem", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
  CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY {_text}""")
_both("sql_join_inner", "orders customer", """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
_both("sql_join_left", "customer orders", """SELECT c_custkey, count(o_orderkey) AS n FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
_both("sql_join_right", "labels documents", """SELECT d.doc_id, l.quality, l.toxic FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""")
_both("sql_join_full", "supplier nation", """SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s
  FULL JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""")
_both("sql_join_semi", "customer orders", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
  AND o_totalprice > 400000)""")
_both("sql_join_anti", "documents labels", """SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
_both("sql_join_five", "lineitem orders customer nation region", """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""", digits=2)


@check("sql_range_join", """SELECT s_suppkey, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM supplier
  JOIN part ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 250 GROUP BY s_suppkey""")
def sql_range_join(spark, d):
    bands = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 250).alias("high"))
    joined = range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high")
    return joined.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@check("sql_range_join_long", """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 25000.0 ELSE l_extendedprice::DOUBLE END AS price
  FROM lineitem), b AS (SELECT n_nationkey AS band, CASE WHEN n_nationkey % 5 = 0 THEN -1.0 ELSE n_nationkey * 3000.0 END AS low,
  CASE WHEN n_nationkey % 5 = 0 THEN 1e9 WHEN n_nationkey % 5 = 1 THEN n_nationkey * 3000.0 + 40000 ELSE n_nationkey * 3000.0 + 700 END AS high FROM nation)
  SELECT band, count(*) AS n, sum(l_orderkey * 10 + l_linenumber)::BIGINT AS keys FROM b JOIN p ON price >= low AND price < high GROUP BY band""")
def sql_range_join_long(spark, d):
    """Intervals from short ones to the whole axis, and one price in a third of the points."""
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 25000.0D ELSE cast(l_extendedprice AS double) END AS price"))
    bands = table(spark, d, "nation").selectExpr(
        "n_nationkey AS band", "CASE WHEN n_nationkey % 5 = 0 THEN -1.0D ELSE n_nationkey * 3000.0D END AS low",
        "CASE n_nationkey % 5 WHEN 0 THEN 1e9D WHEN 1 THEN n_nationkey * 3000.0D + 40000 ELSE n_nationkey * 3000.0D + 700 END AS high")
    return range_join(points, bands, "price", "low", "high").groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.expr("l_orderkey * 10 + l_linenumber")).alias("keys"))


@check("asof_join", """WITH e AS (SELECT event_id, ts, user_id FROM events), p AS (SELECT ts, user_id, value AS last_purchase FROM events
  WHERE event_type = 'purchase') SELECT event_id, user_id, last_purchase FROM e ASOF LEFT JOIN p USING (user_id, ts)""")
def asof_join_query(spark, d):
    events = table(spark, d, "events")
    purchases = events.where("event_type = 'purchase'").select("ts", "user_id", F.col("value").alias("last_purchase"))
    return asof_join(events.select("event_id", "ts", "user_id"), purchases, "ts", ["user_id"], ["last_purchase"]).drop("ts")


HOLES = """e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value FROM events)"""


@check("asof_join_nulls", f"""WITH {HOLES}, p AS (SELECT ts, user_id, value AS last_purchase FROM e WHERE event_type = 'purchase'
  AND ts IS NOT NULL AND user_id IS NOT NULL) SELECT event_id, user_id, last_purchase FROM e ASOF LEFT JOIN p USING (user_id, ts)""")
def asof_join_nulls(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id"), "event_type", "value")
    purchases = events.where("event_type = 'purchase'").select("ts", "user_id", F.col("value").alias("last_purchase"))
    return asof_join(events.select("event_id", "ts", "user_id"), purchases, "ts", ["user_id"], ["last_purchase"]).drop("ts")


_both("sql_rank", "orders", """SELECT o_custkey, o_orderkey, place, dense, ties FROM (SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place,
  CAST(dense_rank() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderpriority) AS INT) AS dense,
  CAST(rank() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderpriority) AS INT) AS ties FROM orders) t WHERE place <= 3""")
_both("sql_ntile", "orders", """SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice, o_orderkey) AS INT) AS quarter FROM orders""")
_both("sql_lag", "events", """SELECT event_id, lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS before,
  lead(event_type, 2, 'none') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS after FROM events""")
_both("sql_first_last", "events", """SELECT event_id, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v FROM events
  WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
_both("sql_frame_rows", "events", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id
  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events""")
_both("sql_frame_range", "orders", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice
  RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS near FROM orders""")
_both("sql_union", "customer supplier", """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
_both("sql_union_all", "customer supplier", """SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
_both("sql_intersect", "customer orders", "SELECT c_custkey * 2 AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
_both("sql_intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_both("sql_except", "customer orders", "SELECT o_custkey % 997 AS k FROM orders EXCEPT SELECT c_nationkey FROM customer")
_both("sql_except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_both("sql_exists", "orders lineitem", """WITH heavy AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, (SELECT max(h.q) FROM heavy h WHERE h.l_orderkey = o_orderkey) AS q FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM heavy WHERE q > 100)""")
_both("sql_string", "customer", """SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS n, substring(c_name, 1, 8) AS head,
  concat(c_mktsegment, '-', c_name) AS joined, replace(c_name, '0', '') AS short, lpad(c_mktsegment, 12, '*') AS padded,
  instr(c_name, '#') AS hash_at, reverse(c_mktsegment) AS back, split_part(c_name, '#', 2) AS tail FROM customer""")
_both("sql_date", "orders", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
  date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS month_start, date_diff(DATE'2001-01-01', CAST(o_orderdate AS DATE)) AS days,
  date_format(o_orderdate + INTERVAL 10 DAY, 'yyyy-MM-dd') AS later FROM orders""",
      """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS days,
  strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later FROM orders""")
_both("sql_math", "customer", """SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, floor(c_acctbal) AS low, ceil(c_acctbal) AS high,
  round(power(c_acctbal / 1000, 2), 6) AS sq, c_custkey % 7 AS rest, sign(c_acctbal) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l,
  greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le FROM customer""",
      """SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high,
  round(power(c_acctbal / 1000, 2), 6) AS sq, c_custkey % 7 AS rest, CAST(sign(c_acctbal) AS DOUBLE) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l,
  greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le FROM customer""")
_both("sql_conditional", "orders", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size,
  nullif(o_orderstatus, 'F') AS open_status, coalesce(nullif(o_orderstatus, 'F'), 'done') AS state FROM orders""")
_both("sql_json", "events", """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k AS k2 FROM events""",
      """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS k2 FROM events""")
_both("sql_array", "embeddings", """SELECT vec_id, size(embedding) AS n, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, b) -> a + b), 4) AS norm2,
  round(CAST(array_max(embedding) AS DOUBLE), 6) AS hi FROM embeddings""",
      """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS norm2,
  round(list_max(embedding)::DOUBLE, 6) AS hi FROM embeddings""")
_both("sql_explode", "documents", """SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM documents) GROUP BY word""",
      """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""")
_both("sql_pivot", "lineitem", """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
  PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open_qty, 'F' AS final_qty))""",
      """SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_qty, sum(l_quantity) FILTER (l_linestatus = 'F') AS final_qty
  FROM lineitem GROUP BY 1""", digits=2)
_both("sql_unpivot", "lineitem", """SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
  UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""",
      """SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
  UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""")


@check("sql_replace_data", """SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 5""")
def sql_replace_data(spark, d):
    """A result becomes the next query's ``data``."""
    first = sql(table(spark, d, "events"), "SELECT event_type, value FROM data WHERE value > 10")
    second = sql(first, "SELECT event_type, count(*) AS n FROM data GROUP BY event_type")
    return sql(second, "SELECT * FROM data WHERE n > 5")


@check("sql_records", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record FROM nation""")
def sql_records(spark, d):
    return to_records(sql(table(spark, d, "nation"), "SELECT n_nationkey, n_name, n_regionkey FROM data"))
