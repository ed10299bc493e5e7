"""Cleaning."""

from pyspark.sql import functions as F

from checks.common import DIRTY, DUPS, SPIKY, TEXTS, check, dirty, dups, rounded, spiky, table, texts
from sparktidy.config import get_config
from sparktidy.operators import cleaner, repair
from sparktidy.operators.dedup import remove_duplicates
from sparktidy.operators.impute import impute, null_ratios
from sparktidy.operators.knn import knn_impute
from sparktidy.operators.outliers import treat_outliers

OUT = ["event_id", "user_id", "event_type", "value", "props"]


def _out(df):
    return rounded(df.select(*OUT))


def filled(value="value", event_type="event_type"):
    return f"""WITH {DIRTY} SELECT event_id, user_id, {event_type} AS event_type, round({value}, 6) AS value, props FROM dirty"""


@check("impute_drop", f"WITH {DIRTY} SELECT event_id, user_id, event_type, value, props FROM dirty WHERE value IS NOT NULL AND event_type IS NOT NULL")
def impute_drop(spark, d):
    return _out(impute(dirty(spark, d), "drop"))


@check("impute_mean", filled("coalesce(value, (SELECT avg(value) FROM dirty))"))
def impute_mean(spark, d):
    return _out(impute(dirty(spark, d), "mean"))


@check("impute_median", filled("coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty))"))
def impute_median(spark, d):
    return _out(impute(dirty(spark, d), "median"))


def _mode(c):
    return f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@check("impute_mode", filled(f"coalesce(value, {_mode('value')})", f"coalesce(event_type, {_mode('event_type')})"))
def impute_mode(spark, d):
    return _out(impute(dirty(spark, d), "mode"))


FFILL = "last_value({c} IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BFILL = "first_value({c} IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@check("impute_ffill", filled(FFILL.format(c="value", p=""), FFILL.format(c="event_type", p="")))
def impute_ffill(spark, d):
    return _out(impute(dirty(spark, d), "ffill", ["value", "event_type"], order_by=["event_id"]))


@check("impute_ffill_grouped", filled(FFILL.format(c="value", p="PARTITION BY user_id"),
                                      FFILL.format(c="event_type", p="PARTITION BY user_id")))
def impute_ffill_grouped(spark, d):
    return _out(impute(dirty(spark, d), "ffill", ["value", "event_type"], order_by=["event_id"], partition_by=["user_id"]))


@check("impute_bfill", filled(BFILL.format(c="value", p=""), BFILL.format(c="event_type", p="")))
def impute_bfill(spark, d):
    return _out(impute(dirty(spark, d), "bfill", ["value", "event_type"], order_by=["event_id"]))


@check("impute_bfill_grouped", filled(BFILL.format(c="value", p="PARTITION BY user_id"),
                                      BFILL.format(c="event_type", p="PARTITION BY user_id")))
def impute_bfill_grouped(spark, d):
    return _out(impute(dirty(spark, d), "bfill", ["value", "event_type"], order_by=["event_id"], partition_by=["user_id"]))


@check("impute_custom", filled("value", "coalesce(event_type, 'unknown')"))
def impute_custom(spark, d):
    return _out(impute(dirty(spark, d), "custom", ["event_type"], "unknown"))


def _uniform(part):
    text = f"event_id || '|value|{get_config().random_state}|{part}'"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


@check("impute_distribution", f"""WITH {DIRTY}, m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM dirty)
  SELECT event_id, user_id, event_type, round(coalesce(value, a + s * sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)})), 6) AS value, props
  FROM dirty, m""")
def impute_distribution(spark, d):
    return _out(impute(dirty(spark, d), "distribution", ["value"], key=["event_id"]))


# Parts with every tenth price missing; every row is a query or a donor.
PARTS = "parts AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"


@check("impute_knn", f"""WITH {PARTS}, near AS (SELECT q.p_partkey, d.p_retailprice, row_number() OVER (PARTITION BY q.p_partkey
  ORDER BY (pow(q.p_size - d.p_size, 2) + pow(q.p_partkey - d.p_partkey, 2)), d.p_partkey) AS place
  FROM parts q, parts d WHERE q.p_retailprice IS NULL AND d.p_retailprice IS NOT NULL),
  fill AS (SELECT p_partkey, avg(p_retailprice) AS price FROM near WHERE place <= 5 GROUP BY 1)
  SELECT p_partkey, p_size, round(coalesce(p_retailprice, price), 6) AS p_retailprice FROM parts LEFT JOIN fill USING (p_partkey)""")
def impute_knn(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.expr(
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END").alias("p_retailprice"))
    return rounded(impute(parts, "knn", ["p_retailprice"], key=["p_partkey"]))


GAPS = """gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey * 10 END AS serial,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS size,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS price FROM part)"""


@check("impute_knn_gaps", f"""WITH {GAPS}, near AS (SELECT q.p_partkey, d.price, row_number() OVER (PARTITION BY q.p_partkey
  ORDER BY (coalesce(pow(q.serial - d.serial, 2), 0) + coalesce(pow(q.size - d.size, 2), 0)) * (3.0::DOUBLE
    / ((q.serial IS NOT NULL AND d.serial IS NOT NULL)::INT + (q.size IS NOT NULL AND d.size IS NOT NULL)::INT)), d.p_partkey) AS place
  FROM gaps q, gaps d WHERE q.price IS NULL AND d.price IS NOT NULL
    AND ((q.serial IS NOT NULL AND d.serial IS NOT NULL) OR (q.size IS NOT NULL AND d.size IS NOT NULL))),
  fill AS (SELECT p_partkey, avg(price) AS fill FROM near WHERE place <= 5 GROUP BY 1)
  SELECT p_partkey, round(coalesce(price, fill, (SELECT avg(price) FROM gaps)), 6) AS price FROM gaps LEFT JOIN fill USING (p_partkey)""")
def impute_knn_gaps(spark, d):
    """Nulls in the widest column and in the other one, on both sides."""
    gaps = table(spark, d, "part").select("p_partkey", F.expr(
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey * 10 END").alias("serial"), F.expr(
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END").alias("size"), F.expr(
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END").alias("price"))
    filled = knn_impute(gaps, "price", ["p_partkey"], columns=["serial", "size", "price"], cell_rows=500)
    return rounded(filled.select("p_partkey", "price"))


@check("null_ratio_filter", f"""WITH {DIRTY} SELECT 'event_type' AS "column", round((count(*) - count(event_type)) * 100.0::DOUBLE / count(*), 6)
  AS missing_pct FROM dirty UNION ALL SELECT 'value', round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 6) FROM dirty""")
def null_ratio_filter(spark, d):
    return rounded(null_ratios(dirty(spark, d)).where(F.col("missing_pct") > 5.0))


@check("impute_threshold_drop", f"""WITH {DIRTY} SELECT event_id, user_id, coalesce(event_type, {_mode('event_type')}) AS event_type, props FROM dirty""")
def impute_threshold_drop(spark, d):
    return impute(dirty(spark, d), "mode", drop_threshold=10.0, on_exceed="drop").drop("ts")


@check("dedup_all", f"WITH {DUPS} SELECT DISTINCT event_id, user_id, event_type, value, props FROM dups")
def dedup_all(spark, d):
    return remove_duplicates(dups(spark, d)).select(*OUT)


def ranked(order):
    return f"""WITH {DIRTY} SELECT event_id, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY event_id {order}) AS place FROM dirty) WHERE place = 1"""


@check("dedup_first", ranked(""))
def dedup_first(spark, d):
    return remove_duplicates(dirty(spark, d), ["user_id", "event_type"], "first", ["event_id"]).select(*OUT)


@check("dedup_last", ranked("DESC"))
def dedup_last(spark, d):
    return remove_duplicates(dirty(spark, d), ["user_id", "event_type"], "last", ["event_id"]).select(*OUT)


@check("dedup_none", f"""WITH {DUPS} SELECT event_id, user_id, event_type, value, props FROM dups
  GROUP BY event_id, ts, user_id, event_type, value, props HAVING count(*) = 1""")
def dedup_none(spark, d):
    return remove_duplicates(dups(spark, d), keep="none").select(*OUT)


@check("dedup_none_subset", f"""WITH {DIRTY} SELECT event_id, user_id, event_type, value, props FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, props) AS n FROM dirty) WHERE n = 1""")
def dedup_none_subset(spark, d):
    return remove_duplicates(dirty(spark, d), ["user_id", "props"], "none").select(*OUT)


IQR = """(SELECT quantile_cont({c}, 0.25) - {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""
Z = "(SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi FROM {t})"
MZ = """(SELECT any_value(m) - 3.5 * median(abs({c} - m)) / 0.6745 AS lo, any_value(m) + 3.5 * median(abs({c} - m)) / 0.6745 AS hi
  FROM {t}, (SELECT median({c}) AS m FROM {t}))"""


def removal(bounds):
    """Two columns in turn, the second fitted on what the first left."""
    return f"""WITH {SPIKY}, one AS (SELECT spiky.* FROM spiky, {bounds.format(c="value", t="spiky", f=1.5)} b
  WHERE value BETWEEN lo AND hi), two AS (SELECT one.* FROM one, {bounds.format(c="user_id", t="one", f=1.5)} b
  WHERE user_id BETWEEN lo AND hi) SELECT event_id, user_id, value FROM two"""


@check("outlier_remove_iqr", removal(IQR))
def outlier_remove_iqr(spark, d):
    return treat_outliers(spiky(spark, d), "iqr", "remove", ["value", "user_id"])


@check("outlier_remove_z", removal(Z))
def outlier_remove_z(spark, d):
    return treat_outliers(spiky(spark, d), "zscore", "remove", ["value", "user_id"])


@check("outlier_remove_mz", removal(MZ))
def outlier_remove_mz(spark, d):
    return treat_outliers(spiky(spark, d), "modified_zscore", "remove", ["value", "user_id"])


@check("outlier_remove_joint", f"""WITH {SPIKY} SELECT event_id, user_id, value FROM spiky, {IQR.format(c="value", t="spiky", f=1.5)} b
  WHERE value IS NULL OR value BETWEEN lo AND hi""")
def outlier_remove_joint(spark, d):
    return treat_outliers(spiky(spark, d), "iqr", "remove", ["value", "user_id"], fit="joint", keep_nulls=True)


@check("outlier_cap", f"""WITH {SPIKY} SELECT event_id, user_id, round(CASE WHEN value < p05 THEN p05 WHEN value > p95 THEN p95
  ELSE value END, 6) AS value FROM spiky, (SELECT quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM spiky)""")
def outlier_cap(spark, d):
    return rounded(treat_outliers(spiky(spark, d), "iqr", "cap", ["value", "user_id"]))


@check("outlier_log", f"WITH {SPIKY} SELECT event_id, user_id, round(ln(value), 6) AS value FROM spiky")
def outlier_log(spark, d):
    return rounded(treat_outliers(spiky(spark, d), "iqr", "transform", ["value", "user_id"]))


@check("cast_map", """SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity, l_extendedprice::VARCHAR AS price_text,
  l_linenumber::DOUBLE AS line_float FROM lineitem""")
def cast_map(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                            F.col("l_extendedprice").alias("price_text"),
                                            F.col("l_linenumber").alias("line_float"))
    out, _ = repair.convert_types(df, {"l_quantity": "int", "price_text": "str", "line_float": "float"})
    return out


TYPED = """typed AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole,
  CAST(l_discount AS VARCHAR) AS fraction, CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS broken,
  l_returnflag AS flag FROM lineitem)"""


def _typed(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").cast("string").alias("whole"),
        F.col("l_discount").cast("string").alias("fraction"),
        F.expr("CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' ELSE cast(l_linenumber AS string) END").alias("broken"),
        F.col("l_returnflag").alias("flag"))


@check("infer_types", f"WITH {TYPED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column",
  CASE WHEN count(*) FILTER (NOT regexp_full_match({c}, '[+-]?[0-9]+')) = 0 THEN 'int'
       WHEN count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL) = 0 THEN 'float' ELSE 'none' END AS suggested FROM typed"""
                                                             for c in ("whole", "fraction", "broken", "flag")))
def infer_types(spark, d):
    return repair.type_suggestions(_typed(spark, d))


@check("auto_convert", f"""WITH {TYPED} SELECT l_orderkey, l_linenumber, whole::BIGINT AS whole, fraction::DOUBLE AS fraction, broken, flag FROM typed""")
def auto_convert(spark, d):
    return repair.auto_convert(_typed(spark, d))[0]


@check("cast_preview", f"""WITH {TYPED} SELECT l_orderkey, l_linenumber, broken AS "before", TRY_CAST(broken AS BIGINT) AS "after",
  CASE WHEN TRY_CAST(broken AS BIGINT) IS NULL THEN 'failed' ELSE 'ok' END AS status FROM typed""")
def cast_preview(spark, d):
    return repair.cast_preview(_typed(spark, d), "broken", "int", ["l_orderkey", "l_linenumber"])


WORDS = "CASE l_linenumber % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'T' WHEN 3 THEN '0' ELSE 'maybe' END"


@check("parse_bool", f"""SELECT l_orderkey, l_linenumber, CASE WHEN lower(w) IN ('true', '1', 'yes', 'y', 't') THEN true
  WHEN lower(w) IN ('false', '0', 'no', 'n', 'f') THEN false END AS flag FROM (SELECT l_orderkey, l_linenumber, {WORDS} AS w FROM lineitem)""")
def parse_bool(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(WORDS).alias("flag"))
    return repair.convert_types(df, {"flag": "bool"}, strict=False)[0]


STRIP = r"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"
SQUEEZE = r"regexp_replace({c}, '\s+', ' ', 'g')"


def text_sql(expr):
    return f"WITH {TEXTS} SELECT doc_id, {expr} AS text FROM texts"


@check("text_strip", text_sql(STRIP.format(c="text")))
def text_strip(spark, d):
    return repair.clean_text(texts(spark, d), ["text"], ["strip"])


@check("text_normalize", text_sql(SQUEEZE.format(c="text")))
def text_normalize(spark, d):
    return repair.clean_text(texts(spark, d), ["text"], ["normalize_whitespace"])


@check("text_default", text_sql(SQUEEZE.format(c=STRIP.format(c="text"))))
def text_default(spark, d):
    return repair.clean_text(texts(spark, d))


@check("text_remove_special", text_sql(r"regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g')"))
def text_remove_special(spark, d):
    return repair.clean_text(texts(spark, d), ["text"], ["remove_special"])


@check("text_lower", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def text_lower(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return repair.clean_text(df, operations=["lower"])


@check("text_upper", "SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
def text_upper(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return repair.clean_text(df, operations=["upper"])


@check("constraint_violations", """WITH r AS (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS "column", concat_ws(',', CASE WHEN l_quantity < 5 THEN 'min_value' END,
    CASE WHEN l_quantity > 45 THEN 'max_value' END) AS rules FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', concat_ws(',',
    CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'allowed_values' END,
    CASE WHEN NOT regexp_matches(l_returnflag, '^[AR]$') THEN 'regex_pattern' END) FROM lineitem)
  SELECT * FROM r WHERE rules <> ''""")
def constraint_violations(spark, d):
    rules = {"l_quantity": {"min_value": 5, "max_value": 45},
             "l_returnflag": {"allowed_values": ["A", "N"], "regex_pattern": "^[AR]$"}, "no_such": {"min_value": 0}}
    return repair.constraint_violations(table(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


def strategy_sql(value, event_type="event_type", tail=""):
    return f"""WITH {DUPS}, f AS (SELECT event_id, user_id, {event_type} AS event_type, {value} AS value, props FROM dups),
  u AS (SELECT DISTINCT * FROM f){tail}"""


@check("strategy_custom", strategy_sql("coalesce(value, 0.0)") + """ SELECT event_id, user_id, upper(event_type) AS event_type,
  value, upper(props) AS props FROM u""")
def strategy_custom(spark, d):
    batch = cleaner.BatchCleaner()
    batch.register_cleaning_strategy("mine", {
        "missing_values": {"strategy": "custom", "columns": ["value"], "custom_value": 0.0},
        "duplicates": {"keep": "first"}, "text_cleaning": {"operations": ["upper"]}})
    return batch.apply_strategy(dups(spark, d), "mine").get_cleaned_data().drop("ts")


@check("quick_clean_basic", strategy_sql("coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dups))")
       + " SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM u")
def quick_clean_basic(spark, d):
    return _out(cleaner.quick_clean(dups(spark, d)))


def _after(t, c):
    return f"{t}.{c} BETWEEN lo AND hi"


@check("quick_clean_aggressive", strategy_sql("coalesce(value, (SELECT avg(value) FROM dups))", tail=f""",
  a AS (SELECT u.* FROM u, {IQR.format(c="event_id", t="u", f=1.5)} b WHERE event_id BETWEEN lo AND hi),
  b1 AS (SELECT a.* FROM a, {IQR.format(c="user_id", t="a", f=1.5)} b WHERE user_id BETWEEN lo AND hi),
  c AS (SELECT b1.* FROM b1, {IQR.format(c="value", t="b1", f=1.5)} b WHERE value BETWEEN lo AND hi)""")
       + " SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM c")
def quick_clean_aggressive(spark, d):
    return _out(cleaner.quick_clean(dups(spark, d), "aggressive_cleaning"))


def _dup_mode(c):
    return f"(SELECT {c} FROM dups WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@check("quick_clean_conservative", strategy_sql(f"coalesce(value, {_dup_mode('value')})", f"coalesce(event_type, {_dup_mode('event_type')})")
       + """ SELECT event_id, user_id, event_type, round(CASE WHEN value < p05 THEN p05 WHEN value > p95 THEN p95 ELSE value END, 6)
  AS value, props FROM u, (SELECT quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM u)""")
def quick_clean_conservative(spark, d):
    return _out(cleaner.quick_clean(dups(spark, d), "conservative_cleaning"))


@check("quick_clean_ml_ready", f"""WITH {DIRTY}, near AS (SELECT q.event_id, d.value, row_number() OVER (PARTITION BY q.event_id
  ORDER BY pow(q.event_id - d.event_id, 2) + pow(q.user_id - d.user_id, 2), d.event_id) AS place
  FROM dirty q, dirty d WHERE q.value IS NULL AND d.value IS NOT NULL),
  fill AS (SELECT event_id, avg(value) AS v FROM near WHERE place <= 5 GROUP BY 1),
  f AS (SELECT event_id, user_id, lower(event_type) AS event_type, coalesce(value, v) AS value, lower(props) AS props
  FROM dirty LEFT JOIN fill USING (event_id))
  SELECT event_id, user_id, event_type, round(CASE WHEN value < p05 THEN p05 WHEN value > p95 THEN p95 ELSE value END, 6) AS value, props
  FROM f, (SELECT quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM f)""")
def quick_clean_ml_ready(spark, d):
    return _out(cleaner.quick_clean(dirty(spark, d), "ml_ready", key=["event_id"]))
