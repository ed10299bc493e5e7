"""Schema validation and table comparison."""

from pyspark.sql import functions as F

from checks.common import DIRTY, check, dirty, rounded, table, union_all
from sparktidy.operators import diff, validate
from sparktidy.operators.validate import ColumnSchema, DataSchema

COLS = '"column", "check", severity, actual, expected'


def _found(df, schema, *checks):
    out = validate.violations(df, schema)
    return out.where(F.col("check").isin(*checks)).drop("message") if checks else out.drop("message")


@check("validate_presence", """SELECT 'no_such' AS "column", 'column_presence' AS "check", 'error' AS severity,
  CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS expected
  UNION ALL SELECT c, 'extra_column', 'warning', NULL, NULL FROM (SELECT column_name AS c FROM (DESCRIBE orders)
  WHERE column_name NOT IN ('o_orderkey', 'o_custkey'))""")
def validate_presence(spark, d):
    schema = DataSchema([ColumnSchema("o_orderkey"), ColumnSchema("o_custkey"), ColumnSchema("no_such")],
                        allow_extra_columns=False)
    return _found(table(spark, d, "orders"), schema)


@check("validate_dtype", """SELECT 'o_totalprice' AS "column", 'dtype' AS "check", 'error' AS severity,
  (SELECT CASE any_value(typeof(o_totalprice)) WHEN 'DOUBLE' THEN 'double' END FROM orders) AS actual, 'Int64' AS expected""")
def validate_dtype(spark, d):
    schema = DataSchema([ColumnSchema("o_orderkey", "Int64"), ColumnSchema("o_totalprice", "Int64"),
                         ColumnSchema("o_orderstatus", "Utf8"), ColumnSchema("o_orderdate", "Datetime")])
    return _found(table(spark, d, "orders"), schema)


@check("validate_nulls", f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, count(*) - count(value) AS v, count(*) - count(event_type) AS e FROM dirty)
  SELECT 'event_type' AS "column", 'nullable' AS "check", 'error' AS severity, CAST(e AS VARCHAR) AS actual, '0' AS expected FROM n WHERE e > 0
  UNION ALL SELECT 'value', 'max_missing_pct', 'warning', printf('%.1f%%', v * 100.0::DOUBLE / n), '≤10.0%' FROM n WHERE v * 100.0::DOUBLE / n > 10""")
def validate_nulls(spark, d):
    schema = DataSchema([ColumnSchema("event_type", nullable=False), ColumnSchema("event_id", nullable=False),
                         ColumnSchema("value", max_missing_pct=10.0)])
    return _found(dirty(spark, d), schema)


@check("validate_unique", """SELECT 'user_id' AS "column", 'unique' AS "check", 'error' AS severity,
  CAST(count(DISTINCT user_id) AS VARCHAR) AS actual, 'all values distinct' AS expected FROM events""")
def validate_unique(spark, d):
    return _found(table(spark, d, "events"), DataSchema([ColumnSchema("event_id", unique=True), ColumnSchema("user_id", unique=True)]))


@check("validate_range", """SELECT 'l_quantity' AS "column", 'min_value' AS "check", 'error' AS severity, CAST(min(l_quantity) AS VARCHAR) AS actual,
  '≥5' AS expected FROM lineitem HAVING min(l_quantity) < 5
  UNION ALL SELECT 'l_quantity', 'max_value', 'error', CAST(max(l_quantity) AS VARCHAR), '≤45' FROM lineitem HAVING max(l_quantity) > 45""")
def validate_range(spark, d):
    schema = DataSchema([ColumnSchema("l_quantity", min_value=5, max_value=45), ColumnSchema("l_tax", min_value=0.0, max_value=1.0)])
    return _found(table(spark, d, "lineitem"), schema)


@check("validate_allowed", """WITH bad AS (SELECT lang AS v FROM documents WHERE lang NOT IN ('en') GROUP BY 1)
  SELECT 'lang' AS "column", 'allowed_values' AS "check", 'error' AS severity, (SELECT string_agg(v, ',' ORDER BY v) FROM
  (SELECT v FROM bad ORDER BY v LIMIT 5)) AS actual, 'one of en' AS expected, (SELECT count(*) FROM bad) || ' disallowed value(s)' AS message""")
def validate_allowed(spark, d):
    return validate.violations(table(spark, d, "documents"), DataSchema([ColumnSchema("lang", allowed_values=["en"])]))


FULL = DataSchema([
    ColumnSchema("event_id", "Int64", nullable=False, unique=True), ColumnSchema("value", "Float64", max_missing_pct=10.0, min_value=1.0),
    ColumnSchema("event_type", "Utf8", nullable=False, allowed_values=["view", "click"]), ColumnSchema("no_such")])


@check("validate_full", f"""WITH {DIRTY} SELECT false AS passed, 1 + (SELECT count(*) FROM (SELECT 1 FROM dirty HAVING min(value) < 1))
  + (SELECT count(*) FROM (SELECT 1 FROM dirty HAVING count(event_type) < count(*)))
  + (SELECT count(*) FROM (SELECT 1 FROM dirty WHERE event_type NOT IN ('view', 'click') HAVING count(*) > 0)) AS error_count,
  (SELECT count(*) FROM (SELECT 1 FROM dirty HAVING (count(*) - count(value)) * 100.0 / count(*) > 10)) AS warning_count""")
def validate_full(spark, d):
    return validate.validation_summary(dirty(spark, d), FULL)


TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@check("infer_schema", f"WITH {DIRTY} " + union_all([f"""SELECT '{c}' AS name, '{t}' AS dtype, count({c}) < count(*) AS nullable,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*) + 5, 1) AS max_missing_pct, false AS "unique" FROM dirty""" for c, t in TYPES.items()]))
def infer_schema(spark, d):
    return validate.schema_facts(dirty(spark, d))


@check("validate_own_schema", f"WITH {DIRTY} SELECT count(*) >= 0 AS passed, 0::BIGINT AS error_count, 0::BIGINT AS warning_count FROM dirty")
def validate_own_schema(spark, d):
    df = dirty(spark, d)
    return validate.validation_summary(df, validate.infer_schema(df))


def _changed(spark, d):
    return (table(spark, d, "orders").drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)
            .withColumn("o_custkey", F.col("o_custkey").cast("double")).withColumn("o_extra", F.lit("x")))


@check("diff_shape", """SELECT count(*) AS rows_a, count(*) AS rows_b, 6::BIGINT AS columns_a, 6::BIGINT AS columns_b, true AS shape_match,
  false AS schema_match, 'o_orderpriority' AS columns_only_in_a, 'o_extra' AS columns_only_in_b,
  'o_custkey:bigint->double' AS dtype_changes, 1::INTEGER AS verdict FROM orders""")
def diff_shape(spark, d):
    return diff.diff_shape(table(spark, d, "orders"), _changed(spark, d))


@check("diff_numeric", union_all([f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean_a, round(avg({c} * {f}), 4) AS mean_b,
  round(avg({c} * {f}) - avg({c}), 4) AS mean_delta, 0.0::DOUBLE AS null_pct_a, 0.0::DOUBLE AS null_pct_b FROM orders"""
                                  for c, f in (("o_orderkey", 1), ("o_custkey", 1), ("o_totalprice", 1.1))]))
def diff_numeric(spark, d):
    return diff.diff_numeric(table(spark, d, "orders"), _changed(spark, d))


@check("diff_nulls", f"""WITH {DIRTY} SELECT 'event_id' AS "column", round((SELECT avg(event_id) FROM events), 4) AS mean_a, round(avg(event_id), 4) AS mean_b,
  0.0::DOUBLE AS mean_delta, 0.0::DOUBLE AS null_pct_a, 0.0::DOUBLE AS null_pct_b FROM dirty
  UNION ALL SELECT 'user_id', round((SELECT avg(user_id) FROM events), 4), round(avg(user_id), 4), 0.0, 0.0, 0.0 FROM dirty
  UNION ALL SELECT 'value', round((SELECT avg(value) FROM events), 4), round(avg(value), 4), round(avg(value) - (SELECT avg(value) FROM events), 4),
  0.0, round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 2) FROM dirty""")
def diff_nulls(spark, d):
    return rounded(diff.diff_numeric(table(spark, d, "events"), dirty(spark, d)), 4)
