"""Profiling."""

from pyspark.sql import functions as F

from checks.common import DIRTY, DUPS, check, dirty, dups, rounded, table, union_all
from sparktidy.operators import profile

LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
EVENTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
          "value": "double", "props": "string"}
NUMERIC = ("bigint", "int", "double")
KIND = {"string": "categorical", "timestamp_ntz": "datetime"}


def profile_sql(source: str, columns: dict[str, str], pct=None) -> str:
    pct = pct or (lambda e: f"round({e}, 6)")
    return union_all([f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{KIND.get(t, "numeric")}' AS kind,
       count(*) AS n_rows, count(*) - count({c}) AS missing_count,
       {pct(f"(count(*) - count({c})) * 100.0::DOUBLE / count(*)")} AS missing_pct,
       count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count,
       {pct(f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0::DOUBLE / count(*)")} AS unique_pct
       FROM {source}""" for c, t in columns.items()])


def summary_sql(source: str, columns, digits: int = 6) -> str:
    return union_all([f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), {digits}) AS mean,
       round(stddev_samp({c}), {digits}) AS std, round(min({c})::DOUBLE, {digits}) AS "min",
       round(quantile_cont({c}::DOUBLE, 0.25), {digits}) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), {digits}) AS median,
       round(quantile_cont({c}::DOUBLE, 0.75), {digits}) AS q75, round(max({c})::DOUBLE, {digits}) AS "max"
       FROM {source}""" for c in columns])


LINE_NUMBERS = [c for c, t in LINEITEM.items() if t in NUMERIC]


@check("profile_basic", f"""WITH {DUPS}, g AS (SELECT count(*) AS copies FROM dups GROUP BY ALL)
SELECT (SELECT count(*) FROM dups) AS n_rows, 6::BIGINT AS n_columns,
  (SELECT 2 * count(*) - count(value) - count(event_type) FROM dups) AS missing_values_total,
  (SELECT CAST(sum(copies - 1) AS BIGINT) FROM (SELECT count(*) AS copies FROM dups
     GROUP BY event_id, ts, user_id, event_type, value, props)) AS duplicate_rows,
  3::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 1::BIGINT AS datetime_columns""".replace(
    ", g AS (SELECT count(*) AS copies FROM dups GROUP BY ALL)", ""))
def profile_basic(spark, d):
    return profile.basic_info(dups(spark, d))


@check("profile_columns", profile_sql("lineitem", LINEITEM))
def profile_columns(spark, d):
    return rounded(profile.column_profiles(table(spark, d, "lineitem")))


@check("profile_columns_nulls", f"WITH {DIRTY} " + profile_sql("dirty", EVENTS))
def profile_columns_nulls(spark, d):
    return rounded(profile.column_profiles(dirty(spark, d)))


@check("profile_samples", f"WITH {DIRTY} " + union_all([f"""SELECT '{c}' AS "column", position, value FROM (
  SELECT row_number() OVER (ORDER BY event_id)::INTEGER AS position, CAST({c} AS VARCHAR) AS value FROM dirty
  WHERE {c} IS NOT NULL) WHERE position <= 5""" for c in ("user_id", "event_type", "props")]))
def profile_samples(spark, d):
    return profile.sample_values(dirty(spark, d), ["event_id"], 5, ["user_id", "event_type", "props"])


@check("numeric_summary", summary_sql("lineitem", LINE_NUMBERS))
def numeric_summary(spark, d):
    return rounded(profile.numeric_summary(table(spark, d, "lineitem")))


@check("numeric_summary_nulls", f"WITH {DIRTY} " + summary_sql("dirty", ["event_id", "user_id", "value"]))
def numeric_summary_nulls(spark, d):
    return rounded(profile.numeric_summary(dirty(spark, d)))


def top_sql(source: str, columns, k: int) -> str:
    return union_all([f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS "count",
       row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR))::INTEGER AS rank
       FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}""" for c in columns])


@check("top_values", f"WITH {DIRTY} " + top_sql("dirty", ["event_type", "props"], 10))
def top_values(spark, d):
    return profile.top_values(dirty(spark, d))


@check("top_values_documents", top_sql("documents", ["lang", "source", "text"], 10))
def top_values_documents(spark, d):
    return profile.top_values(table(spark, d, "documents"), ["lang", "source", "text"])


@check("quality_summary", f"""WITH {DUPS}, g AS (SELECT count(*) AS copies FROM dups
     GROUP BY event_id, ts, user_id, event_type, value, props)
SELECT 2::BIGINT AS columns_with_missing, n_null AS total_missing_cells, round(n_null * 100.0::DOUBLE / (n * 6), 6) AS missing_pct,
  'value,event_type' AS worst_columns, 'bigint:2,double:1,string:2,timestamp_ntz:1' AS type_distribution,
  n - d AS duplicate_rows, round((n - d) * 100.0::DOUBLE / n, 6) AS duplicate_pct, d AS unique_rows
FROM (SELECT count(*) AS n, 2 * count(*) - count(value) - count(event_type) AS n_null FROM dups),
     (SELECT count(*) AS d FROM g)""")
def quality_summary(spark, d):
    return rounded(profile.quality_summary(dups(spark, d)))


MESSY = DUPS + """, messy AS (SELECT *, 'x' AS constant, CASE WHEN event_id % 3 = 0 THEN value END AS sparse,
  CASE WHEN event_id % 10 < 7 THEN user_id END AS partial FROM dups)"""
MESSY_COLUMNS = {**EVENTS, "constant": "string", "sparse": "double", "partial": "bigint"}


@check("detect_issues", f"""WITH {MESSY}, p AS ({profile_sql("messy", MESSY_COLUMNS, pct=lambda e: e)}),
dup AS (SELECT (SELECT count(*) FROM dups) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS d)
SELECT CASE WHEN missing_pct > 50 THEN 'high_missing_values' ELSE 'moderate_missing_values' END AS type,
  CASE WHEN missing_pct > 50 THEN 'high' ELSE 'medium' END AS severity, "column",
  printf('%.1f%% missing values', missing_pct) AS details,
  CASE WHEN missing_pct > 50 THEN 'mostly empty: leave it out, or fill it from other columns'
       ELSE 'fill the gaps before modelling' END AS recommendation FROM p WHERE missing_pct > 20
UNION ALL SELECT 'constant_column', 'medium', "column", 'Column has only one unique value',
  'one value throughout: it separates nothing' FROM p WHERE unique_count = 1
UNION ALL SELECT 'potential_id_column', 'low', "column", printf('%.1f%% unique values', unique_pct),
  'nearly every value is its own: looks like a key, not a feature' FROM p WHERE unique_pct > 95 AND unique_count > 100
UNION ALL SELECT 'duplicate_rows', CASE WHEN (n - d) * 100.0::DOUBLE / n > 10 THEN 'high' WHEN (n - d) * 100.0::DOUBLE / n > 1 THEN 'medium'
  ELSE 'low' END, 'entire_dataset', format('{{:,}}', n - d) || printf(' duplicate rows (%.1f%%)', (n - d) * 100.0::DOUBLE / n),
  'some rows are repeated: deduplicate' FROM dup WHERE n > d""")
def detect_issues(spark, d):
    messy = dups(spark, d).withColumns({
        "constant": F.lit("x"), "sparse": F.expr("CASE WHEN event_id % 3 = 0 THEN value END"),
        "partial": F.expr("CASE WHEN event_id % 10 < 7 THEN user_id END")})
    return profile.detect_issues(messy)


@check("detect_issues_ids", f"""WITH p AS ({profile_sql("orders", {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}, pct=lambda e: e)})
SELECT 'potential_id_column' AS type, 'low' AS severity, "column", printf('%.1f%% unique values', unique_pct) AS details,
  'nearly every value is its own: looks like a key, not a feature' AS recommendation
FROM p WHERE unique_pct > 95 AND unique_count > 100""")
def detect_issues_ids(spark, d):
    return profile.detect_issues(table(spark, d, "orders"))


@check("column_bytes", union_all(
    [f"SELECT '{c}' AS \"column\", CAST(sum(8) AS BIGINT) AS bytes FROM documents" for c in ("doc_id", "n_chars")]
    + [f"SELECT '{c}', CAST(sum(strlen({c})) AS BIGINT) FROM documents" for c in ("text", "lang", "source")]))
def column_bytes(spark, d):
    return profile.column_bytes(table(spark, d, "documents"))


@check("column_bytes_arrays", """SELECT 'vec_id' AS "column", CAST(count(*) * 8 AS BIGINT) AS bytes FROM embeddings
UNION ALL SELECT 'embedding', CAST(sum(len(embedding) * 4) AS BIGINT) FROM embeddings
UNION ALL SELECT 'label', CAST(count(*) * 4 AS BIGINT) FROM embeddings""")
def column_bytes_arrays(spark, d):
    return profile.column_bytes(table(spark, d, "embeddings"))


@check("dup_members", f"""WITH {DUPS}, g AS (SELECT count(*) AS copies FROM dups
     GROUP BY event_id, ts, user_id, event_type, value, props)
SELECT CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows,
  CAST(sum(CASE WHEN copies > 1 THEN copies END) AS BIGINT) AS duplicate_members FROM g""")
def dup_members(spark, d):
    return profile.duplicate_counts(dups(spark, d))


@check("report_overview", f"""WITH {DUPS}, g AS (SELECT count(*) AS copies FROM dups
     GROUP BY event_id, ts, user_id, event_type, value, props)
SELECT n AS "rows", 6::BIGINT AS cols, m AS missing_cells, round(m * 100.0::DOUBLE / (n * 6), 2) AS missing_pct,
  (SELECT CAST(sum(copies) AS BIGINT) FROM g WHERE copies > 1) AS duplicate_rows
FROM (SELECT count(*) AS n, 2 * count(*) - count(value) - count(event_type) AS m FROM dups)""")
def report_overview(spark, d):
    return profile.profile_report(dups(spark, d), ["event_id"])["overview"]


@check("report_columns", f"""WITH {DIRTY}, p AS ({profile_sql("dirty", EVENTS)}),
s AS ({summary_sql("dirty", ["event_id", "user_id", "value"], 4)})
SELECT p."column" AS name, dtype, kind, missing_count AS null_count, round(missing_pct, 2) AS null_pct, unique_count AS "unique",
  mean, std, "min", q25, median, q75, "max" FROM p LEFT JOIN s ON p."column" = s."column" """)
def report_columns(spark, d):
    return profile.profile_report(dirty(spark, d), ["event_id"])["columns"]


@check("report_numeric_only", """SELECT 0::BIGINT AS top_rows, count(*) AS "rows", 4::BIGINT AS cols FROM lineitem""")
def report_numeric_only(spark, d):
    """A table without a text column, with a constant one."""
    report = profile.profile_report(table(spark, d, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", F.lit(1).alias("flat")), ["l_orderkey"])
    rows = report["overview"].select("rows", F.col("cols").cast("bigint").alias("cols"))
    return rows.withColumn("top_rows", F.lit(report["top_values"].count()).cast("bigint"))


@check("report_sample", f"""WITH {DIRTY} SELECT event_id, user_id, event_type, value, props FROM dirty
  ORDER BY event_id LIMIT 10""")
def report_sample(spark, d):
    return profile.profile_report(dirty(spark, d), ["event_id"])["sample"].drop("ts")


@check("inspect_json", f"WITH {DIRTY} " + union_all([f"""SELECT count(*) AS "rows", 6::BIGINT AS columns, '{c}' AS "column",
   '{t}' AS dtype, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM dirty"""
                                                     for c, t in EVENTS.items()]))
def inspect_json(spark, d):
    fields = "array<struct<column:string,dtype:string,missing_pct:double>>"
    doc = profile.inspect_json(dirty(spark, d)).select(
        F.from_json("json", f"rows bigint, columns bigint, fields {fields}").alias("j"))
    return doc.select("j.rows", "j.columns", F.inline("j.fields"))
