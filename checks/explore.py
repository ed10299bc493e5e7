"""Exploration statistics."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.common import DIRTY, SPIKY, check, dirty, rounded, spiky, table, union_all
from sparktidy.config import get_config
from sparktidy.operators import explore, normality, outliers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRENGTH = """CASE WHEN abs(correlation) >= 0.9 THEN 'Very Strong' WHEN abs(correlation) >= 0.7 THEN 'Strong'
  WHEN abs(correlation) >= 0.5 THEN 'Moderate' WHEN abs(correlation) >= 0.3 THEN 'Weak' ELSE 'Very Weak' END"""
PAIR_OUT = f"""SELECT column1, column2, round(correlation, 6) AS correlation, round(abs(correlation), 6) AS abs_correlation,
  {STRENGTH} AS strength FROM pairs"""


def pearson_sql(source, columns, where):
    return union_all([f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS correlation FROM {source} {where}"
                      for a, b in combinations(columns, 2)])


def ranks_sql(source, a, b):
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, corr(ra, rb) AS correlation FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def tau_sql(source, a, b):
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, (SELECT
    (s.c / sqrt(n0 - n1)) / sqrt(n0 - n2) FROM
    (SELECT sum(CASE WHEN p.x < q.x AND p.y < q.y THEN 1.0 WHEN p.x < q.x AND p.y > q.y THEN -1.0 ELSE 0.0 END
       * p.w * q.w)::DOUBLE AS c FROM g p, g q) s,
    (SELECT sum(w)::DOUBLE * (sum(w) - 1) / 2 AS n0 FROM g),
    (SELECT sum(t * (t - 1) / 2.0)::DOUBLE AS n1 FROM (SELECT sum(w) AS t FROM g GROUP BY x)),
    (SELECT sum(t * (t - 1) / 2.0)::DOUBLE AS n2 FROM (SELECT sum(w) AS t FROM g GROUP BY y))) AS correlation""", \
        f"g AS (SELECT {a} AS x, {b} AS y, count(*) AS w FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"


@check("corr_pearson", f"WITH pairs AS ({pearson_sql('lineitem', LINE, '')}) {PAIR_OUT}")
def corr_pearson(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), LINE, min_correlation=0.0))


@check("corr_pearson_threshold", """WITH pairs AS (SELECT 'p_partkey' AS column1, 'p_retailprice' AS column2,
  corr(p_partkey, p_retailprice) AS correlation FROM part UNION ALL SELECT 'p_partkey', 'p_size', corr(p_partkey, p_size)
  FROM part UNION ALL SELECT 'p_size', 'p_retailprice', corr(p_size, p_retailprice) FROM part) """ + PAIR_OUT
       + " WHERE abs(correlation) >= 0.1")
def corr_pearson_threshold(spark, d):
    return rounded(explore.correlations(table(spark, d, "part")))


EVENT_NUMBERS = ["event_id", "user_id", "value"]


@check("corr_pearson_listwise", f"WITH {DIRTY}, pairs AS ({pearson_sql('dirty', EVENT_NUMBERS, 'WHERE value IS NOT NULL')}) {PAIR_OUT}")
def corr_pearson_listwise(spark, d):
    return rounded(explore.correlations(dirty(spark, d), EVENT_NUMBERS, min_correlation=0.0))


@check("corr_pearson_wide", f"""WITH pairs AS ({pearson_sql('lineitem', LINE, '')})
  SELECT column1, column2, round(correlation, 6) AS correlation FROM pairs""")
def corr_pearson_wide(spark, d):
    df = explore._doubles(table(spark, d, "lineitem"), LINE).na.drop()
    return rounded(explore._vector_pairs(df, LINE))


# A constant column and one with NaN make every pair with them undefined: no row reaches the threshold.
ODD = "odd AS (SELECT l_quantity, l_extendedprice, l_discount, 7.5::DOUBLE AS flat FROM lineitem)"


def _odd(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit(7.5).alias("flat"))


@check("corr_constant", f"WITH {ODD}, pairs AS ({pearson_sql('odd', LINE[:3], '')}) {PAIR_OUT}")
def corr_constant(spark, d):
    return rounded(explore.correlations(_odd(spark, d), [*LINE[:3], "flat"], min_correlation=0.0))


@check("corr_constant_spearman", f"WITH {ODD}, pairs AS (" + union_all(
    [ranks_sql("odd", a, b) for a, b in combinations(LINE[:3], 2)]) + f") {PAIR_OUT}")
def corr_constant_spearman(spark, d):
    return rounded(explore.correlations(_odd(spark, d), [*LINE[:3], "flat"], "spearman", 0.0))


SHIFTS = [(i, c) for i in range(11) for c in LINE]


@check("corr_constant_wide", "WITH odd AS (SELECT " + ", ".join(
    f"{c} * {i + 1} + l_tax * {i} AS w{k}" for k, (i, c) in enumerate(SHIFTS)) + " FROM lineitem), wide AS (SELECT "
    + ", ".join(f'corr(w{i}, w{j}) AS "w{i} w{j}"' for i, j in combinations(range(len(SHIFTS)), 2))
    + " FROM odd), long AS (UNPIVOT wide ON COLUMNS(*) INTO NAME pair VALUE correlation), pairs AS ("
    f"SELECT split_part(pair, ' ', 1) AS column1, split_part(pair, ' ', 2) AS column2, correlation FROM long) {PAIR_OUT}")
def corr_constant_wide(spark, d):
    wide = table(spark, d, "lineitem").select(
        *[(F.col(c) * (i + 1) + F.col("l_tax") * i).alias(f"w{k}") for k, (i, c) in enumerate(SHIFTS)], F.lit(1.0).alias("flat"))
    return rounded(explore.correlations(wide, min_correlation=0.0))


def _every_pair_sql(columns):
    """One scan computes the correlations of all pairs, which then become rows."""
    pairs = ", ".join(f'corr({a}, {b}) AS "{a} {b}"' for a, b in combinations(columns, 2))
    return f"""every AS (SELECT {pairs} FROM wide), pairs AS (
  SELECT split_part(pair, ' ', 1) AS column1, split_part(pair, ' ', 2) AS column2, correlation
  FROM (UNPIVOT every ON COLUMNS(*) INTO NAME pair VALUE correlation))"""


@check("corr_wide_pairs", "WITH wide AS (SELECT " + ", ".join(
    f"{c} * {i + 1} + l_tax * {i} AS w{k}" for k, (i, c) in enumerate(SHIFTS)) + " FROM lineitem), "
    + _every_pair_sql([f"w{k}" for k in range(len(SHIFTS))]) + f" {PAIR_OUT}")
def corr_wide_pairs(spark, d):
    """All 946 pairs of 44 columns; a pair with the constant column would be one row too many."""
    wide = table(spark, d, "lineitem").select(
        *[(F.col(c) * (i + 1) + F.col("l_tax") * i).alias(f"w{k}") for k, (i, c) in enumerate(SHIFTS)], F.lit(1.0).alias("flat"))
    return rounded(explore.correlations(wide, min_correlation=0.0))


@check("corr_spearman", "WITH pairs AS (" + union_all([ranks_sql("lineitem", a, b) for a, b in combinations(LINE, 2)])
       + f") {PAIR_OUT}")
def corr_spearman(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), LINE, "spearman", 0.0))


KEYED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE]


@check("corr_spearman_wide", "WITH ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in KEYED)
    + " FROM lineitem), wide AS (SELECT " + ", ".join(f'corr({a}, {b}) AS "{a} {b}"' for a, b in combinations(KEYED, 2))
    + " FROM ranked), long AS (UNPIVOT wide ON COLUMNS(*) INTO NAME pair VALUE correlation), pairs AS ("
    f"SELECT split_part(pair, ' ', 1) AS column1, split_part(pair, ' ', 2) AS column2, correlation FROM long) {PAIR_OUT}")
def corr_spearman_wide(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), KEYED, "spearman", 0.0))


@check("corr_spearman_nulls", f"WITH {DIRTY}, pairs AS (" + union_all(
    [ranks_sql("dirty", a, b) for a, b in combinations(EVENT_NUMBERS, 2)]) + f") {PAIR_OUT}")
def corr_spearman_nulls(spark, d):
    return rounded(explore.correlations(dirty(spark, d), EVENT_NUMBERS, "spearman", 0.0))


_TAU = tau_sql("lineitem", "l_quantity", "l_linenumber")


@check("corr_kendall", f"WITH {_TAU[1]}, pairs AS ({_TAU[0]}) {PAIR_OUT}")
def corr_kendall(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], "kendall", 0.0))


STEPS = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]
_TAUS = [tau_sql("lineitem", a, b) for a, b in combinations(STEPS, 2)]


@check("corr_kendall_columns", "WITH pairs AS (" + union_all([f"SELECT * FROM (WITH {g} {tau})" for tau, g in _TAUS]) + f") {PAIR_OUT}")
def corr_kendall_columns(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), STEPS, "kendall", 0.0))


_TAU2 = tau_sql("customer", "c_acctbal", "c_nationkey")


@check("corr_kendall_continuous", f"WITH {_TAU2[1]}, pairs AS ({_TAU2[0]}) {PAIR_OUT}")
def corr_kendall_continuous(spark, d):
    return rounded(explore.correlations(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "kendall", 0.0))


@check("corr_matrix", f"""WITH pairs AS ({pearson_sql('lineitem', LINE, '')}), m AS (
  SELECT column1, column2, correlation FROM pairs UNION ALL SELECT column2, column1, correlation FROM pairs
  UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest({LINE}) AS c))
  SELECT column1, column2, round(correlation, 6) AS correlation FROM m""")
def corr_matrix(spark, d):
    return rounded(explore.correlation_matrix(table(spark, d, "lineitem"), LINE))


def distribution_sql(source, columns):
    return union_all([f"""SELECT '{c}' AS "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  round((avg(pow(v - m, 3))) / pow(avg(pow(v - m, 2)), 1.5), 6) AS skewness,
  round(avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3, 6) AS kurtosis,
  round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(max(v) - min(v), 6) AS "range",
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr
  FROM (SELECT {c}::DOUBLE AS v FROM {source} WHERE {c} IS NOT NULL),
       (SELECT avg({c}::DOUBLE) AS m FROM {source})""" for c in columns])


@check("distribution", distribution_sql("lineitem", LINE))
def distribution(spark, d):
    return rounded(explore.distributions(table(spark, d, "lineitem"), LINE))


@check("distribution_nulls", f"WITH {DIRTY} " + distribution_sql("dirty", ["user_id", "value"]))
def distribution_nulls(spark, d):
    return rounded(explore.distributions(dirty(spark, d), ["user_id", "value"]))


@check("skew_label", f"""WITH {SPIKY}, s AS (""" + union_all([f"""SELECT '{c}' AS "column",
  avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS skewness FROM (SELECT {c}::DOUBLE AS v FROM spiky WHERE {c} IS NOT NULL),
  (SELECT avg({c}::DOUBLE) AS m FROM spiky)""" for c in EVENT_NUMBERS]) + """) SELECT "column", round(skewness, 6) AS skewness,
  CASE WHEN abs(skewness) > 1 THEN 'highly skewed' WHEN abs(skewness) > 0.5 THEN 'moderately skewed'
  ELSE 'approximately symmetric' END AS label FROM s""")
def skew_label(spark, d):
    return rounded(explore.skew_labels(spiky(spark, d)))


IQR_BOUNDS = """b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
  quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM spiky)"""
Z_BOUNDS = "b AS (SELECT avg(value) - 3 * stddev_pop(value) AS lo, avg(value) + 3 * stddev_pop(value) AS hi FROM spiky)"
MZ_BOUNDS = """md AS (SELECT median(value) AS m FROM spiky), dv AS (SELECT median(abs(value - m)) AS mad, any_value(m) AS m FROM spiky, md),
  b AS (SELECT m - 3.5 * mad / 0.6745 AS lo, m + 3.5 * mad / 0.6745 AS hi FROM dv)"""


def report_sql(method, bounds):
    return f"""WITH {SPIKY}, {bounds} SELECT 'value' AS "column", '{method}' AS method, count(value) AS total_count,
  count(*) FILTER (value < lo OR value > hi) AS outlier_count,
  round(count(*) FILTER (value < lo OR value > hi) * 100.0::DOUBLE / count(value), 6) AS outlier_pct,
  round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper FROM spiky, b"""


def rows_sql(bounds):
    return f"""WITH {SPIKY}, {bounds} SELECT event_id, 'value' AS "column", round(value, 6) AS value FROM spiky, b
  WHERE value < lo OR value > hi"""


@check("outliers_iqr", report_sql("iqr", IQR_BOUNDS))
def outliers_iqr(spark, d):
    return rounded(outliers.outlier_report(spiky(spark, d), ["value"], "iqr"))


@check("outliers_z", report_sql("zscore", Z_BOUNDS))
def outliers_z(spark, d):
    return rounded(outliers.outlier_report(spiky(spark, d), ["value"], "zscore"))


@check("outliers_mz", report_sql("modified_zscore", MZ_BOUNDS))
def outliers_mz(spark, d):
    return rounded(outliers.outlier_report(spiky(spark, d), ["value"], "modified_zscore"))


@check("outlier_rows_iqr", rows_sql(IQR_BOUNDS))
def outlier_rows_iqr(spark, d):
    return rounded(outliers.outlier_rows(spiky(spark, d), ["event_id"], ["value"], "iqr"))


@check("outlier_rows_z", rows_sql(Z_BOUNDS))
def outlier_rows_z(spark, d):
    return rounded(outliers.outlier_rows(spiky(spark, d), ["event_id"], ["value"], "zscore"))


@check("outlier_rows_mz", rows_sql(MZ_BOUNDS))
def outlier_rows_mz(spark, d):
    return rounded(outliers.outlier_rows(spiky(spark, d), ["event_id"], ["value"], "modified_zscore"))


def frequency_sql(source, columns, k):
    return union_all([f"""SELECT "column", value, "count", rank, unique_count, total_count, missing_count,
  round("count"::DOUBLE / total_count, 6) AS share FROM (
  SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS "count",
  row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}),
  (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count, count({c}) AS total_count,
   count(*) - count({c}) AS missing_count FROM {source}) WHERE rank <= {k}""" for c in columns])


@check("categorical_freq", f"WITH {DIRTY} " + frequency_sql("dirty", ["event_type", "props"], 20))
def categorical_freq(spark, d):
    return rounded(explore.categorical_analysis(dirty(spark, d)))


@check("normality_jb", union_all([f"""SELECT '{c}' AS "column", n, round(jb, 6) AS statistic, round(exp(-jb / 2), 6) AS p_value,
  exp(-jb / 2) > 0.05 AS is_normal FROM (SELECT n, n / 6.0 * (s * s + k * k / 4) AS jb FROM (SELECT count(*) AS n,
  avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS s, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS k
  FROM (SELECT {c}::DOUBLE AS v FROM customer), (SELECT avg({c}::DOUBLE) AS m FROM customer)))"""
                                  for c in ("c_custkey", "c_nationkey", "c_acctbal")]))
def normality_jb(spark, d):
    return rounded(normality.jarque_bera(table(spark, d, "customer")))


@check("normality_repeated_rows", """SELECT 'v' AS "column", 60 * count(*) AS n_total, true AS drawn FROM lineitem""")
def normality_repeated_rows(spark, d):
    """Ten values, each in very many equal rows."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).cast("double").alias("v"),
                                              F.explode(F.sequence(F.lit(1), F.lit(60))).alias("copy")).select("v")
    out = normality.shapiro_test(rows, ["v"])
    return out.select("column", "n_total", F.col("n").between(4000, 5000).alias("drawn"))


@check("normality_sw")
def normality_sw(spark, d):
    return normality.shapiro_test(table(spark, d, "lineitem"), LINE)


@check("histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
  c AS (SELECT least(floor((l_extendedprice - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
  SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS lower, round(lo + (i + 1) * w, 6) AS upper, coalesce(n, 0) AS "count"
  FROM (SELECT unnest(range(20)) AS i) g CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def histogram(spark, d):
    return rounded(explore.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20).drop("not_finite"))


@check("histogram_nan", """WITH t AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_orderkey % 10 > 1),
  b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM t), c AS (SELECT least(floor((v - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM t, b GROUP BY 1)
  SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS lower, round(lo + (i + 1) * w, 6) AS upper, coalesce(n, 0) AS "count",
  (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 <= 1) AS not_finite
  FROM (SELECT unnest(range(20)) AS i) g CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def histogram_nan(spark, d):
    odd = table(spark, d, "lineitem").select(F.expr(
        "CASE l_orderkey % 10 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') ELSE l_extendedprice END AS v"))
    return rounded(explore.histogram(odd, "v", 20))


@check("histogram_gaps", f"""WITH {SPIKY}, b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM spiky),
  c AS (SELECT least(floor((value - lo) / w), 49)::INTEGER AS bin, count(*) AS n FROM spiky, b WHERE value IS NOT NULL GROUP BY 1)
  SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS lower, round(lo + (i + 1) * w, 6) AS upper, coalesce(n, 0) AS "count"
  FROM (SELECT unnest(range(50)) AS i) g CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def histogram_gaps(spark, d):
    return rounded(explore.histogram(spiky(spark, d), "value", 50).drop("not_finite"))


@check("pair_corr", f"""WITH {DIRTY}, p AS (SELECT count(*) AS n, corr(user_id, value) AS correlation FROM dirty
  WHERE value IS NOT NULL) SELECT n, round(correlation, 6) AS correlation, {STRENGTH} AS strength FROM p""")
def pair_corr(spark, d):
    return rounded(explore.pair_correlation(dirty(spark, d), "user_id", "value"))


@check("scatter_sample", f"""WITH {DIRTY} SELECT event_id, user_id, value FROM dirty WHERE user_id IS NOT NULL AND value IS NOT NULL
  ORDER BY ('0x' || substr(md5(event_id || '|{get_config().random_state}'), 1, 13))::BIGINT, event_id LIMIT 1000""")
def scatter_sample(spark, d):
    return explore.scatter_sample(dirty(spark, d), "user_id", "value", ["event_id"])


@check("class_balance", """WITH c AS (SELECT quality AS class, count(*) AS "count" FROM labels GROUP BY 1)
  SELECT class, "count", round("count"::DOUBLE / (SELECT sum("count") FROM c), 6) AS share,
  round((SELECT max("count")::DOUBLE / min("count") FROM c), 6) AS imbalance_ratio FROM c""")
def class_balance(spark, d):
    return rounded(explore.class_balance(table(spark, d, "labels"), "quality"))
