"""Feature transformation."""

from itertools import combinations_with_replacement

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.common import DIRTY, check, dirty, rounded, table, union_all
from sparktidy.functions import normal
from sparktidy.operators import encode, features, scale, select, transformer

CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal"]


def _customer(spark, d):
    return table(spark, d, "customer").select(*CUSTOMER)


def _code(c, source):
    return f"(SELECT i FROM (SELECT {c} AS v, (row_number() OVER (ORDER BY {c}) - 1)::INTEGER AS i FROM (SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL)) m WHERE m.v = s.{c})"


@check("encode_eligible", f"WITH {DIRTY}, u AS (" + union_all([f"""SELECT '{c}' AS "column", count(DISTINCT {c})
  + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count FROM dirty""" for c in ("event_type", "props")])
       + """) SELECT "column", unique_count, CASE WHEN unique_count > 30 THEN 'too many values' WHEN unique_count = 1 THEN 'single value'
  ELSE '' END AS reason, unique_count <= 30 AND unique_count <> 1 AS eligible FROM u""")
def encode_eligible(spark, d):
    return encode.encode_eligibility(dirty(spark, d), method="onehot")


@check("encode_label", f"""WITH {DIRTY} SELECT event_id, event_type, props, {_code("event_type", "dirty")} AS event_type_encoded,
  {_code("props", "dirty")} AS props_encoded FROM dirty s""")
def encode_label(spark, d):
    df = dirty(spark, d).select("event_id", "event_type", "props")
    return encode.encode(df, "label", drop_original=False)


@check("encode_label_replace", f"""SELECT l_orderkey, {_code("l_returnflag", "lineitem")} AS l_returnflag,
  {_code("l_linestatus", "lineitem")} AS l_linestatus FROM lineitem s""")
def encode_label_replace(spark, d):
    return encode.encode(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "label")


SEGMENTS = ["click", "error", "purchase", "signup", "view"]


@check("encode_onehot", f"WITH {DIRTY} SELECT event_id, " + ", ".join(
    f"(event_type = '{s}')::TINYINT AS event_type_{s}" for s in SEGMENTS) + " FROM dirty")
def encode_onehot(spark, d):
    return encode.encode(dirty(spark, d).select("event_id", "event_type"), "onehot")


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@check("encode_ordinal", "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES)) + " END AS o_orderpriority_encoded FROM orders")
def encode_ordinal(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encode.encode(df, "ordinal", order={"o_orderpriority": PRIORITIES}, drop_original=False)


@check("encode_ordinal_large", """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS c_name FROM customer""")
def encode_ordinal_large(spark, d):
    return encode.encode(table(spark, d, "customer").select("c_custkey", "c_name"), "ordinal", columns=["c_name"])


@check("encode_target", f"""WITH {DIRTY}, m AS (SELECT avg(value) AS g FROM dirty), k AS (SELECT event_type,
  (sum(value) + 10 * any_value(g)) / (count(*) + 10) AS e FROM dirty, m WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1)
  SELECT event_id, event_type, value, round(e, 6) AS event_type_encoded FROM dirty LEFT JOIN k USING (event_type)""")
def encode_target(spark, d):
    df = dirty(spark, d).select("event_id", "event_type", "value")
    return rounded(encode.encode(df, "target", columns=["event_type"], target="value", smoothing=10.0, drop_original=False))


@check("encode_target_large", """WITH k AS (SELECT l_partkey, avg(l_quantity) AS e FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, round(e, 6) AS l_partkey, l_quantity FROM lineitem JOIN k USING (l_partkey)""")
def encode_target_large(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rounded(encode.encode(df, "target", columns=["l_partkey"], target="l_quantity"))


@check("encode_target_skewed", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 THEN -1 ELSE l_partkey END AS k,
  l_quantity FROM lineitem), m AS (SELECT k, avg(l_quantity) AS e FROM t GROUP BY 1)
  SELECT l_orderkey, l_linenumber, round(e, 6) AS k, l_quantity FROM t JOIN m USING (k)""")
def encode_target_skewed(spark, d):
    """Two thirds of the rows hold one value."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(
        "CASE WHEN l_orderkey % 3 > 0 THEN -1 ELSE l_partkey END AS k"), "l_quantity")
    return rounded(encode.encode(df, "target", columns=["k"], target="l_quantity"))


KEYS = ["l_orderkey", "l_partkey", "l_shipdate"]


@check("encode_ordinal_columns", "SELECT l_orderkey * 10 + l_linenumber AS row_key, " + ", ".join(
    f"(dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS {c}" for c in KEYS) + " FROM lineitem")
def encode_ordinal_columns(spark, d):
    """Three maps of more than a thousand categories, of two types, looked up together."""
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber AS row_key"), *KEYS)
    return encode.encode(rows, "ordinal", columns=KEYS)


@check("encode_target_columns", "WITH " + ", ".join(
    f"k{i} AS (SELECT {c}, avg(l_quantity) AS e{i} FROM lineitem GROUP BY 1)" for i, c in enumerate(KEYS))
    + " SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, " + ", ".join(
    f"round(e{i}, 6) AS {c}_encoded" for i, c in enumerate(KEYS)) + " FROM lineitem "
    + " ".join(f"JOIN k{i} USING ({c})" for i, c in enumerate(KEYS)))
def encode_target_columns(spark, d):
    rows = table(spark, d, "lineitem").select(*KEYS, "l_linenumber", "l_quantity")
    return rounded(encode.encode(rows, "target", columns=KEYS, target="l_quantity", drop_original=False))


@check("encode_unknown_large", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN (k.code)::INTEGER END AS l_partkey
  FROM lineitem LEFT JOIN (SELECT p_partkey, dense_rank() OVER (ORDER BY p_partkey) - 1 AS code FROM part WHERE p_partkey % 2 = 0) k
  ON l_partkey = p_partkey""")
def encode_unknown_large(spark, d):
    """A map learned from half of the keys meets the other half: null codes, or an error if asked for."""
    known = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    strict = encode.fit_encoder(known, "ordinal", columns=["l_partkey"], handle_unknown="error")
    try:
        strict.transform(rows).agg(F.max("l_partkey")).collect()
    except PySparkException as error:
        if "unknown category" not in str(error):
            raise
    else:
        raise AssertionError("an unseen category passed")
    return encode.fit_encoder(known, "ordinal", columns=["l_partkey"]).transform(rows)


def scaled(expr):
    cols = ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in CUSTOMER[1:])
    return f"SELECT c_custkey, {cols} FROM customer"


@check("scale_standard", scaled("({c} - (SELECT avg({c}) FROM customer)) / (SELECT stddev_pop({c}) FROM customer)"))
def scale_standard(spark, d):
    return rounded(scale.scale(_customer(spark, d), "standard", columns=CUSTOMER[1:]))


@check("scale_standard_nulls", f"""WITH {DIRTY} SELECT event_id, round((value - (SELECT avg(value) FROM dirty))
  / (SELECT stddev_pop(value) FROM dirty), 6) AS value FROM dirty""")
def scale_standard_nulls(spark, d):
    return rounded(scale.scale(dirty(spark, d).select("event_id", "value"), "standard", columns=["value"]))


@check("scale_minmax", scaled("({c} - (SELECT min({c}) FROM customer))::DOUBLE / (SELECT max({c}) - min({c}) FROM customer) * 2 - 1"))
def scale_minmax(spark, d):
    return rounded(scale.scale(_customer(spark, d), "minmax", columns=CUSTOMER[1:], feature_range=(-1.0, 1.0)))


@check("scale_robust", scaled("""({c} - (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM customer))
  / (SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM customer)"""))
def scale_robust(spark, d):
    return rounded(scale.scale(_customer(spark, d), "robust", columns=CUSTOMER[1:]))


@check("scale_maxabs", scaled("{c}::DOUBLE / (SELECT max(abs({c})) FROM customer)"))
def scale_maxabs(spark, d):
    return rounded(scale.scale(_customer(spark, d), "maxabs", columns=CUSTOMER[1:]))


# Knots are linear quantiles at least(1000, n) evenly spaced ranks.
_UNIFORM = """WITH s AS (SELECT list_sort(list(c_acctbal)) AS l, count(*) AS n, least(1000, count(*)) AS k FROM customer),
  g AS (SELECT l, n, i::DOUBLE / (k - 1) AS p, i::DOUBLE / (k - 1) * (n - 1) AS spot FROM (SELECT *, unnest(range(k)) AS i FROM s)),
  kn AS (SELECT p, l[floor(spot)::BIGINT + 1] * (1 - (spot - floor(spot))) + l[ceil(spot)::BIGINT + 1] * (spot - floor(spot)) AS q FROM g),
  near AS (SELECT c_custkey, c_acctbal AS x, max(q) FILTER (q <= c_acctbal) AS ql, min(q) FILTER (q >= c_acctbal) AS qh,
  max(p) FILTER (q <= c_acctbal) AS pl, min(p) FILTER (q >= c_acctbal) AS ph, any_value(lo) AS lo, any_value(hi) AS hi
  FROM customer, kn, (SELECT min(q) AS lo, max(q) AS hi FROM kn) GROUP BY 1, 2),
  placed AS (SELECT c_custkey, CASE WHEN x = lo THEN 0.0 WHEN x = hi THEN 1.0 WHEN ql = qh THEN (pl + ph) / 2
  ELSE pl + (ph - pl) * (x - ql) / (qh - ql) END::DOUBLE AS p FROM near)"""


@check("scale_quantile_uniform", _UNIFORM + " SELECT c_custkey, round(p, 6) AS c_acctbal FROM placed")
def scale_quantile_uniform(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.scale(df, "quantile_uniform", columns=["c_acctbal"]))


def _ratio(coefficients, x):
    """A quotient of two polynomials, highest power first, as SQL."""
    def nested(powers):
        out = f"{powers[0]!r}::DOUBLE"
        for c in powers[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    return f"{nested(coefficients[0])} / {nested(coefficients[1])}"


@check("scale_quantile_normal", _UNIFORM + f""", clipped AS (SELECT c_custkey, least(greatest(p, {scale.NORMAL_CLIP!r}), 1 - {scale.NORMAL_CLIP!r}) AS p FROM placed),
  terms AS (SELECT c_custkey, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS t FROM clipped)
  SELECT c_custkey, round(CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(normal.CENTRE, "(0.180625 - q * q)")}
  ELSE sign(q) * CASE WHEN t <= 5 THEN {_ratio(normal.NEAR, "(t - 1.6)")} ELSE {_ratio(normal.FAR, "(t - 5.0)")} END END, 6) AS c_acctbal FROM terms""")
def scale_quantile_normal(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.scale(df, "quantile_normal", columns=["c_acctbal"]))


@check("scale_report", union_all([f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS original_mean, round(stddev_samp({c}), 6) AS original_std,
  round(avg(({c} - lo)::DOUBLE / (hi - lo)), 6) AS new_mean, round(stddev_samp(({c} - lo)::DOUBLE / (hi - lo)), 6) AS new_std
  FROM customer, (SELECT min({c}) AS lo, max({c}) AS hi FROM customer)""" for c in CUSTOMER[1:]]))
def scale_report(spark, d):
    df = _customer(spark, d)
    return rounded(scale.scale_report(df, scale.scale(df, "minmax", columns=CUSTOMER[1:]), CUSTOMER[1:]))


LINE = ["l_quantity", "l_discount", "l_tax"]


def _line(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)


def _term(t):
    names = {c: t.count(c) for c in dict.fromkeys(t)}
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in names.items()), " * ".join(t)


@check("polynomial", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, 1.0::DOUBLE AS \"1\", " + ", ".join(
    f'round({e}, 6) AS "{n}"' for n, e in (_term(t) for k in (2, 3) for t in combinations_with_replacement(LINE, k)))
       + " FROM lineitem")
def polynomial(spark, d):
    out = features.polynomial_features(_line(spark, d), LINE, degree=3, include_bias=True)
    return out.select(*[F.round(f"`{c}`", 6).alias(c) if c not in ("l_orderkey", "l_linenumber") else F.col(c)
                        for c in out.columns])


@check("interactions", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, round(l_quantity * l_discount, 6) AS "l_quantity l_discount",
  round(l_quantity * l_tax, 6) AS "l_quantity l_tax", round(l_discount * l_tax, 6) AS "l_discount l_tax" FROM lineitem""")
def interactions(spark, d):
    out = features.polynomial_features(_line(spark, d), LINE, interaction_only=True)
    return out.select(*[F.round(f"`{c}`", 6).alias(c) if c not in ("l_orderkey", "l_linenumber") else F.col(c)
                        for c in out.columns])


MATH_SQL = {
    "log": "CASE WHEN {c} > 0 THEN ln({c}) END", "log1p": "CASE WHEN {c} > -1 THEN ln(1 + {c}) END",
    "sqrt": "CASE WHEN {c} >= 0 THEN sqrt({c}) END", "square": "{c} * {c}", "cube": "pow({c} / 1000, 3)",
    "reciprocal": "CASE WHEN {c} <> 0 THEN 1.0 / {c} END", "exp": "CASE WHEN {c} / 1000 < 700 THEN exp({c} / 1000) END",
    "abs": "abs({c})", "sin": "sin({c})", "cos": "cos({c})", "tan": "tan({c})",
}


def _math_query(name):
    def run(spark, d):
        df = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
        if name in ("exp", "cube"):
            df = df.withColumn("v", F.col("v") / 1000)
        out = features.math_transforms(df, {"v": name}).drop("v")
        return rounded(out)

    run.__name__ = f"math_{name}"
    return run


for _name, _sql in MATH_SQL.items():
    check(f"math_{_name}", f"SELECT c_custkey, round({_sql.format(c='c_acctbal')}, 6) AS v_{_name} FROM customer")(_math_query(_name))


@check("math_in_place", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS c_acctbal FROM customer")
def math_in_place(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(features.math_transforms(df, {"c_acctbal": "log", "c_custkey": "unknown"}, create_new_columns=False))


def binned(edges, out="c_acctbal_binned", pick="{i}"):
    inner = " + ".join(f"(c_acctbal > {e})::INTEGER" for e in edges)
    return f"SELECT c_custkey, c_acctbal, {pick.format(i=inner)} AS {out} FROM customer"


QUINTILES = [f"(SELECT quantile_cont(c_acctbal, {p}) FROM customer)" for p in (0.2, 0.4, 0.6, 0.8)]
FIFTHS = [f"(SELECT min(c_acctbal) + {i} * (max(c_acctbal) - min(c_acctbal)) / 5 FROM customer)" for i in range(1, 5)]
THIRDS = [f"(SELECT min(c_acctbal) + {i} * (max(c_acctbal) - min(c_acctbal)) / 3 FROM customer)" for i in range(1, 3)]


def _bins(spark, d, **options):
    return features.binned_features(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], **options)


@check("bin_quantile", binned(QUINTILES))
def bin_quantile(spark, d):
    return _bins(spark, d)


@check("bin_uniform", binned(FIFTHS))
def bin_uniform(spark, d):
    return _bins(spark, d, strategy="uniform")


def _longer(used):
    """One cluster more: the best start of the last one for every end."""
    return f"""d{used + 1} AS MATERIALIZED (SELECT p.b AS e, min(d.cost + p.cost) AS cost, arg_min(list_append(d.cuts, p.a), d.cost + p.cost) AS cuts
    FROM p JOIN d{used} d ON p.a = d.e GROUP BY 1)"""


KMEANS_SQL = f"""WITH m AS (SELECT avg(c_acctbal) AS m FROM customer),
  v AS (SELECT c_acctbal - m AS v, count(*) AS n FROM customer, m GROUP BY 1),
  r AS (SELECT row_number() OVER w AS i, v, n, sum(n) OVER w AS nn, sum(n * v) OVER w AS s, sum(n * v * v) OVER w AS q FROM v WINDOW w AS (ORDER BY v)),
  z AS MATERIALIZED (SELECT i, nn, s, q FROM r UNION ALL SELECT 0, 0, 0, 0),
  p AS MATERIALIZED (SELECT a.i AS a, b.i AS b, b.q - a.q - pow(b.s - a.s, 2) / (b.nn - a.nn) AS cost FROM z a JOIN z b ON a.i < b.i),
  d1 AS (SELECT b AS e, cost, []::BIGINT[] AS cuts FROM p WHERE a = 0), {_longer(1)}, {_longer(2)}, {_longer(3)},
  best AS (SELECT cuts FROM d4 ORDER BY e DESC LIMIT 1),
  g AS (SELECT len(list_filter(cuts, lambda x: x < i)) AS g, sum(n * v) / sum(n) + any_value(m) AS centre FROM r, best, m GROUP BY 1),
  e AS (SELECT (centre + lead(centre) OVER (ORDER BY g)) / 2 AS edge FROM g)
  SELECT c_custkey, c_acctbal, (SELECT count(*) FROM e WHERE edge < c_acctbal)::INTEGER AS c_acctbal_binned FROM customer"""


@check("bin_kmeans", KMEANS_SQL)
def bin_kmeans(spark, d):
    return _bins(spark, d, strategy="kmeans", n_bins=4)


@check("bin_labels", binned(THIRDS, pick="list_extract(['low', 'mid', 'high'], {i} + 1)"))
def bin_labels(spark, d):
    return _bins(spark, d, strategy="uniform", n_bins=3, labels=["low", "mid", "high"])


SCORED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scored(spark, d):
    return table(spark, d, "lineitem").select(*SCORED, "l_returnflag")


F_SQL = union_all([f"""SELECT '{c}' AS feature, (SELECT sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) FROM
  (SELECT count(*) AS n, avg({c}) AS m, sum(pow({c} - cm, 2)) AS w, any_value(g) AS g FROM lineitem
   JOIN (SELECT l_returnflag, avg({c}) AS cm FROM lineitem GROUP BY 1) USING (l_returnflag), (SELECT avg({c}) AS g FROM lineitem)
   GROUP BY l_returnflag)) AS score""" for c in SCORED])


@check("score_f", f"SELECT feature, round(score, 6) AS score FROM ({F_SQL})")
def score_f(spark, d):
    return rounded(select.feature_scores(_scored(spark, d), "l_returnflag", "f_classif"))


@check("score_chi2", union_all([f"""SELECT '{c}' AS feature, (SELECT round(sum(pow(o - e, 2) / e), 6) FROM (SELECT sum(abs({c})) AS o,
  count(*)::DOUBLE / any_value(n) * any_value(t) AS e FROM lineitem, (SELECT count(*) AS n, sum(abs({c})) AS t FROM lineitem)
  GROUP BY l_returnflag)) AS score""" for c in SCORED]))
def score_chi2(spark, d):
    return rounded(select.feature_scores(_scored(spark, d), "l_returnflag", "chi2"))


DECILES = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def mi_sql(target, target_expr, columns):
    return union_all([f"""SELECT '{c}' AS feature, (WITH e AS (SELECT list_slice(list_sort(list_distinct(quantile_cont({c}::DOUBLE, {DECILES}))), 2, -2) AS e FROM lineitem),
  te AS (SELECT list_slice(list_sort(list_distinct(quantile_cont({target_expr}, {DECILES}))), 2, -2) AS te FROM lineitem),
  j AS (SELECT len(list_filter(e, lambda x: x < {c})) AS b, {target} AS t, count(*) AS n FROM lineitem, e, te GROUP BY 1, 2),
  m AS (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb, sum(n) OVER (PARTITION BY t)::DOUBLE AS nt, sum(n) OVER ()::DOUBLE AS nn FROM j)
  SELECT round(sum(n / nn * ln(n * nn / (nb * nt))), 6) FROM m) AS score""" for c in columns])


@check("score_mi", mi_sql("l_returnflag", "l_tax", SCORED))
def score_mi(spark, d):
    return rounded(select.feature_scores(_scored(spark, d), "l_returnflag", "mutual_info"))


@check("score_mi_numeric", mi_sql("len(list_filter(te, lambda x: x < l_quantity))", "l_quantity", SCORED[1:]))
def score_mi_numeric(spark, d):
    return rounded(select.feature_scores(_scored(spark, d), "l_quantity", "mutual_info"))


def _psi(n):
    return (f"(ln({n} + 8) - 1 / (2.0 * ({n} + 8)) - 1 / (12 * pow({n} + 8, 2)) + 1 / (120 * pow({n} + 8, 4)) - 1 / (252 * pow({n} + 8, 6)) - "
            + " - ".join(f"1.0 / ({n} + {i})" for i in range(8)) + ")")


def neighbour_sql(source, columns, target, k=3):
    """Every pair of points, for small tables."""
    return union_all([f"""SELECT '{c}' AS feature, (WITH s AS (SELECT stddev_pop({c}) AS sx, stddev_pop({target}) AS sy, count(*) AS rows FROM {source}),
  p AS MATERIALIZED (SELECT {c} / any_value(sx) AS x, {target} / any_value(sy) AS y, count(*) AS w, any_value(rows) AS rows FROM {source}, s GROUP BY {c}, {target}),
  d AS (SELECT a.x, a.y, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d,
    sum(b.w - (a.x = b.x AND a.y = b.y)::INTEGER) OVER (PARTITION BY a.x, a.y ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS upto FROM p a, p b),
  r AS MATERIALIZED (SELECT x, y, min(d) AS r FROM d WHERE upto >= {k} GROUP BY 1, 2),
  n AS (SELECT p.x, p.y, any_value(p.w) AS w, any_value(r.r) AS r, any_value(p.rows) AS rows,
    sum(o.w) FILTER (CASE WHEN r.r > 0 THEN abs(o.x - p.x) < r.r * (1 - 1e-10) - abs(p.x) * 1e-15 ELSE o.x = p.x END) AS nx,
    sum(o.w) FILTER (CASE WHEN r.r > 0 THEN abs(o.y - p.y) < r.r * (1 - 1e-10) - abs(p.y) * 1e-15 ELSE o.y = p.y END) AS ny
    FROM p JOIN r ON p.x = r.x AND p.y = r.y, p o GROUP BY 1, 2)
  SELECT round(greatest(0.0, any_value({_psi("rows")}) + sum(w * (CASE WHEN r > 0 THEN {_psi(f"{k}")} ELSE {_psi("greatest(w - 1, 1)")} END
    - {_psi("nx")} - {_psi("ny")})) / any_value(rows)), 6) FROM n) AS score""" for c in columns])


@check("score_mi_neighbours", neighbour_sql("part", ["p_partkey", "p_size"], "p_retailprice"))
def score_mi_neighbours(spark, d):
    return rounded(select.feature_scores(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                                         "p_retailprice", "mutual_info", estimator="neighbours"))


@check("feature_topk", f"SELECT feature, round(score, 6) AS score FROM ({F_SQL}) ORDER BY score DESC LIMIT 2")
def feature_topk(spark, d):
    scores = select.feature_scores(_scored(spark, d), "l_returnflag", "f_classif")
    return rounded(scores.orderBy(F.desc("score")).limit(2))


@check("feature_top1", """SELECT p_partkey, p_retailprice, p_brand FROM part""")
def feature_top1(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return select.select_features(df, "p_retailprice", "mutual_info", k=1)


ORDER_STEPS = f"""SELECT o_orderkey, {_code("o_orderstatus", "orders")} AS o_orderstatus,
  {_code("o_orderpriority", "orders")} AS o_orderpriority,
  round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice,
  round(CASE WHEN o_custkey > 0 THEN ln(o_custkey) END, 6) AS o_custkey_log FROM orders s"""


def _order_steps():
    return (transformer.create_pipeline().add_step("codes", "encode", method="label")
            .add_step("scaled", "scale", columns=["o_totalprice"])
            .add_step("logs", "math_transform", transforms={"o_custkey": "log"}))


@check("transform_steps", ORDER_STEPS)
def transform_steps(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(_order_steps().fit_transform(df).drop("o_custkey"))


@check("transform_steps_reloaded", ORDER_STEPS)
def transform_steps_reloaded(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    stored = _order_steps().fit(df).to_dict()
    return rounded(transformer.FittedSteps.from_dict(stored).transform(df).drop("o_custkey"))


def _standard(e):
    return f"round((({e}) - (SELECT avg({e}) FROM orders s)) / (SELECT stddev_pop({e}) FROM orders s), 6)"


@check("quick_transform", f"""SELECT {_standard("o_orderkey")} AS o_orderkey, {_standard("o_totalprice")} AS o_totalprice,
  {_standard(_code("o_orderstatus", "orders"))} AS o_orderstatus,
  {_standard(_code("o_orderpriority", "orders"))} AS o_orderpriority FROM orders s""")
def quick_transform(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(transformer.quick_transform(df))
