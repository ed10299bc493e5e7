"""Profiling, exploration, normality, validation and comparison."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from sparktidy import ColumnSchema, DataExplorer, DataInspector, DataSchema, diff_numeric, diff_shape, infer_schema, validate_data
from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.normal import inverse_normal
from sparktidy.operators import explore, profile
from sparktidy.operators.kendall import _signed_pairs, kendall_pair
from sparktidy.operators.normality import shapiro_wilk


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(21, "kiwi", 6.0, False), (22, "fig", None, None), (23, None, 9.0, True), (24, "kiwi", 0.5, True), (25, "date", 4.0, False)],
        "id long, name string, score double, active boolean")


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame([(4, "u"), (5, "v"), (4, "u"), (6, "w"), (4, "u"), (5, "v")], "x long, y string")


def test_basic_info(mixed, copies):
    info = DataInspector(mixed).get_basic_info()
    assert (info["n_rows"], info["n_columns"], info["missing_values_total"], info["duplicate_rows"]) == (5, 4, 3, 0)
    assert (info["numeric_columns"], info["categorical_columns"]) == (2, 1)
    assert DataInspector(copies).get_basic_info()["duplicate_rows"] == 3
    assert profile.duplicate_counts(copies).first().duplicate_members == 5


def test_profiles(mixed):
    got = DataInspector(mixed).get_column_profiles()
    assert got["name"]["unique_count"] == 4 and got["name"]["missing_count"] == 1  # a null is one value
    assert got["score"]["median"] == 5.0 and got["score"]["q25"] == 3.125
    assert got["name"]["top_values"] == {"kiwi": 2, "date": 1, "fig": 1}
    approx = profile.column_profiles(mixed, approx=True).where("column = 'name'").first()
    assert approx.unique_count == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert DataInspector(empty).get_basic_info()["n_rows"] == 0
    assert profile.column_profiles(empty).first().missing_pct == 0.0
    assert profile.numeric_summary(empty).first().mean is None


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], {"k": 1}), (1, [1.0, 2.0], {"k": 1})], "a int, b array<double>, c map<string,int>")
    assert kinds.columns_of(df, "other") == ["b", "c"]
    assert DataInspector(df).get_basic_info()["duplicate_rows"] == 1
    assert {r.column: r.bytes for r in profile.column_bytes(df).collect()}["b"] == 32


def test_issues(spark):
    df = spark.createDataFrame([(i, 3 if i == 2 else None, -4) for i in range(6)], "ok long, sparse long, constant long")
    found = {(i["type"], i["column"], i["severity"]) for i in DataInspector(df).detect_potential_issues()}
    assert found == {("high_missing_values", "sparse", "high"), ("constant_column", "constant", "medium")}


def test_report_and_json(mixed):
    report = DataInspector(mixed).report(["id"], sample_rows=2)
    assert set(report) == {"overview", "columns", "top_values", "sample", "correlations"}
    assert report["sample"].count() == 2 and report["columns"].count() == 4
    doc = json.loads(profile.inspect_json(mixed).first().json)
    assert doc["rows"] == 5 and {f["column"]: f["missing_pct"] for f in doc["fields"]}["name"] == 20.0
    assert DataInspector(mixed).get_memory_usage()["column_bytes"]["name"] == 15


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"x": x, "y": 2 * x, "z": np.round(rng.exponential(2, 300), 1), "t": np.where(np.arange(300) % 3 == 0, 1.0, np.round(x, 1))})
    pdf.loc[pdf.index % 10 == 0, "z"] = np.nan
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double, z double, t double"), pdf


def test_rank_correlations(numbers):
    df, pdf = numbers
    for method in ("spearman", "kendall"):
        got = {(r.column1, r.column2): r.correlation for r in explore.correlation_pairs(df, ["x", "z", "t"], method).collect()}
        for (a, b), r in got.items():
            both = pdf[[a, b]].dropna()
            want = np.corrcoef(both[a].rank(), both[b].rank())[0, 1] if method == "spearman" else brute_tau(both[a].to_numpy(), both[b].to_numpy())
            assert math.isclose(r, want, abs_tol=1e-12), (method, a, b)


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), min_size=1, max_size=30))
def test_signed_pairs(points):
    x, y, w = (np.array(c) for c in zip(*points))
    sign = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :]) * (w[:, None] * w[None, :])
    assert _signed_pairs(x, y, w) == sign.sum() / 2


def test_kendall_bands(numbers):
    df, pdf = numbers
    both = pdf[["z", "t"]].dropna()
    assert math.isclose(kendall_pair(df, "z", "t", bands=5).first()[0], brute_tau(both.z.to_numpy(), both.t.to_numpy()), abs_tol=1e-12)


def test_correlation_report(numbers):
    df, _ = numbers
    top = DataExplorer(df).analyze_correlations().first()
    assert (top.column1, top.column2, top.strength) == ("x", "y", "Very Strong") and math.isclose(top.correlation, 1.0)
    with pytest.raises(UnsupportedOperationError):
        explore.correlation_pairs(df, method="other")


def test_distribution_histogram_scatter(numbers):
    df, pdf = numbers
    d = DataExplorer(df).analyze_distributions(["x"]).first()
    assert math.isclose(d.std, pdf.x.std(ddof=0)) and math.isclose(d.iqr, np.subtract(*np.percentile(pdf.x, [75, 25])))
    bins = DataExplorer(df).histogram("z", 8)
    assert [r["count"] for r in bins.orderBy("bin").collect()] == list(np.histogram(pdf.z.dropna(), 8)[0])
    one = [tuple(r) for r in explore.scatter_sample(df, "x", "z", ["x"], 40).collect()]
    two = [tuple(r) for r in explore.scatter_sample(df.repartition(7), "x", "z", ["x"], 40).collect()]
    assert len(one) == 40 and sorted(one) == sorted(two)


MPG = [21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9,
       21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4]


def test_shapiro_published_values():
    """Values printed by a widely used statistics package for public samples."""
    w, p = shapiro_wilk(np.array(MPG))
    assert abs(w - 0.94756) < 1e-5 and abs(p - 0.1229) < 1e-4
    w, p = shapiro_wilk(np.arange(58.0, 73.0))
    assert abs(w - 0.96359) < 1e-5 and abs(p - 0.7545) < 1e-4
    assert shapiro_wilk(np.ones(5)) == (1.0, 1.0)
    assert 0 <= shapiro_wilk(np.array([1.0, 2.0, 4.0]))[1] <= 1
    assert shapiro_wilk(np.array([1.0, 2.0, 3.0, 4.0, 500.0]))[1] < 0.01


def test_normality(numbers, spark):
    df, _ = numbers
    got = {r.column: r for r in DataExplorer(df).test_normality(["x", "z"]).collect()}
    assert got["x"].is_normal and not got["z"].is_normal and got["z"].n == 270
    jb = {r.column: r.is_normal for r in DataExplorer(df).test_normality(["x", "z"], method="jarque_bera").collect()}
    assert jb == {"x": True, "z": False}
    big = spark.range(30000).selectExpr("id", "cast(id % 1000 as double) v")
    drawn = DataExplorer(big).test_normality(["v"]).first()
    assert 4000 < drawn.n <= 5000 < drawn.n_total
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert DataExplorer(few).test_normality(["v"]).first().p_value is None


def test_inverse_normal():
    assert np.allclose(inverse_normal(np.array([0.5, 0.975, 0.025, 1e-7])), [0, 1.959963984540054, -1.959963984540054, -5.199337582192817])


SCHEMA = {"columns": [{"name": "id", "dtype": "Int64", "nullable": False, "unique": True},
                      {"name": "name", "allowed_values": ["a", "b"], "max_missing_pct": 10.0},
                      {"name": "score", "dtype": "Float64", "min_value": 2.0, "max_value": 4.0}, {"name": "gone"}],
          "allow_extra_columns": False}


def test_validation(mixed, tmp_path):
    result = validate_data(mixed, SCHEMA)
    assert {(v["column"], v["check"], v["severity"]) for v in result.violations} == {
        ("gone", "column_presence", "error"), ("active", "extra_column", "warning"), ("name", "allowed_values", "error"),
        ("name", "max_missing_pct", "warning"), ("score", "min_value", "error"), ("score", "max_value", "error")}
    assert not result.passed and result.to_dict()["error_count"] == 4
    DataSchema.from_dict(SCHEMA).to_json(tmp_path / "s.json")
    assert validate_data(mixed, tmp_path / "s.json").to_dict() == result.to_dict()
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(SCHEMA))
    assert len(validate_data(mixed, str(tmp_path / "s.yaml")).violations) == 6


def test_validation_details(mixed, copies):
    bad = validate_data(copies, DataSchema([ColumnSchema("x", "Utf8", unique=True)]))
    assert [(v["check"], v["actual"]) for v in sorted(bad.violations, key=lambda v: v["check"])] == [("dtype", "bigint"), ("unique", "3")]
    assert validate_data(mixed, DataSchema([])).passed
    nulls = validate_data(mixed, DataSchema([ColumnSchema("score", nullable=False)])).errors[0]
    assert nulls["actual"] == "1" and nulls["expected"] == "0"


def test_inferred_schema_fits(mixed):
    schema = infer_schema(mixed)
    assert [c.nullable for c in schema.columns] == [False, True, True, True]
    assert schema.columns[1].max_missing_pct == 25.0
    assert validate_data(mixed, schema).passed
    assert DataSchema.from_structtype(mixed.schema).columns[0].dtype == "bigint"


def test_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "x long, y double")
    same = diff_shape(a, a).first()
    assert same.verdict == 0 and same.shape_match and same.schema_match
    b = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "x long, z long")
    other = diff_shape(a, b).first()
    assert (other.verdict, other.columns_only_in_a, other.columns_only_in_b) == (1, "y", "z")
    row = diff_numeric(a, b).first()
    assert (row.column, row.mean_a, row.mean_b, row.mean_delta) == ("x", 1.5, 2.0, 0.5)
    assert diff_numeric(a, a).where("column = 'y'").first().null_pct_a == 50.0


def test_column_classes(spark):
    df = spark.createDataFrame([], "i int, d double, m decimal(5,2), s string, b boolean, t timestamp, n timestamp_ntz, e date")
    assert kinds.numeric_columns(df) == ["i", "d", "m"] and kinds.categorical_columns(df) == ["s"]
    assert kinds.boolean_columns(df) == ["b"] and kinds.datetime_columns(df) == ["t", "n", "e"]
    assert kinds.same_dtype(df.schema["n"].dataType, "Datetime") and not kinds.same_dtype(df.schema["s"].dataType, "Int64")


def test_top_values_from_candidates(spark):
    """Columns that candidates settle, that they cannot settle, and that have few values."""
    df = spark.range(6000).selectExpr(
        "CASE WHEN id % 10 < 6 THEN concat('head', id % 5) ELSE concat('tail', id) END AS heads",
        "concat('v', id div 2) AS flat", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'only' END AS one", "CAST(NULL AS STRING) AS none",
        "CASE WHEN id % 2 = 0 THEN concat('v', id % 7) ELSE concat('w', id % 1500) END AS mixed")
    names, pdf = df.columns, df.toPandas()
    want = {}
    for c in names:
        counts = pdf[c].dropna().value_counts()
        want[c] = sorted(((v, int(n)) for v, n in counts.items()), key=lambda x: (-x[1], x[0]))[:4]
    for tracked in (4, 64, 256, 4096):
        got = {c: [] for c in names}
        for r in profile.top_values(df, names, 4, tracked).orderBy("column", "rank").collect():
            got[r["column"]].append((r["value"], r["count"]))
        assert got == want, tracked
    assert set(profile._candidate_counts(df, names, 4, 256)[1]) == {"heads", "one", "none", "mixed"}
    assert profile.top_values(df.limit(0), names).count() == 0
