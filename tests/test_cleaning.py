import math

import numpy as np
import pandas as pd
import pytest

from sparktidy import BatchCleaner, DataCleaner, clean_data, quick_clean
from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.operators import repair
from sparktidy.operators.dedup import remove_duplicates
from sparktidy.operators.impute import columns_within_threshold, impute
from sparktidy.operators import knn
from sparktidy.operators.knn import knn_impute
from sparktidy.operators.outliers import fit_fences, outlier_report, treat_outliers


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([
        (11, 12.5, "ok", 3), (12, 20.0, None, 1), (13, None, "poor", 4), (14, 31.5, "ok", 1), (15, None, None, 5),
        (16, None, "fine", 9), (17, 8.0, "ok", 2)], "id long, score double, grade string, rank long")


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame([(7, "x"), (8, "y"), (7, "x"), (9, "z"), (8, "y"), (8, "y"), (10, "w")], "x long, y string")


@pytest.fixture(scope="module")
def spikes(spark):
    return spark.createDataFrame([(v,) for v in (6.1, 5.8, 6.4, 6.0, 250.0, 5.9, 6.3, 6.2, 5.7, 6.5)], "val double")


def scores(df):
    return [r.score for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("strategy,want", [
    ("mean", [12.5, 20, 18, 31.5, 18, 18, 8]), ("median", [12.5, 20, 16.25, 31.5, 16.25, 16.25, 8]),
    ("ffill", [12.5, 20, 20, 31.5, 31.5, 31.5, 8]), ("bfill", [12.5, 20, 31.5, 31.5, 8, 8, 8]),
])
def test_fill_strategies(nulls, strategy, want):
    out = impute(nulls, strategy, ["score"], order_by=["id"])
    assert scores(out) == want
    assert out.schema["rank"].dataType == nulls.schema["rank"].dataType


def test_drop_mode_custom(nulls):
    assert [r.id for r in impute(nulls, "drop").orderBy("id").collect()] == [11, 14, 17]
    assert [r.grade for r in impute(nulls, "mode", ["grade"]).orderBy("id").collect()] == ["ok", "ok", "poor", "ok", "ok", "fine", "ok"]
    assert scores(impute(nulls, "mode", ["score"]))[2] == 8.0  # all tie: the smallest
    assert scores(impute(nulls, "custom", ["score"], 0.0)) == [12.5, 20, 0, 31.5, 0, 0, 8]
    assert scores(impute(nulls, "custom", ["score"])) == scores(nulls)


def test_text_columns_are_left_by_numeric_strategies(nulls):
    assert impute(nulls, "mean").where("grade IS NULL").count() == 2
    assert impute(nulls, "median", ["score", "no_such"]).where("score IS NULL").count() == 0


def test_unknown_strategy_and_missing_order(nulls):
    with pytest.raises(UnsupportedOperationError):
        impute(nulls, "guess")
    with pytest.raises(DataValidationError):
        impute(nulls, "ffill", ["score"])


def test_threshold(nulls):
    assert columns_within_threshold(nulls, nulls.columns, 20.0) == ["id", "rank"]
    assert impute(nulls, "mean", drop_threshold=30.0).where("score IS NULL").count() == 3
    assert "score" not in impute(nulls, "mean", drop_threshold=30.0, on_exceed="drop").columns


def test_distribution_is_seeded(nulls):
    one = scores(impute(nulls, "distribution", ["score"], key=["id"]))
    two = scores(impute(nulls.repartition(3), "distribution", ["score"], key=["id"]))
    other = scores(impute(nulls, "distribution", ["score"], key=["id"], seed=7))
    assert one == pytest.approx(two, rel=1e-9) and one != pytest.approx(other, rel=1e-3) and None not in one
    assert [one[i] for i in (0, 1, 3, 6)] == [12.5, 20, 31.5, 8]


def test_distribution_has_the_right_shape(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select("id", F.when(F.col("id") % 2 == 0, (F.col("id") % 101).cast("double")).alias("x"))
    got = impute(df, "distribution", ["x"], key=["id"]).where("id % 2 = 1").agg(F.avg("x"), F.stddev("x")).first()
    want = df.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(got[0] - want[0]) < 1.5 and abs(got[1] / want[1] - 1) < 0.05


def brute_knn(pdf, column, features, k):
    """Nan-Euclidean nearest neighbours, ties to the smaller key."""
    out = {}
    donors = pdf[pdf[column].notna()].sort_values("id")
    for _, q in pdf[pdf[column].isna()].iterrows():
        gap = donors[features].to_numpy() - q[features].to_numpy("float64")
        seen = (~np.isnan(gap)).sum(axis=1)
        dist = np.where(seen > 0, np.nansum(gap**2, axis=1) * (len(features) + 1) / np.maximum(seen, 1), np.inf)
        best = [i for i in np.lexsort((donors.id.to_numpy(), dist)) if np.isfinite(dist[i])][:k]
        out[q.id] = donors[column].to_numpy()[best].mean() if best else donors[column].mean()
    return out


@pytest.mark.parametrize("cell_rows", [10_000, 40])
def test_knn_against_brute_force(spark, cell_rows):
    """With missing features and a pivot value that a third of the rows share."""
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "a": np.round(rng.normal(0, 30, n), 1), "b": rng.integers(0, 9, n).astype(float),
                        "y": np.round(rng.normal(5, 2, n), 3)})
    pdf.loc[pdf.id % 3 == 0, "a"] = 12.5
    pdf.loc[pdf.id % 17 == 0, "a"] = np.nan
    pdf.loc[pdf.id % 19 == 0, "b"] = np.nan
    pdf.loc[pdf.id % 8 == 0, "y"] = np.nan
    want = brute_knn(pdf, "y", ["a", "b"], 5)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, a double, b double, y double")
    got = {r.id: r.y for r in knn_impute(df, "y", ["id"], columns=["a", "b", "y"], cell_rows=cell_rows).collect()}
    assert len(got) == n
    for i, value in want.items():
        assert math.isclose(got[i], value, abs_tol=1e-9), i


@pytest.mark.parametrize("cell_rows", [10_000, 25])
def test_knn_where_columns_are_missing_in_turn(spark, cell_rows):
    """Rows that lack the widest column, all but one column or all of them, and
    values that are no numbers."""
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), "wide": np.round(rng.normal(0, 900, n), 1), "mid": np.round(rng.normal(0, 40, n), 1),
                        "thin": rng.integers(0, 5, n).astype(float), "y": np.round(rng.normal(5, 2, n), 3)})
    pdf.loc[pdf.id % 5 == 0, "wide"] = np.nan
    pdf.loc[pdf.id % 7 == 0, "mid"] = np.nan
    pdf.loc[pdf.id % 35 == 0, "thin"] = np.nan
    pdf.loc[pdf.id % 4 == 0, "y"] = np.nan
    want = brute_knn(pdf, "y", ["wide", "mid", "thin"], 5)
    given = pdf.astype(object).where(pdf.notna(), None)
    given.loc[10, "wide"], given.loc[15, "wide"] = math.inf, math.nan
    df = spark.createDataFrame(given, "id long, wide double, mid double, thin double, y double")
    filled = knn_impute(df, "y", ["id"], columns=["wide", "mid", "thin", "y"], cell_rows=cell_rows)
    got = {r.id: r.y for r in filled.collect()}
    assert len(got) == n
    for i, value in want.items():
        assert math.isclose(got[i], value, abs_tol=1e-9), i


def test_knn_boxes_bound_distances_and_rule_cells_out():
    """No donor lies nearer than its cell's bound, and a row without the widest
    column still visits few cells of its own tree."""
    rng = np.random.default_rng(4)
    points = np.column_stack([rng.normal(0, s, 4000) for s in (500, 60, 40)])
    points[::3, 1] = 7.0  # a third of the donors share a value
    points[::11, 2] = np.nan
    queries = np.column_stack([rng.normal(0, s, 60) for s in (500, 60, 40)])
    for lacking, axes in ((None, [0, 1, 2]), (0, [1, 2])):
        q = queries.copy()
        if lacking is not None:
            q[:, lacking] = np.nan
        tree = knn.grow(points, axes, 64)
        cell = tree.cell(points)
        names = np.unique(cell)
        parts = [points[cell == c] for c in names]
        boxes = knn.Boxes(names, np.zeros(len(names), int), np.array([len(p) for p in parts]),
                          np.array([np.nanmin(p, axis=0, initial=np.inf) for p in parts]),
                          np.array([np.nanmax(p, axis=0, initial=-np.inf) for p in parts]),
                          np.array([~np.isnan(p).any(axis=0) for p in parts]), np.array([~np.isnan(p).all(axis=0) for p in parts]))
        assert 40 <= tree.cells <= 90 and max(len(p) for p in parts) < 400
        bounds, exact = boxes.bounds(q, 4), knn._distances(q, points, 4)
        for j, c in enumerate(names):
            assert (bounds[:, j] <= exact[:, cell == c].min(axis=1)).all()
        edge = np.sort(exact, axis=1)[:, 4]
        visits = [len(v) for v in boxes.within(np.zeros(60, int), q, 4, edge)]
        assert np.mean(visits) < len(names) / 3, lacking


def test_knn_needs_key_and_second_column(spark, nulls):
    with pytest.raises(DataValidationError):
        impute(nulls, "knn", ["score"])
    one = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in impute(one, "knn").collect()) == [1.0, 2.0, 3.0]


def test_duplicates(spark, copies, rows):
    assert remove_duplicates(copies).count() == 4
    assert sorted(rows(remove_duplicates(copies, keep="none"))) == [(9, "z"), (10, "w")]
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, None, 5)], "id long, k string, v int")
    assert rows(remove_duplicates(df, ["k"], "first", ["id"]), "id") == [(1, "a", 1), (3, "b", 3), (4, None, 4)]
    assert rows(remove_duplicates(df, ["k"], "last", ["id"]), "id") == [(2, "a", 2), (3, "b", 3), (5, None, 5)]
    assert rows(remove_duplicates(df, ["k"], "none"), "id") == [(3, "b", 3)]
    assert remove_duplicates(df, ["k"]).count() == 3
    with pytest.raises(DataValidationError):
        remove_duplicates(df, ["no_such"])
    with pytest.raises(UnsupportedOperationError):
        remove_duplicates(df, keep="some")


def test_outliers(spikes):
    fence = fit_fences(spikes, ["val"])["val"]
    assert math.isclose(fence.low, 5.925 - 1.5 * 0.45) and math.isclose(fence.high, 6.375 + 1.5 * 0.45)
    assert outlier_report(spikes, ["val"]).first().outlier_count == 1
    assert treat_outliers(spikes).count() == 9
    assert treat_outliers(spikes, stage=True).count() == 9
    assert treat_outliers(spikes, action="cap").agg({"val": "max"}).first()[0] < 250
    assert treat_outliers(spikes, "modified_zscore").count() == 9
    assert treat_outliers(spikes, "zscore").count() == 10  # ten values never reach three sigma
    logs = [r.val for r in treat_outliers(spikes, action="transform").orderBy("val").collect()]
    assert math.isclose(logs[-1], math.log(250))


def test_outliers_without_spread(spark):
    flat = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "v double")
    assert treat_outliers(flat, "modified_zscore").count() == 10
    assert treat_outliers(spark.createDataFrame([(None,)], "v double")).count() == 1
    with pytest.raises(UnsupportedOperationError):
        treat_outliers(flat, "isolation")


def test_outlier_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(900.0,), (None,)], "v double")
    assert treat_outliers(df).count() == 20
    assert treat_outliers(df, keep_nulls=True, fit="joint").count() == 21


def test_types(spark):
    df = spark.createDataFrame([("1", "1.5", "x", "Yes", " 7 "), ("22", "2", "y", "f", "n/a")], "i string, f string, s string, b string, p string")
    out, report = repair.auto_convert(df)
    assert dict(out.dtypes) == {"i": "bigint", "f": "double", "s": "string", "b": "string", "p": "string"}
    assert {r["column"] for r in report} == {"i", "f"}
    out, report = repair.convert_types(df, {"i": "int", "p": "int", "b": "bool", "s": "thing"})
    assert dict(out.dtypes)["i"] == "bigint" and dict(out.dtypes)["p"] == "string" and dict(out.dtypes)["b"] == "boolean"
    assert {r["column"]: r["status"] for r in report} == {"i": "converted", "p": "failed", "b": "converted", "s": "failed"}
    out, _ = repair.convert_types(df, {"p": "int"}, strict=False, trim=True)
    assert sorted((r.p for r in out.collect()), key=str) == [7, None]
    dates = spark.createDataFrame([("2024-01-02 03:04:05",)], "t string")
    assert dict(repair.convert_types(dates, {"t": "datetime"})[0].dtypes)["t"] == "timestamp"


def test_text(spark):
    df = spark.createDataFrame([(" A  b\t",), (" C! ",), (None,)], "t string")
    assert [r.t for r in repair.clean_text(df).collect()] == ["A b", " C! ", None]
    assert repair.clean_text(df, operations=["strip"], unicode=True).collect()[1].t == "C!"
    assert repair.clean_text(df, operations=["remove_special", "strip", "lower"]).collect()[0].t == "a  b"
    with pytest.raises(UnsupportedOperationError):
        repair.clean_text(df, operations=["shout"])


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 50, None)], "id long, n int, s string")
    found = repair.constraint_violations(df, {"n": {"min_value": 10, "max_value": 40}, "s": {"allowed_values": ["a"]}}, ["id"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "n", "min_value"), (2, "s", "allowed_values"), (3, "n", "max_value")]
    assert repair.constraint_violations(df, {"zz": {"min_value": 1}}, ["id"]).count() == 0


def test_cleaner_chain_history_undo(nulls):
    cleaner = clean_data(nulls, order_by=["id"])
    cleaner.handle_missing_values("mean", ["score"]).remove_duplicates().clean_text_data(operations=["lower"])
    assert [h["operation"] for h in cleaner.get_history()] == ["missing_values", "duplicates", "text"]
    assert cleaner.get_cleaned_data().where("score IS NULL").count() == 0
    summary = cleaner.get_cleaning_summary()
    assert summary["rows_removed"] == 0 and summary["operations_performed"] == 3
    assert cleaner.undo() and len(cleaner.get_history()) == 2
    cleaner.undo_all()
    assert cleaner.get_cleaned_data().where("score IS NULL").count() == 3
    assert not cleaner.undo()
    shape, numeric = cleaner.handle_missing_values("drop").compare()
    assert shape.first().rows_b == 3 and numeric.count() == 3


def test_chain_mean_then_duplicates(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "x"), (1.0, "x"), (None, "y"), (1.0, "y")], "a double, b string")
    out = DataCleaner(df).handle_missing_values("mean", ["a"]).remove_duplicates().get_cleaned_data()
    assert out.count() == 2


@pytest.mark.parametrize("name", ["basic_cleaning", "aggressive_cleaning", "conservative_cleaning", "ml_ready"])
def test_templates(nulls, name):
    assert quick_clean(nulls, name, key=["id"]).count() >= 1


def test_strategies(nulls):
    batch = BatchCleaner()
    batch.register_cleaning_strategy("fn", lambda df: df.where("id > 13"))
    assert batch.apply_strategy(nulls, "fn").get_cleaned_data().count() == 4
    with pytest.raises(ValueError):
        batch.apply_strategy(nulls, "other")
    with pytest.raises(ValueError):
        quick_clean(nulls, "other")


def test_knn_result_does_not_search_again(spark):
    """Whoever reads the filled table reads the found values, not the search."""
    df = spark.range(60).selectExpr("id", "cast(id as double) as x", "CASE WHEN id % 6 > 0 THEN id * 2.0 END as y")
    filled = knn_impute(df, "y", ["id"], k=2)
    assert "CoGroups" not in filled._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.y for r in filled.where("id in (6, 12)").collect()} == {6: 12.0, 12: 24.0}
