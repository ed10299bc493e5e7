import itertools
import math

import numpy as np
import pytest

from sparktidy import DataTransformer, FittedSteps, create_pipeline, quick_transform, transform_data
from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.operators import encode, features, scale, select
from sparktidy.operators.mutual import neighbour_information
from sparktidy.plans import clusters


@pytest.fixture(scope="module")
def numbers(spark):
    """``a`` runs over 2, 6, .. 18, ``b`` orders the rows, ``c`` is constant."""
    return spark.createDataFrame([(2.0 + 4 * i, 0.5 + i, -1.0) for i in range(5)], "a double, b double, c double")


@pytest.fixture(scope="module")
def colors(spark):
    return spark.createDataFrame([("teal", "wide", 1.0), ("amber", "slim", 2.0), ("teal", "slim", 3.0), (None, "tall", 4.0),
                                  ("plum", "wide", 6.0), ("teal", "tall", 8.0)], "color string, size string, weight double")


def column(df, c, order="weight"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_label(colors):
    out = encode.encode(colors, "label")
    assert column(out, "color") == [2, 0, 2, None, 1, 2] and column(out, "size") == [2, 0, 0, 1, 2, 1]
    assert "color_encoded" in encode.encode(colors, "label", drop_original=False).columns


def test_onehot(colors):
    out = encode.encode(colors, "onehot", columns=["color"])
    assert out.columns == ["size", "weight", "color_amber", "color_plum", "color_teal"]
    assert column(out, "color_teal") == [1, 0, 1, None, 0, 1]


def test_unknown_categories(spark, colors):
    new = spark.createDataFrame([("pink", "slim", 1.0)], colors.schema)
    assert column(encode.fit_encoder(colors, "label").transform(new), "color") == [None]
    strict = encode.fit_encoder(colors, "label", handle_unknown="error")
    assert column(strict.transform(colors), "color") == [2, 0, 2, None, 1, 2]
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(new).collect()


def test_eligibility(spark):
    df = spark.range(400).selectExpr("concat('v', id) as many", "concat('w', id % 40) as some", "'x' as one")
    assert [r.column for r in encode.encode_eligibility(df, method="label").where("eligible").collect()] == ["some"]
    assert encode.encode_eligibility(df, method="onehot").where("eligible").count() == 0
    assert encode.encode(df, "onehot").columns == ["many", "some", "one"]


def test_target_and_ordinal(colors):
    out = encode.encode(colors, "target", columns=["size"], target="weight")
    assert column(out, "size", "weight") == [3.5, 2.5, 2.5, 6.0, 3.5, 6.0]
    smooth = encode.encode(colors, "target", columns=["color"], target="weight", smoothing=1.0)
    assert math.isclose(column(smooth, "color")[0], (12 + 4) / 4)
    assert column(encode.encode(colors, "ordinal", columns=["size"], order={"size": ["slim", "wide", "tall"]}), "size") == [1, 0, 0, 2, 1, 2]
    with pytest.raises(DataValidationError):
        encode.fit_encoder(colors, "target")
    with pytest.raises(UnsupportedOperationError):
        encode.fit_encoder(colors, "hash")


def test_large_maps(spark, monkeypatch):
    monkeypatch.setattr(encode, "INLINE_LIMIT", 5)
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 40) END as k", "cast(id as double) as y")
    pdf = df.toPandas()
    means = pdf.dropna(subset=["k"]).groupby("k").y.mean()
    got = encode.fit_encoder(df, "target", columns=["k"], target="y").transform(df).toPandas().sort_values("id")
    assert np.allclose(got.k.to_numpy("float64"), pdf.k.map(means).to_numpy("float64"), equal_nan=True)
    codes = encode.encode(df, "ordinal", columns=["k"]).toPandas().sort_values("id", ignore_index=True).k
    order = {v: i for i, v in enumerate(sorted(pdf.k.dropna().unique()))}
    assert codes.isna().sum() == pdf.k.isna().sum() and (codes.dropna() == pdf.k.dropna().map(order)).all()


@pytest.mark.parametrize("method,want", [
    ("standard", [(i - 2) / math.sqrt(2) for i in range(5)]), ("minmax", [0, .25, .5, .75, 1]),
    ("robust", [-1, -.5, 0, .5, 1]), ("maxabs", [1 / 9, 3 / 9, 5 / 9, 7 / 9, 1]), ("quantile_uniform", [0, .25, .5, .75, 1]),
])
def test_scaling(numbers, method, want):
    assert np.allclose(column(scale.scale(numbers, method, columns=["a"]), "a", "b"), want)


def test_scaling_details(spark, numbers):
    assert column(scale.scale(numbers, "standard"), "c", "b") == [0.0] * 5  # no spread: divide by one
    assert np.allclose(column(scale.scale(numbers, "minmax", columns=["a"], feature_range=(-1, 1)), "a", "b"), [-1, -.5, 0, .5, 1])
    normal = column(scale.scale(numbers, "quantile_normal", columns=["a"]), "a", "b")
    assert normal == sorted(normal) and abs(normal[2]) < 1e-12 and math.isclose(normal[0], -5.199337582192817, rel_tol=1e-6)
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    for method in scale.METHODS:
        assert sum(r.v is None for r in scale.scale(holes, method).collect()) == 1
    with pytest.raises(UnsupportedOperationError):
        scale.scale(numbers, "zip")


def test_quantile_rank_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 3 + [2.0] * 4 + [3.0] * 3], "v double")
    got = sorted({round(r.v, 6) for r in scale.scale(df, "quantile_uniform").collect()})
    assert got == [0.0, 0.5, 1.0]


def test_products(numbers):
    out = features.polynomial_features(numbers, ["a", "b"], include_bias=True)
    assert out.columns == ["a", "b", "c", "1", "a^2", "a b", "b^2"]
    assert column(out, "a b", "a")[1] == 9.0
    assert features.polynomial_features(numbers, ["a", "b", "c"], interaction_only=True, degree=3).columns[3:] == ["a b", "a c", "b c", "a b c"]
    assert features.polynomial_features(numbers, ["a"]).columns == numbers.columns


def test_math(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.0,), (None,), (800.0,)], "v double")
    got = {name: [r[f"v_{name}"] for r in features.math_transforms(df, {"v": name}).collect()] for name in features.MATH_TRANSFORMS}
    assert got["log"][:2] == [None, None] and got["sqrt"][0] is None and got["sqrt"][2] == 2.0
    assert got["log1p"][0] is None and got["reciprocal"][1] is None and got["exp"][4] is None and got["cube"][2] == 64.0
    assert all(v[3] is None for v in got.values())
    assert features.math_transforms(df, {"v": "nothing", "w": "log"}).columns == ["v"]


def test_bins(spark, numbers):
    assert column(features.binned_features(numbers, ["a"], n_bins=2, strategy="uniform"), "a_binned", "b") == [0, 0, 0, 1, 1]
    assert column(features.binned_features(numbers, ["a"], n_bins=2, labels=["lo", "hi"]), "a_binned", "b") == ["lo", "lo", "lo", "hi", "hi"]
    assert column(features.binned_features(numbers, ["c"], n_bins=4), "c_binned", "b") == [0] * 5
    groups = spark.createDataFrame([(v,) for v in (1.0, 1.1, 0.9, 10.0, 10.2, 9.9, 50.0, 50.5)], "v double")
    assert [r.v_binned for r in features.binned_features(groups, strategy="kmeans", n_bins=3).orderBy("v").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    with pytest.raises(UnsupportedOperationError):
        features.fit_bins(numbers, strategy="odd")


def _spread(values, centres):
    return float((np.min(np.abs(values[:, None] - np.array(centres)), axis=1) ** 2).sum())


def test_clusters(spark):
    rng = np.random.default_rng(5)
    small = np.round(rng.normal(0, 1, 9), 1).tolist() + [4.0, 4.0, 9.5]
    frame = spark.createDataFrame([(v,) for v in [*small, None, float("nan"), float("inf")]], "v double")
    values = np.array(small)
    for k in (1, 2, 3, 4):
        distinct = sorted(set(small))
        splits = [[distinct[a:b] for a, b in zip((0, *cut), (*cut, len(distinct)))]
                  for cut in itertools.combinations(range(1, len(distinct)), k - 1)]
        least = min(sum(((values[np.isin(values, part)] - values[np.isin(values, part)].mean()) ** 2).sum() for part in split)
                    for split in splits)
        assert _spread(values, clusters.cluster_means(frame, k)) == pytest.approx(least), k
    assert clusters.cluster_means(frame.where("v = 4"), 3) == [4.0]
    assert clusters.cluster_means(frame.where("v IS NULL"), 3) == []
    # cells instead of single values, one far value and a third of the rows alike
    many = np.concatenate([rng.lognormal(0, 2, 3000), np.full(1500, 1.25), [1e7]])
    table = spark.createDataFrame([(float(v),) for v in many], "v double")
    exact, celled = clusters.cluster_means(table, 5), clusters.cluster_means(table, 5, most_values=64)
    assert celled == pytest.approx(exact) and len(exact) == 5


def test_selection(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(float(k * 5 + n), float(u), f"c{k}", "x") for k, n, u in zip(t, rng.normal(0, 1, 500), rng.normal(0, 1, 500))],
                               "good double, noise double, target string, note string")
    for method in select.METHODS:
        assert select.select_features(df, "target", method, k=1).columns == ["good", "target", "note"], method
    assert select.select_features(df, "target", "f_classif", k=99).columns == ["good", "noise", "target", "note"]
    with pytest.raises(DataValidationError):
        select.select_features(df, "gone")


def _psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def _pairwise_information(x, y, k):
    """The estimate from all pairs of rows."""
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    far, total = np.maximum(dx, dy), 0.0
    for i in range(len(x)):
        r = np.sort(np.delete(far[i], i))[k - 1]
        near = r * (1 - 1e-10)
        a, b = ((dx[i] < near).sum(), (dy[i] < near).sum()) if r > 0 else ((dx[i] == 0).sum(), (dy[i] == 0).sum())
        total += _psi(k if r > 0 else (far[i] == 0).sum() - 1) - _psi(a) - _psi(b)
    return max(0.0, _psi(len(x)) + total / len(x))


def test_neighbour_information(spark):
    rng = np.random.default_rng(11)
    y = rng.normal(0, 3, 400)
    shapes = {"line": y * 2 + rng.normal(0, 0.5, 400), "none": rng.exponential(1, 400), "same": np.full(400, 7.0),
              "steps": np.where(rng.random(400) < 0.4, 1.0, np.round(y)), "far": np.where(np.arange(400) == 3, 1e6, y)}
    y = np.where(np.arange(400) % 3 == 0, np.round(y), y)
    for name in ("line", "steps"):  # whole rows that repeat
        shapes[name][:40] = shapes[name][40]
    y[:40] = y[40]
    frame = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(y, *shapes.values())]
                                  + [(None, *[1.0] * 5), (float("nan"), *[1.0] * 5)], "y double, " + ", ".join(f"{n} double" for n in shapes))
    for cell_points in (25, 10_000):
        got = {r["feature"]: r["score"] for r in neighbour_information(frame, "y", list(shapes), cell_points=cell_points).collect()}
        for name, x in shapes.items():
            assert got[name] == pytest.approx(_pairwise_information(x, y, 3), abs=1e-9), (name, cell_points)
    assert got["line"] > 1 > got["none"]
    few = frame.limit(0).select("y", "line")
    assert [tuple(r) for r in neighbour_information(few, "y", ["line"]).collect()] == [("line", None)]
    two = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "y double, line double")
    assert neighbour_information(two, "y", ["line"]).first()["score"] >= 0
    with pytest.raises(UnsupportedOperationError):
        select.feature_scores(frame, "y", "mutual_info", estimator="guess")


def test_steps(colors, tmp_path):
    steps = (create_pipeline().add_step("e", "encode", method="label").add_step("s", "scale", columns=["weight"])
             .add_step("m", "math_transform", transforms={"weight": "square"}).add_step("p", "polynomial", columns=["weight", "size"])
             .add_step("b", "binning", columns=["weight"], n_bins=2).add_step("k", "select", target_column="color", k=3, method="f_classif"))
    with pytest.warns(UserWarning):
        steps.add_step("u", "unheard_of").fit(colors)
    out = steps.fitted.transform(colors)
    assert steps.get_pipeline_summary()["fitted"] and out.count() == 6
    steps.fitted.save(tmp_path / "steps.json")
    again = FittedSteps.load(tmp_path / "steps.json").transform(colors)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_fluent(colors):
    t = transform_data(colors).encode_categorical_features().scale_features(columns=["weight"]).create_binned_features(["weight"], n_bins=2)
    summary = t.get_transformation_summary()
    assert summary["transformations_applied"] == 3 and summary["current_columns"] == 4
    assert isinstance(create_pipeline(colors), DataTransformer)
    assert quick_transform(colors).columns == colors.columns
    assert quick_transform(colors, encode_categorical=False, scaling_method="minmax").where("weight = 1.0").count() == 1


def test_single_values_are_told_without_counting(spark, monkeypatch):
    """Methods without a limit of values judge columns as ``encode_eligibility`` does, without its shuffle."""
    df = spark.createDataFrame([(1.0, "x", None, 0.0, "a", None), (2.0, "x", None, -0.0, None, math.nan), (3.0, "x", None, 0.0, "a", math.nan)],
                               "y double, same string, none string, zero double, gap string, odd double")
    columns = ["same", "none", "zero", "gap", "odd"]
    for data in (df, df.limit(0), df.where("y = 1")):
        want = {r["column"]: r["reason"] for r in encode.encode_eligibility(data, columns, "target").collect()}
        assert encode._single_values(data, columns) == want
    monkeypatch.setattr(encode, "encode_eligibility", lambda *_: pytest.fail("counts every value"))
    assert set(encode.fit_encoder(df, "target", columns=columns, target="y").skipped) == {"same", "none", "zero"}
