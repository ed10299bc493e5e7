"""The distributed building blocks against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktidy.operators import explore
from sparktidy.plans import ordering
from sparktidy.plans import lookup as lookup_plans
from sparktidy.plans.lookup import COLUMN, VALUE, cell, lookup, lookup_columns
from sparktidy.plans.quantiles import exact_quantiles
from sparktidy.plans.sampling import hash_limit, key_bits

PROBS = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value; some are null."""
    rng = np.random.default_rng(3)
    n = 6000
    value = np.where(np.arange(n) % 3 == 0, 7.0, np.round(rng.normal(0, 50, n), 2))
    pdf = pd.DataFrame({"id": rng.permutation(n), "k": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 400, n)), "v": value,
                        "w": rng.exponential(10, n)})
    df = spark.createDataFrame(pdf).repartition(5)
    return df.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v"))), pdf.assign(v=np.where(pdf.id % 11 != 0, pdf.v, np.nan))


@pytest.mark.parametrize("direct,interval", [(10**9, 10**9), (10, 10**9), (10, 200)])
def test_quantiles(skewed, direct, interval):
    df, pdf = skewed
    found = exact_quantiles(df, ["v", "w", "k"], PROBS, direct, interval)
    for c in ("v", "w", "k"):
        assert np.allclose(found[c], np.nanquantile(pdf[c], PROBS)), c


def test_many_quantiles(skewed):
    df, pdf = skewed
    probs = [i / 199 for i in range(200)]
    assert np.allclose(exact_quantiles(df, ["v"], probs)["v"], np.nanquantile(pdf.v, probs))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(empty, ["x"], [0.5]) == {"x": [None]}
    assert exact_quantiles(empty, ["x"], [0.5], direct_limit=0) == {"x": [None]}
    assert exact_quantiles(empty, [], [0.5]) == {}


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)


@pytest.mark.parametrize("groups", [[], ["k"]])
@pytest.mark.parametrize("forward", [True, False])
def test_fill(skewed, many_ranges, groups, forward):
    df, pdf = skewed
    got = ordering.fill_along(df, ["v"], ["id"], groups, forward).toPandas().sort_values("id")
    base = pdf.sort_values("id")
    series = base.groupby("k").v if groups else base.v
    want = series.ffill() if forward else series.bfill()
    assert np.allclose(got.v.to_numpy(), want.to_numpy(), equal_nan=True)


def test_row_numbers(skewed, many_ranges):
    df, _ = skewed
    got = ordering.row_numbers(df, ["id"]).toPandas()
    assert (got.row_number == got.id + 1).all()


def test_ranks_with_ties(skewed, many_ranges):
    df, pdf = skewed
    names = ["k", "w"]
    got = explore._ranked(df.select(*[F.col(c).cast("double").alias(c) for c in names]), names).toPandas()
    want = pdf[names].rank()
    assert np.allclose(got.sort_values(names), want.sort_values(names))


def rows_per_range(df, order_by):
    return [r["count"] for r in ordering.ordered_ranges(df, order_by).groupBy(ordering.RANGE).count().collect()]


def test_ranges_cut_on_the_whole_key(spark, many_ranges):
    """A tied first column and a long common prefix do not fill one range."""
    df = spark.range(4000).select("id", F.lit(1).alias("tied"), F.format_string("a common beginning %06d", "id").alias("t"))
    for key in (["tied", "id"], ["t"]):
        assert max(rows_per_range(df, key)) < 400
    got = ordering.row_numbers(df, ["tied", "t"]).toPandas()
    assert (got.row_number == got.id + 1).all()


def test_served_rows_are_not_shuffled(spark):
    """Half of the rows hold one value the table does not know."""
    df = spark.range(4000).select(F.expr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END").alias("k"))
    table = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("n"), (F.col("id") * 3).alias("v"))
    out = lookup(df, table, "k", "n")
    assert out.where("k = -1 AND v IS NULL").count() == 2000 and out.where("v = k * 3").count() == 2000


def test_order_by_text_and_dates(spark, many_ranges):
    df = spark.range(500).select("id", F.format_string("row%05d", "id").alias("t"),
                                 F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for key in ("t", "d"):
        got = ordering.row_numbers(df, [key]).toPandas()
        assert (got.row_number == got.id + 1).all()


def test_lookup_with_hot_and_missing_keys(spark):
    df = spark.range(9000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 10 = 1 THEN NULL ELSE id END").alias("k"))
    table = df.where("k IS NOT NULL AND k % 7 <> 1").groupBy("k").agg(F.count("*").alias("n"), (F.max("k") * 2).alias("double"))
    got = lookup(df, table, "k", "n").toPandas()
    want = np.where(got.k.isna() | (got.k % 7 == 1), np.nan, got.k * 2)
    assert len(got) == 9000
    assert np.allclose(got["double"].to_numpy("float64"), want, equal_nan=True)


def test_hash_limit_keeps_enough(spark):
    near = spark.range(100_000).where(key_bits([F.col("id")]) <= F.lit(hash_limit(100_000, 1000))).count()
    assert 1000 <= near < 2000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_plan_has_no_whole_table_task(skewed):
    df, _ = skewed
    plan = _plan(ordering.fill_along(df, ["v"], ["id"], ["k"]))
    assert "SinglePartition" not in plan
    assert "hashpartitioning(__group" in plan


def test_scan_is_pruned_and_filtered(spark):
    from sparktidy.operators.profile import numeric_summary

    path = "/root/testdata/sf0.001/lineitem.parquet"
    df = spark.read.parquet(path).where("l_quantity > 10")
    plan = _plan(numeric_summary(df, ["l_tax"]))
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan
    assert plan.count("FileScan") == 1


def test_keep_first_limits_before_the_shuffle(spark):
    from sparktidy.operators.dedup import remove_duplicates

    plan = _plan(remove_duplicates(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["user_id"], "first", ["event_id"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") + df._jdf.queryExecution(
        ).optimizedPlan().toString().count("LogicalRDD [")


def test_spearman_plan_is_linear_in_columns(spark):
    wide = spark.range(300).select(*[(F.col("id") * (7 * i + 3) % (50 + 40 * i)).cast("double").alias(f"x{i}") for i in range(20)])
    found = {}
    for n in (4, 8, 20):
        names = [f"x{i}" for i in range(n)]
        pairs = explore.correlation_pairs(wide, names, "spearman")
        found[n] = scans(pairs)
        frame = wide.select(*names).toPandas().corr("spearman")
        for r in pairs.collect():
            assert abs(r.correlation - frame.loc[r.column1, r.column2]) < 1e-9
    assert found[8] - found[4] <= 2 * 4 and found[20] <= found[8]  # wide ones go through one vector aggregate


def test_lookup_of_several_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else int(v) if v < 0.7 * 4000 else -1, f"k{int(v) % 2500}", float(i % 7) if i % 7 else -0.0)
            for i, v in enumerate(rng.integers(0, 4000, 6000))]
    df = spark.createDataFrame(rows, "id long, a long, b string, c double").repartition(5)
    maps = [{v: j * 1.0 for j, v in enumerate(sorted({r[k] for r in rows if r[k] is not None})) if j % 3} for k in (1, 2, 3)]
    table = spark.createDataFrame([(i, str(0.0 + v if i == 2 else v), p) for i, m in enumerate(maps) for v, p in m.items()],
                                  "__i int, __v string, code double")
    got = lookup_columns(df, [cell(df, c) for c in "abc"], table, "code", ["x", "y", "z"])
    assert got.columns == ["id", "a", "b", "c", "x", "y", "z"]
    want = {i: (maps[0].get(a), maps[1].get(b), maps[2].get(c)) for i, a, b, c in rows}
    assert {r.id: (r.x, r.y, r.z) for r in got.collect()} == want
    assert got.count() == len(rows) and scans(got) <= 12
    assert lookup_columns(df.limit(0), [cell(df, "a")], table, "code", ["x"]).count() == 0


def test_lookup_tasks_follow_the_cells(spark, monkeypatch):
    """Cells that meet the map are dealt over more tasks as they grow, numbers only once."""
    monkeypatch.setattr(lookup_plans, "TASK_CELLS", 50)
    monkeypatch.setattr(lookup_plans, "HOT_CELLS", 5)
    df = spark.range(2000).select("id", F.col("id").alias("a"), (F.col("id") % 700).cast("double").alias("b"))
    table = df.select(F.lit(0).alias(COLUMN), F.col("a").cast("string").alias(VALUE), (F.col("a") * 3).alias("code"))
    got = lookup_columns(df, [cell(df, "a")], table, "code", ["x"]).withColumn("task", F.spark_partition_id())
    assert [r.x for r in got.orderBy("id").collect()] == [3 * i for i in range(2000)]
    assert got.select("task").distinct().count() > 30
    ranked = explore._ranked(df.select("a", "b"), ["a", "b"])
    assert "hashpartitioning" in (plan := ranked._jdf.queryExecution().executedPlan().toString())
    assert "ENSURE_REQUIREMENTS" not in plan
    assert sorted(r.a for r in ranked.collect()) == [float(i) for i in range(1, 2001)]
    assert sorted({r.b for r in ranked.collect()}) == [3 * i + 2.0 for i in range(600)] + [1800 + 2 * i + 1.5 for i in range(100)]
