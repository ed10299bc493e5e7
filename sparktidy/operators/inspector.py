"""Object-style access to the profiling and exploration tables. Methods return
small result tables; ``get_*`` collect a bounded number of report rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from sparktidy.errors import DataValidationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import format_bytes
from sparktidy.operators import explore, normality, outliers, profile


class DataInspector:
    def __init__(self, df: DataFrame):
        if df is None:
            raise DataValidationError("no table to inspect")
        self.df = df

    def get_basic_info(self) -> dict[str, Any]:
        facts = profile.basic_info(self.df).first().asDict()
        return {**facts, "column_types": {c: kinds.dtype_name(self.df, c) for c in self.df.columns}}

    def get_column_profiles(self, approx: bool = False) -> dict[str, dict[str, Any]]:
        out = {r["column"]: r.asDict() for r in profile.column_profiles(self.df, approx=approx).collect()}
        numeric = kinds.numeric_columns(self.df)
        if numeric:
            for r in profile.numeric_summary(self.df, numeric).collect():
                out[r["column"]].update({k: v for k, v in r.asDict().items() if k != "column"})
        if kinds.categorical_columns(self.df):
            for r in profile.top_values(self.df).orderBy("column", "rank").collect():
                out[r["column"]].setdefault("top_values", {})[r["value"]] = r["count"]
        return out

    def statistical_summary(self) -> DataFrame:
        return profile.numeric_summary(self.df)

    def data_quality(self) -> DataFrame:
        return profile.quality_summary(self.df)

    def get_memory_usage(self) -> dict[str, Any]:
        sizes = {r["column"]: r["bytes"] for r in profile.column_bytes(self.df).collect()}
        total = sum(sizes.values())
        largest = sorted(sizes.items(), key=lambda kv: -kv[1])[:5]
        return {"total_bytes": total, "total_human": format_bytes(total), "column_bytes": sizes,
                "largest_columns": largest}

    def detect_potential_issues(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in profile.detect_issues(self.df).collect()]

    def report(self, order_by: list[str], **options) -> dict[str, DataFrame]:
        return profile.profile_report(self.df, order_by, **options)


class DataExplorer:
    def __init__(self, df: DataFrame):
        if df is None:
            raise DataValidationError("no table to explore")
        self.df = df

    def analyze_correlations(self, method: str = "pearson", min_correlation: float = 0.1) -> DataFrame:
        return explore.correlations(self.df, None, method, min_correlation)

    def correlation_matrix(self, method: str = "pearson") -> DataFrame:
        return explore.correlation_matrix(self.df, None, method)

    def analyze_distributions(self, columns: list[str] | None = None) -> DataFrame:
        return explore.distributions(self.df, columns)

    def detect_outliers(self, method: str = "iqr", columns: list[str] | None = None) -> DataFrame:
        return outliers.outlier_report(self.df, columns, method)

    def outlier_rows(self, key: list[str], method: str = "iqr", columns: list[str] | None = None) -> DataFrame:
        return outliers.outlier_rows(self.df, key, columns, method)

    def analyze_categorical_variables(self, max_categories: int | None = None) -> DataFrame:
        return explore.categorical_analysis(self.df, None, max_categories)

    def test_normality(self, columns: list[str] | None = None, alpha: float = 0.05,
                       method: str = "shapiro") -> DataFrame:
        test = normality.jarque_bera if method == "jarque_bera" else normality.shapiro_test
        return test(self.df, columns, alpha)

    def histogram(self, column: str, bins: int = 20) -> DataFrame:
        return explore.histogram(self.df, column, bins)

    def scatter(self, x: str, y: str, key: list[str], sample_size: int = 1000) -> DataFrame:
        return explore.scatter_sample(self.df, x, y, key, sample_size)


def inspect_data(df: DataFrame) -> DataInspector:
    return DataInspector(df)


def explore_data(df: DataFrame) -> DataExplorer:
    return DataExplorer(df)
