"""Fluent cleaning with history and undo, and named cleaning strategies."""

from __future__ import annotations

import time
from typing import Any, Callable

from pyspark.sql import DataFrame

from sparktidy.errors import DataValidationError
from sparktidy.operators.dedup import remove_duplicates
from sparktidy.operators.diff import diff_numeric, diff_shape
from sparktidy.operators.impute import impute
from sparktidy.operators.outliers import treat_outliers
from sparktidy.operators.repair import auto_convert, clean_text, constraint_violations, convert_types


class DataCleaner:
    """Chain cleaning steps on a lazy table. A step keeps its parent plan, so
    undo costs nothing; row counts are computed only when asked for.

    ``order_by`` stands for the row order that fills and keep-first need, and
    ``key`` identifies rows for draws and nearest neighbours.
    """

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, key: list[str] | None = None):
        if df is None:
            raise DataValidationError("no table to clean")
        self.original_df = self.df = df
        self.order_by, self.key = list(order_by or []), list(key or order_by or [])
        self._steps: list[tuple[dict[str, Any], DataFrame]] = []

    def _step(self, operation: str, details: dict[str, Any], df: DataFrame) -> "DataCleaner":
        entry = {"operation": operation, "details": details, "timestamp": time.time()}
        self._steps.append((entry, self.df))
        self.df = df
        return self

    def handle_missing_values(self, strategy: str = "median", columns: list[str] | None = None,
                              custom_value: Any = None, drop_threshold: float | None = None,
                              **options) -> "DataCleaner":
        options = {"order_by": self.order_by, "key": self.key, **options}
        df = impute(self.df, strategy, columns, custom_value, drop_threshold, **options)
        return self._step("missing_values", {"strategy": strategy, "columns": columns}, df)

    def remove_duplicates(self, columns: list[str] | None = None, keep: str = "first") -> "DataCleaner":
        df = remove_duplicates(self.df, columns, keep, self.order_by)
        return self._step("duplicates", {"columns": columns, "keep": keep}, df)

    def handle_outliers(self, method: str = "iqr", action: str = "remove", columns: list[str] | None = None,
                        factor: float = 1.5, **options) -> "DataCleaner":
        shuffled = any(e["operation"] == "duplicates" or e["details"].get("strategy") in ("ffill", "bfill", "knn")
                       for e in self.get_history())
        df = treat_outliers(self.df, method, action, columns, factor, **{"stage": shuffled, **options})
        return self._step("outliers", {"method": method, "action": action, "columns": columns}, df)

    def validate_data_types(self, type_map: dict[str, str] | None = None,
                            auto_convert_types: bool = True) -> "DataCleaner":
        df, report = convert_types(self.df, type_map) if type_map else (self.df, [])
        if auto_convert_types:
            df, more = auto_convert(df, skip=list(type_map or {}))
            report = report + more
        return self._step("data_types", {"report": report}, df)

    def clean_text_data(self, columns: list[str] | None = None,
                        operations: list[str] | None = None) -> "DataCleaner":
        return self._step("text", {"columns": columns, "operations": operations},
                          clean_text(self.df, columns, operations))

    def apply(self, name: str, step: Callable[[DataFrame], DataFrame]) -> "DataCleaner":
        """Any function from table to table as a step."""
        return self._step(name, {}, step(self.df))

    def validate_constraints(self, constraints: dict[str, dict[str, Any]], key: list[str] | None = None) -> DataFrame:
        return constraint_violations(self.df, constraints, key or self.key)

    def undo(self) -> bool:
        if not self._steps:
            return False
        _, self.df = self._steps.pop()
        return True

    def undo_all(self) -> None:
        self._steps.clear()
        self.df = self.original_df

    def get_history(self) -> list[dict[str, Any]]:
        return [entry for entry, _ in self._steps]

    def get_cleaning_summary(self) -> dict[str, Any]:
        """Shapes before and after; this runs two counts."""
        before, after = self.original_df.count(), self.df.count()
        return {"original_shape": (before, len(self.original_df.columns)),
                "current_shape": (after, len(self.df.columns)), "rows_removed": before - after,
                "operations_performed": len(self._steps), "cleaning_log": self.get_history()}

    def compare(self) -> tuple[DataFrame, DataFrame]:
        """Shape and numeric differences between the original and the result."""
        return diff_shape(self.original_df, self.df), diff_numeric(self.original_df, self.df)

    def get_cleaned_data(self) -> DataFrame:
        return self.df


# Settings of the ready-made strategies.
TEMPLATES: dict[str, dict[str, Any]] = {
    "basic_cleaning": {
        "missing_values": {"strategy": "median", "drop_threshold": 90.0},
        "duplicates": {"keep": "first"},
        "data_types": {"auto_convert": True},
        "text_cleaning": {"operations": ["strip", "normalize_whitespace"]},
    },
    "aggressive_cleaning": {
        "missing_values": {"strategy": "mean", "drop_threshold": 50.0},
        "duplicates": {"keep": "first"},
        "outliers": {"method": "iqr", "action": "remove", "factor": 1.5},
        "data_types": {"auto_convert": True},
    },
    "conservative_cleaning": {
        "missing_values": {"strategy": "mode", "drop_threshold": 95.0},
        "duplicates": {"keep": "first"},
        "outliers": {"method": "iqr", "action": "cap", "factor": 2.0},
        "text_cleaning": {"operations": ["strip"]},
    },
    "ml_ready": {
        "missing_values": {"strategy": "knn", "drop_threshold": 75.0},
        "duplicates": {"keep": "first"},
        "outliers": {"method": "modified_zscore", "action": "cap", "factor": 1.5},
        "data_types": {"auto_convert": True},
        "text_cleaning": {"operations": ["strip", "lower", "normalize_whitespace"]},
    },
}


class BatchCleaner:
    """Named strategies applied to any number of tables, always in the order
    missing values, duplicates, outliers, types, text."""

    def __init__(self):
        self.strategies: dict[str, dict[str, Any] | Callable[[DataFrame], DataFrame]] = {}

    def register_cleaning_strategy(self, name: str, strategy) -> None:
        """A dict of step settings, or a function from table to table."""
        self.strategies[name] = strategy

    def get_strategy_templates(self) -> dict[str, dict[str, Any]]:
        return TEMPLATES

    def apply_strategy(self, df: DataFrame, name: str, order_by: list[str] | None = None,
                       key: list[str] | None = None) -> DataCleaner:
        if name not in self.strategies:
            raise ValueError(f"strategy {name!r} not found")
        strategy = self.strategies[name]
        cleaner = DataCleaner(df, order_by, key)
        if callable(strategy):
            return cleaner.apply(name, strategy)
        steps = [
            ("missing_values", cleaner.handle_missing_values),
            ("duplicates", cleaner.remove_duplicates),
            ("outliers", cleaner.handle_outliers),
            ("data_types", lambda type_map=None, auto_convert=True: cleaner.validate_data_types(type_map, auto_convert)),
            ("text_cleaning", cleaner.clean_text_data),
        ]
        for part, run in steps:
            if part in strategy:
                run(**strategy[part])
        return cleaner


def clean_data(df: DataFrame, **options) -> DataCleaner:
    return DataCleaner(df, **options)


def quick_clean(df: DataFrame, strategy: str = "basic_cleaning", order_by: list[str] | None = None,
                key: list[str] | None = None) -> DataFrame:
    """Clean a table with a ready-made strategy."""
    batch = BatchCleaner()
    batch.strategies.update(TEMPLATES)
    return batch.apply_strategy(df, strategy, order_by, key).get_cleaned_data()
