"""Fluent feature transformation, and fitted step chains that can be stored."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any, Callable

from pyspark.sql import DataFrame

from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.operators.encode import EncodeModel, fit_encoder
from sparktidy.operators.features import BinModel, MathModel, ProductModel, fit_bins, fit_products
from sparktidy.operators.scale import ScaleModel, fit_scaler
from sparktidy.operators.select import SelectModel, fit_selection

MODELS = {m.kind: m for m in (EncodeModel, ScaleModel, MathModel, ProductModel, BinModel, SelectModel)}


def _fit_math(df: DataFrame, transforms: dict[str, str], create_new_columns: bool = True) -> MathModel:
    return MathModel(dict(transforms), create_new_columns)


def _fit_select(df: DataFrame, target_column: str, method: str = "mutual_info", k: int = 10, **options) -> SelectModel:
    return fit_selection(df, target_column, method, k, **options)


FITTERS: dict[str, Callable[..., Any]] = {
    "encode": fit_encoder,
    "scale": fit_scaler,
    "math_transform": _fit_math,
    "polynomial": fit_products,
    "binning": fit_bins,
    "select": _fit_select,
}


class FittedSteps:
    """A fitted chain: a plain plan rewrite for batch and streaming tables."""

    def __init__(self, steps: list[tuple[str, Any]]):
        self.steps = steps

    def transform(self, df: DataFrame) -> DataFrame:
        for _, model in self.steps:
            df = model.transform(df)
        return df

    def to_dict(self, folder: str | None = None) -> dict[str, Any]:
        """Parameters of all steps; large maps are written below ``folder``."""
        return {"steps": [{"name": name, **(model.to_dict(f"{folder}/{i}") if folder and getattr(model, "tables", None)
                                            else model.to_dict())} for i, (name, model) in enumerate(self.steps)]}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "FittedSteps":
        steps = []
        for s in d["steps"]:
            body = {k: v for k, v in s.items() if k != "name"}
            steps.append((s["name"], MODELS[s["kind"]].from_dict(body)))
        return cls(steps)

    def save(self, path: str | Path, tables: str | None = None) -> None:
        """One JSON file; maps too large for it go to the folder ``tables``, by
        default one beside the file."""
        folder = tables or f"{path}.tables"
        Path(path).write_text(json.dumps(self.to_dict(folder)), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> "FittedSteps":
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


class TransformationPipeline:
    """Named steps, fitted in order. Unknown operations warn and are skipped."""

    def __init__(self):
        self.steps: list[tuple[str, str, dict[str, Any]]] = []
        self.fitted: FittedSteps | None = None

    def add_step(self, step_name: str, operation: str | Callable[[DataFrame], DataFrame], **options):
        self.steps.append((step_name, operation, options))
        return self

    def fit(self, df: DataFrame) -> FittedSteps:
        done = []
        for name, operation, options in self.steps:
            if callable(operation):
                model = _Function(operation)
            elif operation in FITTERS:
                model = FITTERS[operation](df, **options)
            else:
                warnings.warn(f"step {name!r}: unknown operation {operation!r} skipped", stacklevel=2)
                continue
            df = model.transform(df)
            done.append((name, model))
        self.fitted = FittedSteps(done)
        return self.fitted

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_pipeline_summary(self) -> dict[str, Any]:
        return {"total_steps": len(self.steps), "fitted": self.fitted is not None,
                "steps": [{"name": n, "operation": o, "parameters": p} for n, o, p in self.steps]}


class _Function:
    """A user function as a step; it has nothing to store."""

    def __init__(self, function):
        self.transform = function

    def to_dict(self):
        raise UnsupportedOperationError("a step made of a function cannot be stored")


class DataTransformer:
    """Chain transformations on a lazy table; every fit stays available."""

    def __init__(self, df: DataFrame):
        if df is None:
            raise DataValidationError("no table to transform")
        self.original_df = self.df = df
        self.fitted_transformers: dict[str, Any] = {}
        self.transformation_log: list[dict[str, Any]] = []

    def _run(self, operation: str, options: dict[str, Any]) -> "DataTransformer":
        model = FITTERS[operation](self.df, **options)
        self.df = model.transform(self.df)
        self.fitted_transformers[f"{operation}_{len(self.fitted_transformers)}"] = model
        self.transformation_log.append({"operation": operation, "details": options})
        return self

    def encode_categorical_features(self, method: str = "label", **options) -> "DataTransformer":
        return self._run("encode", {"method": method, **options})

    def scale_features(self, method: str = "standard", **options) -> "DataTransformer":
        return self._run("scale", {"method": method, **options})

    def create_polynomial_features(self, columns: list[str] | None = None, **options) -> "DataTransformer":
        return self._run("polynomial", {"columns": columns, **options})

    def apply_mathematical_transforms(self, transforms: dict[str, str],
                                      create_new_columns: bool = True) -> "DataTransformer":
        return self._run("math_transform", {"transforms": transforms, "create_new_columns": create_new_columns})

    def create_binned_features(self, columns: list[str] | None = None, **options) -> "DataTransformer":
        return self._run("binning", {"columns": columns, **options})

    def select_features(self, target_column: str, **options) -> "DataTransformer":
        return self._run("select", {"target_column": target_column, **options})

    def get_transformation_summary(self) -> dict[str, Any]:
        return {"original_columns": len(self.original_df.columns), "current_columns": len(self.df.columns),
                "transformations_applied": len(self.transformation_log),
                "transformation_log": list(self.transformation_log),
                "fitted_transformers": list(self.fitted_transformers)}

    def get_transformed_data(self) -> DataFrame:
        return self.df


def transform_data(df: DataFrame) -> DataTransformer:
    return DataTransformer(df)


def create_pipeline(df: DataFrame | None = None) -> TransformationPipeline | DataTransformer:
    """An empty chain of steps, or a fluent transformer when a table is given."""
    return TransformationPipeline() if df is None else DataTransformer(df)


def quick_transform(df: DataFrame, encode_categorical: bool = True, scale_features: bool = True,
                    encoding_method: str = "label", scaling_method: str = "standard") -> DataFrame:
    """Encode text columns, then scale every numeric column, codes included."""
    out = DataTransformer(df)
    if encode_categorical and kinds.categorical_columns(df):
        out.encode_categorical_features(method=encoding_method)
    if scale_features:
        out.scale_features(method=scaling_method)
    return out.get_transformed_data()
