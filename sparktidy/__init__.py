"""Data preparation on Spark: load, profile, explore, clean, transform,
validate, compare and query tables."""

from sparktidy.config import Config, get_config, reset_config, update_config
from sparktidy.operators.cleaner import BatchCleaner, DataCleaner, clean_data, quick_clean
from sparktidy.operators.diff import diff_numeric, diff_shape
from sparktidy.operators.inspector import DataExplorer, DataInspector, explore_data, inspect_data
from sparktidy.operators.query import asof_join, range_join, sql, to_records
from sparktidy.operators.transformer import (
    DataTransformer,
    FittedSteps,
    TransformationPipeline,
    create_pipeline,
    quick_transform,
    transform_data,
)
from sparktidy.operators.validate import (
    ColumnSchema,
    DataSchema,
    DataValidator,
    ValidationResult,
    infer_schema,
    validate_data,
)
from sparktidy.sources.files import DataSaver, FastDataLoader, convert_format, load_data, peek, save_data, scan_lazy

__all__ = [
    "BatchCleaner", "ColumnSchema", "Config", "DataCleaner", "DataExplorer", "DataInspector", "DataSaver",
    "DataSchema", "DataTransformer", "DataValidator", "FastDataLoader", "FittedSteps", "TransformationPipeline",
    "ValidationResult", "asof_join", "clean_data", "convert_format", "create_pipeline", "diff_numeric", "diff_shape",
    "explore_data", "get_config", "infer_schema", "inspect_data", "load_data", "peek", "quick_clean",
    "quick_transform", "range_join", "reset_config", "save_data", "scan_lazy", "sql", "to_records", "transform_data",
    "update_config", "validate_data",
]
