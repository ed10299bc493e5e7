"""Typed errors raised by the library."""

from __future__ import annotations


class TidyError(Exception):
    """Base class of every error the library raises on purpose."""


class DataLoadError(TidyError):
    """A table could not be read."""


class DataValidationError(TidyError):
    """The input table does not fit the requested operation."""


class PreprocessingError(TidyError):
    """A cleaning or transformation step could not be carried out."""


class ExportError(TidyError):
    """A table could not be written."""


class UnsupportedOperationError(TidyError):
    """The requested format, method or option does not exist."""
