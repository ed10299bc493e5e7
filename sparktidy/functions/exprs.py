"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that read as true and false.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]

# Lower limits of the correlation strength labels.
CORRELATION_LABELS = [(0.9, "Very Strong"), (0.7, "Strong"), (0.5, "Moderate"), (0.3, "Weak")]
CORRELATION_FLOOR_LABEL = "Very Weak"

# Lower limits of the skewness labels.
SKEW_LABELS = [(1.0, "highly skewed"), (0.5, "moderately skewed")]
SKEW_FLOOR_LABEL = "approximately symmetric"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def double_array(values: list[float]) -> Column:
    """A literal array; one expression however long the list."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def finite(c: Column) -> Column:
    """Infinite and NaN results become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def _label(c: Column, limits, floor: str, strict: bool) -> Column:
    out = None
    for limit, text in limits:
        hit = c > limit if strict else c >= limit
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.when(finite(c).isNotNull(), out.otherwise(floor))


def correlation_label(r: Column) -> Column:
    return _label(F.abs(r), CORRELATION_LABELS, CORRELATION_FLOOR_LABEL, strict=False)


def skew_label(skew: Column) -> Column:
    return _label(F.abs(skew), SKEW_LABELS, SKEW_FLOOR_LABEL, strict=True)


def parse_bool(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def _space(unicode: bool) -> str:
    return r"(?U)\s" if unicode else r"\s"


def strip(c: Column, unicode: bool = False) -> Column:
    s = _space(unicode)
    return F.regexp_replace(F.regexp_replace(c, f"^{s}+", ""), f"{s}+$", "")


def collapse_spaces(c: Column, unicode: bool = False) -> Column:
    return F.regexp_replace(c, f"{_space(unicode)}+", " ")


def drop_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


TEXT_OPERATIONS = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "normalize_whitespace": collapse_spaces,
    "remove_special": drop_special,
}

MATH_TRANSFORMS = {
    "log": F.ln,
    "log1p": F.log1p,
    "sqrt": F.sqrt,
    "square": lambda c: c * c,
    "cube": lambda c: c * c * c,
    "reciprocal": lambda c: F.try_divide(F.lit(1.0), c),
    "exp": F.exp,
    "abs": F.abs,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
}


def math_transform(c: Column, name: str) -> Column:
    return finite(MATH_TRANSFORMS[name](c.cast("double")))


def null_share(total: Column, present: Column) -> Column:
    """Missing percentage from a row count and a non-null count; 0 without rows."""
    return F.coalesce(F.try_divide((total - present) * 100.0, total), F.lit(0.0))


# Size units.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(size: float) -> str:
    """Human-readable size of a small driver-side number."""
    step = 0
    while size >= 1024 and step < len(SIZE_UNITS) - 1:
        size, step = size / 1024, step + 1
    return f"{size:.1f} {SIZE_UNITS[step]}"
