"""Column expressions: missing-value policies, casts, names and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT32_MAX = 3.4028234663852886e38  # fixed value: largest finite 32-bit float
FLOAT64_MAX = 1.7976931348623157e308  # fixed value: largest finite 64-bit float
INF = float("inf")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite_or_zero(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(x.isNotNull() & is_finite(x), x).otherwise(F.lit(0.0))


def nan_to_num(vec: Column) -> Column:
    """Null, NaN and infinities inside a vector become 0; each element is evaluated once."""
    return F.transform(vec, finite_or_zero)


def clean_property(text: Column) -> Column:
    """A property written as text: empty or any spelling with "inf" is 0, else the number."""
    return F.when((text == "") | text.contains("inf"), F.lit(0.0)).otherwise(text.try_cast("double"))


def clamp_float(x: Column, largest: float = FLOAT32_MAX) -> Column:
    """NaN becomes 0, infinities the largest number of the float type."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.least(x, F.lit(largest)), F.lit(-largest)))


def to_float32(x: Column) -> Column:
    """Cast to 32 bits; what does not fit becomes infinite there and is clamped back."""
    return clamp_float(x.cast("float").cast("double")).cast("float")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return finite_or_zero((x - mean) / std)


def log1p_checked(x: Column) -> Column:
    """log(1+x); null stays null, x <= -1 raises instead of turning into null."""
    return F.when(
        x <= -1, F.raise_error(F.concat(F.lit("log1p of a value not above -1: "), x.cast("string"))).cast("double")
    ).otherwise(F.log1p(x))


def _path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/+$", ""), "/")


def path_stem(path: Column, suffix: str = ".csv") -> Column:
    """Last part of a path without ``suffix``."""
    return F.replace(F.element_at(_path_parts(path), -1), F.lit(suffix), F.lit(""))


def path_parent(path: Column, suffix: str = ".csv") -> Column:
    """Name of the folder a path lies in, empty if there is none."""
    parts = _path_parts(path)
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return F.replace(parent, F.lit(suffix), F.lit(""))


def log_basename(path: Column) -> Column:
    """Last part of a path without a trailing ``.log``."""
    return F.regexp_replace(F.element_at(_path_parts(path), -1), r"\.log$", "")


def display4(x: Column) -> Column:
    """Four decimals, or "N/A" for null."""
    return F.when(x.isNotNull(), F.format_string("%.4f", x)).otherwise("N/A")


def pack_labels(columns: list[str], task: str) -> Column:
    """Label columns as the model expects them: a vector in column order, a scalar for one label.

    Regression and property labels are 32-bit floats; classes are integers when there is one.
    """
    kind = "bigint" if task == "classification" and len(columns) == 1 else "float"
    cells = [F.col(c).cast(kind) for c in columns]
    return cells[0] if len(cells) == 1 else F.array(*cells)


def float_columns(df: DataFrame) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype in ("float", "double")]


def of_size(vec: Column, n: int) -> Column:
    """The vector itself; an error if it has not ``n`` elements. Null stays null."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} elements, got "), F.size(vec).cast("string")))
    return F.when(F.size(vec) != n, wrong).otherwise(vec)
