"""Column and vector statistics, and the transforms that use them.

A statistic is one row. It enters the rows it normalizes as a scalar subquery, so the plan stays
lazy and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltable.functions.columns import clean_property, finite_or_zero, float_columns, is_finite, log1p_checked, nan_to_null, of_size, zscore

# Dataset name fragments, in order, and the transform each asks for.
TRANSFORM_OF = {
    "delaney": "zscore",
    "freesolv": "zscore",
    "lipo": "zscore",
    "clearance": "log1p",
    "bace_regression": "zscore",
}
DEFAULT_TRANSFORM = "zscore"


def _usable_std(std: Column) -> Column:
    return F.when(std.isNotNull() & is_finite(std) & (std != 0), std).otherwise(F.lit(1.0))


def _wide_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a (mean, std) struct per column; NaN counts as missing."""
    cells = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        cells.append(
            F.struct(
                F.coalesce(F.avg(x), F.lit(float("nan"))).alias("mean"), _usable_std(F.stddev_pop(x)).alias("std")
            ).alias(c)
        )
    return df.agg(F.struct(*cells).alias("stats"))


def nan_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation per float column as (column, mean, std).

    Integer and text columns have no row. A deviation of 0 or no value at all is given as 1.
    """
    columns = float_columns(df) if columns is None else columns
    wide = _wide_stats(df, columns)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"stats.`{c}`.mean"), F.col(f"stats.`{c}`.std")) for c in columns]
    return wide.select(F.inline(F.array(*cells)))


def normalize(df: DataFrame, fit_on: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """z-scores of all float columns, scaled by ``fit_on`` or by the table itself."""
    columns = float_columns(df) if columns is None else columns
    if not columns:
        return df
    fitted = _wide_stats(df if fit_on is None else fit_on, columns)
    scored = {
        c: zscore(F.col(c).cast("double"), F.col(f"_stats.`{c}`.mean"), F.col(f"_stats.`{c}`.std")) for c in columns
    }
    return df.withColumn("_stats", fitted.scalar()).withColumns(scored).drop("_stats")


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, mean, m2) of the float columns: count, mean and sum of squared deviations of what is not missing.

    Such rows of several tables are merged by ``merged_moments`` into those of all of them.
    """
    columns = float_columns(df) if columns is None else columns
    cells = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        parts = (F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))
        cells.append(F.struct(F.lit(c).alias("column"), *parts))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def append_moments(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Add the moments of new rows to those stored at ``path``; what was stored before is not read."""
    moments(df, columns).write.mode("append").parquet(path)


def merged_moments(parts: DataFrame) -> DataFrame:
    """(column, n, mean, std) of all rows whose moments ``parts`` holds, scaled as ``nan_stats`` does.

    Deviations of the parts are taken from the mean of all, so nothing is lost where means are large against them. As
    small as the number of parts times that of the columns.
    """
    held = parts.where("n > 0")
    whole = held.groupBy("column").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    apart = held.join(whole.select("column", F.col("mean").alias("all")), "column")
    off = F.col("mean") - F.col("all")
    squares = apart.groupBy("column").agg(F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))
    known = whole.join(squares, "column").select("column", "n", "mean", _usable_std(F.sqrt(F.col("m2") / F.col("n"))).alias("std"))
    empty = parts.groupBy("column").agg(F.sum("n").alias("n")).where("n = 0")
    return known.unionByName(empty.select("column", "n", F.lit(float("nan")).alias("mean"), F.lit(1.0).alias("std")))


def normalize_by(df: DataFrame, stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """z-scores of float columns, scaled by a (column, mean, std) table such as ``merged_moments`` gives."""
    columns = float_columns(df) if columns is None else columns
    if not columns:
        return df
    fitted = stats.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std")))))  # a row per column
    scored = {c: zscore(F.col(c).cast("double"), F.col("_stats")[c]["mean"], F.col("_stats")[c]["std"]) for c in columns}
    return df.withColumn("_stats", fitted.scalar()).withColumns(scored).drop("_stats")


def log_transform(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """log(1+x) of all float columns."""
    columns = float_columns(df) if columns is None else columns
    return df.withColumns({c: log1p_checked(F.col(c).cast("double")) for c in columns})


def transform_name(dataset: str) -> str:
    """Transform for a dataset path: the first fragment it contains decides, z-score otherwise."""
    lowered = dataset.lower()
    return next((t for fragment, t in TRANSFORM_OF.items() if fragment in lowered), DEFAULT_TRANSFORM)


def transform_name_column(path: Column) -> Column:
    """``transform_name`` over a column of paths."""
    lowered = F.lower(path)
    chain = None
    for fragment, name in TRANSFORM_OF.items():
        hit = lowered.contains(fragment)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(DEFAULT_TRANSFORM))


def apply_transform(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    if transform_name(dataset) == "log1p":
        return log_transform(df, columns)
    return normalize(df, columns=columns)


def undo_normalize(df: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions back on the scale of ``fitted_on``."""
    stats = _wide_stats(fitted_on, columns)
    back = {c: F.col(c) * F.col(f"_stats.`{c}`.std") + F.col(f"_stats.`{c}`.mean") for c in columns}
    return df.withColumn("_stats", stats.scalar()).withColumns(back).drop("_stats")


def undo_log(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.expm1(c) for c in columns})


def undo_transforms(df: DataFrame, steps: list[tuple[str, DataFrame | None]], columns: list[str]) -> DataFrame:
    """Undo (transform name, table it was fitted on) steps, last one first."""
    for name, fitted_on in reversed(steps):
        df = undo_log(df, columns) if name == "log1p" else undo_normalize(df, fitted_on, columns)
    return df


def label_stats(df: DataFrame, vec_col: str, names: list[str]) -> DataFrame:
    """Mean and population deviation per position of a label vector: (label_idx, label_name, mean, std).

    A vector that has not one element per name is an error. Every row counts, rows of zeros too. Vectors are taken apart before they are grouped: what is
    shuffled is one partial row per position and task, whatever the width.
    """
    listed = F.array(*[F.lit(n) for n in names])
    return (
        df.select(F.posexplode(of_size(F.col(vec_col), len(names))).alias("label_idx", "x"))
        .groupBy("label_idx")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
        .select("label_idx", listed[F.col("label_idx")].alias("label_name"), "mean", "std")
    )


_KEPT = "array<struct<mean:double,std:double>>"

# Names of the "surface" subset.
SURFACE_NAMES = [
    "SlogP_VSA1",
    "SlogP_VSA10",
    "SlogP_VSA11",
    "SlogP_VSA12",
    "SlogP_VSA2",
    "SlogP_VSA3",
    "SlogP_VSA4",
    "SlogP_VSA5",
    "SlogP_VSA6",
    "SlogP_VSA7",
    "SlogP_VSA8",
    "SlogP_VSA9",
    "SMR_VSA1",
    "SMR_VSA10",
    "SMR_VSA2",
    "SMR_VSA3",
    "SMR_VSA4",
    "SMR_VSA5",
    "SMR_VSA6",
    "SMR_VSA7",
    "SMR_VSA8",
    "SMR_VSA9",
    "EState_VSA1",
    "EState_VSA10",
    "EState_VSA11",
    "EState_VSA2",
    "EState_VSA3",
    "EState_VSA4",
    "EState_VSA5",
    "EState_VSA6",
    "EState_VSA7",
    "EState_VSA8",
    "EState_VSA9",
    "LabuteASA",
    "PEOE_VSA1",
    "PEOE_VSA10",
    "PEOE_VSA11",
    "PEOE_VSA12",
    "PEOE_VSA13",
    "PEOE_VSA14",
    "PEOE_VSA2",
    "PEOE_VSA3",
    "PEOE_VSA4",
    "PEOE_VSA5",
    "PEOE_VSA6",
    "PEOE_VSA7",
    "PEOE_VSA8",
    "PEOE_VSA9",
    "TPSA",
]


def keep_subset(stats: DataFrame, subset: str = "all", surface_names: list[str] | None = None) -> DataFrame:
    """Labels to train on: in the named subset, and not constant."""
    if subset not in ("all", "surface"):
        raise ValueError(f"subset must be 'all' or 'surface', not {subset!r}")
    kept = stats.where(F.col("std") != 0)
    if subset == "surface":
        kept = kept.where(F.col("label_name").isin(surface_names or SURFACE_NAMES))
    return kept


def label_dictionary(kept: DataFrame) -> DataFrame:
    """Consecutive ids for kept labels: (label_id, label_name). One row per label name in the job."""
    cells = F.array_sort(F.collect_list(F.struct("label_idx", "label_name")))
    return kept.agg(cells.alias("c")).select(F.posexplode("c.label_name").alias("label_id", "label_name"))


def normalize_vectors(df: DataFrame, vec_col: str, kept: DataFrame) -> DataFrame:
    """Label vectors reduced to the kept labels and z-scored, in label order.

    A vector shorter than the label list is scaled as far as it goes. Text cells are cleaned first; text that
    is no number is an error. A missing label stays null in its place.
    """
    element = df.schema[vec_col].dataType.elementType.simpleString()

    def value(x: Column) -> Column:
        # A cell whose spelling contains "inf" counts as 0, NaN stays.
        if element == "string":
            clean = clean_property(x)
            wrong = F.raise_error(F.concat(F.lit("label is no number: "), x)).cast("double")
            return F.when(x.isNotNull() & clean.isNull(), wrong).otherwise(clean)
        number = x.cast("double")
        return F.when(F.isnan(number), number).otherwise(finite_or_zero(number))

    # One cell per position of the vector, null for labels that are not kept: rows are then scaled
    # in one walk over both lists.
    found = F.map_from_entries(F.collect_list(F.struct("label_idx", F.struct("mean", "std"))))
    dense = F.transform(F.sequence(F.lit(0), F.max("label_idx")), lambda i: F.try_element_at(found, i))
    cells = F.coalesce(F.col("_kept"), F.array().cast(_KEPT))
    scaled = F.zip_with(
        F.col(vec_col),
        F.slice(cells, F.lit(1), F.size(vec_col)),
        lambda x, c: F.struct(
            c.isNotNull().alias("kept"), F.when(c.isNotNull(), (value(x) - c["mean"]) / c["std"]).alias("z")
        ),
    )
    kept_only = F.transform(F.filter(scaled, lambda s: s["kept"]), lambda s: s["z"])
    return df.withColumn("_kept", kept.agg(dense).scalar()).withColumn(vec_col, kept_only).drop("_kept")
