"""The two main plans: a training set from a table, and the feature job of a dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from moltable.operators import features as feat
from moltable.operators.prepare import dedup_first, keep_labels, sample_rows
from moltable.operators.splits import select_split
from moltable.operators.stats import apply_transform, label_stats
from moltable.operators.validate import check_arity, check_task, require_columns, resolve_labels
from moltable.runtime import committed
from moltable.sources.readers import read_properties
from moltable.sources.writers import write_normalization, write_properties


@dataclass(frozen=True)
class TrainingSet:
    """What to do with a table before it is tokenized."""

    name: str
    text_col: str
    task: str = "mlm"
    n_tasks: int = 1
    labels: str | list[str] | None = None
    split: str | None = None
    apply_transforms: bool = False
    deduplicate: bool = False
    sample_size: int | None = None
    seed: int = 0
    id_col: str = "row_idx"


def prepare(df: DataFrame, spec: TrainingSet, assignment: DataFrame | None = None) -> DataFrame:
    """Split, check, transform, project, deduplicate, sample: in this order, as one lazy plan.

    Transform statistics are those of the split, before duplicates go and the sample is drawn.
    """
    check_task(spec.task)
    require_columns(df, [spec.text_col, spec.id_col], spec.name)
    labels = [c for c in resolve_labels(df, spec.text_col, spec.labels) if c != spec.id_col]
    check_arity(labels, spec.n_tasks, spec.task, df.columns)
    # Statistics cover float columns that are kept; the others would be dropped below anyway.
    out = keep_labels(df, spec.text_col, labels, [spec.id_col])
    if assignment is not None and spec.split is not None:
        out = select_split(out, assignment, spec.split, spec.id_col).select(*out.columns)
    if spec.apply_transforms:
        out = apply_transform(out, spec.name)
    if spec.deduplicate:
        out = dedup_first(out, spec.text_col, spec.id_col)
    return sample_rows(out, spec.sample_size, spec.id_col, spec.seed)


def feature_job(
    df: DataFrame, text_col: str, features: dict[str, Column], folder: str, parsable: Column | None = None
) -> tuple[str, str]:
    """Property records and normalization values of a table, below ``folder``; returns the paths of both.

    Features are computed once and written as the property records; statistics are read from those. ``folder`` appears
    when both are complete; a job that fails leaves nothing.
    """
    spark = df.sparkSession
    with committed(spark, folder) as draft:
        properties = f"{draft}/properties"
        write_properties(feat.feature_table(df.select(text_col), text_col, features, parsable), properties, text_col)
        stats = label_stats(read_properties(spark, properties), "labels", feat.feature_names(features))
        write_normalization(stats, f"{draft}/normalization")
    return f"{folder}/properties", f"{folder}/normalization"
