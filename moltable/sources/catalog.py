"""Which datasets there are, and how their columns are to be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, text_column string, label_columns string, task string, n_tasks int, apply_transforms boolean, kind string"

# Benchmark datasets with their task counts, and the task-adaptation datasets.
BENCHMARK_CLASSIFICATION = {
    "antimalarial": 1,
    "bace_classification": 1,
    "bbbp": 1,
    "clintox": 2,
    "cocrystal": 1,
    "covid19": 1,
    "hiv": 1,
    "sider": 27,
    "tox21": 12,
}
BENCHMARK_REGRESSION = ["bace_regression", "clearance", "delaney", "freesolv", "lipo"]
TASK_ADAPTATION = [
    "adme_microsom_stab_h",
    "adme_microsom_stab_r",
    "adme_permeability",
    "adme_ppb_h",
    "adme_ppb_r",
    "adme_solubility",
    "astrazeneca_CL",
    "astrazeneca_LogD74",
    "astrazeneca_PPB",
    "astrazeneca_Solubility",
]


def dataset_catalog(spark: SparkSession) -> DataFrame:
    rows = [(n, "smiles", "*", "classification", t, False, "benchmark") for n, t in BENCHMARK_CLASSIFICATION.items()]
    rows += [(n, "smiles", "*", "regression", 1, True, "benchmark") for n in BENCHMARK_REGRESSION]
    rows += [(n, "smiles", "y", "regression", 1, True, "task_adaptation") for n in TASK_ADAPTATION]
    return spark.createDataFrame(rows, SCHEMA)


def with_table_counts(catalog: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Add ``n_rows`` of the table each catalog row names; null where there is none."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return catalog.join(counts, "name", "left")


def budget_plan(
    counted: DataFrame, epochs: int, batch_size: int, base_lr: float, lr_denominator: float, decay_factor: float = 0.05
) -> DataFrame:
    """Learning rate scaled by sqrt(batch/denominator) and decay by sqrt(batch/(rows*epochs)).

    A dataset with no rows, or a plan with no epochs, raises when it is evaluated.
    """
    seen = F.col("n_rows") * F.lit(epochs)
    checked = F.when(seen > 0, seen).otherwise(F.raise_error(F.lit("rows times epochs must be greater than zero")))
    return counted.withColumn("scaled_lr", F.lit(base_lr) * F.sqrt(F.lit(batch_size / lr_denominator))).withColumn(
        "weight_decay", F.lit(decay_factor) * F.sqrt(F.lit(float(batch_size)) / checked)
    )
