"""Losses and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltable.operators.index import with_running
from moltable.runtime import stage


def mse(pred: Column, label: Column) -> Column:
    """Aggregate: mean squared error over scalar cells."""
    return F.avg((pred - label) * (pred - label))


def mse_vectors(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Mean squared error over all cells of two vector columns."""
    cells = df.select(F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(label).alias("y"))).alias("c"))
    return cells.agg(mse(F.col("c.p").cast("double"), F.col("c.y").cast("double")).alias("loss"))


IGNORE_LABEL = -100  # fixed value: rows with this label do not count


def cross_entropy(logits: Column, label: Column) -> Column:
    """Aggregate: cross-entropy of an integer class under a vector of logits.

    Rows labelled IGNORE_LABEL, and rows without label or logits, are left out; any other label outside the classes is an error.
    """
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    known = (label >= 0) & (label < F.size(logits))
    wrong = F.raise_error(F.concat(F.lit("no such class: "), label.cast("string"))).cast("double")
    loss = F.ln(total) + top - F.get(logits, label).cast("double")
    return F.avg(F.when(label != IGNORE_LABEL, F.when(known, loss).when(~known, wrong)))


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Aggregate: binary cross-entropy of a 0/1 label under a logit."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))


def problem_type(labels: T.DataType, n_labels: int) -> str:
    """Which loss a label column asks for when none is named."""
    element = labels.elementType if isinstance(labels, T.ArrayType) else labels
    if n_labels == 1:
        return "regression"
    if isinstance(element, T.IntegralType):
        return "single_label_classification"
    return "multi_label_classification"


def infer_loss(df: DataFrame, logits: str, labels: str, n_labels: int) -> DataFrame:
    """(problem_type, loss) with the loss the label type asks for."""
    kind = problem_type(df.schema[labels].dataType, n_labels)
    if kind == "regression":
        loss = df.agg(mse(F.col(logits).cast("double"), F.col(labels).cast("double")).alias("loss"))
    elif kind == "single_label_classification":
        loss = df.agg(cross_entropy(F.col(logits), F.col(labels)).alias("loss"))
    else:
        cells = df.select(F.explode(F.arrays_zip(F.col(logits).alias("x"), F.col(labels).alias("y"))).alias("c"))
        loss = cells.agg(bce_with_logits(F.col("c.x").cast("double"), F.col("c.y").cast("double")).alias("loss"))
    return loss.select(F.lit(kind).alias("problem_type"), "loss")


def _ranked(scored: DataFrame, descending: bool) -> DataFrame:
    """Positives and negatives per (task, distinct score), and how many come before.

    ``scored`` is (task, score, label). Equal scores are added up before any ordering, so a score
    shared by a third of the rows is one row. These counts are dealt out by ranges of (task, score) and written once with the number
    of their range: the ranges are the pieces whose totals are accumulated first, as many as the session shuffles into.
    """
    rows = scored.where("score is not null and label is not null").withColumn(
        "score", -F.col("score").cast("double") if descending else F.col("score").cast("double")
    )
    counts = rows.groupBy("task", "score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"),
    )
    ranges = counts.repartitionByRange("task", "score").withColumn("_range", F.spark_partition_id())
    running = {"pos_before": ("sum", F.col("pos"), False), "neg_before": ("sum", F.col("neg"), False)}
    return with_running(stage(ranges, "scores"), ["task"], F.col("_range"), ["score"], running).drop("_range")


def roc_auc(scored: DataFrame) -> DataFrame:
    """(task, roc_auc): chance that a positive scores above a negative, ties count half.

    Null where a task has one class only.
    """
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    area = F.when((pos > 0) & (neg > 0), wins / (pos.cast("double") * neg.cast("double")))
    return _ranked(scored, descending=False).groupBy("task").agg(area.alias("roc_auc"))


def prc_auc(scored: DataFrame) -> DataFrame:
    """(task, prc_auc): trapezoid area under precision over recall, from recall 0 and precision 1."""
    tp0, fp0 = F.col("pos_before"), F.col("neg_before")
    tp1, fp1 = tp0 + F.col("pos"), fp0 + F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    piece = F.col("pos") * (before + tp1 / (tp1 + fp1)) / 2.0
    pos, neg = F.sum("pos"), F.sum("neg")
    area = F.when((pos > 0) & (neg > 0), F.sum(piece) / pos)
    return _ranked(scored, descending=True).groupBy("task").agg(area.alias("prc_auc"))


def mean_score(per_task: DataFrame, score: str) -> DataFrame:
    """Mean over tasks, undefined tasks left out."""
    return per_task.agg(F.avg(score).alias(f"mean_{score}"))


def regression_metrics(pred: Column, label: Column) -> list[Column]:
    """Aggregates: rms, mse and mae."""
    squared = mse(pred, label)
    return [F.sqrt(squared).alias("rms"), squared.alias("mse"), F.avg(F.abs(pred - label)).alias("mae")]
