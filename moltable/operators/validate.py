"""Checks made on the schema, before any job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS = ("mlm", "classification", "regression", "mtr")  # fixed values


def check_task(task: str) -> str:
    if task not in TASKS:
        raise ValueError(f"task must be one of {list(TASKS)}, got {task!r}")
    return task


def require_columns(df: DataFrame, columns: list[str], where: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"column(s) {missing} not found in {where}; available: {df.columns}")
    return df


def resolve_labels(df: DataFrame, text_col: str, labels: str | list[str] | None) -> list[str]:
    """Label columns that exist: ``"*"`` is every other column, unknown names are left out."""
    if labels is None:
        return []
    if labels == "*":
        return [c for c in df.columns if c != text_col]
    wanted = [labels] if isinstance(labels, str) else labels
    return [c for c in wanted if c in df.columns]


def check_arity(found: list[str], n_tasks: int, task: str, available: list[str]) -> list[str]:
    if task != "mlm" and len(found) != n_tasks:
        raise ValueError(f"expected {n_tasks} label columns, found {len(found)}; available: {available}")
    return found
