"""Reports over run logs, metric histories and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltable.functions.columns import display4
from moltable.operators.index import with_running
from moltable.runtime import stage

NUMBER = r"([0-9]*\.[0-9]*)"

# Phrases a finished and a broken run leave in their log, in lower case.
SUCCESS_PHRASES = [
    "training completed with return code: 0",
    "training complete",
    "model saved successfully",
    "training finished",
]
ERROR_PHRASES = ["error", "exception", "failed", "traceback", "return code: 1", "return code: 2"]

VALIDATION_ROC = "Val mean-roc_auc_score: "
VALIDATION_RMS = "Val rms_score: "
MIN_START = 999999.0  # fixed value: where the search for a minimum starts
OUTLIER_ABOVE = 10.0  # fixed value: the second average leaves larger values out


def _number_after(line: Column, label: str) -> Column:
    number = F.regexp_extract(line, f".*{label}{NUMBER}", 1).try_cast("double")
    return F.when(line.contains(label), number)


def _final(line: Column, metric: str) -> Column:
    """(avg, std) as text of a final result line, null for other lines."""
    pattern = f"Final Triplicate Test Results.*Avg {metric}: {NUMBER}, Std Dev: {NUMBER}"
    found = F.struct(F.regexp_extract(line, pattern, 1).alias("avg"), F.regexp_extract(line, pattern, 2).alias("std"))
    return F.when(line.rlike(pattern), found)


def _best_scores() -> list[Column]:
    lowest = F.min(_number_after(F.col("value"), VALIDATION_RMS))
    return [
        F.max(_number_after(F.col("value"), VALIDATION_ROC)).alias("max_val_roc"),
        F.when(lowest.isNotNull(), F.least(lowest, F.lit(MIN_START))).alias("min_val_rms"),
    ]


def best_validation(lines: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(file, max_val_roc, min_val_rms): the best validation scores of each log, from (file, value) lines.

    Lines whose number is not plain decimal are passed over; null if there is none. ``logs`` (file), as ``list_logs`` gives
    it, adds a row for each log without lines.
    """
    best = lines.groupBy("file").agg(*_best_scores())
    return best if logs is None else logs.select("file").join(best, "file", "left")


def _first_final(metric: str) -> Column:
    cell = _final(F.col("value"), metric)
    return F.min_by(cell, F.when(cell.isNotNull(), F.col("line_at")))


def final_results(lines: DataFrame) -> DataFrame:
    """First final test line per log: (file, roc_avg, roc_std, rms_avg, rms_std)."""
    found = lines.where(F.col("value").contains("Final Triplicate Test Results"))
    first = found.groupBy("file").agg(
        _first_final("mean-roc_auc_score").alias("roc"), _first_final("rms_score").alias("rms")
    )
    return first.select(
        "file",
        *[F.col(f"{m}.{s}").try_cast("double").alias(f"{m}_{s}") for m in ("roc", "rms") for s in ("avg", "std")],
    )


def log_state(lines: DataFrame) -> DataFrame:
    """All that the log table and the run status need of each log, in one pass: one row per log.

    (file, max_val_roc, min_val_rms, final_roc, final_rms, final_roc_std, final_rms_std, succeeded, failed). Every column is a
    mergeable aggregate, so ``lines`` may also be a stream, whose state is that row. Batch reports over all lines are
    cheaper by ``log_table`` and ``run_status``, which keep only final lines whole.
    """
    state = lines.groupBy("file").agg(
        *_best_scores(),
        _first_final("mean-roc_auc_score").alias("roc"),
        _first_final("rms_score").alias("rms"),
        _holds(SUCCESS_PHRASES).alias("succeeded"),
        _holds(ERROR_PHRASES).alias("failed"),
    )
    finals = {f"final_{m}{end}": F.col(f"{m}.{s}").try_cast("double") for s, end in (("avg", ""), ("std", "_std")) for m in ("roc", "rms")}
    return state.select("file", "max_val_roc", "min_val_rms", *[c.alias(n) for n, c in finals.items()], "succeeded", "failed")


def log_table(lines: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One row per log and two AVERAGE rows, of values up to OUTLIER_ABOVE and of all; these have no deviations.

    ``logs`` as in ``best_validation``. Best scores are plain numbers and group by hash over all lines; only the few final result
    lines are kept whole, to find the first.
    """
    finals = final_results(lines).select(
        "file",
        F.col("roc_avg").alias("final_roc"),
        F.col("rms_avg").alias("final_rms"),
        F.col("roc_std").alias("final_roc_std"),
        F.col("rms_std").alias("final_rms_std"),
    )
    per_file = best_validation(lines, logs).join(finals, "file", "left")
    return with_averages(per_file)


def with_averages(per_file: DataFrame) -> DataFrame:
    """The rows of each log and the two AVERAGE rows of ``log_table``."""
    values = ["max_val_roc", "min_val_rms", "final_roc", "final_rms"]
    # The best values enter the averages as they are printed, with four decimals.
    per_file = per_file.withColumns({c: F.round(c, 4) for c in values[:2]})
    averages = per_file.agg(
        *[F.avg(c).alias(f"all_{c}") for c in values],
        *[F.avg(F.when(F.col(c) <= OUTLIER_ABOVE, F.col(c))).alias(f"low_{c}") for c in values],
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("file"), *[F.col(f"{p}_{c}").alias(c) for c in values])
            for label, p in (("AVERAGE (no outliers)", "low"), ("AVERAGE (all)", "all"))
        ]
    )
    return per_file.unionByName(averages.select(F.inline(rows)), allowMissingColumns=True)


def display_table(table: DataFrame) -> DataFrame:
    """The log table as text, in name order; a deviation is shown behind its mean."""

    def shown(name: str) -> Column:
        spread = f"{name}_std"
        behind = F.concat(F.lit(" ± "), F.format_string("%.4f", spread)) if spread in table.columns else F.lit("")
        known = F.col(spread).isNotNull() if spread in table.columns else F.lit(False)
        return F.concat(display4(F.col(name)), F.when(known, behind).otherwise("")).alias(name)

    return table.orderBy("file").select("file", *[shown(c) for c in table.columns if c != "file" and not c.endswith("_std")])


def run_status(lines: DataFrame, expected: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(file, status) for every expected run.

    A success phrase anywhere in a log wins over an error phrase; no phrase is UNKNOWN, no log is
    LOG_NOT_FOUND. Phrases lie within lines, so logs are never put together. ``logs`` (file, n_bytes), as ``list_logs``
    gives it, tells a log without lines from a missing one: UNKNOWN if it is empty, ERROR_READING_LOG if it has bytes
    and yet no line could be read (the reader must run with ``spark.sql.files.ignoreCorruptFiles``).
    """
    seen = lines.groupBy("file").agg(_holds(SUCCESS_PHRASES).alias("succeeded"), _holds(ERROR_PHRASES).alias("failed"))
    return status_of(seen, expected, logs)


def _holds(phrases: list[str]) -> Column:
    line = F.lower("value")
    hit = line.contains(phrases[0])
    for p in phrases[1:]:
        hit = hit | line.contains(p)
    return F.max(hit)


def status_of(seen: DataFrame, expected: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """``run_status`` from the phrases seen in each log, (file, succeeded, failed)."""
    status = F.when(F.col("succeeded"), "SUCCESS").when(F.col("failed"), "FAILED").otherwise("UNKNOWN")
    found = expected.select("file").join(seen.select("file", status.alias("status")), "file", "left")
    without = F.lit("LOG_NOT_FOUND")
    if logs is not None:
        found = found.join(logs.select("file", "n_bytes"), "file", "left")
        without = F.when(F.col("n_bytes") == 0, "UNKNOWN").when(F.col("n_bytes") > 0, "ERROR_READING_LOG").otherwise(without)
    return found.select("file", F.coalesce("status", without).alias("status"))


def run_outcomes(results: DataFrame, status: DataFrame) -> DataFrame:
    """(file, outcome): a run reported as failed still counts as SUCCESS if its log says so.

    ``results`` is (file, success).
    """
    checked = results.join(status, "file", "left")
    fine = F.col("success") | F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    return checked.select("file", F.when(fine, "SUCCESS").otherwise("FAILED").alias("outcome"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n_runs"))


def interval_means(history: DataFrame, every: int) -> DataFrame:
    """Mean loss per ``every`` steps of a run, the rest at the end included: (run, interval, mean_loss).

    ``history`` is (run, step, loss) with steps from 1.
    """
    return history.groupBy("run", F.expr(f"(step - 1) div {every}").alias("interval")).agg(
        F.avg("loss").alias("mean_loss")
    )


def last_interval(means: DataFrame) -> DataFrame:
    """The last mean of each run."""
    return means.groupBy("run").agg(F.max_by("mean_loss", "interval").alias("last_loss"))


def best_trial(trials: DataFrame) -> DataFrame:
    """(study, trial, loss) with the smallest loss, the lowest trial on a tie."""
    best = trials.groupBy("study").agg(F.min(F.struct("loss", "trial")).alias("b"))
    return best.select("study", "b.trial", "b.loss")


def early_stopping(history: DataFrame, patience: int, block_epochs: int = 100_000) -> DataFrame:
    """Where each run stops and what was best by then: (run, stop_epoch, best_epoch, best_metric).

    ``history`` is (run, epoch, metric), smaller is better. A run stops at the first evaluation
    that is ``patience`` evaluations after the last improvement; ``stop_epoch`` is null if none is.
    Running minima and counts go block by block, so a long run is not one task; they are written
    before the second round of running values reads them twice.
    """
    block = F.expr(f"epoch div {block_epochs}L")
    seen = with_running(
        history,
        ["run"],
        block,
        ["epoch"],
        {"_best": ("min", F.col("metric"), False), "_nth": ("sum", F.lit(1), True)},
    )
    improved = F.col("_best").isNull() | (F.col("metric") < F.col("_best"))
    when_improved = F.when(F.col("_improved"), F.col("_nth")), F.when(F.col("_improved"), F.col("epoch"))
    waited = with_running(
        stage(seen.withColumn("_improved", improved), "history"),
        ["run"],
        block,
        ["epoch"],
        {"_last": ("max", when_improved[0], True), "_best_epoch": ("max", when_improved[1], True)},
    ).withColumn("_best", F.least("_best", "metric"))
    stopped = F.when(F.col("_nth") - F.col("_last") >= patience, F.col("epoch"))
    at_stop = waited.withColumn("_stop", stopped).groupBy("run").agg(
        F.min("_stop").alias("stop_epoch"),
        *[F.min_by(c, "_stop").alias(f"{c}_stop") for c in ("_best_epoch", "_best")],
        *[F.max_by(c, "epoch").alias(f"{c}_end") for c in ("_best_epoch", "_best")],
    )
    return at_stop.select(
        "run",
        "stop_epoch",
        F.coalesce("_best_epoch_stop", "_best_epoch_end").alias("best_epoch"),
        F.coalesce("_best_stop", "_best_end").alias("best_metric"),
    )
