"""Losses, ranking and regression metrics, logs, histories and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import CELLS_SQL
from checks.registry import SQL, check, table
from moltable.operators import metrics as m
from moltable.operators import runs
from moltable.runtime import new_path
from moltable.sources.readers import list_logs, read_log_lines
from moltable.streaming.logs import latest_log_table, latest_table, stream_best_validation, stream_log_state


@check(
    "loss_mse",
    "SELECT l_returnflag, round(avg((l_quantity * l_discount - l_tax * 10) ** 2), 6) AS loss FROM lineitem GROUP BY 1",
)
def loss_mse(spark, sf_dir):
    pred, label = F.col("l_quantity") * F.col("l_discount"), F.col("l_tax") * 10
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(m.mse(pred, label), 6).alias("loss"))


CE_SQL = f"""
    SELECT avg(z - x) AS loss FROM (
        SELECT vec_id, ln(sum(exp(x))) AS z, any_value(x) FILTER (idx = label) AS x
        FROM ({CELLS_SQL}) GROUP BY vec_id)
"""


@check("loss_ce", f"SELECT round(loss, 6) AS loss FROM ({CE_SQL})")
def loss_ce(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.round(m.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


@check("loss_ce_ignored", f"SELECT round(loss, 6) AS loss FROM ({CE_SQL.replace('FROM embeddings', 'FROM embeddings WHERE label <> 3')})")
def loss_ce_ignored(spark, sf_dir):
    label = F.when(F.col("label") == 3, m.IGNORE_LABEL).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").agg(F.round(m.cross_entropy(F.col("embedding"), label), 6).alias("loss"))


LABELLED_SQL = """
    SELECT doc_id, (n_chars - 2500) / 1000.0::DOUBLE AS score, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)
"""
TASKS_SQL = f"""
    SELECT 'quality' AS task, score, quality AS label FROM ({LABELLED_SQL})
    UNION ALL SELECT 'toxic', score, toxic FROM ({LABELLED_SQL})
"""


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") - 2500) / F.lit(1000.0)
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", score)


def _tasks(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in ("quality", "toxic")])
    return _labelled(spark, sf_dir).select("score", F.inline(cells))


@check(
    "loss_bce",
    f"""
    SELECT task, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6) AS loss
    FROM ({TASKS_SQL}) GROUP BY task
    """,
)
def loss_bce(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy("task").agg(
        F.round(m.bce_with_logits(F.col("score"), F.col("label")), 6).alias("loss")
    )


@check(
    "loss_infer",
    f"""
    SELECT 'regression' AS problem_type, round(avg((value - user_id) ** 2), 4) AS loss FROM events
    UNION ALL SELECT 'single_label_classification', round(loss, 4) FROM ({CE_SQL})
    UNION ALL SELECT 'multi_label_classification',
              round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 4) FROM ({TASKS_SQL})
    """,
)
def loss_infer(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("value", F.col("user_id").cast("float").alias("labels"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("logits"), "label")
    pairs = _labelled(spark, sf_dir).select(
        F.array("score", "score").alias("logits"), F.array("quality", "toxic").cast("array<float>").alias("labels")
    )
    losses = [
        m.infer_loss(events, "value", "labels", 1),
        m.infer_loss(vectors, "logits", "label", 64),
        m.infer_loss(pairs, "logits", "labels", 2),
    ]
    out = losses[0].unionByName(losses[1]).unionByName(losses[2])
    return out.select("problem_type", F.round("loss", 4).alias("loss"))


ROC_SQL = f"""
    SELECT task, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))::DOUBLE AS roc_auc
    FROM (SELECT task, label, rank() OVER (PARTITION BY task ORDER BY score)
                 + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS r FROM ({TASKS_SQL}))
    GROUP BY task
"""


@check("met_roc_auc", f"SELECT task, round(roc_auc, 6) AS roc_auc FROM ({ROC_SQL})")
def met_roc_auc(spark, sf_dir):
    return m.roc_auc(_tasks(spark, sf_dir)).select("task", F.round("roc_auc", 6).alias("roc_auc"))


@check("met_mean_roc_auc", f"SELECT round(avg(roc_auc), 6) AS mean_roc_auc FROM ({ROC_SQL})")
def met_mean_roc_auc(spark, sf_dir):
    return m.mean_score(m.roc_auc(_tasks(spark, sf_dir)), "roc_auc").select(F.round("mean_roc_auc", 6).alias("mean_roc_auc"))


@check(
    "met_prc_auc",
    f"""
    WITH d AS (SELECT task, score, sum(label) AS pos, count(*) AS n FROM ({TASKS_SQL}) GROUP BY ALL),
         c AS (SELECT task, score, sum(pos) OVER w AS tp, sum(n) OVER w AS k,
                      sum(pos) OVER (PARTITION BY task) AS p FROM d WINDOW w AS (PARTITION BY task ORDER BY score DESC)),
         e AS (SELECT *, lag(tp, 1, 0) OVER w AS tp0, lag(k) OVER w AS k0 FROM c WINDOW w AS (PARTITION BY task ORDER BY score DESC))
    SELECT task, round(sum((tp - tp0) / p::DOUBLE * (tp / k::DOUBLE + coalesce(tp0 / k0::DOUBLE, 1)) / 2), 6) AS prc_auc FROM e GROUP BY task
    """,
)
def met_prc_auc(spark, sf_dir):
    return m.prc_auc(_tasks(spark, sf_dir)).select("task", F.round("prc_auc", 6).alias("prc_auc"))


@check(
    "met_regression",
    """
    SELECT event_type, round(sqrt(avg((value - user_id) ** 2)), 6) AS rms, round(avg((value - user_id) ** 2), 4) AS mse,
           round(avg(abs(value - user_id)), 6) AS mae FROM events GROUP BY 1
    """,
)
def met_regression(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy("event_type").agg(*m.regression_metrics(F.col("value"), F.col("user_id")))
    return scores.select(
        "event_type", F.round("rms", 6).alias("rms"), F.round("mse", 4).alias("mse"), F.round("mae", 6).alias("mae")
    )


def metric_logs(spark, sf_dir):
    """Logs per event type, four lines per event: a step, validation scores and final results.

    The type "error" has no metric lines, "click" none of rms.
    """
    score, rms = F.format_string("%.4f", F.col("value") / 100), F.format_string("%.4f", F.col("value"))
    quiet, no_rms = F.col("event_type") == "error", F.col("event_type").isin("error", "click")
    candidates = F.array(
        F.concat(F.lit("step "), F.col("event_id")),
        F.when(~quiet, F.concat(F.lit("epoch 1 | Val mean-roc_auc_score: "), score, F.lit(" done"))),
        F.when(~no_rms, F.concat(F.lit("Val rms_score: "), rms)),
        F.when(~quiet, F.concat(F.lit("Final Triplicate Test Results - Avg mean-roc_auc_score: "), score, F.lit(", Std Dev: "), score)),
        F.when(~no_rms, F.concat(F.lit("Final Triplicate Test Results - Avg rms_score: "), rms, F.lit(", Std Dev: "), score)),
    )
    lines = (
        table(spark, sf_dir, "events")
        .select(F.concat("event_type", F.lit(".log")).alias("file"), "event_id", F.posexplode(candidates).alias("at", "value"))
        .where("value is not null")
    )
    folder = new_path(spark, "logs")
    order = ["file", "event_id", "at"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("file", "value").write.partitionBy("file").text(folder)
    table(spark, sf_dir, "events").select("event_type").where("false").write.text(f"{folder}/empty.log")
    return folder


NO_LINES_SQL = "SELECT 'empty' AS file, NULL AS max_val_roc, NULL AS min_val_rms"
BEST_SQL = """
    SELECT event_type AS file, round(max(value / 100) FILTER (event_type <> 'error'), 4) AS max_val_roc,
           round(min(value) FILTER (event_type NOT IN ('error', 'click')), 4) AS min_val_rms
    FROM events GROUP BY 1
"""
FINAL_SQL = """
    SELECT event_type AS file, round(arg_min(value / 100, event_id), 4) AS roc_avg, round(arg_min(value / 100, event_id), 4) AS roc_std,
           round(arg_min(value, event_id) FILTER (event_type <> 'click'), 4) AS rms_avg,
           round(arg_min(value / 100, event_id) FILTER (event_type <> 'click'), 4) AS rms_std
    FROM events WHERE event_type <> 'error' GROUP BY 1
"""


@check("log_best_val", f"{BEST_SQL} UNION ALL {NO_LINES_SQL}")
def log_best_val(spark, sf_dir):
    folder = metric_logs(spark, sf_dir)
    return runs.best_validation(read_log_lines(spark, folder), list_logs(spark, folder))


@check("stream_log_best", BEST_SQL)
def stream_log_best(spark, sf_dir):
    folder, out = metric_logs(spark, sf_dir), new_path(spark, "best")
    stream_best_validation(spark, folder, out, new_path(spark, "progress")).awaitTermination()
    return latest_table(spark, out)


@check("log_final_first", FINAL_SQL)
def log_final_first(spark, sf_dir):
    return runs.final_results(read_log_lines(spark, metric_logs(spark, sf_dir)))


@check("lim_first_match", f"SELECT file, roc_avg, rms_avg FROM ({FINAL_SQL})")
def lim_first_match(spark, sf_dir):
    return runs.final_results(read_log_lines(spark, metric_logs(spark, sf_dir))).select("file", "roc_avg", "rms_avg")


LOG_VALUES = ["max_val_roc", "min_val_rms", "final_roc", "final_rms"]
LOG_TABLE_SQL = f"""
    WITH t AS (SELECT b.file, max_val_roc, min_val_rms, roc_avg AS final_roc, rms_avg AS final_rms,
                      roc_std AS final_roc_std, rms_std AS final_rms_std
               FROM ({BEST_SQL} UNION ALL {NO_LINES_SQL}) b LEFT JOIN ({FINAL_SQL}) f USING (file))
    SELECT * FROM t
    UNION ALL SELECT 'AVERAGE (all)', {", ".join(f"avg({c})" for c in LOG_VALUES)}, NULL, NULL FROM t
    UNION ALL SELECT 'AVERAGE (no outliers)', {", ".join(f"avg({c}) FILTER ({c} <= 10)" for c in LOG_VALUES)}, NULL, NULL FROM t
"""


LOG_COLUMNS = [*LOG_VALUES, "final_roc_std", "final_rms_std"]


@check("log_table", f"SELECT file, {', '.join(f'round({c}, 6) AS {c}' for c in LOG_COLUMNS)} FROM ({LOG_TABLE_SQL})")
def log_table(spark, sf_dir):
    folder = metric_logs(spark, sf_dir)
    made = runs.log_table(read_log_lines(spark, folder), list_logs(spark, folder))
    return made.select("file", *[F.round(c, 6).alias(c) for c in LOG_COLUMNS])


@check("stream_log_table", SQL["log_table"])
def stream_log_table(spark, sf_dir):
    folder, out = metric_logs(spark, sf_dir), new_path(spark, "state")
    stream_log_state(spark, folder, out, new_path(spark, "progress")).awaitTermination()
    made = latest_log_table(spark, out, list_logs(spark, folder))
    return made.select("file", *[F.round(c, 6).alias(c) for c in LOG_COLUMNS])


def _run_logs(spark, sf_dir):
    """A log per labelled document: its lines and a closing line that depends on its source."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    closing = (
        F.when(number == 0, "Training Completed with return code: 0")
        .when(number == 1, "Traceback (most recent call last)")
        .when(number == 2, "ValueError in step; later: Model saved successfully")
        .when(number == 3, "Training completed with RETURN CODE: 2")
        .otherwise("still at it")
    )
    logged = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    lines = F.concat(F.split("text", "\n"), F.array(closing))
    return logged.select(F.col("doc_id").alias("file"), F.explode(lines).alias("value"))


def _any_sql(phrases: list[str]) -> str:
    return " OR ".join(f"contains(content, '{p}')" for p in phrases)


STATUS_SQL = f"""
    WITH logs AS (
        SELECT doc_id, lower(text || chr(10) || CASE regexp_extract(source, '(\\d+)$', 1)::INTEGER % 5
               WHEN 0 THEN 'Training Completed with return code: 0' WHEN 1 THEN 'Traceback (most recent call last)'
               WHEN 2 THEN 'ValueError in step; later: Model saved successfully'
               WHEN 3 THEN 'Training completed with RETURN CODE: 2' ELSE 'still at it' END) AS content
        FROM documents JOIN labels USING (doc_id))
    SELECT d.doc_id AS file, CASE WHEN content IS NULL THEN 'LOG_NOT_FOUND' WHEN {_any_sql(runs.SUCCESS_PHRASES)} THEN 'SUCCESS'
           WHEN {_any_sql(runs.ERROR_PHRASES)} THEN 'FAILED' ELSE 'UNKNOWN' END AS status
    FROM documents d LEFT JOIN logs USING (doc_id)
"""


def _status(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    return runs.run_status(_run_logs(spark, sf_dir), expected)


@check("log_status", STATUS_SQL)
def log_status(spark, sf_dir):
    return _status(spark, sf_dir)


@check(
    "log_summary",
    f"""
    SELECT CASE WHEN lang = 'de' OR status = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS outcome, count(*) AS n_runs
    FROM documents JOIN ({STATUS_SQL}) s ON s.file = doc_id GROUP BY 1
    """,
)
def log_summary(spark, sf_dir):
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), (F.col("lang") == "de").alias("success"))
    return runs.run_summary(runs.run_outcomes(results, _status(spark, sf_dir)))


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), (F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")
    )


@check(
    "agg_interval_avg",
    "SELECT event_type AS run, event_id // 100 AS interval, round(avg(value), 6) AS mean_loss FROM events GROUP BY ALL",
)
def agg_interval_avg(spark, sf_dir):
    means = runs.interval_means(_history(spark, sf_dir), 100)
    return means.select("run", "interval", F.round("mean_loss", 6).alias("mean_loss"))


@check(
    "agg_interval_last",
    """
    SELECT run, round(arg_max(mean_loss, i), 6) AS last_loss
    FROM (SELECT event_type AS run, event_id // 100 AS i, avg(value) AS mean_loss FROM events GROUP BY ALL) GROUP BY run
    """,
)
def agg_interval_last(spark, sf_dir):
    last = runs.last_interval(runs.interval_means(_history(spark, sf_dir), 100))
    return last.select("run", F.round("last_loss", 6).alias("last_loss"))


@check(
    "agg_best_trial",
    """
    SELECT study, arg_min(trial, (loss, trial)) AS trial, min(loss) AS loss
    FROM (SELECT event_type AS study, user_id AS trial, round(avg(value), 6) AS loss FROM events GROUP BY ALL) GROUP BY study
    """,
)
def agg_best_trial(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    trials = events.groupBy(F.col("event_type").alias("study"), F.col("user_id").alias("trial")).agg(
        F.round(F.avg("value"), 6).alias("loss")
    )
    return runs.best_trial(trials)


@check(
    "agg_early_stop",
    """
    WITH a AS (SELECT user_id AS run, event_id AS epoch, value, row_number() OVER w AS nth,
                      min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
         b AS (SELECT *, prev IS NULL OR value < prev AS better FROM a),
         c AS (SELECT *, max(nth) FILTER (better) OVER w AS last, max(epoch) FILTER (better) OVER w AS best_epoch,
                      min(value) OVER w AS best_metric FROM b WINDOW w AS (PARTITION BY run ORDER BY epoch)),
         s AS (SELECT run, min(epoch) FILTER (nth - last >= 5) AS stop_epoch, max(epoch) AS end_epoch FROM c GROUP BY run)
    SELECT run, stop_epoch, best_epoch, best_metric FROM s JOIN c USING (run) WHERE epoch = coalesce(stop_epoch, end_epoch)
    """,
)
def agg_early_stop(spark, sf_dir):
    history = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("metric")
    )
    return runs.early_stopping(history, patience=5)
