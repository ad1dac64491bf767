"""Scalar and array functions, and the transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import LINEITEM_FLOATS
from checks.registry import check, table
from moltable.functions import columns as fn
from moltable.operators.stats import log_transform, normalize, transform_name_column, undo_transforms


@check(
    "fn_zscore",
    f"""
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in LINEITEM_FLOATS)}
    FROM lineitem, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_FLOATS)} FROM lineitem)
    """,
)
def q_zscore(spark, sf_dir):
    scored = normalize(table(spark, sf_dir, "lineitem"))
    return scored.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in LINEITEM_FLOATS])


@check("fn_log1p", "SELECT event_id, round(ln(1 + value), 6) AS value FROM events")
def q_log1p(spark, sf_dir):
    logged = log_transform(table(spark, sf_dir, "events"))
    return logged.select("event_id", F.round("value", 6).alias("value"))


DATASET_NAMES = ["Delaney", "freesolv", "Lipo", "clearance", "bace_regression", "tox21"]


@check(
    "fn_dispatch",
    f"""
    SELECT p_partkey, CASE ({DATASET_NAMES}::VARCHAR[])[(p_size % 6 + 1)::INTEGER] WHEN 'clearance' THEN 'log1p' ELSE 'zscore' END AS transform
    FROM part
    """,
)
def q_dispatch(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in DATASET_NAMES])
    path = F.concat(F.lit("data/"), F.get(names, F.col("p_size") % 6), F.lit("/train.csv"))
    return table(spark, sf_dir, "part").select("p_partkey", transform_name_column(path).alias("transform"))


@check("fn_undo", "SELECT event_id, round(value, 6) AS value FROM events")
def q_undo(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    logged = log_transform(events)
    back = undo_transforms(normalize(logged), [("log1p", None), ("zscore", logged)], ["value"])
    return back.select("event_id", F.round("value", 6).alias("value"))


def _odd_values(spark, sf_dir):
    """Event values, with NaN and infinities by event type."""
    kind = F.col("event_type")
    odd = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").withColumn("odd", odd)


@check(
    "fn_nan_to_num",
    "SELECT event_id, value AS v0, CASE WHEN event_type IN ('error', 'click', 'view') THEN 0 ELSE value END AS v1 FROM events",
)
def q_nan_to_num(spark, sf_dir):
    vec = fn.nan_to_num(F.array("value", "odd"))
    return _odd_values(spark, sf_dir).select("event_id", vec[0].alias("v0"), vec[1].alias("v1"))


@check(
    "fn_clean_property",
    "SELECT event_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN 0 ELSE value END AS value FROM events",
)
def q_clean_property(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "").when(kind == "click", "inf").when(kind == "view", "-inf").otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", fn.clean_property(text).alias("value"))


@check(
    "fn_clamp_f32",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 3.4028234663852886e38
                     WHEN 'view' THEN -3.4028234663852886e38 ELSE value END AS value FROM events
    """,
)
def q_clamp(spark, sf_dir):
    return _odd_values(spark, sf_dir).select("event_id", fn.clamp_float(F.col("odd")).alias("value"))


@check("fn_labels_pack", "SELECT p_partkey, p_size::DOUBLE AS y0, p_retailprice::FLOAT::DOUBLE AS y1 FROM part")
def q_labels_pack(spark, sf_dir):
    packed = table(spark, sf_dir, "part").select("p_partkey", fn.pack_labels(["p_size", "p_retailprice"], "regression").alias("y"))
    return packed.select("p_partkey", F.col("y")[0].cast("double").alias("y0"), F.col("y")[1].cast("double").alias("y1"))


@check(
    "fn_label_dtype",
    """
    SELECT doc_id, quality::BIGINT AS one_class, 'bigint' AS one_class_type, 'array<float>' AS two_class_type,
           'float' AS value_type FROM labels
    """,
)
def q_label_dtype(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    one, two = fn.pack_labels(["quality"], "classification"), fn.pack_labels(["quality", "toxic"], "classification")
    value = fn.pack_labels(["quality"], "regression")
    return labels.select(
        "doc_id",
        one.alias("one_class"),
        F.typeof(one).alias("one_class_type"),
        F.typeof(two).alias("two_class_type"),
        F.typeof(value).alias("value_type"),
    )


@check(
    "fn_path_stem",
    r"""
    SELECT page_id, replace(parts[-1], '.csv', '') AS stem, parts[-2] AS parent, regexp_replace(parts[-1], '\.log$', '') AS log_stem
    FROM (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS parts FROM pages)
    """,
)
def q_path_stem(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.path_stem(url).alias("stem"), fn.path_parent(url).alias("parent"), fn.log_basename(url).alias("log_stem")
    )


@check(
    "fn_fmt4",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'N/A' ELSE printf('%.4f', value) END AS shown FROM events",
)
def q_fmt4(spark, sf_dir):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", fn.display4(value).alias("shown"))
