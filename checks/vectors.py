"""Pooling, merging and batch scoring of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.features import CELLS_SQL
from checks.registry import check, table
from moltable.operators.pooling import linear_merge, pool
from moltable.operators.score import batch_map, linear_model, predict, store_weights, stored_model
from moltable.operators.stats import log_transform, undo_transforms
from moltable.runtime import new_path

DIM, LAYERS, LAST_K = 64, 4, 3


def _states(spark, sf_dir):
    """Sixteen vectors in a row are a sequence; layers are scaled copies with changing sign."""
    vectors = table(spark, sf_dir, "embeddings")
    layered = vectors.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))))
    factor = (F.col("layer") + 1) * F.when(F.col("layer") % 2 == 0, 1.0).otherwise(-1.0)
    pos = (F.col("vec_id") % 16).cast("int")
    return layered.select(
        F.expr("vec_id div 16").alias("seq_id"),
        "layer",
        pos.alias("pos"),
        (pos <= F.col("label")).cast("int").alias("mask"),
        F.transform("embedding", lambda x: x.cast("double") * factor).alias("vec"),
    )


STATES_SQL = f"""
    SELECT vec_id // 16 AS seq_id, layer, vec_id % 16 AS pos, (vec_id % 16 <= label)::INTEGER AS mask, idx,
           x * (layer + 1) * (CASE WHEN layer % 2 = 0 THEN 1 ELSE -1 END) AS x
    FROM ({CELLS_SQL}), (SELECT unnest(range({LAYERS})) AS layer)
"""
LAST, TOP = f"layer = {LAYERS - 1}", f"layer >= {LAYERS - LAST_K}"


def _grouped(value: str, where: str = "TRUE", source: str = f"({STATES_SQL})") -> str:
    return f"SELECT seq_id, idx, {value} AS v FROM {source} WHERE {where} GROUP BY seq_id, idx"


PER_POS = f"(SELECT seq_id, pos, idx, max(x) AS x FROM ({STATES_SQL}) WHERE {TOP} GROUP BY seq_id, pos, idx)"
POOL_SQL = {
    "cls": f"SELECT seq_id, idx, x AS v FROM ({STATES_SQL}) WHERE {LAST} AND pos = 0",
    "mean": _grouped("sum(x * mask) / sum(mask)", LAST),
    "max_cls": _grouped("max(x)", f"{TOP} AND pos = 0"),
    "max_seq_mean": _grouped("avg(x)", source=PER_POS),
    "sum_mean": _grouped("sum(x) / count(DISTINCT pos)"),
    "sum_sum": _grouped("sum(x)"),
    "mean_sum": _grouped("sum(x) / count(DISTINCT layer)"),
    "mean_mean": _grouped("avg(x)"),
}


def _register_pool(how: str) -> None:
    @check(f"pool_{how}", f"SELECT seq_id, idx::INTEGER AS idx, round(v, 6) AS v FROM ({POOL_SQL[how]})")
    def query(spark, sf_dir):
        pooled = pool(_states(spark, sf_dir), how, DIM, LAYERS, LAST_K)
        return pooled.select("seq_id", F.posexplode("vec").alias("idx", "v")).select("seq_id", "idx", F.round("v", 6).alias("v"))


for _how in POOL_SQL:
    _register_pool(_how)

MODEL_DIM = 768


def _register_model_pool(how: str) -> None:
    """The same vectors, twelve times side by side: as wide as those of a usual model."""
    wide = MODEL_DIM // DIM

    @check(f"pool_{how}_768", f"SELECT seq_id, (idx + {DIM} * k)::INTEGER AS idx, round(v, 6) AS v FROM ({POOL_SQL[how]}), (SELECT unnest(range({wide})) AS k)")
    def query(spark, sf_dir):
        states = _states(spark, sf_dir).withColumn("vec", F.flatten(F.array_repeat("vec", wide)))
        pooled = pool(states, how, MODEL_DIM, LAYERS, LAST_K)
        return pooled.select("seq_id", F.posexplode("vec").alias("idx", "v")).select("seq_id", "idx", F.round("v", 6).alias("v"))


for _how in ("mean", "max_seq_mean", "mean_mean"):
    _register_model_pool(_how)


@check(
    "agg_linear_merge",
    f"""
    SELECT vec_id // 10 AS tensor, idx::INTEGER AS idx, round(sum(x * w) / sum(w), 6) AS v
    FROM ({CELLS_SQL}), (SELECT unnest(range(10)) AS model, 1.0::DOUBLE / (1 + unnest(range(10))) AS w)
    WHERE vec_id % 10 = model GROUP BY ALL
    """,
)
def agg_linear_merge(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    tensors = vectors.select(
        (F.col("vec_id") % 10).alias("model"), F.expr("vec_id div 10").alias("tensor"), F.col("embedding").alias("vec")
    )
    weights = spark.createDataFrame([(i, 1.0 / (1 + i)) for i in range(10)], "model bigint, weight double")
    return linear_merge(tensors, weights).select("tensor", "idx", F.round("value", 6).alias("v"))


@check(
    "udf_predict",
    f"""
    SELECT vec_id, round(sum(x * (idx + 1) / 64)::DOUBLE + 0.5, 3) AS first,
           round(sum(CASE WHEN idx % 2 = 0 THEN x ELSE -x END) - 0.25, 3) AS second
    FROM ({CELLS_SQL}) GROUP BY vec_id
    """,
)
def udf_predict(spark, sf_dir):
    idx = np.arange(DIM)
    weights = np.stack([(idx + 1) / 64.0, np.where(idx % 2 == 0, 1.0, -1.0)], axis=1)
    scored = predict(table(spark, sf_dir, "embeddings"), "embedding", linear_model(weights, np.array([0.5, -0.25])))
    logit = [F.round(F.col("logits")[i].cast("double"), 3) for i in (0, 1)]
    return scored.select("vec_id", logit[0].alias("first"), logit[1].alias("second"))


@check(
    "udf_predict_stored",
    f"""
    SELECT vec_id, round(sum(x * (idx + 1) / 64)::DOUBLE + 0.5, 3) AS first, round(sum(x * (idx % 7))::DOUBLE, 3) AS last
    FROM ({CELLS_SQL}) GROUP BY vec_id
    """,
)
def udf_predict_stored(spark, sf_dir):
    """A wide head of 4,096 outputs from a file that every worker maps; its first and last outputs are compared."""
    idx = np.arange(DIM)
    weights = np.zeros((DIM, 4096))
    weights[:, 0], weights[:, -1] = (idx + 1) / 64.0, idx % 7
    path = store_weights(spark, new_path(spark, "head") + ".npy", weights, np.eye(1, 4096)[0] / 2)
    scored = predict(table(spark, sf_dir, "embeddings"), "embedding", stored_model(spark, path))
    logit = [F.round(F.element_at("logits", i).cast("double"), 3) for i in (1, -1)]
    return scored.select("vec_id", logit[0].alias("first"), logit[1].alias("last"))


@check(
    "udf_predict_undo",
    f"""
    SELECT vec_id, round(exp(least(s * 0.01, 3) * d + m) - 1, 3) AS value
    FROM (SELECT vec_id, sum(x) AS s FROM ({CELLS_SQL}) GROUP BY vec_id),
         (SELECT avg(ln(1 + value)) AS m, stddev_pop(ln(1 + value)) AS d FROM events)
    """,
)
def udf_predict_undo(spark, sf_dir):
    """Logits of a model trained on transformed labels, brought back to the labels' own scale."""
    logged = log_transform(table(spark, sf_dir, "events").select("event_id", "value"))
    scored = predict(table(spark, sf_dir, "embeddings"), "embedding", linear_model(np.full((DIM, 1), 0.01), np.zeros(1)))
    value = F.least(F.col("logits")[0].cast("double"), F.lit(3.0)).alias("value")
    back = undo_transforms(scored.select("vec_id", value), [("log1p", None), ("zscore", logged)], ["value"])
    return back.select("vec_id", F.round("value", 3).alias("value"))


@check("udf_batch_map", "SELECT doc_id, length(text) AS length, len(string_split(text, chr(10))) AS n_lines FROM documents")
def udf_batch_map(spark, sf_dir):
    def measure(batch):
        return batch.assign(length=batch["text"].str.len(), n_lines=batch["text"].str.count("\n") + 1)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return batch_map(docs, measure, "doc_id bigint, length bigint, n_lines bigint", remove=["text"])
