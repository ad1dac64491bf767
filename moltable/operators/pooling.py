"""Pooling of token vectors to one vector per sequence.

Input: (seq_id, layer, pos, mask, vec), layers counted from 0, one row per cell of the grid.
Only ``mean`` looks at the mask; the others take padding in, as the models do.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltable.functions.columns import of_size

PAGE = 4096  # elements of a tensor that are merged as one row
POOLINGS = ("cls", "mean", "max_cls", "max_seq_mean", "sum_mean", "sum_sum", "mean_sum", "mean_mean")  # fixed values
_REDUCE = {"sum": (np.add, 0.0), "max": (np.maximum, -np.inf)}  # and what a missing element counts as

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(vectors: pa.Array, missing: float) -> np.ndarray:
    cells = pc.fill_null(vectors.flatten().cast(pa.float64()), missing).to_numpy(zero_copy_only=False)
    return cells.reshape(len(vectors), -1)


def _reduced(table: pa.Table | pa.RecordBatch, keys: list[str], how: str) -> pa.RecordBatch:
    """One row per key: its vectors reduced element by element. Equal rows of keys are brought together by sorting."""
    ufunc, missing = _REDUCE[how]
    frame = pd.DataFrame({k: table.column(k).to_pandas() for k in keys})
    code = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    vectors = table.column("vec")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    cells = ufunc.reduceat(_matrix(vectors, missing)[order], first, axis=0)
    heads = pa.array(order[first])
    offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * cells.shape[1])
    named = [table.column(k).take(heads) for k in keys]
    named = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in named]
    return pa.record_batch([*named, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], names=[*keys, "vec"])


def aggregate_vectors(df: DataFrame, keys: list[str], dim: int, how: str) -> DataFrame:
    """(keys, vec): the element-wise ``sum`` or ``max`` of vectors of ``dim`` elements per key; a null element is left out.

    The rows of one value of the first key, a sequence, meet in one group. One plan for any width: a task reduces the rows of each Arrow batch first, so what is shuffled is a row per key and
    batch, never one per element, and the generated code does not grow with the vectors.
    """
    cells = df.select(*keys, of_size(F.col("vec"), dim).cast("array<double>").alias("vec"))
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _reduced(batch, keys, how)

    def finally_(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_reduced(table, keys, how)])

    return cells.mapInArrow(partly, schema).groupBy(keys[0]).applyInArrow(finally_, schema)


def pool(states: DataFrame, how: str, dim: int, n_layers: int, last_k: int = 8) -> DataFrame:
    """(seq_id, vec) under one of the pooling rules.

    Sums and means over layers and positions are linear, so they are one aggregate each, divided
    by the number of layers or positions at the end, which is added up as one more element; only a maximum needs two levels.
    """
    if how not in POOLINGS:
        raise ValueError(f"pooling must be one of {POOLINGS}, got {how!r}")
    states = states.withColumn("vec", of_size(F.col("vec"), dim))
    last = states.where(F.col("layer") == n_layers - 1)
    top = states.where(F.col("layer") >= n_layers - last_k)

    def counted(df: DataFrame, vec: Column, weight: Column) -> tuple[DataFrame, Column]:
        """Summed vectors, and the sum of the weights, their last element."""
        both = df.withColumn("vec", F.concat(vec.cast("array<double>"), F.array(weight.cast("double"))))
        return aggregate_vectors(both, ["seq_id"], dim + 1, "sum"), F.get("vec", F.lit(dim))

    def divided(df: DataFrame, by: Column) -> DataFrame:
        return df.select("seq_id", F.transform(F.slice("vec", 1, dim), lambda x: x / by).alias("vec"))

    if how == "cls":
        return last.where("pos = 0").select("seq_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    if how == "mean":
        return divided(*counted(last, F.transform("vec", lambda x: x * F.col("mask")), F.col("mask")))
    if how == "max_cls":
        return aggregate_vectors(top.where("pos = 0"), ["seq_id"], dim, "max")
    if how == "max_seq_mean":
        return divided(*counted(aggregate_vectors(top, ["seq_id", "pos"], dim, "max"), F.col("vec"), F.lit(1)))
    over_layers, over_positions = how.split("_")
    summed, positions = counted(states, F.col("vec"), F.col("layer") == n_layers - 1)
    by = F.lit(float(n_layers) if over_layers == "mean" else 1.0)
    return divided(summed, by * positions if over_positions == "mean" else by)


def linear_merge(tensors: DataFrame, weights: DataFrame, missing: str = "skip") -> DataFrame:
    """Weighted mean of same-named tensors over models: (tensor, idx, value).

    ``tensors`` is (model, tensor, vec), of any length per tensor, and ``weights`` (model, weight),
    one row per model. The weights of the models that have the tensor are scaled to sum to one; with
    ``missing="error"`` every weighted model must have it. A model without a weight and a tensor whose length
    differs between models are errors. Tensors are cut into pages of PAGE elements, and a page of every model meets in
    one group: what is shuffled is a row per page, and a tensor of millions of elements is never one value.
    """
    if missing not in ("skip", "error"):
        raise ValueError(f"missing must be 'skip' or 'error', got {missing!r}")
    size = F.size("vec")
    shapes = tensors.groupBy("tensor").agg(F.min(size).alias("_least"), F.max(size).alias("_most"), F.count("*").alias("_n"))
    joined = tensors.join(weights, "model", "left").join(shapes, "tensor")

    def wrong(text: str, column: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.col(column).cast("string"))).cast("double")

    weight = F.when(F.col("weight").isNull(), wrong("no weight for model ", "model"))
    weight = weight.when(F.col("_least") != F.col("_most"), wrong("lengths differ of ", "tensor"))
    if missing == "error":
        weight = weight.when(F.col("_n") != weights.agg(F.count("*")).scalar(), wrong("not every model has ", "tensor"))
    weight = weight.otherwise(F.col("weight")).alias("weight")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(PAGE)))
    pages = F.posexplode(F.transform(starts, lambda at: F.slice("vec", at + 1, PAGE).cast("array<double>"))).alias("page", "vec")
    paged = joined.select("tensor", "model", weight, pages)
    schema = T.StructType([tensors.schema["tensor"], T.StructField("page", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("model")  # the same sum in every run
        weights = table.column("weight").to_numpy()
        cells = _matrix(table.column("vec").combine_chunks(), 0.0)
        mean = weights @ cells / weights.sum()
        return pa.table([table.column("tensor")[:1], table.column("page")[:1], pa.array([mean])], names=schema.names)

    merged = paged.groupBy("tensor", "page").applyInArrow(merge, schema)
    return merged.select("tensor", "page", F.posexplode("vec").alias("at", "value")).select(
        "tensor", (F.col("page") * PAGE + F.col("at")).alias("idx"), "value"
    )
