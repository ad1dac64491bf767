"""Batch scoring and batched maps: model code inside Arrow batches, one model per task."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2048  # rows per batch of a batched map
BATCH_BYTES = 32 << 20  # of the vectors that a model gets at a time, as 64-bit floats, and of the logits it makes of them

# Tasks get these functions by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def linear_model(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loader of the scorer that ships with the package: logits = vectors @ weights + bias."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        return lambda batch: batch @ weights + bias

    return load


def store_weights(spark: SparkSession, path: str, weights: np.ndarray, bias: np.ndarray | None = None) -> str:
    """Write a linear head (inputs, outputs), and its bias as a last row, to a new file that ``stored_model`` loads.

    ``path`` lies in any store that Spark reaches and ends in ``.npy``. The driver holds the head in any case; it goes through a file of
    the driver's own, which is removed.
    """
    bias = np.zeros(weights.shape[1]) if bias is None else bias
    files, context = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    target = files.Path(path)
    with tempfile.TemporaryDirectory() as own:
        np.save(f"{own}/head.npy", np.vstack([weights, bias]))
        system = target.getFileSystem(context._jsc.hadoopConfiguration())
        system.copyFromLocalFile(False, False, files.Path(f"file://{own}/head.npy"), target)
    return path


def stored_model(spark: SparkSession, path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loader of a linear head from a file as ``store_weights`` writes it; nothing of the head travels with the tasks.

    Spark brings the file to each executor once. Every task maps it instead of reading it, so all workers of a machine share
    one copy in its page cache. An executor that takes the place of a lost one fetches the file again. File
    names must differ between models of a session.
    """
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def load() -> Callable[[np.ndarray], np.ndarray]:
        head = np.load(SparkFiles.get(name), mmap_mode="r")

        def score(batch: np.ndarray) -> np.ndarray:
            return batch @ head[:-1] + head[-1]

        score.outputs = head.shape[1]
        return score

    return load


def predict(
    df: DataFrame,
    vec_col: str,
    load: Callable[[], Callable],
    name: str = "logits",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Add the logits of a model as an array of 32-bit floats.

    ``load`` is called once per task and returns a function from a batch (rows, width) to logits
    (rows, outputs). The function gets as many rows as ``batch_bytes`` hold, at least one, counting the vectors and, if it has
    an attribute ``outputs``, the logits, which go back to Spark in the same pieces. Undo the label transforms on the result with ``undo_transforms``. A null vector has
    null logits; vectors of different lengths in a batch are an error.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            widths = batch.value_lengths().drop_null().unique().to_pylist()
            if len(widths) > 1:
                raise ValueError("vectors of one batch differ in length")
            width = widths[0] if widths else 0
            step = max(1, batch_bytes // (8 * max(1, width + getattr(model, "outputs", 0))))
            for at in range(0, len(batch), step):
                piece = batch.slice(at, step)
                there = piece.is_valid().to_numpy(zero_copy_only=False)
                vectors = piece.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rows = int(there.sum())
                logits = np.asarray(model(vectors.reshape(rows, width)), dtype=np.float32) if rows else np.empty(0, np.float32)
                offsets = pa.array(np.arange(rows + 1) * (logits.size // max(rows, 1)), type=pa.int32())
                found = pa.ListArray.from_arrays(offsets, pa.array(logits.ravel()))
                yield found.take(pa.array(np.cumsum(there) - 1, mask=~there))

    return df.withColumn(name, run(vec_col))


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, remove: list[str] = ()) -> DataFrame:
    """Apply ``fn`` to batches of at most BATCH_ROWS rows; ``remove`` leaves out consumed columns.

    ``schema`` describes what ``fn`` returns once the removed columns are gone. ``fn`` may keep what it gets.

    A worker holds one Arrow batch as pandas objects and what ``fn`` makes of one of its pieces, whatever the number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                out = fn(batch.iloc[start : start + BATCH_ROWS].reset_index(drop=True))
                yield out.drop(columns=[c for c in remove if c in out.columns])
                # A column and its .str refer to each other and hold the texts; Python looks for such circles by the number of
                # objects, not by their size, so they are looked for here, among the young ones.
                del out
                gc.collect(1)
            # Spark holds the frame while it makes the next one.
            batch.drop(columns=batch.columns, inplace=True)

    return df.mapInPandas(run, schema)
