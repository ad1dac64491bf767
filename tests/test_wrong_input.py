"""Input that must not be cut, shifted or mixed up in silence."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moltable import runtime
from moltable.operators import pooling, score, splits, stats


@pytest.mark.parametrize("block_rows", [10, 1_000_000])
def test_group_folds_of_ids_beyond_the_block_size(spark, block_rows):
    rows = spark.createDataFrame([(5_000_000 + 7919 * i, f"g{i}") for i in range(300)], "row_idx bigint, key string")
    got = splits.group_kfold(rows, "key", 1, block_rows=block_rows).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 30, "test": 30, "train": 240}


def _kept(spark):
    rows = [(i, n, 0.0, 1.0) for i, n in enumerate("abc")]
    return spark.createDataFrame(rows, "label_idx int, label_name string, mean double, std double")


def test_labels_stay_in_their_places(spark):
    df = spark.createDataFrame([(["2.0", None, "4.0"],)], "v array<string>")
    assert stats.normalize_vectors(df, "v", _kept(spark)).first()["v"] == [2.0, None, 4.0]
    with pytest.raises(PySparkException, match="no number"):
        stats.normalize_vectors(spark.createDataFrame([(["1.0", "abc", "3.0"],)], "v array<string>"), "v", _kept(spark)).collect()


def test_label_vectors_of_another_width(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(PySparkException, match="expected 1 elements"):
        stats.label_stats(df, "v", ["a"]).collect()


def test_prediction_keeps_rows_apart(spark):
    load = score.linear_model(np.ones((2, 1)), np.zeros(1))
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "i int, v array<double>").coalesce(1)
    rows = score.predict(df, "v", load).orderBy("i").collect()
    assert [r["logits"] for r in rows] == [[3.0], None, [7.0]]
    with pytest.raises(PySparkException, match="differ in length"):
        score.predict(spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "v array<double>").coalesce(1), "v", load).collect()
    none = spark.createDataFrame([(None,)], "v array<double>")
    assert score.predict(none, "v", load).first()["logits"] is None


@pytest.mark.parametrize("vec", [[1.0], [1.0, 2.0, 3.0]])
def test_pooling_of_another_width(spark, vec):
    df = spark.createDataFrame([(0, 0, 0, 1, vec)], "seq_id int, layer int, pos int, mask int, vec array<double>")
    with pytest.raises(PySparkException, match="expected 2 elements"):
        pooling.pool(df, "mean", 2, 1).collect()


def test_merge_of_incomplete_models(spark):
    ddl = "model string, tensor string, vec array<double>"
    both = spark.createDataFrame([("a", "t", [1.0]), ("b", "t", [3.0])], ddl)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model string, weight double")
    assert pooling.linear_merge(both, weights).first()["value"] == 2.5
    with pytest.raises(PySparkException, match="no weight"):
        pooling.linear_merge(both, weights.where("model = 'a'")).collect()
    with pytest.raises(PySparkException, match="not every model"):
        pooling.linear_merge(both.where("model = 'a'"), weights, missing="error").collect()
    with pytest.raises(PySparkException, match="lengths differ"):
        pooling.linear_merge(both.withColumn("vec", F.when(F.col("model") == "a", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("vec"))), weights).collect()


class _Session:
    """What ``shared_folder`` looks at, of a session on a cluster."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(_, default):
            return default


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(_Session)
