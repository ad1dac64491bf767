import math

import pytest
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from moltable.operators.features import python_feature, text_slices
from moltable.functions import columns as fn
from moltable.operators import stats
from moltable.operators.features import computed_features, feature_failures

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    values = [(1.0, 5.0, 1), (2.0, 5.0, 2), (None, 5.0, 3), (NAN, 5.0, 4), (3.0, 5.0, 5)]
    return spark.createDataFrame(values, "x double, constant double, i int")


def test_zscore_policies(spark, odd):
    out = stats.normalize(odd).orderBy("i").collect()
    std = math.sqrt(2 / 3)
    assert [r.x for r in out] == pytest.approx([-1 / std, 0, 0, 0, 1 / std])
    assert [r.constant for r in out] == [0.0] * 5
    assert [r.i for r in out] == [1, 2, 3, 4, 5]


def test_zscore_with_infinity_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (-INF,)], "x double")
    assert {r.x for r in stats.normalize(df).collect()} == {0.0}


def test_zscore_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert stats.normalize(empty).count() == 0
    stat = stats.nan_stats(empty).first()
    assert math.isnan(stat.mean) and stat.std == 1.0


def test_zscore_from_train(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    other = spark.createDataFrame([(5.0,)], "x double")
    assert stats.normalize(other, fit_on=train).first().x == 4.0
    assert stats.normalize(other).first().x == 0.0


def test_float_columns_only(odd):
    assert fn.float_columns(odd) == ["x", "constant"]
    assert [r.column for r in stats.nan_stats(odd).collect()] == ["x", "constant"]


def test_log(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "x double")
    assert [r.x for r in stats.log_transform(df).collect()] == [0.0, None]
    for bad in (-1.0, -2.0):
        with pytest.raises(Exception, match="log1p"):
            stats.log_transform(spark.createDataFrame([(bad,)], "x double")).collect()


def test_transform_names():
    assert stats.transform_name("data/DELANEY/train.csv") == "zscore"
    assert stats.transform_name("data/clearance/train.csv") == "log1p"
    assert stats.transform_name("data/unheard.csv") == "zscore"


def test_undo_is_inverse(spark):
    df = spark.range(50).select((F.col("id") * 1.5).alias("x"))
    logged = stats.log_transform(df)
    back = stats.undo_transforms(stats.normalize(logged), [("log1p", None), ("zscore", logged)], ["x"])
    assert sorted(r.x for r in back.collect()) == pytest.approx([i * 1.5 for i in range(50)])


def test_vectors_and_texts(spark):
    df = spark.createDataFrame([([1.0, NAN, INF, -INF, None],)], "v array<double>")
    assert df.select(fn.nan_to_num(F.col("v"))).first()[0] == [1.0, 0.0, 0.0, 0.0, 0.0]
    texts = spark.createDataFrame([("",), ("inf",), ("-inf",), ("2.5",)], "t string")
    assert [r[0] for r in texts.select(fn.clean_property(F.col("t"))).collect()] == [0.0, 0.0, 0.0, 2.5]
    odd = spark.createDataFrame([(NAN,), (INF,), (-INF,), (1e300,), (1.0,)], "x double")
    clamped = [r[0] for r in odd.select(fn.to_float32(F.col("x")).cast("double")).collect()]
    assert clamped == [0.0, fn.FLOAT32_MAX, -fn.FLOAT32_MAX, fn.FLOAT32_MAX, 1.0]


def test_labels(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    kinds = [
        df.select(fn.pack_labels(c, t).alias("y")).dtypes[0][1]
        for c, t in ((["a"], "classification"), (["a", "b"], "classification"), (["a"], "regression"), (["a", "b"], "mtr"))
    ]
    assert kinds == ["bigint", "array<float>", "float", "array<float>"]


def test_names(spark):
    df = spark.createDataFrame([("a/b.csv",), ("b.csv",), ("x.csv/y.log/",)], "p string")
    assert [r[0] for r in df.select(fn.path_stem(F.col("p"))).collect()] == ["b", "b", "y.log"]
    assert [r[0] for r in df.select(fn.path_parent(F.col("p"))).collect()] == ["a", "", "x"]
    assert [r[0] for r in df.select(fn.log_basename(F.col("p"))).collect()] == ["b.csv", "b.csv", "y"]


def test_surface_names_and_subset(spark):
    assert len(stats.SURFACE_NAMES) == 49
    df = spark.createDataFrame(
        [(0, "TPSA", 1.0, 2.0), (1, "MolWt", 1.0, 2.0), (2, "SMR_VSA1", 1.0, 0.0)],
        "label_idx int, label_name string, mean double, std double",
    )
    assert [r.label_name for r in stats.keep_subset(df, "surface").collect()] == ["TPSA"]
    assert [tuple(r) for r in stats.label_dictionary(stats.keep_subset(df)).collect()] == [(0, "TPSA"), (1, "MolWt")]
    with pytest.raises(ValueError, match="subset"):
        stats.keep_subset(df, "volume")


def test_normalize_text_vectors(spark):
    kept = spark.createDataFrame(
        [(0, "a", 1.0, 2.0), (2, "c", 0.0, 1.0)], "label_idx int, label_name string, mean double, std double"
    )
    df = spark.createDataFrame([(["5", "7", ""],), (["inf", "7", "3"],), (["3"],)], "v array<string>")
    out = [r.v for r in stats.normalize_vectors(df, "v", kept).collect()]
    assert out == [[2.0, 0.0], [-0.5, 3.0], [1.0]]


def test_moments_merge_as_one_pass(spark):


    rows = spark.range(3000).select((F.lit(1e6) + F.sin(F.col("id").cast("double"))).alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") * 0.5).alias("y"))
    rows = rows.withColumns({"z": F.lit(None).cast("double"), "same": F.lit(2.5), "nan": F.when(rows.x > 1e6, F.lit(float("nan"))).otherwise(rows.x - 1e6)})
    lots = [rows.where(F.floor(F.col("x") * 100) % 3 == lot) for lot in range(3)] + [rows.where("false")]
    parts = stats.moments(lots[0])
    for lot in lots[1:]:
        parts = parts.unionByName(stats.moments(lot))
    merged = {r["column"]: r for r in stats.merged_moments(parts).collect()}
    for r in stats.nan_stats(rows).collect():
        got = merged.pop(r["column"])
        assert got["mean"] == pytest.approx(r["mean"], rel=1e-9, nan_ok=True) and got["std"] == pytest.approx(r["std"], rel=1e-9)
    assert not merged


def test_computed_features_once_per_string(spark):
    calls = spark.sparkContext.accumulator(0)

    def compute(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no structure")
        if text == "short":
            return [1.0]
        return [len(text), NAN if text == "nan" else None if text == "none" else INF if text == "inf" else 2, 7]

    texts = ["hot"] * 3000 + ["bad", "bad", "short", "nan", "none", "inf", "", None, None] + [f"t{i}" for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    made = computed_features(rows.withColumn("labels", F.lit("x")), "text", compute, ["n", "odd", "Ipc"])
    out = {r.id: r for r in made.collect()}
    assert calls.value == len({t for t in texts if t is not None})
    assert len(out) == len(texts) and made.columns == ["id", "text", "labels", "feature_error"]
    for i, text in enumerate(texts):
        failed = {"bad": "ValueError: no structure", "short": "ValueError: 1 features instead of 3", None: "no text"}.get(text)
        assert out[i].text == text and out[i].feature_error == failed
        assert out[i].labels == ([0.0, 0.0] if failed else [len(text), 0.0 if text in ("nan", "none", "inf") else 2.0])
    wrong = {tuple(r) for r in feature_failures(made, "id").collect()}
    assert wrong == {("ValueError: no structure", 2, 3000), ("ValueError: 1 features instead of 3", 1, 3002), ("no text", 2, 3007)}
    empty = computed_features(rows.where("id < 0"), "text", compute, ["n", "odd", "Ipc"])
    assert empty.count() == 0


def test_python_feature_takes_bounded_slices(spark):
    texts = ["ABc", "", None, "x" * 50, "É Z"] * 5
    cut = list(text_slices(pa.array(texts), 10))
    assert pa.concat_arrays(cut).to_pylist() == texts
    assert all(len(c) == 1 or pc.sum(pc.binary_length(c)).as_py() <= 10 for c in cut)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    out = df.select("i", python_feature("t", lambda t: float(sum(c.isupper() for c in t))).alias("n")).collect()
    assert {r.i: r.n for r in out} == {i: None if t is None else float(sum(c.isupper() for c in t)) for i, t in enumerate(texts)}
