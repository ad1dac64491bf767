import math
import random
import weakref

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moltable.operators import metrics as m
from moltable.operators import runs
from moltable.operators.pooling import POOLINGS, linear_merge, pool
from moltable.operators.score import batch_map, linear_model, predict, store_weights, stored_model
from moltable.sources import readers
from moltable.streaming.logs import latest_log_table, latest_status, latest_table, stream_best_validation, stream_log_state


def _scored(spark, data, task="t"):
    return spark.createDataFrame([(task, float(s), y) for s, y in data], "task string, score double, label int")


def _auc(data):
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def _prc(data):
    p = sum(y for _, y in data)
    area, tp, fp, recall, precision = 0.0, 0, 0, 0.0, 1.0
    for s in sorted({s for s, _ in data}, reverse=True):
        tp += sum(1 for t, y in data if t == s and y)
        fp += sum(1 for t, y in data if t == s and not y)
        r, q = tp / p, tp / (tp + fp)
        area += (r - recall) * (q + precision) / 2
        recall, precision = r, q
    return area


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_ranking_metrics_with_ties(spark, spread):
    rng = random.Random(spread)
    data = [(rng.randrange(spread), int(rng.random() < 0.3)) for _ in range(1500)]
    df = _scored(spark, data)
    assert m.roc_auc(df).first().roc_auc == pytest.approx(_auc(data))
    assert m.prc_auc(df).first().prc_auc == pytest.approx(_prc(data))


def test_undefined_ranking(spark):
    one = _scored(spark, [(1, 1), (2, 1)], "one").union(_scored(spark, [(1, 0)], "row")).union(_scored(spark, [(1, 0), (2, 1)], "ok"))
    assert {r.task: r.roc_auc for r in m.roc_auc(one).collect()} == {"one": None, "row": None, "ok": 1.0}
    assert {r.task: r.prc_auc for r in m.prc_auc(one).collect()} == {"one": None, "row": None, "ok": 1.0}
    assert m.mean_score(m.roc_auc(one), "roc_auc").first()[0] == 1.0


def test_losses(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0, 3.0, 1.0), ([0.0, 0.0], 1, 0.0, 0.0)], "z array<double>, c int, x double, y double")
    ce = df.agg(m.cross_entropy(F.col("z"), F.col("c"))).first()[0]
    assert ce == pytest.approx(math.log(2) / 2)
    bce = df.agg(m.bce_with_logits(F.col("x"), F.col("y"))).first()[0]
    assert bce == pytest.approx((math.log1p(math.exp(-3)) + math.log(2)) / 2)
    vectors = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "p array<double>, y array<double>")
    assert m.mse_vectors(vectors, "p", "y").first().loss == 2.5


def test_problem_types(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1, [1.0, 0.0], 0.5)], "z array<double>, c int, ys array<float>, y float")
    types = [m.problem_type(df.schema[c].dataType, n) for c, n in (("y", 1), ("c", 1), ("c", 2), ("ys", 2))]
    assert types == ["regression", "regression", "single_label_classification", "multi_label_classification"]


def _lines(spark, logs):
    data = [(f, (f, 0, i), v) for f, text in logs.items() for i, v in enumerate(text.split("\n"))]
    return spark.createDataFrame(data, "file string, line_at struct<path:string,block:bigint,line:bigint>, value string")


LOGS = {
    "a": "Val mean-roc_auc_score: 0.5\nVal mean-roc_auc_score: 0.75 x\nVal mean-roc_auc_score: none\n"
    "Final Triplicate Test Results - Avg mean-roc_auc_score: 0.6, Std Dev: 0.1\n"
    "Final Triplicate Test Results - Avg mean-roc_auc_score: 0.9, Std Dev: 0.2",
    "b": "Val rms_score: 12.5\nVal rms_score: 20.25\nFinal Triplicate Test Results - Avg rms_score: 11.0, Std Dev: 0.5",
    "c": "Val rms_score: 1.5\nVal rms_score: 7",
    "d": "nothing here",
}


def test_log_table(spark):
    rows = {r.file: r for r in runs.log_table(_lines(spark, LOGS)).collect()}
    made = {file: tuple(r)[1:5] for file, r in rows.items()}
    assert made["a"] == (0.75, None, 0.6, None)
    assert made["b"] == (None, 12.5, None, 11.0)
    assert made["c"] == (None, 1.5, None, None)
    assert made["d"] == (None, None, None, None)
    assert made["AVERAGE (all)"] == (0.75, 7.0, 0.6, 11.0)
    assert made["AVERAGE (no outliers)"] == (0.75, 1.5, 0.6, None)
    shown = {r.file: r.min_val_rms for r in runs.display_table(runs.log_table(_lines(spark, LOGS))).collect()}
    assert shown["b"] == "12.5000" and shown["a"] == "N/A"
    assert (rows["a"].final_roc_std, rows["b"].final_rms_std, rows["AVERAGE (all)"].final_roc_std) == (0.1, 0.5, None)
    finals = {r.file: (r.final_roc, r.final_rms) for r in runs.display_table(runs.log_table(_lines(spark, LOGS))).collect()}
    assert finals["a"] == ("0.6000 ± 0.1000", "N/A") and finals["AVERAGE (all)"] == ("0.6000", "11.0000")


def test_logs_without_lines(spark, tmp_path):
    (tmp_path / "full.log").write_text("Val rms_score: 1.5\nTraining complete\n")
    (tmp_path / "empty.log").write_text("")
    logs, lines = readers.list_logs(spark, str(tmp_path)), readers.read_log_lines(spark, str(tmp_path))
    assert dict(map(tuple, logs.collect())) == {"full": 37, "empty": 0}
    assert {r.file: r.min_val_rms for r in runs.best_validation(lines, logs).collect()} == {"full": 1.5, "empty": None}
    assert {r.file for r in runs.log_table(lines, logs).collect()} >= {"full", "empty"}
    expected = spark.createDataFrame([("full",), ("empty",), ("gone",), ("broken",)], "file string")
    listed = logs.unionByName(spark.createDataFrame([("broken", 9)], "file string, n_bytes bigint"))
    got = dict(map(tuple, runs.run_status(lines, expected, listed).collect()))
    assert got == {"full": "SUCCESS", "empty": "UNKNOWN", "gone": "LOG_NOT_FOUND", "broken": "ERROR_READING_LOG"}


def test_final_results(spark):
    out = {r.file: tuple(r)[1:] for r in runs.final_results(_lines(spark, LOGS)).collect()}
    assert out == {"a": (0.6, 0.1, None, None), "b": (None, None, 11.0, 0.5)}


def test_status(spark):
    logs = {
        "both": "Error: disk\nTraining Complete",
        "bad": "ok\nTRACEBACK follows",
        "open": "step 1",
    }
    expected = spark.createDataFrame([(n,) for n in [*logs, "gone"]], "file string")
    status = runs.run_status(_lines(spark, logs), expected)
    got = dict(map(tuple, status.collect()))
    assert got == {"both": "SUCCESS", "bad": "FAILED", "open": "UNKNOWN", "gone": "LOG_NOT_FOUND"}
    results = spark.createDataFrame([("both", False), ("bad", False), ("open", True), ("gone", False)], "file string, success boolean")
    summary = runs.run_summary(runs.run_outcomes(results, status))
    assert dict(map(tuple, summary.collect())) == {"SUCCESS": 2, "FAILED": 2}


def test_streamed_logs_grow(spark, tmp_path):
    folder, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    (folder / "a.log").write_text("Val rms_score: 2.5\n")
    stream_best_validation(spark, str(folder), out, progress).awaitTermination()
    assert [tuple(r) for r in latest_table(spark, out).collect()] == [("a", None, 2.5)]
    (folder / "b.log").write_text("Val mean-roc_auc_score: 0.5\n")
    stream_best_validation(spark, str(folder), out, progress).awaitTermination()
    assert sorted(map(tuple, latest_table(spark, out).collect())) == [("a", None, 2.5), ("b", 0.5, None)]


def test_streamed_log_table_is_the_batch_one(spark, tmp_path):
    folder, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    triggers = [  # a log is a folder of parts, or one file
        {"a.log/part-1": LOGS["a"].split("\n")[0] + "\n", "b.log/part-2": LOGS["b"], "d.log/part-0": LOGS["d"]},
        {"a.log/part-3": "\n".join(LOGS["a"].split("\n")[4:]), "b.log/part-1": LOGS["b"].replace("11.0", "9.0").replace("20.25", "3.5")},
        {"a.log/part-2": "\n".join(LOGS["a"].split("\n")[1:4]) + "\nTraining complete", "c.log": LOGS["c"] + "\nan Error"},
    ]
    expected = spark.createDataFrame([(n,) for n in "abcde"], "file string")
    for files in triggers:
        for name, text in files.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(text)
        stream_log_state(spark, str(folder), out, progress).awaitTermination()
        lines = readers.read_log_lines(spark, str(folder))
        assert sorted(map(repr, latest_log_table(spark, out).collect())) == sorted(map(repr, runs.log_table(lines).collect()))
        got = latest_status(spark, out, expected)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs.run_status(lines, expected).collect()))
    rows = {r.file: tuple(r)[1:5] for r in latest_log_table(spark, out).collect()}
    assert rows["a"] == (0.75, None, 0.6, None) and rows["b"] == (None, 3.5, None, 9.0)
    changed = {r.epoch: r.n for r in spark.read.parquet(out).groupBy("epoch").agg(F.count("*").alias("n")).collect()}
    assert [n for _, n in sorted(changed.items()) if n] == [3, 2, 2]


def _stop(values, patience):
    best, best_at, waited = None, None, 0
    for i, v in enumerate(values):
        if best is None or v < best:
            best, best_at, waited = v, i, 0
        else:
            waited += 1
        if waited >= patience:
            return i, best_at, best
    return None, best_at, best


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_early_stopping(spark, block):
    rng = random.Random(block)
    histories = {r: [rng.randint(0, 60) / 2 for _ in range(40)] for r in range(6)}
    histories[6] = [float(-i) for i in range(40)]
    data = [(r, e, v) for r, vs in histories.items() for e, v in enumerate(vs)]
    df = spark.createDataFrame(data, "run int, epoch bigint, metric double").repartition(5)
    out = {r.run: tuple(r)[1:] for r in runs.early_stopping(df, 5, block_epochs=block).collect()}
    assert out == {r: _stop(vs, 5) for r, vs in histories.items()}


def test_intervals(spark):
    df = spark.createDataFrame([("r", i + 1, float(i)) for i in range(25)], "run string, step bigint, loss double")
    means = runs.interval_means(df, 10)
    assert sorted(map(tuple, means.collect())) == [("r", 0, 4.5), ("r", 1, 14.5), ("r", 2, 22.0)]
    assert runs.last_interval(means).first().last_loss == 22.0


def _states(spark, n_seq=3, n_layers=4, n_pos=5, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n_seq, n_layers, n_pos, dim))
    mask = (np.arange(n_pos) < np.array([[5], [3], [2]])).astype(int)
    data = [
        (s, layer, p, int(mask[s, p]), [float(v) for v in x[s, layer, p]])
        for s in range(n_seq) for layer in range(n_layers) for p in range(n_pos)
    ]
    return spark.createDataFrame(data, "seq_id int, layer int, pos int, mask int, vec array<double>"), x, mask


def test_pooling_against_arrays(spark):
    states, x, mask = _states(spark)
    states = states.repartition(5)
    last, top = x[:, -1], x[:, -2:]
    want = {
        "cls": last[:, 0],
        "mean": (last * mask[..., None]).sum(1) / mask.sum(1)[:, None],
        "max_cls": top.max(1)[:, 0],
        "max_seq_mean": top.max(1).mean(1),
        "sum_mean": x.sum(1).mean(1),
        "sum_sum": x.sum(1).sum(1),
        "mean_sum": x.mean(1).sum(1),
        "mean_mean": x.mean(1).mean(1),
    }
    assert set(want) == set(POOLINGS)
    for how, vectors in want.items():
        out = {r.seq_id: r.vec for r in pool(states, how, 6, 4, 2).collect()}
        for s in range(3):
            assert out[s] == pytest.approx(list(vectors[s])), how


def test_pooling_name(spark):
    with pytest.raises(ValueError, match="pooling"):
        pool(_states(spark)[0], "median", 6, 4)


def test_wide_vectors_are_one_row(spark):
    wide = spark.range(40).select(
        F.expr("id div 4").alias("seq_id"), F.lit(0).alias("layer"), (F.col("id") % 4).alias("pos"), F.lit(1).alias("mask"),
        F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.col("id") * 1.0 + i).alias("vec"),
    )
    pooled = pool(wide, "mean_mean", 5000, 1)
    assert "Generate" not in pooled._jdf.queryExecution().optimizedPlan().toString()
    assert {r.seq_id: (r.vec[0], r.vec[4999]) for r in pooled.collect()} == {i: (4 * i + 1.5, 4 * i + 5000.5) for i in range(10)}


@pytest.mark.parametrize("page", [4096, 3])
def test_merge_in_pages(spark, monkeypatch, page):
    monkeypatch.setattr("moltable.operators.pooling.PAGE", page)
    rng = np.random.default_rng(0)
    shapes, share = {"a": 10, "b": 1, "c": 6, "empty": 0}, {"m1": 0.5, "m2": 2.0, "m3": 1.0}
    vectors = {(m, t): rng.normal(size=n) for m in share for t, n in shapes.items() if (m, t) != ("m3", "c")}
    rows = [(m, t, v.tolist()) for (m, t), v in vectors.items()]
    tensors = spark.createDataFrame(rows, "model string, tensor string, vec array<double>").repartition(3)
    weights = spark.createDataFrame(list(share.items()), "model string, weight double")
    got = {(r.tensor, r.idx): r.value for r in linear_merge(tensors, weights).collect()}
    for t, n in shapes.items():
        held = [m for m in share if (m, t) in vectors]
        for i in range(n):
            mean = sum(share[m] * vectors[m, t][i] for m in held) / sum(share[m] for m in held)
            assert got.pop((t, i)) == pytest.approx(mean)
    assert not got


def test_labels_outside_the_classes(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0], -100), ([1.0, 2.0], None)], "x array<double>, y int")
    loss = df.agg(m.cross_entropy(F.col("x"), F.col("y"))).first()[0]
    assert loss == pytest.approx(np.log(np.exp(1) + np.exp(2)) - 1)
    for bad in (2, -1):
        with pytest.raises(PySparkException, match="no such class"):
            df.withColumn("y", F.lit(bad)).agg(m.cross_entropy(F.col("x"), F.col("y"))).collect()


def test_merge(spark):
    tensors = spark.createDataFrame(
        [("m1", "w", [1.0, 2.0]), ("m2", "w", [3.0, 6.0]), ("m1", "b", [5.0])], "model string, tensor string, vec array<float>"
    )
    weights = spark.createDataFrame([("m1", 1.0), ("m2", 3.0)], "model string, weight double")
    merged = sorted(map(tuple, linear_merge(tensors, weights).collect()))
    assert merged == [("b", 0, 5.0), ("w", 0, 2.5), ("w", 1, 5.0)]


def test_scoring(spark):
    df = spark.range(10).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(3)
    model = linear_model(np.array([[2.0], [0.5]]), np.array([1.0]))
    out = {r.id: r.logits for r in predict(df, "v", model).collect()}
    assert out == {i: [2.0 * i + 1.5] for i in range(10)}


def test_large_head_is_mapped_from_a_file(spark, tmp_path):
    weights = np.zeros((64, 400_000))  # 205 MB
    weights[:, 0], weights[3, -1] = 1.0, 2.0
    load = stored_model(spark, store_weights(spark, f"{tmp_path}/large_head.npy", weights))
    assert len(cloudpickle.dumps(load)) < 10_000
    df = spark.range(6).select("id", F.when(F.col("id") != 4, F.array(*[F.col("id").cast("float")] * 64)).alias("v"))
    scored = predict(df, "v", load, batch_bytes=1 << 20)
    out = scored.select("id", F.size("logits").alias("n"), F.element_at("logits", 1).alias("a"), F.element_at("logits", -1).alias("z"))
    assert {tuple(r) for r in out.collect()} == {(i, 400_000, 64.0 * i, 2.0 * i) for i in (0, 1, 2, 3, 5)} | {(4, None, None, None)}
    with pytest.raises(Exception, match="exists"):
        store_weights(spark, f"{tmp_path}/large_head.npy", weights[:, :2])


@pytest.mark.parametrize("limit,most", [(1, 1), (8 * 3 * 5, 5), (1 << 20, 100)])
def test_models_get_batches_of_bounded_bytes(spark, limit, most):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).coalesce(1)

    def load():
        def score(batch):
            return np.full((len(batch), 1), len(batch), float)

        score.outputs = 1
        return score

    sizes = [r.logits[0] for r in predict(df, "v", load, batch_bytes=limit).collect()]
    assert len(sizes) == 100 and max(sizes) == most


def test_batches_are_bounded(spark):
    df = spark.range(5000).coalesce(1)
    out = batch_map(df, lambda b: b.assign(n=len(b)), "n bigint", remove=["id"])
    assert out.agg(F.max("n"), F.count("*")).first()[:] == (2048, 5000)


def test_batches_are_freed(spark):
    seen = []

    def measure(batch):
        alive = sum(earlier() is not None for earlier in seen)
        text = batch["text"]
        seen.append(weakref.ref(text))
        return batch.assign(length=text.str.len(), alive=alive)  # text and text.str refer to each other

    df = spark.range(25_000).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).coalesce(1)
    out = batch_map(df, measure, "id bigint, length bigint, alive bigint", remove=["text"])
    assert out.agg(F.max("alive"), F.count("*"), F.countDistinct("id")).first()[:] == (0, 25_000, 25_000)
    assert out.where("length <> id % 7").count() == 0


def test_batched_functions_may_keep_what_they_get(spark):
    kept = []

    def first_words(batch):
        kept.append(batch)
        return batch.assign(first=kept[0]["text"].iloc[0], n=sum(len(b) for b in kept))

    df = spark.range(12_000, numPartitions=1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = batch_map(df, first_words, "first string, n bigint", remove=["text"])
    assert out.agg(F.min("first"), F.max("first"), F.max("n"), F.count("*")).first()[:] == ("t0", "t0", 12_000, 12_000)
