import json
import warnings

import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moltable.operators import validate
from moltable.operators.features import feature_names, feature_table, pick_variant, warn_if_kept
from moltable.operators.prepare import clean_index, keep_labels
from moltable.runtime import local_path, new_path, shared_folder, stage
from moltable.sources import catalog, readers, writers


def test_csv_keeps_backslashes_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("F/C=C\\F", 1.5), ('say "hi", there', 2.0), ("C\\", None)], "smiles string, y double")
    path = str(tmp_path / "t.csv")
    writers.write_csv(df, path)
    assert sorted(map(tuple, readers.read_csv(spark, path).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_pandas_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿,smiles,index,y\n0,CC,7,1\n1,C\\C,8,\n2,CCO,9,3\n", encoding="utf-8")
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        out = clean_index(df, "smiles")
    assert any("index" in str(w.message) for w in caught)
    assert sorted(out.columns) == ["row_idx", "smiles", "y"]
    assert [tuple(r) for r in out.orderBy("row_idx").select("row_idx", "smiles", "y").collect()] == [
        (0, "CC", 1), (1, "C\\C", None), (2, "CCO", 3)
    ]


def test_unreadable_table(spark, tmp_path):
    with pytest.raises(RuntimeError, match="missing.csv"):
        readers.read_table(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(RuntimeError, match="xyz"):
        readers.read_table(spark, str(tmp_path / "t.xyz"))


def test_file_order_over_many_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part{i}.csv").write_text("smiles\n" + "".join(f"{i}-{j}\n" for j in range(100)))
    df = readers.read_csv(spark, str(tmp_path), "smiles string")
    out = clean_index(df, "smiles").orderBy("row_idx").collect()
    assert [(r.row_idx, r.smiles) for r in out] == [(100 * i + j, f"{i}-{j}") for i in range(5) for j in range(100)]


def test_file_order_over_many_blocks(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"part{i}.csv").write_text("smiles\n" + "".join(f"{i}-{j}\n" for j in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_csv(spark, str(tmp_path), "smiles string")
        assert df.rdd.getNumPartitions() > 4
        out = clean_index(df, "smiles").orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_idx, r.smiles) for r in out] == [(3000 * i + j, f"{i}-{j}") for i in range(2) for j in range(3000)]


def test_split_record(spark, tmp_path):
    record = {"train": [3, 0], "val": [2], "test": [1]}
    (tmp_path / "set_0.scaffold_splits.json").write_text(json.dumps(record, indent=2))
    out = readers.read_split_record(spark, str(tmp_path / "set.csv"))
    got = {(r.split, r.pos_in_split): r.row_idx for r in out.collect()}
    assert got == {("train", 0): 3, ("train", 1): 0, ("val", 0): 2, ("test", 0): 1}
    with pytest.raises(FileNotFoundError, match="other_0"):
        readers.read_split_record(spark, str(tmp_path / "other.csv"))


def test_normalization_round_trip(spark, tmp_path):
    rows = [(1, "b", 2.0, 3.0), (0, "a", 0.5, 1.0)]
    stats = spark.createDataFrame(rows, "label_idx int, label_name string, mean double, std double")
    writers.write_normalization(stats, str(tmp_path / "n"))
    back = readers.read_normalization(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_reads_single_record_files(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"mean": [1.0], "std": [2.0], "label_names": ["MolWt"]}))
    assert [tuple(r) for r in readers.read_normalization(spark, str(tmp_path / "n.json")).collect()] == [(0, "MolWt", 1.0, 2.0)]
    (tmp_path / "p.jsonl").write_text('{"smile": "CC", "labels": [1.0, 2.5]}\n{"smile": "C", "labels": [0.0, 0.0]}\n')
    assert readers.read_properties(spark, str(tmp_path / "p.jsonl")).agg(F.sum(F.col("labels")[1])).first()[0] == 2.5


def test_log_files(spark, tmp_path):
    (tmp_path / "b.log").write_text("One\nTwo\n")
    (tmp_path / "a.log").write_text("Three\n")
    (tmp_path / "notes.txt").write_text("no\n")
    lines = readers.read_log_lines(spark, str(tmp_path)).orderBy("line_at").collect()
    assert [(r.file, r.value) for r in lines] == [("a", "Three"), ("b", "One"), ("b", "Two")]
    whole = readers.read_log_whole(spark, str(tmp_path)).orderBy("file").collect()
    assert [tuple(r) for r in whole] == [("a", "three\n"), ("b", "one\ntwo\n")]


def test_text_items(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "", None), (3, None, "c")], "k int, t string, p string")
    assert sorted(map(tuple, readers.text_items(df, "t", "p", ["k"]).collect())) == [(1, 0, "a"), (1, 1, "b"), (3, 1, "c")]


def test_checks(spark):
    df = spark.createDataFrame([("C", 1.0, 2)], "smiles string, y double, z int")
    with pytest.raises(KeyError, match="smile"):
        validate.require_columns(df, ["smile"])
    with pytest.raises(ValueError, match="task"):
        validate.check_task("ranking")
    assert validate.resolve_labels(df, "smiles", "y") == ["y"]
    assert validate.resolve_labels(df, "smiles", ["y", "no"]) == ["y"]
    assert validate.resolve_labels(df, "smiles", "*") == ["y", "z"]
    assert validate.resolve_labels(df, "smiles", None) == []
    with pytest.raises(ValueError, match="expected 3"):
        validate.check_arity(["y"], 3, "regression", df.columns)
    assert validate.check_arity([], 3, "mlm", df.columns) == []
    assert keep_labels(df, "smiles", None).columns == ["smiles"]


def test_catalog(spark):
    counts = {r.task: r["count"] for r in catalog.dataset_catalog(spark).groupBy("task").count().collect()}
    assert counts == {"classification": 9, "regression": 15}
    none = spark.createDataFrame([("a", 0)], "name string, n_rows bigint")
    with pytest.raises(Exception, match="greater than zero"):
        catalog.budget_plan(none, 3, 32, 1e-4, 128.0).collect()


def test_features(spark):
    df = spark.createDataFrame([(1, "CC"), (2, ""), (3, None)], "i int, t string")
    features = {"n": F.length("t"), "odd": F.lit(float("inf")), "Ipc": F.lit(9.0)}
    assert feature_names(features) == ["n", "odd"]
    out = {r.i: r.labels for r in feature_table(df, "t", features).collect()}
    assert out == {1: [2.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_pick_variant(spark):
    originals = spark.createDataFrame([(1, "a"), (2, "x"), (3, "q")], "i int, o string")
    variants = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "x")], "i int, v string")
    picked = pick_variant(originals, variants, "i", "o", "v", 0)
    assert sorted(map(tuple, picked.collect())) == [(1, "a", "b", False), (2, "x", "x", True), (3, "q", "q", True)]
    with pytest.warns(UserWarning, match="no other variant"):
        warn_if_kept(picked)


def test_pick_variant_is_fair(spark):
    originals = spark.range(300).select(F.col("id").alias("i"), F.lit("v0").alias("o"))
    variants = originals.select("i", F.explode(F.array(*[F.lit(f"v{k}") for k in range(4)])).alias("v"))
    counts = {r.picked: r["count"] for r in pick_variant(originals, variants, "i", "o", "v", 1).groupBy("picked").count().collect()}
    assert set(counts) == {"v1", "v2", "v3"} and min(counts.values()) > 60


def test_stage_is_under_the_shared_folder(spark):
    path = new_path(spark, "x")
    assert path.startswith(shared_folder(spark)) and path != new_path(spark, "x")
    assert stage(spark.range(3), "ids").count() == 3


def test_split_record_of_many_positions(spark, tmp_path):
    """Cut into several tasks, with every form a JSON writer may give it."""
    lists = {"train": [7 * i for i in range(300_000)], "other": [1, 2], "val": [], "test": [-1, None, 5]}
    path = tmp_path / "big_0.scaffold_splits.json"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for indent in (None, 1):
            path.write_text(json.dumps(lists, indent=indent))
            assert spark.read.text(str(path), lineSep=",").rdd.getNumPartitions() > 3
            got = [tuple(r) for r in readers.read_split_record(spark, str(tmp_path / "big.csv")).collect()]
            want = [(s, at, x) for s in ("train", "test") for at, x in enumerate(lists[s])]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for odd, want in (('{"train": null, "val": [ 3 ]}', [("val", 0, 3)]), ("{}", []), ('{"test":[4\n,\n5]\n}\n', [("test", 0, 4), ("test", 1, 5)])):
        path.write_text(odd)
        assert sorted(map(tuple, readers.read_split_record(spark, str(tmp_path / "big.csv")).collect())) == want


def test_sinks_leave_nothing_when_they_fail(spark, tmp_path):
    from moltable.plans.prepare import feature_job
    from moltable.sources.writers import write_splits

    rows = spark.range(100).select(
        F.lit("random").alias("splitter"), F.lit(0).alias("fold"), F.lit("train").alias("split"), F.col("id").alias("row_idx"), F.col("id").alias("pos_in_split")
    ).repartition(4)
    broken = rows.withColumn("row_idx", F.when(F.col("row_idx") == 77, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("row_idx")))
    with pytest.raises(PySparkException, match="lost"):
        write_splits(broken, str(tmp_path / "splits"))
    text = F.col("row_idx").cast("string")
    with pytest.raises(PySparkException, match="lost"):
        feature_job(broken.select(text.alias("t")), "t", {"n": F.length("t").cast("double")}, str(tmp_path / "features"))
    assert list(tmp_path.iterdir()) == []
    write_splits(rows, str(tmp_path / "splits"))
    assert readers.read_split_rows(spark, str(tmp_path / "splits")).count() == 100
    with pytest.raises(FileExistsError):
        write_splits(rows, str(tmp_path / "splits"))
    paths = feature_job(rows.select(text.alias("t")), "t", {"n": F.length("t").cast("double")}, str(tmp_path / "features"))
    assert readers.read_properties(spark, paths[0]).count() == 100
    assert sorted(p.name for p in tmp_path.iterdir()) == ["features", "splits"]


def test_page_logs_are_one_file_each_written_and_listed_by_bounded_tasks(spark, tmp_path):
    from checks import sources
    from moltable.sources import readers

    rows = [(i, f"<P>{i}\n") for i in range(120)] + [(7, "<b>again")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    folder = sources.page_logs(spark, str(tmp_path))
    parts = [p for p in pathlib.Path(folder).rglob("part-*") if p.suffix == ".txt"]
    assert len(parts) == 120 and len({p.name[:10] for p in parts}) > 4
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "")
    whole = readers.read_log_whole(spark, folder)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(tasks) <= readers.LISTING_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == own
    got = {r.file: sorted(r.content.split("\n")) for r in whole.collect()}
    assert len(got) == 120 and got["page_7"] == ["", "", "<b>again", "<p>7"] and got["page_8"] == ["", "", "<p>8"]


LOGS = [("a.log", "One"), ("b.log", None), ("b.log", "\u00c4\nx"), ("c=1 %.log", ""), ("notes", "no"), (None, "none"), ("", "empty")]


def test_logs_on_a_disk_are_not_written_through_hadoop(spark, tmp_path):
    folder = tmp_path / "logs"
    logs = spark.createDataFrame([*LOGS, *((f"p{i}.log", f"L{i}") for i in range(60))], "file string, value string")
    writers.write_logs(logs, f"file://{folder}")
    files = [p for p in folder.rglob("*") if p.is_file()]
    # Hadoop leaves a checksum beside each file and starts processes for both. Drafts are gone; null and empty names share a part.
    assert all(p.name.startswith("part-") and p.suffix == ".txt" for p in files) and len(files) == 65
    logs.write.partitionBy("file").text(str(tmp_path / "spark"))
    assert sorted(p.name for p in folder.iterdir()) == sorted(p.name for p in (tmp_path / "spark").iterdir() if p.is_dir())
    got = {r.file: r.content for r in readers.read_log_whole(spark, str(folder)).collect()}
    want = {r.file: r.content for r in readers.read_log_whole(spark, str(tmp_path / "spark")).collect()}
    assert {f: sorted(c.split("\n")) for f, c in got.items()} == {f: sorted(c.split("\n")) for f, c in want.items()}
    assert got["a"] == "one\n" and sorted(got["b"].split("\n")) == ["", "", "x", "\u00e4"] and len(got) == 63
    with pytest.raises(FileExistsError):
        writers.write_logs(logs, str(folder))


def test_logs_in_another_store_are_written_by_spark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}/in")
    assert local_path(spark, "viewfs://logs/in/x") is None and local_path(spark, str(tmp_path)) == str(tmp_path)
    writers.write_logs(spark.createDataFrame(LOGS, "file string, value string"), "viewfs://logs/in/x")
    got = {r.file: sorted(r.content.split("\n")) for r in readers.read_log_whole(spark, "viewfs://logs/in/x").collect()}
    assert got["a"] == ["", "one"] and got["b"] == ["", "", "x", "\u00e4"] and len(got) == 3


def test_very_many_logs_are_read_by_bounded_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.log").write_text(f"A{i}\n")
    whole = readers.read_log_whole(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # a task for each log
    try:
        assert whole.rdd.getNumPartitions() <= readers.READING_PER_CORE * spark.sparkContext.defaultParallelism < 300
        assert {r.file: r.content for r in whole.collect()} == {str(i): f"a{i}\n" for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
