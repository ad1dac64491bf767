import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moltable.operators import index
from moltable.operators import splits as sp
from moltable.operators.prepare import dedup_first, sample_rows


def _frame(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "row_idx bigint, key string").repartition(7)


def _greedy(keys, k):
    """The rule in plain words: one group after the other, in first-seen order."""
    groups = {}
    for i, key in enumerate(keys):
        if key is not None:
            groups.setdefault(key, []).append(i)
    cut = math.floor(0.1 * len(keys))
    used, folds = set(), []
    for _ in range(k):
        fold = {"train": [], "val": [], "test": []}
        for key, members in groups.items():
            name = "train"
            if key not in used:
                name = next((s for s in ("val", "test") if len(fold[s]) + len(members) <= cut), "train")
                if name != "train":
                    used.add(key)
            fold[name].extend(members)
        folds.append({s: sorted(m) for s, m in fold.items()})
    full = all(len(f[s]) == cut for f in folds for s in ("val", "test"))
    return folds, full


def _made(assignment, k):
    folds = [{"train": [], "val": [], "test": []} for _ in range(k)]
    for r in assignment.collect():
        folds[r.fold][r.split].append(r.row_idx)
    return [{s: sorted(m) for s, m in f.items()} for f in folds]


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 16), (3, 7), (4, 50), (5, 3)])
def test_group_folds_equal_the_rule(spark, seed, block):
    rng = random.Random(seed)
    keys = []
    while len(keys) < 300:
        keys += [f"g{len(keys)}"] * rng.choice([1, 1, 1, 2, 3, 9, 35])
    keys = keys[:300]
    if seed % 2:
        rng.shuffle(keys)
    for i in rng.sample(range(300), 10):
        keys[i] = None
    want, full = _greedy(keys, 2)
    if full:
        assert _made(sp.group_kfold(_frame(spark, keys), "key", 2, block_rows=block), 2) == want
    else:
        with pytest.raises(sp.SplittingError):
            sp.group_kfold(_frame(spark, keys), "key", 2, block_rows=block)
        with pytest.warns(UserWarning, match="missing"):
            made = sp.group_kfold(_frame(spark, keys), "key", 2, on_underfull="warn", block_rows=block)
        assert _made(made, 2) == want


def test_group_folds_with_blocks_let_go(spark, monkeypatch):
    monkeypatch.setattr(sp, "KEPT_BLOCKS", 1)
    rng = random.Random(11)
    keys = [key for g in range(400) for key in [f"g{g}"] * rng.choice([1, 1, 2, 5, 8, 21])]
    want, full = _greedy(keys, 3)
    assert full
    assert _made(sp.group_kfold(_frame(spark, keys), "key", 3, block_rows=20), 3) == want


def test_group_folds_take_few_jobs(spark):
    rng = random.Random(5)
    keys = [key for g in range(3000) for key in [f"g{g}"] * rng.choice([1, 1, 2, 5, 8])]
    rng.shuffle(keys)
    df, context = _frame(spark, keys), spark.sparkContext
    context.setJobGroup("folds", "folds")
    made = sp.group_kfold(df, "key", 3)
    jobs = len(context.statusTracker().getJobIdsForGroup("folds"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20, jobs  # each stage of an adaptive plan is one
    assert _made(made, 3) == _greedy(keys, 3)[0]


def test_group_larger_than_a_tenth_trains(spark):
    keys = ["big"] * 60 + [f"s{i}" for i in range(140)]
    made = sp.group_kfold(_frame(spark, keys), "key", 3)
    assert made.where("split <> 'train' and row_idx < 60").count() == 0
    report = {r.split: (r.n_overlap, r.min_rows, r.max_rows) for r in sp.overlap_report(made).collect()}
    assert report == {"val": (0, 20, 20), "test": (0, 20, 20)}
    assert made.groupBy("fold", "row_idx").count().where("count <> 1").count() == 0


def test_underfull_groups_raise(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    with pytest.raises(sp.SplittingError):
        sp.group_kfold(events, "user_id", 1, "event_id")


@pytest.mark.parametrize("n", [3, 5, 7])
def test_random_folds(spark, n):
    df = spark.range(100).withColumnRenamed("id", "row_idx")
    made = sp.random_kfold(df, n, 1).collect()
    sizes = Counter((r.fold, r.split) for r in made)
    long, short = math.ceil(100 / n), 100 // n
    for f in range(n):
        assert sizes[f, "val"] == (long if f < 100 % n else short)
        assert sizes[f, "test"] == sizes[(f + 1) % n, "val"]
        assert sizes[f, "train"] == 100 - sizes[f, "val"] - sizes[f, "test"]
    for f in range(n):
        for s in ("train", "val", "test"):
            places = sorted(r.pos_in_split for r in made if r.fold == f and r.split == s)
            assert places == list(range(len(places)))
    again = sp.random_kfold(df.repartition(7), n, 1).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_random_folds_need_three(spark):
    for n in (1, 2):
        with pytest.raises(ValueError, match="at least 3"):
            sp.random_kfold(spark.range(10).withColumnRenamed("id", "row_idx"), n, 1)


def test_many_checks_its_arguments(spark):
    df = _frame(spark, ["a"])
    with pytest.raises(ValueError, match="number of folds"):
        sp.many_splits(df, ["random"], [3, 4], "key", 0)
    with pytest.raises(NotImplementedError, match="butina"):
        sp.many_splits(df, ["butina"], [3], "key", 0)


def test_split_names():
    assert [sp.split_name(s) for s in ("train", "training", "test", "validation", "val", "dev")] == [
        "train", "train", "test", "val", "val", "val"
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index(spark, parts):
    df = spark.range(1000).select((F.col("id") % 10).alias("hot"), "id").repartition(parts)
    out = index.with_global_index(df, ["hot", "id"]).collect()
    want = {(h, i): n for n, (h, i) in enumerate(sorted((i % 10, i) for i in range(1000)))}
    assert {(r.hot, r.id): r.row_idx for r in out} == want


def test_running_totals(spark):
    rng = random.Random(0)
    data = [(rng.choice("aab"), i, float(rng.randint(-50, 50))) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t bigint, x double").repartition(5)
    running = {
        "total": ("sum", F.col("x"), True),
        "lowest": ("min", F.col("x"), False),
        "highest": ("max", F.col("x"), True),
    }
    out = index.with_running(df, ["k"], F.expr("t div 13"), ["t"], running).collect()
    for k in "ab":
        seen = []
        for r in sorted((r for r in out if r.k == k), key=lambda r: r.t):
            assert r.lowest == (min(seen) if seen else None)
            seen.append(r.x)
            assert r.total == sum(seen) and r.highest == max(seen)


@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_keeps_the_first(spark, parts):
    keys = ["z", "a", "z", None, "a", "b", None]
    df = _frame(spark, keys).repartition(parts)
    assert sorted(r.row_idx for r in dedup_first(df, "key").collect()) == [0, 1, 3, 5]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 5000])
def test_sample_is_exact_and_repeatable(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    one = sorted(r.row_idx for r in sample_rows(df, n, "row_idx", 3).collect())
    two = sorted(r.row_idx for r in sample_rows(df.repartition(5), n, "row_idx", 3).collect())
    assert len(one) == min(n, 1000) and one == two


def test_samples_nest_and_differ_by_seed(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    small = {r.row_idx for r in sample_rows(df, 50, "row_idx", 3).collect()}
    large = {r.row_idx for r in sample_rows(df, 200, "row_idx", 3).collect()}
    other = {r.row_idx for r in sample_rows(df, 50, "row_idx", 4).collect()}
    assert small < large and small != other
    assert sample_rows(df, None, "row_idx", 3).count() == 1000


def test_one_text_in_a_third_of_the_rows(spark):
    keys = [("hot" if i % 3 == 0 else f"k{i}") for i in range(3000)]
    df = _frame(spark, keys)
    kept = dedup_first(df, "key")
    assert kept.count() == 2001 and kept.where("key = 'hot'").first().row_idx == 0
    made = sp.group_kfold(df, "key", 2, block_rows=100)
    want, full = _greedy(keys, 2)
    assert full and _made(made, 2) == want
