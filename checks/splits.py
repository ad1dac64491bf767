"""Deduplication, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, table
from moltable.operators.prepare import dedup_first, sample_rows
from moltable.operators.splits import (
    group_kfold,
    group_map,
    many_splits,
    overlap_report,
    random_kfold,
    select_split,
    select_train_val,
)
from moltable.plans.prepare import TrainingSet, prepare


def random_sql(n: int, seed: int) -> str:
    return f"""
    SELECT fold, split, row_idx, row_number() OVER (PARTITION BY fold, split ORDER BY idx) - 1 AS pos_in_split
    FROM (SELECT fold, idx, doc_id AS row_idx,
                 CASE WHEN part = fold THEN 'val' WHEN part = (fold + 1) % {n} THEN 'test' ELSE 'train' END AS split
          FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{seed}-' || doc_id), doc_id) AS idx,
                       ntile({n}) OVER (ORDER BY md5('{seed}-' || doc_id), doc_id) - 1 AS part FROM documents),
               (SELECT unnest(range({n}))::INTEGER AS fold))
    """


RANDOM_SQL = random_sql(3, 7)


def group_sql(k: int) -> str:
    """Folds by groups of equal text, the greedy choice as one recursive query per fold."""
    parts = [
        "g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS i, text, count(*) AS n FROM documents GROUP BY text)",
        "cap AS (SELECT floor(0.1 * count(*))::BIGINT AS c FROM documents)",
        "g0 AS MATERIALIZED (SELECT i, n, FALSE AS used FROM g)",
    ]
    for f in range(k):
        parts.append(f"""
        f{f}(i, v, t, split) AS (
            SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, ''
            UNION ALL
            SELECT g.i,
                   CASE WHEN NOT g.used AND v + n <= c THEN v + n ELSE v END,
                   CASE WHEN NOT g.used AND v + n > c AND t + n <= c THEN t + n ELSE t END,
                   CASE WHEN g.used THEN 'train' WHEN v + n <= c THEN 'val' WHEN t + n <= c THEN 'test' ELSE 'train' END
            FROM f{f} JOIN g{f} g ON g.i = f{f}.i + 1, cap)""")
        parts.append(
            f"g{f + 1} AS MATERIALIZED (SELECT g{f}.i, n, used OR split <> 'train' AS used FROM g{f} JOIN f{f} USING (i))"
        )
    folds = " UNION ALL ".join(f"SELECT {f} AS fold, i, split FROM f{f}" for f in range(k))
    return f"""
    WITH RECURSIVE {", ".join(parts)}
    SELECT fold::INTEGER AS fold, split, doc_id AS row_idx FROM ({folds}) JOIN g USING (i) JOIN documents USING (text)
    """


@check("dedup_first", "SELECT min(doc_id) AS doc_id, any_value(n_chars) AS n_chars FROM documents GROUP BY text")
def q_dedup_first(spark, sf_dir):
    return dedup_first(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "n_chars")


@check("sample_n", "SELECT doc_id, n_chars FROM documents ORDER BY md5('11-' || doc_id), doc_id LIMIT 100")
def q_sample_n(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "documents"), 100, "doc_id", 11).select("doc_id", "n_chars")


@check("spl_random_kfold", RANDOM_SQL)
def q_random(spark, sf_dir):
    return random_kfold(table(spark, sf_dir, "documents"), 3, 7, "doc_id")


@check(
    "flt_split",
    f"SELECT row_idx AS doc_id, pos_in_split, n_chars FROM ({RANDOM_SQL}) JOIN documents ON doc_id = row_idx WHERE fold = 0 AND split = 'val'",
)
def q_flt_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assignment = random_kfold(docs, 3, 7, "doc_id").where("fold = 0")
    return select_split(docs, assignment, "validation", "doc_id").select("doc_id", "pos_in_split", "n_chars")


@check(
    "flt_split_pair",
    f"SELECT row_idx AS doc_id, split, pos_in_split, n_chars FROM ({RANDOM_SQL}) JOIN documents ON doc_id = row_idx WHERE fold = 1 AND split <> 'test'",
)
def q_flt_split_pair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assignment = random_kfold(docs, 3, 7, "doc_id").where("fold = 1")
    return select_train_val(docs, assignment, "doc_id").select("doc_id", "split", "pos_in_split", "n_chars")


@check(
    "spl_groups",
    "SELECT lang || '/' || source AS \"group\", min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1",
)
def q_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("group", F.concat_ws("/", "lang", "source"))
    return group_map(docs, "group", "doc_id")


@check("spl_group_kfold", group_sql(3))
def q_group_kfold(spark, sf_dir):
    return group_kfold(table(spark, sf_dir, "documents"), "text", 3, "doc_id")


@check(
    "spl_group_kfold_sparse",
    f"SELECT fold, split, row_idx * 7919 + 5000000 AS row_idx FROM ({group_sql(3)})",
)
def q_group_kfold_sparse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") * 7919 + 5_000_000)
    return group_kfold(docs, "text", 3, "doc_id")


@check(
    "spl_overlap",
    f"""
    WITH a AS MATERIALIZED ({group_sql(3)})
    SELECT split, sum((folds > 1)::INTEGER)::BIGINT AS n_overlap, any_value(lo) AS min_rows, any_value(hi) AS max_rows
    FROM (SELECT split, row_idx, count(*) AS folds FROM a WHERE split <> 'train' GROUP BY ALL)
    JOIN (SELECT split, min(n) AS lo, max(n) AS hi FROM (SELECT split, fold, count(*) AS n FROM a GROUP BY ALL) GROUP BY split)
    USING (split) GROUP BY split
    """,
)
def q_overlap(spark, sf_dir):
    return overlap_report(group_kfold(table(spark, sf_dir, "documents"), "text", 3, "doc_id"))


@check(
    "spl_many",
    f"""
    SELECT splitter, fold, split, count(*) AS n, sum(row_idx)::BIGINT AS sum_idx
    FROM (SELECT 'scaffold' AS splitter, fold, split, row_idx FROM ({group_sql(2)})
          UNION ALL SELECT 'random', fold, split, row_idx FROM ({random_sql(4, 3)}))
    GROUP BY ALL
    """,
)
def q_many(spark, sf_dir):
    made = many_splits(table(spark, sf_dir, "documents"), ["scaffold", "random"], [2, 4], "text", 3, "doc_id")
    return made.groupBy("splitter", "fold", "split").agg(F.count("*").alias("n"), F.sum("row_idx").alias("sum_idx"))


PREPARE_SQL = """
    WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents),
         u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)
    SELECT doc_id, md5(text) AS text, round((n_chars - m) / d, 6) AS y FROM documents JOIN u USING (doc_id), s
    ORDER BY md5('42-' || doc_id), doc_id LIMIT 150
"""


@check("plan_prepare", PREPARE_SQL)
def q_prepare(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("y", F.col("n_chars").cast("double"))
    spec = TrainingSet(
        "documents.csv", "text", "regression", 1, "y",
        apply_transforms=True, deduplicate=True, sample_size=150, seed=42, id_col="doc_id",
    )
    return prepare(docs, spec).select("doc_id", F.md5("text").alias("text"), F.round("y", 6).alias("y"))
