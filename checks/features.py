"""Feature tables, label statistics and label vectors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.registry import check, table, texts
from moltable.operators.features import computed_features, feature_failures, feature_table, pick_variant, python_feature, text_features
from moltable.operators.stats import (
    SURFACE_NAMES,
    append_moments,
    keep_subset,
    label_dictionary,
    label_stats,
    merged_moments,
    nan_stats,
    normalize_by,
    normalize_vectors,
)
from moltable.runtime import new_path

NAMES = ["n_chars", "n_letters", "n_upper", "n_digits", "n_brackets", "n_bonds", "n_distinct", "entropy"]


def _count_sql(letters: str) -> str:
    return f"length(regexp_replace(text, '[^{letters}]', '', 'g'))"


FEATURE_SQL = f"""
    SELECT doc_id, text, length(text) AS n_chars, {_count_sql("A-Za-z")} AS n_letters, {_count_sql("A-Z")} AS n_upper,
           {_count_sql("0-9")} AS n_digits, {_count_sql(r"\[\]()")} AS n_brackets, {_count_sql("-=#:/")} AS n_bonds,
           len(chars) AS n_distinct,
           list_sum([-(length(text) - length(replace(text, c, ''))) / length(text)
                     * ln((length(text) - length(replace(text, c, ''))) / length(text)) FOR c IN chars]) AS entropy
    FROM (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '(?s).')) AS chars FROM documents)
"""


@check(
    "feat_table",
    f"SELECT doc_id, {', '.join(f'round({n}, 6)::DOUBLE AS {n}' for n in NAMES)} FROM ({FEATURE_SQL})",
)
def feat_table(spark, sf_dir):
    docs = texts(spark, sf_dir)
    features = {**text_features(F.col("text")), "Ipc": F.lit(1e300)}
    made = feature_table(docs, "text", features)
    return made.select("doc_id", *[F.round(F.col("labels")[i], 6).alias(n) for i, n in enumerate(NAMES)])


@check(
    "udf_feature",
    "SELECT doc_id, length(text)::DOUBLE AS n_chars, len(regexp_extract_all(text, '[A-Z]'))::DOUBLE AS n_upper FROM documents",
)
def udf_feature(spark, sf_dir):
    def upper_letters(text):
        return float(len(re.findall("[A-Z]", text)))

    docs = texts(spark, sf_dir)
    made = feature_table(docs, "text", {"n_chars": F.length("text"), "n_upper": python_feature("text", upper_letters)})
    return made.select("doc_id", F.col("labels")[0].alias("n_chars"), F.col("labels")[1].alias("n_upper"))


# A library that cannot handle every string, in SQL and in Python: bars must pair, and an address is refused.
LIBRARY_FAILS = """
    CASE WHEN text LIKE '%@%' THEN 'ValueError: an address is no structure'
         WHEN (length(text) - length(replace(text, '|', ''))) % 2 = 1 THEN 'ArithmeticError: bars do not pair' END
"""


def _library(text):
    if "@" in text:
        raise ValueError("an address is no structure")
    if text.count("|") % 2:
        raise ArithmeticError("bars do not pair")
    digits = sum(text.count(d) for d in "0123456789")
    return [len(text), 1e300, digits, digits / len(text) if text else None]


def _from_library(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return computed_features(docs, "text", _library, ["n_chars", "Ipc", "n_digits", "digit_share"])


@check(
    "feat_computed",
    f"""
    SELECT doc_id, error, CASE WHEN error IS NULL THEN length(text) ELSE 0 END::DOUBLE AS n_chars,
           CASE WHEN error IS NULL THEN digits ELSE 0 END::DOUBLE AS n_digits,
           round(CASE WHEN error IS NULL AND length(text) > 0 THEN digits / length(text) ELSE 0 END, 6)::DOUBLE AS digit_share
    FROM (SELECT doc_id, text, {LIBRARY_FAILS} AS error, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents)
    """,
)
def feat_computed(spark, sf_dir):
    made, cells = _from_library(spark, sf_dir), ["n_chars", "n_digits", "digit_share"]
    cells = [F.round(F.col("labels")[i], 6).alias(n) for i, n in enumerate(cells)]
    return made.select("doc_id", F.col("feature_error").alias("error"), *cells)


@check(
    "feat_failures",
    f"""
    SELECT error, count(*) AS n_rows, min(doc_id) AS first_id
    FROM (SELECT doc_id, {LIBRARY_FAILS} AS error FROM documents) WHERE error IS NOT NULL GROUP BY error
    """,
)
def feat_failures(spark, sf_dir):
    return feature_failures(_from_library(spark, sf_dir), "doc_id")


def _numbers(spark, sf_dir):
    """Numeric features of documents with one that never varies."""
    docs = table(spark, sf_dir, "documents")
    vec = F.array(
        F.col("n_chars").cast("double"), F.lit(1.0), F.length("lang").cast("double"), F.col("doc_id").cast("double")
    )
    return docs.select("doc_id", vec.alias("labels")), ["n_chars", "constant", "lang_length", "doc_number"]


NUMBER_STATS_SQL = """
    SELECT * FROM (
        SELECT 0 AS label_idx, 'n_chars' AS label_name, stddev_pop(n_chars) AS std FROM documents
        UNION ALL SELECT 1, 'constant', stddev_pop(1.0) FROM documents
        UNION ALL SELECT 2, 'lang_length', stddev_pop(length(lang)) FROM documents
        UNION ALL SELECT 3, 'doc_number', stddev_pop(doc_id) FROM documents)
    WHERE std <> 0
"""


@check("flt_keep_subset", f"SELECT label_idx, label_name, round(std, 6) AS std FROM ({NUMBER_STATS_SQL})")
def flt_keep_subset(spark, sf_dir):
    kept = keep_subset(label_stats(*_with_vec(_numbers(spark, sf_dir))), "all")
    return kept.select("label_idx", "label_name", F.round("std", 6).alias("std"))


SURFACE_SQL = ", ".join(f"({i}, '{n}')" for i, n in enumerate(SURFACE_NAMES[:2]))


@check(
    "flt_keep_surface",
    f"""
    SELECT s.label_idx, v.name AS label_name, round(std, 6) AS std
    FROM ({NUMBER_STATS_SQL}) s JOIN (VALUES {SURFACE_SQL}) v(label_idx, name) USING (label_idx)
    """,
)
def flt_keep_surface(spark, sf_dir):
    # The first two numbers go by the names of surface labels; the others keep their own.
    df, names = _numbers(spark, sf_dir)
    kept = keep_subset(label_stats(df, "labels", [*SURFACE_NAMES[:2], *names[2:]]), "surface")
    return kept.select("label_idx", "label_name", F.round("std", 6).alias("std"))


def _with_vec(numbers):
    df, names = numbers
    return df, "labels", names


@check(
    "lbl_dictionary",
    f"SELECT (row_number() OVER (ORDER BY label_idx) - 1)::INTEGER AS label_id, label_name FROM ({NUMBER_STATS_SQL})",
)
def lbl_dictionary(spark, sf_dir):
    return label_dictionary(keep_subset(label_stats(*_with_vec(_numbers(spark, sf_dir))), "all"))


LINEITEM_FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check(
    "agg_nanstats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem"
        for c in LINEITEM_FLOATS
    ),
)
def agg_nanstats(spark, sf_dir):
    stats = nan_stats(table(spark, sf_dir, "lineitem"))
    return stats.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@check(
    "agg_moments_merged",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_pop({c}), 7) AS std FROM lineitem"
        for c in LINEITEM_FLOATS
    ),
)
def agg_moments_merged(spark, sf_dir):
    """The table arrives in three lots; each adds its own moments to the stored ones.

    Means of cents over these numbers of rows end after seven digits or never, so none lies on the edge of rounding.
    """
    path, items = new_path(spark, "moments"), table(spark, sf_dir, "lineitem")
    for lot in range(3):
        append_moments(items.where(F.col("l_orderkey") % 3 == lot), path)
    merged = merged_moments(spark.read.parquet(path))
    return merged.select("column", "n", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"))


@check(
    "fn_zscore_stored",
    """
    SELECT event_id, round((value - m) / d, 6) AS value
    FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events WHERE event_id % 4 < 2)
    """,
)
def fn_zscore_stored(spark, sf_dir):
    """All rows on the scale of the half that was there before."""
    path, events = new_path(spark, "moments"), table(spark, sf_dir, "events").select("event_id", "value")
    for lot in range(2):
        append_moments(events.where(F.col("event_id") % 4 == lot), path)
    scaled = normalize_by(events, merged_moments(spark.read.parquet(path)))
    return scaled.select("event_id", F.round("value", 6).alias("value"))


CELLS_SQL = """
    SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings
"""


@check(
    "agg_label_stats",
    f"""
    SELECT idx::INTEGER AS label_idx, 'd' || idx AS label_name, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
    FROM ({CELLS_SQL}) GROUP BY idx
    """,
)
def agg_label_stats(spark, sf_dir):
    stats = label_stats(table(spark, sf_dir, "embeddings"), "embedding", [f"d{i}" for i in range(64)])
    return stats.select("label_idx", "label_name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@check(
    "fn_mtr_norm",
    f"""
    SELECT vec_id, idx::INTEGER AS idx, round((x - mean) / std, 6) AS z
    FROM ({CELLS_SQL}) JOIN (SELECT idx, avg(x) AS mean, stddev_pop(x) AS std FROM ({CELLS_SQL}) GROUP BY idx) USING (idx)
    """,
)
def fn_mtr_norm(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("labels"))
    # A last label that never varies, so that the selection has something to leave out.
    vectors = vectors.withColumn("labels", F.concat("labels", F.array(F.lit(1.0))))
    kept = keep_subset(label_stats(vectors, "labels", [f"d{i}" for i in range(64)] + ["constant"]))
    scaled = normalize_vectors(vectors, "labels", kept)
    return scaled.select("vec_id", F.posexplode("labels").alias("idx", "z")).select("vec_id", "idx", F.round("z", 6).alias("z"))


@check(
    "aug_pick_variant",
    """
    WITH o AS (SELECT conv_id, text AS original FROM conversations WHERE turn = 0),
         c AS (SELECT conv_id, original, arg_min(text, md5('5-' || conv_id || '-' || text)) FILTER (text <> original) AS pick
               FROM conversations JOIN o USING (conv_id) GROUP BY ALL)
    SELECT conv_id, md5(original) AS original, md5(coalesce(pick, original)) AS picked, pick IS NULL AS kept_original FROM c
    """,
)
def aug_pick_variant(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    originals = turns.where("turn = 0").select("conv_id", F.col("text").alias("original"))
    picked = pick_variant(originals, turns, "conv_id", "original", "text", 5)
    return picked.select("conv_id", F.md5("original").alias("original"), F.md5("picked").alias("picked"), "kept_original")
