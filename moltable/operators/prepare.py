"""Cleaning, projection, deduplication and sampling of a labelled table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltable.operators.index import HASH_DIGITS, digest_number, hash_offsets, seeded_digest, with_file_index
from moltable.operators.validate import require_columns, resolve_labels
from moltable.runtime import stage


def clean_index(scan: DataFrame, text_col: str) -> DataFrame:
    """Drop a leading saved index and a column called ``index``; rows are numbered in file order."""
    require_columns(scan, [text_col])
    df, first = with_file_index(scan), scan.columns[0]
    if first.startswith("Unnamed:") or first == "_c0":
        df = df.drop(first)
    if "index" in df.columns:
        warnings.warn("dropping column 'index': assumed not to be a label", stacklevel=2)
        df = df.drop("index")
    return df


def keep_labels(df: DataFrame, text_col: str, labels: str | list[str] | None, keys: list[str] = ()) -> DataFrame:
    """Keep the text and the labels that exist; the scan below reads nothing else."""
    require_columns(df, [text_col])
    found = [c for c in resolve_labels(df, text_col, labels) if c not in keys]
    return df.select(*keys, text_col, *found)


def dedup_first(df: DataFrame, text_col: str, id_col: str = "row_idx") -> DataFrame:
    """Keep the first row, by ``id_col``, of each distinct text (null is one text of its own).

    Only (digest, id) pairs are grouped, with partial sums of the minimum before the shuffle, so
    a text repeated in a third of all rows costs one pair per task. Full rows move once, in the
    semi-join on the id, which is unique.
    """
    firsts = (
        df.groupBy(F.sha2(text_col, 256).alias("_digest")).agg(F.min(id_col).alias(id_col)).select(id_col)
    )
    return df.join(firsts, id_col, "left_semi")


def sample_rows(df: DataFrame, n: int | None, id_col: str, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows in seeded random order of their ids; ``None`` keeps all.

    A sorted limit would gather the n rows in one task. Here only the place of the n-th row is
    looked for, among ids: hash buckets are counted, and the one bucket it lies in is ranked. The
    sample is then a filter on that place; full rows are neither moved nor sorted.
    """
    if n is None:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    digest = seeded_digest(seed, id_col)
    ids = stage(df.select(id_col, digest.alias("_digest")), "sampled-ids")  # read three times
    ids = ids.withColumn("_bucket", digest_number(F.col("_digest"), 1, HASH_DIGITS))
    offsets = hash_offsets(ids, F.col("_bucket"))
    edge = offsets.where((F.col("_offset") < n) & (F.col("_offset") + F.col("_n") >= n))
    within = Window.partitionBy("_bucket").orderBy("_digest", id_col)
    ranked = ids.join(F.broadcast(edge), "_bucket").withColumn("_rank", F.row_number().over(within))
    last = ranked.where(F.col("_offset") + F.col("_rank") == n).agg(F.first(F.struct("_digest", id_col))).scalar()
    place = F.struct(digest.alias("_digest"), F.col(id_col))
    # There is no n-th row in a smaller table: all rows stay.
    return df.where(F.coalesce(place <= last, F.lit(True)))
