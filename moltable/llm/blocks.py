"""Groups of any size, handed to tasks in bounded pieces that still bring every two members together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.runtime import stage


def paired_blocks(df: DataFrame, key: str, row_id: str, limit: int) -> DataFrame:
    """Rows of ``df`` with ``_i`` and ``_j``, so that any two rows of a key share some (key, ``_i``, ``_j``).

    A key of up to ``limit`` rows is one block (0, 0). A larger one is cut by the hash of ``row_id`` into blocks of
    about ``limit`` rows, and each pair of blocks becomes a piece of at most two blocks. In a piece
    (i, j) with i < j, rows of ``_own`` i and j are to be compared with each other, in (i, i) among themselves.
    No pair of rows is made here: a row is copied once per block of its own key.
    """
    # Staged, so that the join has a plain table on either side and a hot key can be split.
    sizes = stage(df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias("_n")), "sizes")
    cut = df.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return cut.select(
        "*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    ).drop("_n", "_other")
