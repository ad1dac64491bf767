"""Row positions and running totals without an un-partitioned window.

Row position is the identity that splits, batches and samples refer to. A window with no
partition keys would sort all rows in one task; everything here splits the order into buckets,
sums the buckets (a small table), and only then looks at rows inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.runtime import stage

HASH_DIGITS = 4  # hexadecimal digits of the digest that name a bucket: 16**4 buckets


def seeded_digest(seed: int | str, *ids: Column | str) -> Column:
    """Hexadecimal digest of seed and identity; the same on every run and partitioning."""
    parts = [F.lit(str(seed))] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws("-", *parts))


def digest_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hexadecimal digits of ``digest`` from 1-based ``start``, as a number."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def with_file_index(scan: DataFrame, name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in its source: files by path, then lines.

    ``scan`` must be the scan itself. It is parsed once and written with the place of each row: how a
    scan is cut into tasks may change with the number of executors, so places and counts of rows
    must come from one reading. A position is then the rows of earlier file blocks plus the place
    in the block. Nothing but the block counts is shuffled.
    """
    placed = stage(
        scan.withColumns(
            {
                "_path": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_line": F.monotonically_increasing_id(),
            }
        ),
        "ingested",
    )
    counts = placed.groupBy("_path", "_block").agg(F.min("_line").alias("_start"), F.count("*").alias("_n"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    offsets = stage(counts.select("_path", "_block", (earlier - F.col("_start")).alias("_shift")), "blocks")
    return (
        placed.join(offsets, ["_path", "_block"])
        .withColumn(name, F.col("_line") + F.col("_shift"))
        .drop("_path", "_block", "_line", "_shift")
    )


def with_global_index(df: DataFrame, order_cols: list[str], name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_cols``.

    The rows are range-partitioned, sorted and written once together with their partition
    number and place in it, so that counting and numbering see the same partitions even when
    a task runs again. Make the order total (end it in an id), so equal values can be divided.
    """
    placed = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    placed = stage(placed, "indexed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition, so this window orders a few thousand rows at most.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_offset")
    )


def hash_offsets(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows before each hash bucket, one row per bucket (at most 16**HASH_DIGITS)."""
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def with_shuffled_index(df: DataFrame, id_col: str, seed: int, name: str = "shuffled_idx") -> DataFrame:
    """Add the 0-based position of each row in a seeded random order.

    The order is that of (digest of seed and id, id). Digests are uniform, so buckets named by
    their first digits are even whatever the data looks like.
    """
    hashed = df.withColumn("_digest", seeded_digest(seed, id_col))
    hashed = hashed.withColumn("_bucket", digest_number(F.col("_digest"), 1, HASH_DIGITS))
    offsets = hash_offsets(hashed.select("_bucket"), F.col("_bucket"))
    within = Window.partitionBy("_bucket").orderBy("_digest", id_col)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_digest", "_bucket", "_n", "_offset")
    )


_RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def with_running(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order_cols: list[str],
    running: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running sums, minima and maxima per key, for keys too large for one task.

    ``block`` divides the order of a key into consecutive pieces. The totals of the pieces are
    accumulated first; rows are then sorted only within their piece. ``running`` maps a new
    column to (``sum``, ``min`` or ``max``, value, whether the row itself counts). ``least`` and
    ``greatest`` skip nulls, so a piece with no earlier one needs no special case.
    """
    blocked = df.withColumn("_block", block)
    group = [*keys, "_block"]
    totals = blocked.groupBy(*group).agg(
        *[_RUNNING[kind][0](value).alias(f"_t_{name}") for name, (kind, value, _) in running.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group,
        *[_RUNNING[kind][0](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _, _) in running.items()],
    )
    within = Window.partitionBy(*group).orderBy(*order_cols)
    out = blocked.join(carried, group)
    for name, (kind, value, inclusive) in running.items():
        aggregate, combine = _RUNNING[kind]
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(name, combine(F.col(f"_c_{name}"), aggregate(value).over(frame)))
    return out.drop("_block", *[f"_c_{name}" for name in running])
