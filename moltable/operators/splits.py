"""Fold assignment: seeded random folds, and folds that keep groups together.

An assignment is a relation (fold, split, row_idx), with ``pos_in_split`` where the order inside
a split means something.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.operators.index import with_global_index, with_shuffled_index
from moltable.runtime import stage

HOLDOUT_FRACTION = 0.1  # share of rows that val, and likewise test, must hold exactly
BLOCK_ROWS = 250_000  # groups per block in the group split
KEPT_BLOCKS = 16  # blocks whose sizes the driver holds at a time, of 8 bytes a group


class SplittingError(ValueError):
    """The groups at hand cannot fill val and test exactly."""


def random_kfold(df: DataFrame, n: int, seed: int, id_col: str = "row_idx") -> DataFrame:
    """n folds over a seeded shuffle cut into n nearly equal parts (longer parts first).

    Fold i validates on part i, tests on part i+1 (wrapping) and trains on the others, in part
    order. ``pos_in_split`` is the position in that list.
    """
    if n < 3:
        raise ValueError(f"a random split needs at least 3 folds, got {n}")
    ids = df.select(F.col(id_col).alias("row_idx"))
    shuffled = with_shuffled_index(ids, "row_idx", seed)
    total = ids.agg(F.count("*")).scalar()
    idx, size, extra = F.col("shuffled_idx"), F.expr(f"_total div {n}"), F.expr(f"_total % {n}")
    long_rows = extra * (size + 1)
    part = F.when(idx < long_rows, F.expr(f"shuffled_idx div (_total div {n} + 1)")).otherwise(
        extra + F.floor((idx - long_rows) / F.greatest(size, F.lit(1)))
    )

    def start(p):
        return p * size + F.least(p, extra)

    fold, p = F.col("fold"), F.col("_part")
    test_part = (fold + 1) % n
    split = F.when(p == fold, "val").when(p == test_part, "test").otherwise("train")
    skipped = sum(
        (F.when(q < p, start(q + 1) - start(q)).otherwise(F.lit(0)) for q in (fold, test_part)),
        F.lit(0),
    )
    pos = F.when(F.col("split") == "train", idx - skipped).otherwise(idx - start(p))
    return (
        shuffled.withColumn("_total", total)
        .withColumn("_part", part.cast("bigint"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("split", split)
        .select("fold", "split", "row_idx", pos.cast("bigint").alias("pos_in_split"))
    )


def group_map(df: DataFrame, key: str, id_col: str = "row_idx") -> DataFrame:
    """One row per group: its first position and its size. Rows without a key are in no group."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    )


@dataclass(frozen=True)
class _Rule:
    """Groups that a pass takes: rank by first position in [lo, hi), at most max_n rows, not taken before."""

    seq: int
    lo: int
    hi: int
    max_n: int


def _pass_of(rules: list[_Rule]) -> Column:
    """The first pass that takes a group (rank, n), null if none does."""
    taken = " ".join(f"WHEN rank >= {r.lo} AND rank < {r.hi} AND n <= {r.max_n} THEN {r.seq}" for r in rules)
    return F.expr(f"CASE {taken} END" if rules else "CAST(NULL AS INT)")


class _FreeGroups:
    """What no pass has taken yet: sums of all blocks, and the sizes inside the few blocks that were looked into.

    ``sums`` is (rows, least size) per block of ``width`` ranks, read from the groups once; every later change to it follows
    from what a pass took. A block on the edge of a pass is read once, as one number per group in the order of ranks, 0 for
    a group that is not free. At most KEPT_BLOCKS such blocks stay in memory; one that was let go is read again when needed.
    """

    def __init__(self, groups: DataFrame, capacity: int, width: int):
        self.groups, self.width = groups.where(F.col("n") <= capacity), width
        rows = self.groups.groupBy("block").agg(F.sum("n").alias("rows"), F.min("n").alias("least")).collect()
        self.sums = {r["block"]: (r["rows"], r["least"]) for r in sorted(rows)}
        self.inside: dict[int, np.ndarray] = {}

    def sizes(self, block: int, rules: list[_Rule]) -> np.ndarray:
        """The sizes of the free groups of a block, by rank."""
        found = self.inside.pop(block, None)
        if found is None:
            free = self.groups.where((F.col("block") == block) & _pass_of(rules).isNull())
            read = free.select((F.col("rank") - block * self.width).alias("at"), "n").toArrow()
            found = np.zeros(self.width, np.int64)
            found[read["at"].to_numpy()] = read["n"].to_numpy()
            if len(self.inside) >= KEPT_BLOCKS:
                self.inside.pop(next(iter(self.inside)))
        self.inside[block] = found
        return found

    def take_whole(self, block: int) -> None:
        del self.sums[block]
        self.inside.pop(block, None)

    def taken_inside(self, block: int) -> None:
        left = self.inside[block][self.inside[block] > 0]
        if len(left):
            self.sums[block] = int(left.sum()), int(left.min())
        else:
            self.take_whole(block)


def _fill(free: _FreeGroups, rules: list[_Rule], seq: int, capacity: int) -> int:
    """One greedy pass: in first-seen order take every unused group that still fits.

    Appends the rules that describe what was taken and returns the capacity left. Blocks that fit whole are taken whole, one
    whose smallest group is too large is passed over; only a block on the edge is looked into. There, all groups up to the
    one that overflows are taken, and the search goes on behind it for groups no larger than the
    remaining space. Each such group is smaller than the one before, so a block is walked a few times.
    """
    left, whole_from, end = capacity, None, 0

    def close(at: int) -> None:
        nonlocal whole_from
        if whole_from is not None:
            rules.append(_Rule(seq, whole_from, at, capacity))
            whole_from = None

    for block, (rows, least) in list(free.sums.items()):
        if left == 0:
            break
        lo, end = block * free.width, (block + 1) * free.width
        if rows <= left:
            whole_from = lo if whole_from is None else whole_from
            left -= rows
            free.take_whole(block)
            continue
        close(lo)
        if least > left:
            continue
        sizes, at = free.sizes(block, rules), 0
        while left > 0 and at < free.width:
            fits = np.where(sizes[at:] <= left, sizes[at:], 0)
            running = np.cumsum(fits)
            blocker = int(np.searchsorted(running, left, side="right"))
            taken = int(running[blocker - 1]) if blocker else 0
            if taken:
                rules.append(_Rule(seq, lo + at, lo + at + blocker, left))
                sizes[at : at + blocker][fits[:blocker] > 0] = 0
            left -= taken
            at += blocker + 1
        free.taken_inside(block)
    close(end)
    return left


def group_kfold(
    df: DataFrame, key: str, k: int, id_col: str = "row_idx", on_underfull: str = "error", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """k folds in which a group is whole, and in val or test of one fold at most.

    Per fold the groups are taken in first-seen order: to val while it fits in a tenth of the
    rows, else to test while it fits, else to train; groups once held out train in later folds.
    Whether a group fits depends on every group before it, but the choice for val never looks at
    test. So a fold is two greedy passes, each described by a few rules on (rank, n), found from
    block sums (see ``_fill``). Groups are ranked by first position and blocks are ranges of ranks, so all
    but the last have ``block_rows`` groups whatever the ids are. Block sums are read in one job for all folds, and so is each of
    the few blocks on the edge of a pass; the driver holds no more. Keys travel as digests.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    rows = df.select(F.col(id_col).alias("row_idx"), digest.alias("_key")).where("_key is not null")
    total = df.count()
    cutoff = math.floor(HOLDOUT_FRACTION * total)
    found = stage(group_map(rows, "_key"), "groups")  # ranking reads it twice, and keys may be long texts
    ranked = with_global_index(found, ["first", "_key"], "rank")
    groups = ranked.withColumn("block", F.expr(f"rank div {block_rows}L"))  # read from a written table
    free, rules = _FreeGroups(groups, cutoff, block_rows), []
    for fold in range(k):
        for offset in (0, 1):
            left = _fill(free, rules, 2 * fold + offset, cutoff)
            if left > 0:
                message = (
                    f"fold {fold}: {left} of {cutoff} rows missing in {('val', 'test')[offset]}; "
                    "too few small groups to hold out without overlap"
                )
                if on_underfull == "error":
                    raise SplittingError(message)
                warnings.warn(message, stacklevel=2)
    held = groups.select("_key", _pass_of(rules).alias("seq")).where("seq is not null")
    fold = F.col("fold")
    split = (
        F.when(F.col("seq") == fold * 2, "val").when(F.col("seq") == fold * 2 + 1, "test").otherwise("train")
    )
    return (
        rows.join(held, "_key", "left")
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .select("fold", split.alias("split"), "row_idx")
    )


SPLITTERS = ("scaffold", "random")  # fixed values: names users pass


def many_splits(
    df: DataFrame, splitters: list[str], counts: list[int], key: str, seed: int, id_col: str = "row_idx"
) -> DataFrame:
    """The union of several splitters; ``scaffold`` groups by ``key``."""
    if len(splitters) != len(counts):
        raise ValueError("give one number of folds for each splitter")
    unknown = [s for s in splitters if s not in SPLITTERS]
    if unknown:
        raise NotImplementedError(f"splitter(s) not known: {unknown}")
    parts = []
    for splitter, n in zip(splitters, counts, strict=True):
        made = group_kfold(df, key, n, id_col) if splitter == "scaffold" else random_kfold(df, n, seed, id_col)
        parts.append(made.select(F.lit(splitter).alias("splitter"), "fold", "split", "row_idx"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def overlap_report(assignment: DataFrame) -> DataFrame:
    """Per held-out split: rows found in several folds, and the smallest and largest fold."""
    held = assignment.where(F.col("split").isin("val", "test"))
    shared = (
        held.groupBy("split", "row_idx")
        .agg(F.count("*").alias("folds"))
        .groupBy("split")
        .agg(F.sum(F.when(F.col("folds") > 1, 1).otherwise(0)).alias("n_overlap"))
    )
    sizes = (
        held.groupBy("split", "fold")
        .agg(F.count("*").alias("rows"))
        .groupBy("split")
        .agg(F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"))
    )
    return shared.join(sizes, "split")


def split_name(asked: str) -> str:
    """Loose matching of a split name: holds "train", holds "test", anything else is val."""
    return "train" if "train" in asked else "test" if "test" in asked else "val"


def select_split(df: DataFrame, assignment: DataFrame, asked: str, id_col: str = "row_idx") -> DataFrame:
    """The rows of one split, with their place in it when the assignment knows it."""
    wanted = assignment.where(F.col("split") == split_name(asked)).withColumnRenamed("row_idx", id_col)
    return df.join(wanted, id_col)


def select_train_val(df: DataFrame, assignment: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """Train and validation rows with their split; test rows are left out."""
    wanted = assignment.where(F.col("split").isin("train", "val")).withColumnRenamed("row_idx", id_col)
    return df.join(wanted, id_col)


def splits_from_files(train: DataFrame, valid: DataFrame) -> DataFrame:
    """A table whose splits come as separate files."""
    return train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("validation")))
