"""Feature tables: named numeric features per string, and what is derived from them."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltable.functions.columns import nan_to_num
from moltable.operators.index import seeded_digest
from moltable.runtime import stage

FORBIDDEN = ("Ipc",)  # fixed value: a descriptor whose size ruins every statistic
SLICE_BYTES = 4 << 20  # of strings that a worker turns into Python objects at a time
HOT_SHARE = 0.001  # a string in a larger share of the rows is hot; there are less than 1 / HOT_SHARE of them

# Tasks get these functions by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_features(text: Column) -> dict[str, Column]:
    """Counts and shares read off the text itself; the set that ships with the package."""
    chars, length = F.split(text, ""), F.length(text)

    def count(letters: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))

    # Equal characters side by side, so that each run is the count of one character.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(chars), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.ln(F.length(run)))
    return {
        "n_chars": length,
        "n_letters": count("A-Za-z"),
        "n_upper": count("A-Z"),
        "n_digits": count("0-9"),
        "n_brackets": count(r"\[\]()"),
        "n_bonds": count("-=#:/"),
        "n_distinct": F.size(F.array_distinct(chars)),
        "entropy": F.ln(length) - weighted / length,
    }


def text_slices(batch: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """The strings of a batch, as many at a time as have ``limit`` bytes (``SLICE_BYTES``), at least one."""
    limit = SLICE_BYTES if limit is None else limit
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def python_feature(text: Column | str, compute: Callable[[str], float | None]) -> Column:
    """A feature that plain Python computes from a string, row by row; null where the string is.

    A worker makes Python strings of ``SLICE_BYTES`` of an Arrow batch at a time, so its memory does not follow the length of the texts.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in text_slices(batch):
                yield pa.array([None if t is None else compute(t) for t in some.to_pylist()], pa.float64())

    return run(text)


def feature_names(features: dict[str, Column]) -> list[str]:
    return [name for name in features if name not in FORBIDDEN]


def feature_table(
    df: DataFrame, text_col: str, features: dict[str, Column], parsable: Column | None = None, name: str = "labels"
) -> DataFrame:
    """Add the vector of all features but the forbidden ones.

    Any double column can be a feature, also one made by an Arrow UDF around a chemistry library.
    A row that cannot be parsed gets zeros, as does a cell that is null, NaN or infinite.
    """
    kept = feature_names(features)
    parsable = (F.length(text_col) > 0) if parsable is None else parsable
    cells = nan_to_num(F.array(*[features[f].cast("double") for f in kept]))
    zeros = F.array(*[F.lit(0.0) for _ in kept])
    return df.withColumn(name, F.when(parsable, cells).otherwise(zeros))


def computed_features(
    df: DataFrame,
    text_col: str,
    compute: Callable[[str], Sequence[float | None]],
    features: list[str],
    name: str = "labels",
    error: str = "feature_error",
) -> DataFrame:
    """Add the features that plain Python computes from a string, each distinct string computed once, and why it failed.

    ``compute`` stands for a chemistry library: it returns a number, or None, for each of ``features``, and
    raises on a string it cannot handle. Such a string gets zeros and the text of its error, every other a null error; no
    string fails its task. A null string gets zeros and the error "no text". Cells that are None, NaN or infinite
    become as in ``feature_table``, which also says which features are left out. Columns of the two names are replaced.

    The distinct strings are found by partial aggregates, computed in one go and written with their digests. A join on the
    digest brings them back; strings in more than HOT_SHARE of the rows, of which there are few, are broadcast, so no task gets all
    rows of one string.
    """
    kept = [i for i, f in enumerate(features) if f not in FORBIDDEN]
    width = len(features)

    def one(text: str) -> tuple[list[float | None] | None, str | None]:
        try:
            values = [None if v is None else float(v) for v in compute(text)]
            if len(values) != width:
                raise ValueError(f"{len(values)} features instead of {width}")
            return [values[i] for i in kept], None
        except Exception as failure:  # whatever a library raises is a finding about the string
            return None, f"{type(failure).__name__}: {failure}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(text) for text in batch["_text"].to_pylist()]
            values = pa.array([m[0] for m in made], pa.list_(pa.float64()))
            errors = pa.array([m[1] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([batch["_digest"], batch["_n"], values, errors], ["_digest", "_n", "_values", "_error"])

    text = F.col(text_col).cast("string")
    known = df.where(text.isNotNull()).groupBy(text.alias("_text")).agg(F.count("*").alias("_n"))
    # Adaptive execution would put many strings into a task by their bytes; here the time per string counts.
    known = known.repartition("_text").select(F.sha2("_text", 256).alias("_digest"), "_n", "_text")
    schema = "_digest string, _n bigint, _values array<double>, _error string"
    made = stage(known.mapInArrow(run, schema), "features")
    hot = F.broadcast(made.where(F.col("_n") > HOT_SHARE * made.agg(F.sum("_n")).scalar()))
    rows = df.drop(name, error) if text_col not in (name, error) else df
    rows = rows.withColumn("_digest", F.sha2(text, 256))
    often = rows.join(hot, "_digest")
    seldom = rows.join(hot, "_digest", "left_anti").join(made, "_digest", "left")
    zeros = F.array(*[F.lit(0.0) for _ in kept])
    return (
        often.unionByName(seldom)
        .withColumn(name, F.when(F.col("_values").isNull(), zeros).otherwise(nan_to_num(F.col("_values"))))
        .withColumn(error, F.when(F.col("_digest").isNull(), "no text").otherwise(F.col("_error")))
        .drop("_digest", "_n", "_values", "_error")
    )


def feature_failures(made: DataFrame, id_col: str, error: str = "feature_error") -> DataFrame:
    """What went wrong in ``computed_features``: (error, n_rows, first id), one row per error text."""
    failed = made.where(F.col(error).isNotNull())
    return failed.groupBy(F.col(error).alias("error")).agg(F.count("*").alias("n_rows"), F.min(id_col).alias("first_id"))


def pick_variant(
    originals: DataFrame, candidates: DataFrame, id_col: str, original_col: str, variant_col: str, seed: int
) -> DataFrame:
    """One seeded choice per id among its variants other than the original.

    ``originals`` has one row per id, ``candidates`` any number of variants, equal ones counting
    once. Where the original is the only variant it is kept, and ``kept_original`` says so. The smallest ticket of an
    id is a partial minimum, and the join before it is plain, so an id with very many variants can be split.
    """
    ticket = F.struct(seeded_digest(seed, id_col, variant_col).alias("t"), F.col(variant_col).alias("v"))
    others = candidates.select(id_col, variant_col).join(originals.select(id_col, original_col), id_col)
    best = others.where(F.col(variant_col) != F.col(original_col)).groupBy(id_col).agg(F.min(ticket).alias("_pick"))
    picked = originals.select(id_col, original_col).join(best, id_col, "left")
    return picked.select(
        id_col,
        original_col,
        F.coalesce("_pick.v", original_col).alias("picked"),
        F.col("_pick").isNull().alias("kept_original"),
    )


def warn_if_kept(picked: DataFrame) -> DataFrame:
    """Warn when some original had no other variant. Runs a job."""
    if not picked.where("kept_original").isEmpty():
        warnings.warn("some texts have no other variant and are kept as they are", stacklevel=2)
    return picked
