"""Tables in: labelled files, property records, split records, logs and text streams."""

from __future__ import annotations

import contextlib
import pathlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltable.operators.index import with_file_index

LOADERS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}  # suffix to format

PROPERTY_SCHEMA = T.StructType(
    [T.StructField("smile", T.StringType()), T.StructField("labels", T.ArrayType(T.DoubleType()))]
)
SPLIT_SCHEMA = T.StructType([T.StructField(s, T.ArrayType(T.LongType())) for s in ("train", "val", "test")])
SPLIT_ROWS_SCHEMA = T.StructType(
    [
        T.StructField("splitter", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("pos_in_split", T.LongType()),
    ]
)
READING_PER_CORE = 16  # tasks that read very many logs
LISTING_PER_CORE = 4  # tasks that list the files of very many logs
MAX_LISTS = 1000  # keys of a split record
NORMALIZATION_SCHEMA = T.StructType(
    [
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("std", T.ArrayType(T.DoubleType())),
        T.StructField("label_names", T.ArrayType(T.StringType())),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Quotes are doubled, not escaped: a backslash is a letter of the text.

    Without a schema the types are inferred, which costs one more pass over the file.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', **options)
    return reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table whose format follows from the suffix of its path."""
    suffix = pathlib.PurePath(path).suffix.lower().lstrip(".")
    loader = LOADERS.get(suffix, suffix)
    try:
        if loader == "csv":
            return read_csv(spark, path, schema)
        reader = spark.read.format(loader)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except Exception as e:
        raise RuntimeError(f"failed to load {path!r} as {loader!r}") from e


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan out to all cores when it is cut into fewer tasks than there are cores.

    For work that costs more than moving the rows. A table large enough to keep all cores busy is
    left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def read_named_split(spark: SparkSession, path: str, split: str, subset: str | None = None) -> DataFrame:
    """One split (and subset) of a table laid out in folders; the other folders are not listed for reading."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df if subset is None else df.where(F.col("subset") == subset)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROPERTY_SCHEMA).json(path)


def split_record_path(data_path: str) -> str:
    """Where the split record of a data file lies."""
    suffix = pathlib.PurePath(data_path).suffix
    return data_path.replace(suffix, "_0.scaffold_splits.json")


def read_split_record(spark: SparkSession, data_path: str) -> DataFrame:
    """The record beside a data file, one JSON object of three position lists, as (split, pos_in_split, row_idx).

    The object may be of any size: it is read by as many tasks as its bytes ask for, and places in the lists follow from the
    rows before each. The driver gets the names of the lists.
    """
    path = split_record_path(data_path)
    try:
        # A list is cut at its commas, so a task reads a part of the file and a row is one position.
        scan = spark.read.text(path, lineSep=",")
    except AnalysisException as e:
        raise FileNotFoundError(f"no split record {path!r} for {data_path!r}") from e
    cells = with_file_index(scan, "at")
    opening = cells.where(F.contains("value", F.lit('"'))).select("at", F.regexp_extract("value", r'"([^"]*)"\s*:\s*(\[?)', 1).alias("name"))
    opening = opening.orderBy("at").limit(MAX_LISTS + 1).collect()
    if len(opening) > MAX_LISTS:
        raise ValueError(f"{path!r} is no record of position lists")
    split, start = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for mark in opening:
        split = F.when(F.col("at") >= mark["at"], F.lit(mark["name"])).otherwise(split)
        start = F.when(F.col("at") >= mark["at"], F.lit(mark["at"])).otherwise(start)
    number = F.regexp_extract("value", r"(-?\d+|null)[\]}\s]*$", 1)
    rows = cells.select(split.alias("split"), (F.col("at") - start).alias("pos_in_split"), number.alias("n"), "value")
    empty = (F.col("n") == "") | F.col("value").rlike(r'"\s*:\s*null')
    listed = rows.where(F.col("split").isin(SPLIT_SCHEMA.names) & ~empty)
    return listed.select("split", "pos_in_split", F.when(F.col("n") != "null", F.col("n").cast("bigint")).alias("row_idx"))


def read_split_rows(spark: SparkSession, path: str) -> DataFrame:
    """Splits as written by ``write_splits``: one row per position, folders by splitter and fold."""
    return spark.read.schema(SPLIT_ROWS_SCHEMA).json(path)


def read_normalization(spark: SparkSession, path: str) -> DataFrame:
    """Mean and standard deviation per label as a relation (label_idx, label_name, mean, std)."""
    record = spark.read.schema(NORMALIZATION_SCHEMA).json(path)
    cells = F.arrays_zip("label_names", "mean", "std")
    return record.select(F.posexplode(cells).alias("label_idx", "c")).select(
        "label_idx", F.col("c.label_names").alias("label_name"), "c.mean", "c.std"
    )


def log_name(path: Column) -> Column:
    """Name of the ``.log`` a file belongs to, whether file or folder of parts."""
    return F.regexp_extract(path, r"(?:^|[/=])([^/=]+)\.log(?:/|$)", 1)


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every ``*.log`` of a folder as (file, line_at, value); ``line_at`` sorts as in the file."""
    line_at = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(f"{folder}/*.log").select(
        log_name(F.col("_metadata.file_path")).alias("file"), line_at.alias("line_at"), "value"
    )


def stream_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``read_log_lines`` as a stream of new files.

    A trigger takes whole files, and a task reads a block of a file from its start, so numbering the lines of a task, which
    streams have no expression for, sorts them as in the file, over all triggers.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            lines = pa.array(range(read, read + batch.num_rows), pa.int64())
            yield batch.append_column("line", lines)
            read += batch.num_rows

    path, block = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    numbered = spark.readStream.text(f"{folder}/*.log").select(path, block, "value")
    numbered = numbered.mapInArrow(number, "path string, block bigint, value string, line bigint")
    return numbered.select(log_name(F.col("path")).alias("file"), F.struct("path", "block", "line").alias("line_at"), "value")


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.log`` of a folder as (file, n_bytes), also those without lines; no content is read.

    Scans leave empty files out, so names come from the list of files that the driver makes for any scan.
    """
    path = f"{folder}/*.log"
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "path string")
    files = listed.select(log_name(F.col("path")).alias("file")).distinct()
    filled = spark.read.format("binaryFile").load(path).groupBy(log_name(F.col("path")).alias("file"))
    sizes = filled.agg(F.sum("length").alias("n_bytes"))
    return files.join(sizes, "file", "left").select("file", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


@contextlib.contextmanager
def _listing_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Paths are listed by at most ``tasks`` tasks within the block; the session's own setting comes back after it."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(key)
    spark.conf.set(key, min(int(own), tasks))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def read_log_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Each log as one lower-cased string (file, content); for logs that fit a row.

    Spark lists the files when the reader is made, by default with a task for each of the first 10,000 logs; many logs are
    listed by a few tasks of each core instead. Reading, it counts a log as 4 MB at least, so a task gets a few small ones; very
    many tasks are put together, for a task costs more than small logs do.
    """
    with _listing_tasks(spark, LISTING_PER_CORE * spark.sparkContext.defaultParallelism):
        logs = spark.read.text(f"{folder}/*.log", wholetext=True)
    logs = logs.coalesce(READING_PER_CORE * spark.sparkContext.defaultParallelism)
    return logs.select(log_name(F.col("_metadata.file_path")).alias("file"), F.lower("value").alias("content"))


def text_items(df: DataFrame, text_col: str, pair_col: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Every non-empty text, then its optional partner, as (keys, item, text)."""
    columns = [text_col] + ([pair_col] if pair_col else [])
    texts = F.array(*[F.col(c).cast("string") for c in columns])
    items = df.select(*keys, F.posexplode(texts).alias("item", "text"))
    return items.where(F.length("text") > 0)


def combine_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all rows; columns missing somewhere are null, ``source_table`` tells the origin."""
    named = [df.withColumn("source_table", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
