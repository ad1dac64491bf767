"""Tables out. All sinks write folders of part files, never one file from one task."""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.runtime import committed, local_path

# Tasks get these functions by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WRITERS_PER_CORE = 4  # tasks that write many small files
# Names of partition folders, as Spark spells them
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NAMELESS = "__HIVE_DEFAULT_PARTITION__"  # null or empty


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"').csv(path)


def write_properties(df: DataFrame, path: str, text_col: str = "smile", labels_col: str = "labels") -> None:
    """One JSON object {smile, labels} per row."""
    df.select(F.col(text_col).alias("smile"), F.col(labels_col).alias("labels")).write.json(path)


def normalization_record(stats: DataFrame) -> DataFrame:
    """(label_idx, label_name, mean, std) as one row of parallel arrays; as long as the label list."""
    cells = F.array_sort(F.collect_list(F.struct("label_idx", "mean", "std", "label_name")))
    return stats.agg(cells.alias("c")).select("c.mean", "c.std", F.col("c.label_name").alias("label_names"))


def write_normalization(stats: DataFrame, path: str) -> None:
    normalization_record(stats).write.json(path)


def write_splits(assignment: DataFrame, path: str) -> None:
    """Positions as rows under splitter=…/fold=…; a list in one JSON object would pass through one task.

    Tasks commit their files one by one, and ``path`` appears only once all have: a job that fails leaves nothing.
    """
    with committed(assignment.sparkSession, path) as draft:
        assignment.write.partitionBy("splitter", "fold").json(draft)


def write_logs(logs: DataFrame, folder: str) -> None:
    """Rows (file, value) as a folder of logs: all lines of a file in one part below ``file=<name>``, a null as an empty line.

    A file costs far more than its bytes, so logs are dealt to all cores by name, however few blocks the table has. On a
    disk, Hadoop without its native library starts processes for each file to set its rights: there the workers write.
    Elsewhere Spark does, and each task puts its own files in place (version 2) instead of leaving them all to the driver.
    """
    spark = logs.sparkSession
    tasks = WRITERS_PER_CORE * spark.sparkContext.defaultParallelism
    name = F.coalesce(F.nullif("file", F.lit("")), F.lit(NAMELESS))
    dealt = logs.select(name.alias("file"), "value").repartition(tasks, "file")
    disk = local_path(spark, folder)
    if disk is None:
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("file").text(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():05d}.txt"
        lines = (line for b in batches for line in zip(*b.columns, strict=True))
        for file, values in groupby(lines, key=lambda line: line[0].as_py()):
            log = os.path.join(disk, "file=" + ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", file))
            os.makedirs(log, exist_ok=True)
            # A task that is run again, or twice at once, puts the same file in place of its own.
            draft = os.path.join(log, f"_{part}-{uuid.uuid4().hex}")
            with open(draft, "xb") as out:
                for _, value in values:
                    out.writelines((value.as_buffer() or b"", b"\n"))
            os.replace(draft, os.path.join(log, part))
        yield from ()

    os.makedirs(disk)
    ordered = dealt.sortWithinPartitions("file").select("file", F.col("value").cast("binary"))
    ordered.mapInArrow(write, "written bigint").write.format("noop").mode("overwrite").save()
