"""Quality rules whose thresholds follow quantile sketches of each language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.runtime import stage

WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20  # the fixed base rules
GAMMA = 1.01  # a sketch's buckets end at its powers: a quantile is within half a percent of a value of that rank
ZERO = -(2**31)  # the bucket of zeros
FENCE = 3.0  # interquartile ranges beyond the quartiles
PRIOR_DOCS = 200  # weight of the language's quantiles against those of one of its sources
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"

#: measure: (expression, slack beyond the fence, slack times one over the square root of its base, that base, low side too)
MEASURES = {
    "word_length": ("word_chars / n_words", 0.5, 12.0, "n_words", True),
    "symbol_share": ("n_symbols / n_words", 0.1, 0.3, "n_words", False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.2, 0.5, "n_lines", False),
    "repeat_share": ("n_repeat_words / n_words", 0.12, 0.6, "n_words", False),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        if counts[window] > 1:
            marks[at] += 1
            marks[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def text_stats(text: str) -> tuple[int, ...]:
    """``STATS`` of one text; ``bytes`` methods know exactly the six ASCII blanks that separate words."""
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()] if words else []
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            rows = [text_stats(t or "") for t in some.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.record_batch(
                [*(some.column(c) for c in ("doc_id", "lang", "source")), *columns], names=["doc_id", "lang", "source", *STATS]
            )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The bucket of a value: the least power of ``GAMMA`` that is no smaller."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("int")).otherwise(F.lit(ZERO))


def bucket_value(number: Column) -> Column:
    """The value that is nearest, in proportion, to both ends of a bucket."""
    return F.when(number > ZERO, F.pow(F.lit(GAMMA), number) * F.lit(2 / (1 + GAMMA))).otherwise(F.lit(0.0))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketches of each language and source.

    A sketch counts values by buckets of equal proportion. Tasks count first, so a group, however large, costs each task some
    thousand rows at most. Counts are whole numbers: sketches that are merged, in any order, are the sketch of all values.
    """
    cells = [F.struct(F.lit(m).alias("measure"), bucket(F.expr(e)).alias("bucket")) for m, (e, *_) in MEASURES.items()]
    each = stats.select("lang", "source", F.inline(F.array(*cells)))
    return each.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys``: ``n`` and, of each measure, ``<measure>_25`` and ``<measure>_75``.

    A quartile is the value of the first bucket up to which lies at least that part of the group, in whole numbers.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumns({"upto": upto, "all": F.sum("n").over(whole)})
    columns = [F.max("all").alias("n")]
    for measure in MEASURES:
        for part in (1, 3):
            reached = (F.col("measure") == measure) & (4 * F.col("upto") >= part * F.col("all"))
            columns.append(bucket_value(F.min(F.when(reached, F.col("bucket")))).alias(f"{measure}_{25 * part}"))
    return ranked.groupBy(*keys).agg(*columns)


def fences(stats: DataFrame) -> DataFrame:
    """One row per (lang, source): ``<measure>_low`` and ``<measure>_high`` for each measure.

    The sketches of a language's sources are merged into the language's. A group's quartiles are drawn towards the
    language's by ``PRIOR_DOCS`` documents, so small groups follow their language. Fences depend on the documents
    alone, not on their order, their partitions or a task that ran twice.
    """
    sketch = stage(sketches(stats.where("not base_failed")), "quantile-sketches")
    both = quartiles(sketch, ["lang", "source"]).alias("g").join(quartiles(sketch, ["lang"]).alias("l"), F.expr("g.lang <=> l.lang"))
    columns = []
    for measure, (_, slack, *_, low_too) in MEASURES.items():

        def quartile(percent: int, m: str = measure) -> Column:
            own, parent = F.col(f"g.{m}_{percent}"), F.col(f"l.{m}_{percent}")
            return (F.col("g.n") * own + PRIOR_DOCS * parent) / (F.col("g.n") + PRIOR_DOCS)

        reach = FENCE * (quartile(75) - quartile(25)) + slack
        low = quartile(25) - reach if low_too else F.lit(-1.0)
        columns += [low.alias(f"{measure}_low"), (quartile(75) + reach).alias(f"{measure}_high")]
    return both.select(F.col("g.lang").alias("_lang"), F.col("g.source").alias("_source"), *columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept, broken) per row of ``docs`` (doc_id, text, lang, source).

    A document is kept if it passes the base rules and each measure lies within the fences of its language and source,
    widened for short texts by what chance alone does there. ``broken`` names the measures that do not.

    A null or empty text has no words and fails the base. Null languages and sources are groups of their own.
    Repeated rows count and are judged each. A group without a document that passes the base has no
    fences, and needs none. No rows give none.
    """
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    ddl = ", ".join(["doc_id bigint", "lang string", "source string", *(f"{s} bigint" for s in STATS)])
    stats = stage(given.mapInArrow(_stats, ddl).withColumn("base_failed", base_failed()), "text-stats")
    joined = stats.join(fences(stats), F.expr("lang <=> _lang and source <=> _source"), "left")
    broken = []
    for measure, (expression, _, noise, base, _) in MEASURES.items():
        spread = F.lit(noise) / F.sqrt(F.greatest(base, F.lit(1)))
        value = F.when(~F.col("base_failed"), F.expr(expression))
        out = (value < F.col(f"{measure}_low") - spread) | (value > F.col(f"{measure}_high") + spread)
        broken.append(F.when(out, F.lit(measure)))
    joined = joined.withColumn("broken", F.array_compact(F.array(*broken)))
    kept = (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept")
    return joined.select("doc_id", "lang", "source", *STATS, "base_failed", kept, "broken")
