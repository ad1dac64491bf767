"""Mixing sources to target weights by whole copies and Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.llm.columns import WORD
from moltable.operators.index import seeded_digest, with_global_index
from moltable.runtime import stage

WEIGHTS = (5, 2, 1)
SHARE, MAX_COPIES = 1.5, 2
SEED = 17
CELLS = 4096  # cells of each of the two histograms that find a source's last document
_DIGITS = 13  # hexadecimal digits of a uniform number: 52 bits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Bits of size + 1: grows slowly, so long documents are favoured a little."""
    return F.length(F.bin(size + 1)).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source_key, source_size, target) for (source_key, source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and divide ``share`` of all words by them. A
    target stops at ``max_copies`` times its source; what is cut off is shared anew among the others, until none
    is above. Each round the driver reads one row: the words and weights still open.
    """
    if share > max_copies:
        raise ValueError("no mix of at most max_copies copies has so many words")
    ordered = with_global_index(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "place")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = stage(ordered.withColumn("weight", turn).drop("_null", "place"), "sources")
    stop = F.col("source_size") * max_copies
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, stopped = None, -1
    while True:
        full = F.lit(False) if rate is None else stop <= F.col("weight") * rate
        row = weighted.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if row[0] == stopped or row[2] is None:
            break
        stopped, rate = row[0], (total - (row[1] or 0)) / row[2]
    target = stop if rate is None else F.least(stop, F.col("weight") * rate)
    return weighted.select("source_key", "source_size", target.cast("double").alias("target"))


def _expected_copies(classes: DataFrame, max_copies: int) -> DataFrame:
    """Expected copies of a document of each (source_key, importance), proportional to importance up to ``max_copies``.

    Classes of a source in falling order: those that reach the maximum come first, the factor of the rest follows
    from the words left. A source has a few dozen classes.
    """
    falling = Window.partitionBy("source_key").orderBy(F.desc("importance"))
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("importance") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    factor = F.when(rest > 0, (F.col("target") - max_copies * before) / F.nullif(rest, F.lit(0)))
    open_ = classes.withColumn("factor", factor).withColumn("open", F.col("factor") * F.col("importance") < max_copies)
    chosen = F.max_by(F.when(F.col("open"), F.col("factor")), F.when(F.col("open"), F.col("importance"))).over(
        Window.partitionBy("source_key")
    )
    most = F.lit(float(max_copies))
    copies = F.when(chosen.isNull(), most).otherwise(F.least(most, F.greatest(chosen, F.lit(0.0)) * F.col("importance")))
    return open_.select("source_key", "importance", "words", "target", copies.alias("copies"))


def _last_taken(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_key, last_rank, last_digest): where the order of each source is cut so that its words come nearest ``wanted``.

    Two histograms of the ranks find the cell of a 16-millionth of the order where the words run out; only
    documents in that cell are sorted. Histogram rows are partial sums, so a source of any size costs
    each task a row per cell.
    """

    def boundary(rows: DataFrame, cell: Column, wanted: DataFrame) -> DataFrame:
        counts = rows.groupBy("source_key", cell.alias("cell")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source_key").orderBy("cell")
        running = counts.join(wanted, "source_key").withColumn("sum", F.sum("words").over(upto))
        last = F.max("cell").over(Window.partitionBy("source_key"))
        hit = running.withColumn("last", last).where("sum >= wanted or cell = last")
        first = hit.groupBy("source_key").agg(F.min_by(F.struct("cell", "sum", "words", "wanted"), "cell").alias("b"))
        return stage(
            first.select("source_key", F.col("b.cell").alias("edge"), (F.col("b.wanted") - F.col("b.sum") + F.col("b.words")).alias("wanted")),
            "edges",
        )

    coarse = F.floor(F.col("rank") * CELLS)
    fine = F.floor((F.col("rank") * CELLS - coarse) * CELLS)
    first = boundary(ranked, coarse, wanted)
    inside = ranked.join(first.select("source_key", "edge"), "source_key").where(coarse == F.col("edge"))
    second = boundary(inside.drop("edge"), fine, first.drop("edge"))
    last = inside.drop("edge").join(second, "source_key").where(fine == F.col("edge"))
    equal = last.groupBy("source_key", "rank", "digest", "wanted").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source_key").orderBy("rank", "digest")
    placed = equal.withColumn("sum", F.sum("words").over(order))
    nearer = placed.where(2 * F.col("wanted") >= 2 * F.col("sum") - F.col("words"))  # no further from it with the row than without
    taken = nearer.groupBy("source_key").agg(F.max(F.struct("rank", "digest")).alias("last"))
    edge = first.withColumnRenamed("edge", "coarse").drop("wanted").join(second.select("source_key", "edge"), "source_key")
    below = (F.col("coarse") + F.col("edge") / CELLS) / CELLS  # no row of the cell is taken: cut before it
    return edge.join(taken, "source_key", "left").select(
        "source_key",
        F.coalesce("last.rank", below).alias("last_rank"),
        F.coalesce("last.digest", F.lit("")).alias("last_digest"),
    )


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    importance=size_class,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix`` = (size, source_size, target, expected, copies): how often the mix takes each row.

    A document of a source is expected in proportion to ``importance`` (a function of the size column with few
    integer values above 0), at most ``max_copies`` times, so that the source's words are its target. The whole part of that
    is taken for certain. The rest is its inclusion odds in a Pareto sample: a random number that depends only on
    seed, id and text gives random odds, these are divided by the inclusion odds, and the documents
    smallest in that order are taken until the words come nearest the target (within half a document).

    A null text has size 0; null sources are one source, the last; a null id is one more id. Rows equal in id
    and text share one decision. Sources without words take nothing and have target 0. No rows give none.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = seeded_digest(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    size = word_count(text)
    facts = (key.alias("source_key"), size.alias("size"), digest.alias("digest"))
    rows = docs.select(*facts, F.col(source_col).alias("source")).withColumn("importance", importance(F.col("size")))
    rows = stage(rows, "sizes")
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_copies)
    words = rows.groupBy("source_key", "importance").agg(F.sum("size").alias("words"))
    classes = stage(_expected_copies(words.join(targets.select("source_key", "target"), "source_key"), max_copies), "classes")
    tiny = 1e-9
    whole = F.floor(F.col("copies") + tiny)
    classes = classes.withColumn("whole", whole).withColumn("part", F.greatest(F.col("copies") - whole, F.lit(0.0)))
    classes = classes.withColumn("part", F.when(F.col("part") > tiny, F.col("part")).otherwise(0.0))
    wanted = classes.groupBy("source_key").agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("wanted"), F.max("part").alias("open")
    )
    wanted = stage(wanted.where("open > 0").drop("open"), "wanted")
    parts = classes.select("source_key", "importance", "whole", "part", F.col("copies").alias("expected"))

    def ranked(df: DataFrame) -> DataFrame:
        uniform = (F.conv(F.substring("digest", 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        odds = uniform / (1 - uniform) * (1 - F.col("part")) / F.col("part")
        return df.withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds)))

    sampled = ranked(rows.join(parts, ["source_key", "importance"])).where("rank is not null")
    last = _last_taken(sampled.select("source_key", "rank", "digest", "size"), wanted)
    rules = parts.join(targets, "source_key").join(last, "source_key", "left")
    rules = stage(rules, "rules")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of it can clash
    every = docs.select(row, *facts).withColumn("importance", importance(F.col("size")))
    decided = ranked(every.join(rules, ["source_key", "importance"]))
    extra = F.coalesce(F.struct("rank", "digest") <= F.struct(F.col("last_rank").alias("rank"), F.col("last_digest").alias("digest")), F.lit(False))
    extra = extra & F.col("rank").isNotNull() & F.col("last_rank").isNotNull()
    mix = F.struct("size", "source_size", "target", "expected", (F.col("whole") + extra.cast("int")).cast("int").alias("copies"))
    return decided.select("row.*", mix.alias("mix"))
