"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.runtime import stage

SAMPLE = 16_384  # vectors that the lists are laid out on, a little less where there are more
LIST_SAMPLE = 64  # sampled vectors of a list, at most
REPLICAS = 4  # lists that hold a boundary vector, at most
REPLICA_RATIO = 1.1  # a vector is also in lists this much further than its nearest
LINKS, BEAM = 24, 48  # neighbours of a centroid in the graph, centroids kept while searching it
TARGET = 0.96  # recall of true neighbours aimed at when the pruning ratio is set on the sample
MIN_LISTS = 8  # a query in a crowd, where the nearest centroid is next to it, still looks around
HELD_ROWS = 200_000  # candidates a task holds before it passes on the best of each query
BLOCK = 2048  # vectors of a list that one piece holds
QUERY_BLOCK = 256
SEED = 5


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def balanced_centroids(x: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of clusters of at most ``limit`` rows: halved again and again by two means, equal in size.

    Each split ranks the rows by the difference of their distances to the two means and cuts in the middle, so
    even a crowd of near-equal vectors is divided.
    """
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= limit:
            out.append(x[rows].mean(axis=0))
            continue
        means = x[rng.choice(rows, 2, replace=False)]
        for _ in range(6):
            lean = distances(x[rows], means[:1])[:, 0] - distances(x[rows], means[1:])[:, 0]
            order = np.argsort(lean, kind="stable")
            half = len(rows) // 2
            means = np.stack([x[rows[order[:half]]].mean(axis=0), x[rows[order[half:]]].mean(axis=0)])
        todo += [rows[order[:half]], rows[order[half:]]]
    return np.stack(out)


@dataclasses.dataclass(frozen=True)
class ListIndex:
    """What every task holds: centroids, their neighbour graph, and the ratio that prunes lists."""

    centroids: np.ndarray
    graph: np.ndarray  # (centroids, links): nearest centroids, and some far ones that keep it connected
    entry: np.ndarray
    ratio: float
    radius: float  # largest norm: see ``lift``

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate makes all norms equal, so that the nearest vector has the largest inner product."""
        rest = np.sqrt(np.maximum(self.radius**2 - (x**2).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found by walking the graph, nearest first: (centroids, distances).

        All rows walk at once: each round looks at the links of every row's best centroid not yet looked at, until
        no row has one among its ``beam`` best.
        """
        n, beam = len(x), min(beam, len(self.centroids))
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.entry] = True
        first = distances(x, self.centroids[self.entry])
        width = max(beam, len(self.entry))
        found = np.full((n, width), -1)
        far = np.full((n, width), np.inf)
        found[:, : len(self.entry)], far[:, : len(self.entry)] = self.entry, first
        opened = np.zeros((n, width), bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            found, far, opened = (np.take_along_axis(a, order, axis=1) for a in (found, far, opened))
            fresh = ~opened & (found >= 0)
            rows = np.flatnonzero(fresh.any(axis=1))
            if not len(rows):
                return found, far
            at = fresh[rows].argmax(axis=1)
            opened[rows, at] = True
            near = self.graph[found[rows, at]]
            known = seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            gap = np.sqrt(np.maximum(((x[rows][:, None] - self.centroids[near]) ** 2).sum(2), 0))
            new_far = np.full((n, near.shape[1]), np.inf)
            new_found = np.full((n, near.shape[1]), -1)
            new_far[rows] = np.where(known, np.inf, gap)
            new_found[rows] = np.where(known, -1, near)
            found, far = np.hstack([found, new_found]), np.hstack([far, new_far])
            opened = np.hstack([opened, np.zeros_like(new_found, bool)])


def build_index(sample: np.ndarray, radius: float, list_sample: int = LIST_SAMPLE, target: float = TARGET, k: int = 20) -> ListIndex:
    """Lay out lists on the sample; the pruning ratio is the one that finds ``target`` of the sample's own neighbours."""
    rng = np.random.default_rng(SEED)
    bare = ListIndex(np.zeros((1, 1)), np.zeros((1, 1), int), np.zeros(1, int), 1.0, radius)
    x = bare.lift(sample)
    centroids = balanced_centroids(x, list_sample, rng)
    gaps = distances(centroids, centroids)
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : 1 + LINKS]
    far = rng.integers(0, len(centroids), (len(centroids), 4))
    entry = np.unique(rng.integers(0, len(centroids), 8))
    index = ListIndex(centroids, np.hstack([near, far]), entry, 1.0, radius)
    # A query is not lifted by its own norm: it has no place on the sphere, only a direction.
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    held = distances(x, centroids)
    lists = np.zeros(held.shape, bool)
    np.put_along_axis(lists, np.argsort(held, axis=1, kind="stable")[:, :REPLICAS], True, axis=1)
    lists &= held <= REPLICA_RATIO * held.min(axis=1, keepdims=True)
    to = distances(index_queries(sample[asked], radius), centroids)
    reach = np.stack([np.where(lists[best[:, j]], to, np.inf).min(axis=1) for j in range(best.shape[1])], axis=1)
    ratio = float(np.quantile(reach / np.maximum(to.min(axis=1, keepdims=True), 1e-12), target))
    return dataclasses.replace(index, ratio=max(1.0, ratio))


def index_queries(x: np.ndarray, radius: float) -> np.ndarray:
    """Queries on the sphere of the lifted vectors: their length does not change the order of inner products."""
    norms = np.sqrt((x**2).sum(1))[:, None]
    return np.hstack([x / np.maximum(norms, 1e-300) * radius, np.zeros((len(x), 1))])


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite numbers, one of them not zero."""
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors with the largest inner products found for each query row.

    ``queries`` is a condition on ``vectors``; a query's own row is no candidate. Every usable vector is indexed: it
    goes to the list of its nearest centroid and to up to ``REPLICAS`` of about the same distance. A query
    visits the lists whose centroids are within ``ratio`` times the distance of its nearest. Both find centroids by the
    graph, which is laid out on ``sample`` vectors chosen by a hash of their ids and so has a fixed size. Lists are cut
    into blocks of some ``BLOCK`` vectors, queries of a list into blocks of ``QUERY_BLOCK``, and blocks meet
    blocks, so a list of any size is searched whole and no task holds it. Scores are inner products of the
    original vectors in double precision; ties go to the smaller id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those whose
    dimension is not the commonest (the smaller, if several are). Null ids take no part. Of repeated
    ids, the smallest vector is taken. No vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), queries.alias("asked")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    given = given.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    given = stage(given, "vectors")
    out = "query_id bigint, rank int, vec_id bigint, score double"
    dims = given.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    given = given.where(F.size("v") == dims[0]["dim"])
    kind = given.schema["v"].dataType.simpleString()  # vectors travel as they are stored and are widened in the tasks
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    radius = given.agg(F.max(norm)).first()[0]
    # A hash of the id below a cut that lets a little less than ``sample`` rows pass: nothing else comes to the driver.
    rows = given.count()
    cut = 2**32 if rows <= sample else int(2**32 * 0.97 * sample / rows)
    chosen = given.where(F.pmod(F.xxhash64("vec_id"), F.lit(2**32)) < cut).select("vec_id", "v").toArrow().sort_by("vec_id")
    index = build_index(_matrix(chosen.column("v").combine_chunks()), radius, target=target, k=k)
    held = spark.sparkContext.broadcast(index)  # bounded by the sample

    def route(batches: Iterator[pa.RecordBatch], asked: bool) -> Iterator[pa.RecordBatch]:
        index = held.value
        beam = BEAM
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = _matrix(some.column("v"))
                if asked:
                    points, most = index_queries(x, index.radius), len(index.centroids)
                    ratio, least = index.ratio, MIN_LISTS
                    found, far = index.search(points, beam)
                    # The walk widens until it has passed the last centroid within the ratio, whatever their number.
                    while beam < most and (far[:, -1] <= ratio * far[:, 0]).any():
                        beam = min(most, 2 * beam)
                        found, far = index.search(points, beam)
                else:
                    ratio, least = REPLICA_RATIO, 1
                    found, far = (a[:, :REPLICAS] for a in index.search(index.lift(x), BEAM))
                near = far <= ratio * np.maximum(far[:, :1], 1e-12)
                near[:, :least] = found[:, :least] >= 0
                row, place = np.nonzero(near)
                taken = pa.array(row)
                yield pa.record_batch(
                    [pa.array(found[row, place], pa.int32()), some.column("vec_id").take(taken), some.column("v").take(taken)],
                    names=["list", "vec_id", "v"],
                )

    ddl = f"list int, vec_id bigint, v {kind}"
    stored = given.select("vec_id", "v").mapInArrow(lambda b: route(b, False), ddl)
    asked = given.where("asked").select("vec_id", "v").mapInArrow(lambda b: route(b, True), ddl)

    def blocks(df: DataFrame, size: int, label: str) -> DataFrame:
        """(list, block, ids, matrix): rows of a list in blocks of about ``size``."""
        df = stage(df, label)
        cut = stage(df.groupBy("list").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("n")), f"{label}-sizes")
        placed = df.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
        return placed.groupBy("list", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    pairs = blocks(asked, QUERY_BLOCK, "asked").select("list", F.col("rows").alias("queries"))
    pairs = pairs.join(blocks(stored, BLOCK, "lists").select("list", "rows"), "list")

    def best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ``k`` best of each query among these rows; a vector that several lists hold counts once."""
        query, vec, score = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        query, vec, score = query[new], vec[new], score[new]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
        return [(query[place < k], vec[place < k], score[place < k])]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = floor = 0
        for batch in batches:
            for at in range(batch.num_rows):
                sides = [batch.column(c).slice(at, 1).flatten() for c in ("queries", "rows")]
                ids = [s.field("vec_id").to_numpy() for s in sides]
                q, x = (_matrix(s.field("v")) for s in sides)
                scores = q @ x.T
                scores[ids[0][:, None] == ids[1][None]] = -np.inf
                most = min(k, scores.shape[1])
                # All that tie with the last are kept, so that the smaller id can win later.
                edge = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                row, place = np.nonzero((scores >= edge[:, None] - 1e-9 * np.abs(edge[:, None])) & (scores > -np.inf))
                held.append((ids[0][row], ids[1][place], (q[row] * x[place]).sum(axis=1)))
                rows += len(row)
                if rows > floor + HELD_ROWS:
                    held = best(held)
                    rows = floor = len(held[0][0])
                    if rows > HELD_ROWS:  # of so many queries that their best alone are too many to hold
                        yield pa.record_batch([pa.array(c) for c in held[0]], names=names)
                        held, rows, floor = [], 0, 0
        if held:
            yield pa.record_batch([pa.array(c) for c in best(held)[0]], names=names)

    found = pairs.select("queries", "rows").mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
