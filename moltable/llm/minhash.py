"""Near duplicates by circulant MinHash, every link confirmed on full shingle sets."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.llm.blocks import paired_blocks
from moltable.llm.columns import with_text
from moltable.llm.components import components
from moltable.runtime import stage

SHINGLE_WORDS = 5
UNIVERSE_BITS = 18  # places of the circle that shingles are thrown on
BAND_ROWS = 8
MISS = 1e-6  # chance that a pair at the threshold shares no band
GROUP_ROWS = 400  # documents compared in one piece
SEED = 7
SHINGLE_SLICE = 2048
CACHED_WORDS = 200_000  # word hashes a worker remembers within a task


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` coordinates that a pair at the threshold misses with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (two rounds of xor-shift and odd multiplication)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; one of the whole sequence below five words.

    Words are runs of anything but ASCII blanks, A-Z in lower case (as ``bytes`` methods define both).
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHED_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE_WORDS, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(n):
            mixed = _mix(mixed + h[at : len(h) - n + 1 + at])
    return np.unique(mixed)


@functools.cache
def _circle(coordinates: int, seed: int = SEED) -> np.ndarray:
    """Windows of the second permutation: row ``x`` holds its values at places x, x + 1, ... round the circle."""
    size = 1 << UNIVERSE_BITS
    values = np.random.default_rng(seed).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash: coordinate ``k`` is the minimum of the second permutation, shifted by ``k``, over the set.

    The first permutation scatters the shingles on a circle of 2**18 places, which breaks any structure;
    shifting the second by one place after the other gives all coordinates from that one permutation.
    Its window at a shingle's place holds the values of all shifts side by side.
    """
    circle = _circle(coordinates, seed)
    with np.errstate(over="ignore"):
        place = (_mix(shingles + np.uint64(seed)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    low = np.full(coordinates, 1 << UNIVERSE_BITS, np.uint32)
    for at in range(0, len(place), SHINGLE_SLICE):
        np.minimum(low, circle[place[at : at + SHINGLE_SLICE]].min(axis=0), out=low)
    return low


def band_keys(coordinates: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, the number of the band mixed in."""
    bands = coordinates.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(rows):
            key = _mix(key + bands[:, at])
    return key.view(np.int64)


def sketch(docs: DataFrame, threshold: float, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) per row; digest null and no bands for an empty set."""
    coordinates = band_count(threshold, rows) * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sizes, digests, bands = [], [], []
                for text in some.column(1).to_pylist():
                    shingles = shingle_set(text)
                    sizes.append(len(shingles))
                    digests.append(xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None)
                    bands.append(band_keys(signature(shingles, coordinates), rows) if len(shingles) else [])
                yield pa.record_batch(
                    [some.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )
        _words.clear()

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _forest(
    sets: list[np.ndarray], ids: np.ndarray, block: np.ndarray, cross: bool, threshold: float, coordinates: int
) -> list[tuple[int, int]]:
    """Links that join the documents of a piece as all its links at the threshold would.

    A pair is tested on its full sets unless both are already joined, their sizes rule a link out, or their
    signatures agree in so few coordinates that a pair at the threshold would do so once in millions.
    """
    percent = round(threshold * 100)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, sizes))
    signatures = np.stack([signature(s, coordinates) for s in sets])
    least = coordinates * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / coordinates))
    group = np.arange(len(sets))
    links = []
    for at, j in enumerate(order):
        near = order[:at][100 * sizes[order[:at]] >= percent * sizes[j]]
        if cross:
            near = near[block[near] != block[j]]
        near = near[np.count_nonzero(signatures[near] == signatures[j], axis=1) >= least]
        for i in near:
            if group[i] == group[j]:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (len(both) - common):
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    rows: int = BAND_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; documents of one component are near duplicates.

    1. One pass turns each text into the size and digest of its set of five-word shingles and the band keys of its
       circulant MinHash signature.
    2. Documents with equal sets are one class, named by its smallest id; only classes go on.
    3. Classes that share a band key are candidates. Each bucket is named by its smallest class (a partial
       minimum: a hot bucket costs a row per task), and each class hooked to the smallest of its buckets' names.
       Only a hook and another name of the same class are tied, so a family of near copies leaves few ties,
       and the components of these bring together all candidate pairs without listing one.
    4. The texts of candidates alone are read again. A component too large for one task is cut into blocks, and all pairs
       of blocks are compared, so nothing is capped. Tasks return links that span what they found.
    5. The components of confirmed links and equal sets are the answer.

    A null or blank text has no shingles and is linked with nothing; below five words the whole sequence is
    the one shingle. A null id is linked with nothing, its component is null and it is kept. Rows that repeat an id
    are one document with the links of all of them. No rows give none.
    """
    given = with_text(docs, id_col, text_col)
    sketched = stage(sketch(given, threshold, rows), "sketches")
    usable = sketched.where("digest is not null and doc_id is not null")
    classes = stage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    heads = classes.select(F.col("rep").alias("doc_id"), "digest")
    banded = usable.join(heads, ["doc_id", "digest"], "left_semi").select("doc_id", F.explode("bands").alias("key"))
    banded = stage(banded, "bands")
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    buckets = stage(buckets.where("low < high").drop("high"), "buckets")
    lows = banded.join(buckets, "key").groupBy("doc_id").agg(F.collect_set("low").alias("lows"))
    hooked = stage(lows.select("doc_id", F.array_min("lows").alias("hook"), "lows"), "hooked")
    ties = hooked.select(F.col("hook").alias("a"), F.explode("lows").alias("b")).where("a <> b").distinct()
    tied = components(ties).select(F.col("node").alias("hook"), "component")
    groups = hooked.select("doc_id", "hook").join(tied, "hook", "left")
    groups = groups.select("doc_id", F.coalesce("component", "hook").alias("group_id"))
    pieces = paired_blocks(groups, "group_id", "doc_id", group_rows)
    texts = given.join(pieces, "doc_id").dropDuplicates(["doc_id", "_i", "_j", "text"])
    compare = _compare(threshold, band_count(threshold, rows) * rows)
    links = stage(texts.groupBy("group_id", "_i", "_j").applyInPandas(compare, "a bigint, b bigint"), "links")
    equal = usable.join(classes, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    found = components(links.union(equal))
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))


def _compare(threshold: float, coordinates: int):
    def compare(piece: pd.DataFrame) -> pd.DataFrame:
        cross = int(piece["_i"].iloc[0]) < int(piece["_j"].iloc[0])
        sets = [shingle_set(t) for t in piece["text"]]
        ids, own = piece["doc_id"].to_numpy(), piece["_own"].to_numpy()
        links = _forest(sets, ids, own, cross, threshold, coordinates)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return compare
