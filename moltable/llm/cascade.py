"""URL filters by a cascade of Bloom filters that is exact over the corpus's own keys."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltable.runtime import stage

LATER_MISS = 0.25  # false positives of every level but the first
LEAST_MISS = 2.0**-20
MAX_BITS = 1 << 27  # of a level; a longer list is cut into shards of this size, read one after the other
_WORD = 64


@dataclasses.dataclass(frozen=True)
class Level:
    bits: np.ndarray  # 64-bit words
    hashes: int

    @property
    def size(self) -> int:
        return len(self.bits) * _WORD


def _geometry(n: int, miss: float) -> tuple[int, int]:
    """(words, hash functions) of a filter of ``n`` keys with this rate of false positives."""
    hashes = max(1, round(-math.log2(miss)))
    return max(1, math.ceil(n * hashes / math.log(2) / _WORD)), hashes


def _hash(key: Column, level: int) -> Column:
    """64 bits of the key; the number of the level is hashed first, so keys that meet in one level part in the next."""
    return F.xxhash64(F.lit(level), key)


def _hashes(keys: str, level: int) -> Column:
    return F.transform(keys, lambda k: _hash(k, level))


def _places(h: np.ndarray, level: Level) -> Iterator[np.ndarray]:
    """The places of hashed keys, one hash function after the other; as ``_filter`` sets them."""
    first, step = h & 0x7FFFFFFF, ((h >> 32) & 0x7FFFFFFF) | 1
    for at in range(level.hashes):
        yield (first + at * step) % level.size


def _holds(h: np.ndarray, level: Level) -> np.ndarray:
    found = np.ones(len(h), bool)
    for place in _places(h, level):
        found &= (level.bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def _filter(keys: DataFrame, n: int, number: int, miss: float) -> Level:
    """Level ``number`` over ``keys``. Its words are or-ed in the tasks; the driver gets at most MAX_BITS of them."""
    words, hashes = _geometry(n, miss)
    h = _hash(F.col("key"), number)
    first, step = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftright(h, 32).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
    size = F.lit(words * _WORD).cast("bigint")
    places = keys.select(F.explode(F.array(*[(first + at * step) % size for at in range(hashes)])).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % _WORD).cast("int"))
    rows = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Level(bits, hashes)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """The keys that a level holds, truly or falsely."""
    sent = keys.sparkSession.sparkContext.broadcast(level)  # MAX_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _holds(batch.column("h").to_numpy(), sent.value)
            yield pa.record_batch([batch.column("key").filter(pa.array(found))], names=["key"])

    return keys.select("key", _hash(F.col("key"), number).alias("h")).mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the keys of ``listed`` from all other keys of ``universe`` (both: one column ``key``) without error.

    Level 0 holds the listed keys; level 1 those other keys of the universe that level 0 holds falsely; level 2 the
    listed keys that level 1 holds falsely; and so on, until no key is held falsely. A key is then listed if the first
    level that lacks it is odd, or none lacks it and their number is odd. The universe is read once, by
    level 0; what passes is as many keys as are listed, and shrinks from level to level. A key outside of the universe
    may be judged wrongly, which is why it must hold all keys that are ever asked.
    """
    listed = stage(listed.where("key is not null").select("key").distinct(), "listed")
    universe = universe.where("key is not null").select("key")
    n, others = listed.count(), universe.count()
    levels: list[Level] = []
    miss = min(0.5, max(LEAST_MISS, n / (2 * max(others, 1))))
    inside, outside = listed, universe
    while n:
        levels.append(_filter(inside, n, len(levels), miss))
        passed = _passing(outside, levels[-1], len(levels) - 1)
        if len(levels) == 1:
            passed = passed.distinct().join(listed, "key", "left_anti")
        inside, outside = stage(passed, "held"), inside
        n, miss = inside.count(), LATER_MISS
    return levels


def _members(hashes: list[np.ndarray], levels: list[Level]) -> np.ndarray:
    """Which keys are listed, from their hashes by level."""
    count = len(hashes[0]) if hashes else 0
    found = np.zeros(count, bool)
    open_ = np.arange(count)
    for number, level in enumerate(levels):
        held = _holds(hashes[number][open_], level)
        found[open_[~held]] = number % 2 == 1
        open_ = open_[held]
    found[open_] = len(levels) % 2 == 1
    return found


def _first_member(rows: DataFrame, keys: str, levels: list[Level], name: str) -> DataFrame:
    """``rows`` with the place of the first of its ``keys`` that is listed, from 0, or null. No shuffle, no join."""
    if not levels:
        return rows.withColumn(name, F.lit(None).cast("int"))
    sent = rows.sparkSession.sparkContext.broadcast(levels)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    hashes = [_hashes(keys, n).alias(f"h{n}") for n in range(len(levels))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(1 + n) for n in range(len(sent.value))]
            found = _members([c.flatten().to_numpy(zero_copy_only=False) for c in lists], sent.value)
            lengths = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(found)
            owner = np.repeat(np.arange(len(lengths)), lengths)[hits]
            first = np.full(len(lengths), -1, np.int64)
            first[owner[::-1]] = (hits - starts[owner])[::-1]  # the earliest hit of a row is written last
            at = pa.array(first, pa.int32(), mask=first < 0)
            yield pa.record_batch([batch.column(0), at], names=["row", name])

    schema = T.StructType([T.StructField("row", rows.schema), T.StructField(name, T.IntegerType())])
    return rows.select(row, *hashes).mapInArrow(run, schema).select("row.*", name)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#`` (A-Z lower-cased), and then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every rule that could fit, as text, longest first: parents of the host with a start of the path.

    Only ``shapes`` (labels of the host, characters of the path) that rules have are tried.
    """
    labels = F.size(F.split(host, r"\."))
    tried = []
    for n, length in shapes:
        possible = (host != "") & (labels >= n) & (F.length(path) >= length)
        parent = F.substring_index(host, ".", -n)
        tried.append(F.when(possible, F.struct(F.length(parent).alias("h"), F.concat(parent, F.substring(path, 1, length)).alias("key"))))
    known = F.filter(F.array(*tried), lambda k: k.isNotNull())
    ordered = F.reverse(F.array_sort(F.transform(known, lambda k: F.struct(F.length(k["key"]).alias("n"), k["h"].alias("h"), k["key"].alias("key")))))
    return F.transform(ordered, lambda k: k["key"])


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``, by ``rules`` (host, path, verdict: allow or block).

    A rule fits its host and all hosts below it, if the path starts with the rule's; the longest fitting rule decides, the
    one with the longer host on a tie. A url that no rule fits is on no list and gets ``default``.

    1. The urls yield every key that any of them could be found by: parents of the host with starts of the path, of the shapes
       that rules have. Their distinct values are the universe.
    2. One cascade tells rules from all other keys of the universe, a second one, over the rules, blocking from allowing
       ones. Both are exact there, so no url is ever compared with a rule and nothing is joined.
    3. The urls are read again where they lie; the cascades travel with the tasks. Lists whose filters would be larger
       than ``max_bits`` are cut by hash into shards that are applied one after the other, so what is sent
       has a bound whatever the list's length.

    A null url, or one without ``://``, has an empty host and path and no rule; a null id stays null; repeated rows are
    judged each; other columns are not read. Rules with a null part are left out; a key listed with both
    verdicts blocks. Without rules every url gets ``default``. No rows give none.
    """
    host, path = host_and_path(F.col(url_col))
    given = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    whole = rules.where("host is not null and path is not null and verdict is not null")
    named = whole.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n"), "verdict")
    named = stage(named.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("labels").alias("labels"), F.max("n").alias("n")), "rules")
    # A host has 127 labels at most; longer paths than a server takes need no rule: a bounded table.
    shapes = sorted((r["labels"], r["n"]) for r in named.select("labels", "n").distinct().collect())
    if not shapes:
        return given.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = given.withColumn("keys", _keys(F.col("host"), F.col("path"), shapes))
    universe = stage(asked.select(F.explode("keys").alias("key")).distinct(), "universe")
    ratio = universe.count() / max(1, named.count())
    per_key = _geometry(1000, max(LEAST_MISS, min(0.5, 1 / (2 * max(ratio, 1)))))[0] * _WORD / 1000
    shards = math.ceil(named.count() * per_key / max_bits)
    judged = asked.withColumn("best", F.lit(None).cast("string"))

    def within(key: Column, shard: int) -> Column:
        return F.pmod(_hash(key, -1), F.lit(shards)) == shard

    def part(df: DataFrame, shard: int) -> DataFrame:
        return df.where(within(F.col("key"), shard))

    def own_keys(shard: int) -> Column:
        return F.filter("keys", lambda k: within(k, shard))

    for shard in range(shards):
        mine = part(named, shard)
        listed = build_cascade(mine, part(universe, shard))
        block = build_cascade(mine.where("verdict = 'block'"), mine)
        found = _first_member(judged.withColumn("_own", own_keys(shard)), "_own", listed, "_at")
        found = found.withColumn("_key", F.get("_own", F.col("_at"))).withColumn("_keys", F.array_compact(F.array("_key")))
        told = _first_member(found, "_keys", block, "_block")
        new = F.when(F.col("_key").isNotNull(), F.concat(F.when(F.col("_block").isNotNull(), "b").otherwise("a"), F.col("_key")))
        place = lambda c: F.array_position(F.col("keys"), F.substr(c, F.lit(2)))
        better = F.col("best").isNull() | (place(new) < place(F.col("best")))
        judged = told.withColumn("best", F.when(new.isNotNull() & better, new).otherwise(F.col("best"))).drop("_own", "_at", "_key", "_keys", "_block")
        if shards > 1:
            judged = stage(judged, "judged")  # the filters of one shard at a time
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.substring("best", 1, 1) == "b", F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.substr("best", F.lit(2)).alias("rule"), verdict.alias("verdict"))
