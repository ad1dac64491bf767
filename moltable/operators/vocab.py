"""Pre-tokens, their counts, and byte-pair vocabularies.

During training a symbol is one character, U+10000 plus its id. A piece is then a plain string,
merging a pair is one ``replace`` (left to right, never overlapping), and the order of pairs as
strings is the order of their ids.
"""

from __future__ import annotations

import heapq
import itertools
import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltable.runtime import stage

SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]  # fixed values, in id order

# Fixed value: the public byte-level pre-token pattern; white space as Unicode defines it.
PIECE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
# The same without look-ahead, as words: what is left of a piece when white space is trimmed.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\p{IsWhite_Space}\p{L}\p{N}]+"

SYMBOL_BASE = 0x10000
PAIR_BITS = 21  # of a code point
FIRST_PAIRS, MAX_PAIRS = 256, 4096  # pairs chosen in the first round of training, and in any
MAX_CHAINS = 100_000  # distinct chains of chosen pairs, the most that a round of training sends to the driver
PIECES_PER_TASK = 10_000  # rows that make a task of the training loop worth its start

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the rest from U+0100 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def byte_level(piece: Column) -> Column:
    """The UTF-8 bytes of a string as printable characters."""
    moved = {chr(b): c for b, c in byte_alphabet().items() if chr(b) != c}
    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(moved), "".join(moved.values()))


def raw_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def pretokenize(text: Column) -> Column:
    """Byte-level pre-tokens of a text, in order."""
    return F.transform(raw_pieces(text), byte_level)


def words(text: Column) -> Column:
    """Pre-tokens without their white space, blank ones left out."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def piece_counts(df: DataFrame, pieces: Column, name: str = "piece") -> DataFrame:
    """How often each piece occurs: (piece, n)."""
    return df.select(F.explode(pieces).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def byte_piece_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Counts of byte-level pre-tokens; pieces are spelled in bytes once each, after counting."""
    counts = piece_counts(df, raw_pieces(F.col(text_col)))
    return counts.select(byte_level(F.col("piece")).alias("piece"), "n")


@dataclass
class Vocabulary:
    """Tokens in id order, and merges in rank order. Never larger than the size asked for."""

    tokens: list[str]
    merges: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def token_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, left, right) for i, (left, right) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string")


def check_special(tokens: DataFrame, special: list[str] = SPECIAL_TOKENS) -> DataFrame:
    """(token, id) of the special tokens; raises if one has no id."""
    found = tokens.where(F.col("token").isin(special)).select("token", "id")
    missing = set(special) - {r.token for r in found.select("token").collect()}
    if missing:
        raise ValueError(f"special tokens without an id: {sorted(missing)}")
    return found


def word_vocabulary(counts: DataFrame, size: int, special: list[str] = SPECIAL_TOKENS) -> Vocabulary:
    """Word-level vocabulary: special tokens, then the most frequent words (piece, n), by name on a tie."""
    top = counts.orderBy(F.desc("n"), "piece").limit(size - len(special))
    return Vocabulary([*special, *[r.piece for r in top.collect()]])


def pair_counts(pieces: DataFrame, symbols: Column) -> DataFrame:
    """Weighted counts of adjacent symbols: (left, right, n), from pieces with their count n.

    Symbols are single characters of ``symbols``; overlapping pairs all count.
    """
    chars = pieces.select(F.split(symbols, "").alias("s"), "n").where(F.size("s") > 1)
    pairs = F.arrays_zip(
        F.slice("s", F.lit(1), F.size("s") - 1).alias("left"), F.slice("s", F.lit(2), F.size("s") - 1).alias("right")
    )
    return (
        chars.select(F.inline(pairs), "n").groupBy("left", "right").agg(F.sum("n").alias("n"))
    )


def _flat(batch: pa.RecordBatch) -> tuple[str, np.ndarray, np.ndarray]:
    """(all pieces of a batch, a line end before, between and after them; its pairs of neighbours as numbers; the place of each
    line end). A pair with a line end in it is 0."""
    text = "\n" + "\n".join(batch.column("s").to_pylist()) + "\n"
    symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = symbols != 10
    pairs = np.where(inside[:-1] & inside[1:], (symbols[:-1] << PAIR_BITS) + symbols[1:], 0)
    return text, pairs, np.flatnonzero(~inside)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, pairs, ends = _flat(batch)
        weights = np.zeros(len(pairs), np.int64)
        weights[ends[:-1]] = np.diff(batch.column("n").to_numpy(), prepend=0)
        weights = np.cumsum(weights)
        found, at = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, weights)
        yield pa.record_batch([pa.array(found[found > 0]), pa.array(total[found > 0])], names=["pair", "n"])


def _chains(pairs: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) symbol of each longest stretch whose neighbours are all among the ``chosen`` pairs."""
    at = np.minimum(np.searchsorted(chosen, pairs), len(chosen) - 1)
    held = np.concatenate([[False], chosen[at] == pairs, [False]])
    return np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(~held[1:] & held[:-1]) + 1


def _count_chains(chosen: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, pairs, ends = _flat(batch)
            first, last = _chains(pairs, chosen.value)
            weights = batch.column("n").to_numpy()[np.searchsorted(ends, first) - 1]
            counts: dict[str, int] = {}
            for u, v, n in zip(first.tolist(), last.tolist(), weights.tolist(), strict=True):
                chain = text[u:v]
                counts[chain] = counts.get(chain, 0) + n
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["chain", "n"])

    return run


def _replace_chains(chosen: Broadcast, merged: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, pairs, _ = _flat(batch)
            parts, done = [], 0
            for u, v in zip(*(x.tolist() for x in _chains(pairs, chosen.value)), strict=True):
                new = merged.value.get(text[u:v])
                if new is not None:
                    parts += (text[done:u], new)
                    done = v
            parts.append(text[done:])
            yield pa.record_batch([pa.array("".join(parts)[1:-1].split("\n"), pa.string()), batch.column("n")], names=["s", "n"])

    return run


class _Greedy:
    """Byte-pair merges of weighted chains, one at a time: the most frequent pair first, the lowest ids on a tie."""

    def __init__(self, chains: list[str], weights: list[int]) -> None:
        self.chains, self.weights = [[ord(c) for c in chain] for chain in chains], weights
        self.counts: dict[tuple[int, int], int] = {}
        self.where: dict[tuple[int, int], set[int]] = {}
        for at in range(len(chains)):
            self._add(at, 1)
        self.queue = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.queue)

    def _add(self, at: int, sign: int) -> set[tuple[int, int]]:
        n = sign * self.weights[at]
        pairs = list(itertools.pairwise(self.chains[at]))
        for pair in pairs:
            self.counts[pair] = self.counts.get(pair, 0) + n
            if sign > 0:
                self.where.setdefault(pair, set()).add(at)
        return set(pairs)

    def best(self) -> tuple[int, int, int] | None:
        """(-count, left, right) of the next pair."""
        while self.queue:
            n, left, right = self.queue[0]
            now = self.counts.get((left, right), 0)
            if now == -n:
                return self.queue[0]
            heapq.heappop(self.queue)
            if now > 0:
                heapq.heappush(self.queue, (-now, left, right))
        return None

    def merge(self, left: int, right: int, symbol: int) -> None:
        created: set[tuple[int, int]] = set()
        for at in self.where.pop((left, right)):
            old = self.chains[at]
            if (left, right) not in itertools.pairwise(old):
                continue
            self._add(at, -1)
            new, i = [], 0
            while i < len(old):
                if old[i] == left and i + 1 < len(old) and old[i + 1] == right:
                    new.append(symbol)
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            self.chains[at] = new
            created |= self._add(at, 1)
        for pair in created:
            if symbol in pair:
                heapq.heappush(self.queue, (-self.counts[pair], *pair))

    def spelled(self) -> list[str]:
        return ["".join(map(chr, chain)) for chain in self.chains]


def train_bpe(
    counts: DataFrame, vocab_size: int = 8192, min_frequency: int = 2, special: list[str] = SPECIAL_TOKENS, max_chains: int = MAX_CHAINS
) -> Vocabulary:
    """Byte-pair vocabulary from byte-level piece counts (piece, n).

    Ids: special tokens, then the characters seen by code point, then merges: always the most frequent adjacent
    pair, the lowest ids on a tie. A round makes many merges at once:

    1. The pairs are counted and the best of them chosen; the first pair that is not is the bar.
    2. Pieces are cut wherever two neighbours are no chosen pair. The distinct chains that are left, with their
       counts, hold every occurrence of the chosen pairs, and of all that is made of them.
    3. On these, the driver merges the best pair again and again, as long as it comes before the bar. No pair
       across a cut can do so: it is never more frequent than the pair that stood there. A merge that
       spells a known token is the last of its round, for only then could a pair across a cut have grown.
    4. The chains in the pieces are replaced by their merged form.

    The number of chains is bounded by ``max_chains``: where there are more, fewer pairs are chosen. So the driver holds the
    vocabulary and one bounded table, never pieces, and a round is three passes over the pieces, whatever the number
    of its merges.
    """
    spark = counts.sparkSession
    counts = stage(counts.select("piece", "n"), "pieces")
    letters = counts.select(F.explode(F.array_distinct(F.split("piece", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(r.c for r in letters.collect())  # at most the 256 characters of the byte alphabet
    tokens = [*special, *alphabet]
    symbol_of = {t: chr(SYMBOL_BASE + i) for i, t in enumerate(tokens)}
    texts = {ord(s): t for t, s in symbol_of.items()}
    merges: list[tuple[str, str]] = []

    start = F.translate("piece", "".join(alphabet), "".join(symbol_of[c] for c in alphabet))
    # The pieces are few bytes and much work: tasks by their number, not by blocks of bytes.
    tasks = 1 + counts.count() // PIECES_PER_TASK
    pieces = stage(counts.select(start.alias("s"), "n").where("length(s) > 1").repartition(tasks), "symbols")
    wanted = FIRST_PAIRS
    while len(tokens) < vocab_size:
        pairs = pieces.mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "pair").limit(MAX_PAIRS + 1).collect()
        if not top:
            break
        while True:
            chosen = spark.sparkContext.broadcast(np.sort(np.array([r.pair for r in top[:wanted]], np.int64)))
            cut = pieces.mapInArrow(_count_chains(chosen), "chain string, n bigint")
            chains = cut.groupBy("chain").agg(F.sum("n").alias("n"))
            found = (chains.limit(max_chains + 1) if wanted > 1 else chains).toArrow()
            if wanted == 1 or found.num_rows <= max_chains:
                break
            wanted = max(1, wanted // 4)
        bar = (-top[wanted].n, *divmod(top[wanted].pair, 1 << PAIR_BITS)) if wanted < len(top) else (1 - min_frequency, 0, 0)
        spelled = found["chain"].to_pylist()
        greedy = _Greedy(spelled, found["n"].to_pylist())
        while len(tokens) < vocab_size and (best := greedy.best()) is not None and best < bar:
            _, left, right = best
            token = texts[left] + texts[right]
            merges.append((texts[left], texts[right]))
            known = token in symbol_of
            if not known:
                symbol_of[token] = chr(SYMBOL_BASE + len(tokens))
                texts[ord(symbol_of[token])] = token
                tokens.append(token)
            greedy.merge(left, right, ord(symbol_of[token]))
            if known:
                break
        if len(tokens) >= vocab_size:
            break
        merged = spark.sparkContext.broadcast({a: b for a, b in zip(spelled, greedy.spelled(), strict=True) if a != b})
        pieces = stage(pieces.mapInArrow(_replace_chains(chosen, merged), "s string, n bigint").where("length(s) > 1"), "symbols")
        if found.num_rows < max_chains // 3:
            wanted = min(2 * wanted, MAX_PAIRS)
    return Vocabulary(tokens, merges)


def write_vocabulary(spark: SparkSession, vocab: Vocabulary, folder: str) -> None:
    """Tokens and merges as JSON lines."""
    vocab.token_table(spark).write.json(f"{folder}/vocab")
    vocab.merge_table(spark).write.json(f"{folder}/merges")


def read_vocabulary(spark: SparkSession, folder: str) -> Vocabulary:
    """A vocabulary to start from, without training."""
    tokens = spark.read.schema("id int, token string").json(f"{folder}/vocab").orderBy("id")
    merges = spark.read.schema("rank int, left string, right string").json(f"{folder}/merges").orderBy("rank")
    return Vocabulary([r.token for r in tokens.collect()], [(r.left, r.right) for r in merges.collect()])


def parse_vocabulary(vocab_json: str, merges_text: str) -> Vocabulary:
    """The usual pair of files: a JSON object token to id, and one merge per line after a comment."""
    ids = json.loads(vocab_json)
    lines = [line for line in merges_text.splitlines() if line and not line.startswith("#version")]
    return Vocabulary(sorted(ids, key=ids.get), [tuple(line.split(" ", 1)) for line in lines])
