"""Token arrays: encoding, templates, padding, masks and masked-language-model labels."""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.operators.index import with_running
from moltable.operators.vocab import Vocabulary, pretokenize
from moltable.runtime import stage

PAD_MULTIPLE = 8  # padded lengths are multiples of this
IGNORE_INDEX = -100  # fixed value: label of positions the loss leaves out
BLOCK_ROWS = 1_000_000  # positions ordered by one task
SLICE_STRINGS = 1 << 17  # elements of lists that a worker handles at a time; what is made of an Arrow batch goes back in such pieces
CACHED_PIECES = 200_000  # encoded pieces a task remembers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _encode_piece(piece: str, ids: dict, ranks: dict, unk: int) -> list[int]:
    """Ids of one piece: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
    parts = list(piece)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if j < len(parts) and (rank := ranks.get((parts[i], parts[j]))) is not None:
            heapq.heappush(queue, (rank, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if parts[i] != left or j >= len(parts) or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ids.get(p, unk) for p in parts if p is not None]


def _slices(lists: pa.Array) -> Iterator[pa.Array]:
    """The rows of a batch, as many at a time as hold ``SLICE_STRINGS`` elements, at least one."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_STRINGS, side="right")))
        yield lists.slice(at, stop - at)
        at = stop


def _map_lists(lists: pa.Array, encode: Callable[[pa.Array], tuple[pa.Array, np.ndarray | None]]) -> pa.Array:
    """Replace the strings of list rows by ids, over all rows at once.

    ``encode`` maps the flat strings to flat ids and, where a string is not one id, how many each
    has. A missing list becomes an empty one.
    """
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids, per_string = encode(lists.flatten())
    ends = np.cumsum(counts)
    if per_string is not None:
        ends = np.concatenate([[0], np.cumsum(per_string)])[ends]
    offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, ids)


def encode_bpe(df: DataFrame, text_col: str, vocab: Vocabulary, unk: str = "[UNK]", name: str = "ids") -> DataFrame:
    """Add the ids of a text under a byte-pair vocabulary.

    No shuffle: pieces are cut in the JVM and merged in slices of Arrow batches, each distinct piece of a
    slice once, and remembered. What every task is sent is the vocabulary, whose size is fixed.
    """
    ids, ranks = vocab.ids, {}
    for rank, pair in enumerate(vocab.merges):
        ranks.setdefault(pair, rank)
    unk_id = ids[unk]

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, list[int]] = {}

        def encode(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
            coded = pieces.dictionary_encode()
            if len(seen) > CACHED_PIECES:
                seen.clear()
            lists = []
            for piece in coded.dictionary.to_pylist():
                if piece not in seen:
                    seen[piece] = _encode_piece(piece, ids, ranks, unk_id)
                lists.append(seen[piece])
            spread = pa.array(lists, type=pa.list_(pa.int32())).take(coded.indices)
            return spread.flatten(), pc.list_value_length(spread).to_numpy(zero_copy_only=False)

        for batch in batches:
            for some in _slices(batch):
                yield _map_lists(some, encode)

    return df.withColumn(name, run(pretokenize(F.col(text_col))))


def encode_words(df: DataFrame, word_lists: Column, vocab: Vocabulary, unk: str = "[UNK]", name: str = "ids") -> DataFrame:
    """Add the id of each word of a list, ``unk`` for those not in the vocabulary.

    No shuffle: joining the words to the vocabulary would move every occurrence twice, to the
    token and back to its text. The fixed vocabulary is looked up in slices of Arrow batches instead.
    """
    tokens, unk_id = vocab.tokens, vocab.ids[unk]

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(tokens, type=pa.string())

        def encode(words: pa.Array) -> tuple[pa.Array, None]:
            return pc.fill_null(pc.index_in(words, value_set=known), unk_id), None

        for batch in batches:
            for some in _slices(batch):
                yield _map_lists(some, encode)

    return df.withColumn(name, run(word_lists))


def template_single(a: Column, cls: int, sep: int) -> Column:
    return F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)))


def template_pair(a: Column, b: Column, cls: int, sep: int) -> Column:
    return F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), b, F.array(F.lit(sep)))


def truncate(ids: Column, max_length: int, n_special: int = 2) -> Column:
    """Leave room for the special tokens within ``max_length``."""
    return F.slice(ids, 1, max(max_length - n_special, 0))


def round_up(length: Column, multiple: int = PAD_MULTIPLE) -> Column:
    return (F.ceil(length / F.lit(multiple)) * multiple).cast("int")


def pad_to(ids: Column, length: Column | int, pad: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def with_batch_length(df: DataFrame, ids_col: str, batch_rows: int, row_col: str = "row_idx") -> DataFrame:
    """Add ``pad_len``: the longest list among consecutive rows, rounded up to the multiple."""
    batch = Window.partitionBy(F.expr(f"{row_col} div {batch_rows}"))
    return df.withColumn("pad_len", round_up(F.max(F.size(ids_col)).over(batch)))


def bucketed_batches(df: DataFrame, ids_col: str, batch_rows: int, row_col: str = "row_idx") -> DataFrame:
    """Add ``batch`` and ``pad_len`` of batches of rows of like length: exactly ``batch_rows`` each, the last one fewer.

    Rows are ordered by their padded length, then by position. Numbers of the batches follow from running counts over
    blocks of that order, blocks being ranges of positions of one length, so a length that most rows have is many
    blocks. Only lengths and positions are ordered; the lists move once, when the batches are joined to them. ``row_col``
    must be unique.
    """
    sizes = df.select(F.col(row_col).alias("_row"), round_up(F.size(ids_col)).alias("_size"))
    block = F.struct("_size", F.expr(f"_row div {BLOCK_ROWS}").alias("range"))
    placed = with_running(sizes, [], block, ["_row"], {"_at": ("sum", F.lit(1), False)})
    placed = placed.select("_row", "_size", F.expr(f"_at div {batch_rows}").alias("batch"))
    longest = placed.groupBy("batch").agg(F.max("_size").alias("pad_len"))
    batches = placed.join(longest, "batch").select(F.col("_row").alias(row_col), "batch", "pad_len")
    return df.join(batches, row_col)


def padding_share(batched: DataFrame, ids_col: str) -> DataFrame:
    """(share): that of padding among all cells of batches with their ``pad_len``."""
    return batched.agg((1 - F.sum(F.size(ids_col)) / F.sum("pad_len")).alias("share"))


def attention_mask(ids: Column, length: Column | int) -> Column:
    """1 for tokens, 0 for padding, from ids without padding."""
    length = F.lit(length) if isinstance(length, int) else length
    zeros = F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), zeros)


def special_mask(ids: Column, special: list[int]) -> Column:
    """1 for special tokens, padding among them."""
    return F.transform(ids, lambda x: x.isin(special).cast("int"))


def mlm_mask(
    id_col: str, ids: Column, special: list[int], mask_id: int, vocab_size: int, seed: int,
    mlm_probability: float = 0.30, mask_replace: float = 0.8, random_replace: float = 0.1,
) -> Column:
    """Array of (input_id, label) for masked-language-model training, both 32-bit as the ids that the encoders make.

    A share of the non-special tokens is chosen; of those most become the mask, some a random id
    and the rest stay. Labels are the ids chosen and IGNORE_INDEX elsewhere. Each token has one draw
    in [0, 1): below the share it is chosen, and where below decides what becomes of it. Four
    draws come from one digest of seed, row and place, so they do not depend on partitioning. Missing
    tokens stay so, and a missing list gives none.
    """

    @F.arrow_udf("array<struct<input_id: int, label: int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, lists in batches:
            at = 0
            for some in _slices(lists):
                names = rows.slice(at, len(some)).to_pylist()
                at += len(some)
                counts = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
                flat = some.flatten()
                there = flat.is_valid().to_numpy(zero_copy_only=False)
                tokens = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
                blocks = -(-counts // 4)
                digests = [hashlib.md5(f"{n}-{b}".encode()).digest() for n, k in zip(names, blocks.tolist(), strict=True) for b in range(k)]
                numbers = np.frombuffer(b"".join(digests), ">u4")
                ends = np.cumsum(counts)
                skipped = 4 * (np.cumsum(blocks) - blocks) - (ends - counts)  # numbers of earlier rows that no token takes
                draws = numbers[np.arange(len(tokens)) + np.repeat(skipped, counts)] / float(16**8)
                chosen = np.flatnonzero((draws < mlm_probability) & there & ~np.isin(tokens, special))
                within = draws[chosen] / mlm_probability
                masked = within < mask_replace
                drawn = ~masked & (within < mask_replace + random_replace)
                inputs, labels = tokens.copy(), np.full(len(tokens), IGNORE_INDEX, np.int32)
                labels[chosen] = tokens[chosen]
                inputs[chosen[masked]] = mask_id
                other = np.floor((within[drawn] - mask_replace) / random_replace * vocab_size).astype(np.int32)
                inputs[chosen[drawn]] = np.minimum(other, vocab_size - 1)
                cells = pa.StructArray.from_arrays([pa.array(inputs, mask=~there), pa.array(labels)], ["input_id", "label"])
                offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
                yield pa.ListArray.from_arrays(offsets, cells, mask=some.is_null())

    return run(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")), ids.cast("array<int>"))


def loss_positions(df: DataFrame, id_col: str, cells_col: str) -> DataFrame:
    """Only the positions the loss looks at: (id, pos, input_id, label).

    Spark would test lists for emptiness below an inner ``posexplode``, which makes the cells twice; the outer one adds only rows
    without a label, which go with the others.
    """
    cells = df.select(id_col, F.posexplode_outer(cells_col).alias("pos", "c"))
    return cells.select(id_col, "pos", "c.input_id", "c.label").where(F.col("label") != IGNORE_INDEX)


def token_usage(encoded: DataFrame, ids_col: str, tokens: DataFrame) -> DataFrame:
    """(id, token, n) for every token of the vocabulary, unused ones with 0.

    An inner ``explode`` would test lists for emptiness below it, for which every text is encoded twice, by two workers. The outer one adds
    a null, which is no token.
    """
    used = encoded.select(F.explode_outer(ids_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return tokens.join(used, "id", "left").select("id", "token", F.coalesce("n", F.lit(0)).alias("n"))


def vocabulary_report(encoded: DataFrame, ids_col: str, unk_id: int) -> DataFrame:
    """One row: tokens, unknown ones, distinct ids, and the spread of lengths per text.

    The ids are read twice, so they are written once instead of encoding every text again.
    """
    encoded = stage(encoded.select(ids_col), "ids")
    size = F.size(ids_col)
    unknown = F.size(F.filter(ids_col, lambda x: x == unk_id))
    lengths = encoded.agg(
        F.count("*").alias("n_texts"),
        F.sum(size).alias("n_tokens"),
        F.sum(unknown).alias("n_unknown"),
        F.percentile(size, 0.5).alias("median_length"),
        F.max(size).alias("max_length"),
    )
    distinct = encoded.select(F.explode(ids_col).alias("id")).distinct().agg(F.count("*")).scalar()
    return lengths.withColumn("n_distinct", distinct)
