"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from moltable.llm.columns import with_text
from moltable.llm.encode import worker_encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
CHUNK_TOKENS = 1 << 21

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("window", pa.int64()),
        ("step_id", pa.int64()),
    ]
)
PIECES_DDL = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, window bigint, step_id bigint"
)


class _Pool:
    """Remainders still to be placed, by length."""

    def __init__(self, rests: list[tuple[int, int, int]]) -> None:
        self.sorted = sorted(rests)  # (length, document, start)

    def add(self, rest: tuple[int, int, int]) -> None:
        bisect.insort(self.sorted, rest)

    def longest_up_to(self, room: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_left(self.sorted, (room + 1,))
        return self.sorted.pop(at - 1) if at else None

    def longest_below(self, tier: int) -> tuple[int, int, int] | None:
        """The longest remainder of a shorter tier, else the longest of all."""
        at = bisect.bisect_left(self.sorted, (tier + 1,)) or len(self.sorted)
        return self.sorted.pop(at - 1) if at else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of these lengths: (window length, pieces (document, start, length) in order).

    Documents are routed by length: whole windows of the longest tier are cut off, the remainder
    belongs to the shortest tier that holds it. Tiers are packed from the longest down. A
    remainder opens a window of its tier, whose gap is filled with the longest fitting remainders
    of shorter tiers, in the end with a cut one, whose rest goes back to its tier. So every window is
    full until the remainders run out; what is left then shares one window of the longest tier.
    """
    longest = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    pool = _Pool(rests)
    partial: list[tuple[int, int, int]] = []
    for tier, shorter in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while pool.sorted and pool.sorted[-1][0] > shorter:
            length, doc, start = pool.sorted.pop()
            pieces, room = [(doc, start, length)], tier - length
            while room and pool.sorted:
                if (rest := pool.longest_up_to(room)) is not None:
                    length, doc, start = rest
                else:
                    whole, doc, start = pool.longest_below(shorter)
                    length = room
                    pool.add((whole - room, doc, start + room))
                pieces.append((doc, start, length))
                room -= length
            if room:
                partial += pieces
            else:
                windows.append((tier, pieces))
    # The remainders ran out in one window of each tier at most; their pieces share the last windows.
    while partial:
        pieces, room = [], longest
        while partial and room:
            doc, start, length = partial.pop()
            if length > room:
                partial.append((doc, start + room, length - room))
                length = room
            pieces.append((doc, start, length))
            room -= length
        windows.append((longest, pieces))
    return windows


def balanced_steps(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """Number of the training step of each window.

    A step holds windows of one length and ``step_tokens`` tokens. The windows of a length are dealt to
    its steps by falling attention cost (squared lengths of the pieces), back and forth, so steps
    of a length cost alike.
    """
    steps = [0] * len(windows)
    first = 0
    for tier in sorted({t for t, _ in windows}):
        mine = [i for i, (t, _) in enumerate(windows) if t == tier]
        mine.sort(key=lambda i: -sum(length * length for _, _, length in windows[i][1]))
        n = -(-len(mine) * tier // step_tokens)
        for at, i in enumerate(mine):
            lap, place = divmod(at, n)
            steps[i] = first + (n - 1 - place if lap % 2 else place)
        first += n
    return steps


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    spaced: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """Pack all documents into windows of the ``tiers``; one row per piece of a document.

    Rows hold the ids of the piece (``ids``, little-endian unsigned 32-bit), where it starts in its
    document, its sequence and offset there, the length its sequence is padded to (``window``) and
    the training step. Each task packs its own documents, some ``chunk_tokens`` at a time,
    so nothing is shuffled, memory is bounded by the chunk, and a lost task is simply run again. Padding
    is one window per chunk at most.

    A null text is empty and is its end id alone; a null id stays null. Repeated rows are packed
    each. No documents, no rows. A text beyond a chunk is a chunk of its own.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    if step_tokens % tiers[-1]:
        raise ValueError("a step must hold whole windows of the longest tier")

    def packed(ids: list, tokens: list[np.ndarray], base: int, first: int, step: int) -> tuple[pa.RecordBatch, int, int]:
        windows = pack([len(t) for t in tokens], tiers)
        steps = balanced_steps(windows, step_tokens)
        columns: list[list] = [[] for _ in PIECES]
        for at, (tier, pieces) in enumerate(windows):
            offset = 0
            used = sum(length for _, _, length in pieces)
            window = tier if used == tier or used & (used - 1) else used  # a power of two needs no padding
            for doc, start, length in pieces:
                row = (
                    ids[doc],
                    start,
                    length,
                    tokens[doc][start : start + length].astype("<u4").tobytes(),
                    len(tokens[doc]),
                    base + first + at,
                    offset,
                    window,
                    base + step + steps[at],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += length
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)
        return batch, first + len(windows), step + max(steps, default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, spaced)
        base = TaskContext.get().partitionId() << 33
        ids: list = []
        tokens: list[np.ndarray] = []
        first = step = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids += some.column(0).to_pylist()
                new = encoder.encode(some.column(1).to_pylist(), end_id)
                tokens += new
                size += sum(map(len, new))
                if size >= chunk_tokens:
                    out, first, step = packed(ids, tokens, base, first, step)
                    yield out
                    ids, tokens, size = [], [], 0
        if tokens:
            yield packed(ids, tokens, base, first, step)[0]

    return with_text(docs, id_col, text_col).mapInArrow(run, PIECES_DDL)
