"""Token ids in binary files of patched frame-of-reference blocks.

A file holds, little-endian and without gaps:

    magic      8 bytes  b"MTPFOR01"
    counts     3 x uint64: documents, ids, blocks
    doc_id     int64 per document (0 where null)
    known      uint8 per document: 0 where doc_id is null
    n_tokens   uint64 per document
    index      uint64 per block: where it starts in the payload
    minimum    uint32 per block
    width      uint8 per block: bits of a packed value
    n_patch    uint8 per block
    payload    per block: 4 * width uint32 words, n_patch places (uint8), n_patch high parts (uint32)

A block is 128 ids. The minimum is subtracted; the width is that of the given percentile of the rest;
values that need more bits leave their high part in the exception list. Value ``j`` of lane ``l``
(place ``4 * j + l``) occupies bits ``j * width`` onwards of the lane's words, words of the lanes interleaved.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltable.llm.columns import with_text
from moltable.llm.encode import worker_encoder

MAGIC = b"MTPFOR01"
BLOCK, LANES = 128, 4
PERCENTILE = 90
FILE_IDS = 1 << 22  # ids of a file, but for a longer last document

MANIFEST_DDL = "part int, place int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
DOCS_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact below 2**32, where a double holds it."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width to (blocks, 4 * width) words."""
    if not width:
        return np.zeros((len(values), 0), "<u4")
    lanes = values.astype(np.uint64).reshape(len(values), BLOCK // LANES, LANES)
    words = np.zeros((len(values), width + 1, LANES), np.uint64)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 32)
        shifted = lanes[:, j] << np.uint64(shift)
        words[:, word] |= shifted & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= shifted >> np.uint64(32)
    return words[:, :width].astype("<u4").reshape(len(values), LANES * width)


def _unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(words), BLOCK), np.uint32)
    lanes = words.reshape(len(words), width, LANES).astype(np.uint64)
    lanes = np.concatenate([lanes, np.zeros((len(words), 1, LANES), np.uint64)], axis=1)
    out = np.empty((len(words), BLOCK // LANES, LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 32)
        both = lanes[:, word] | (lanes[:, word + 1] << np.uint64(32))
        out[:, j] = ((both >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(len(words), BLOCK)


def encode_file(doc_ids: list[int | None], tokens: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    """The bytes of one file."""
    ids = np.concatenate([np.zeros(0, np.uint32), *tokens]).astype(np.uint32)
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).reshape(n_blocks, BLOCK)
    minimum = padded.min(axis=1, initial=0xFFFFFFFF).astype(np.uint32)
    rest = padded - minimum[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = _bit_widths(np.partition(rest, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.uint8)
    patched = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    n_patch = patched.sum(axis=1)  # 127 at most: the percentile is below the maximum by less than a block
    sizes = 4 * LANES * width.astype(np.int64) + 5 * n_patch
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if not w:
            continue
        words = _pack_bits(rest[mine] & np.uint32((1 << int(w)) - 1), int(w))
        cells = words.view(np.uint8).reshape(len(mine), -1)
        payload[starts[mine][:, None] + np.arange(cells.shape[1])] = cells
    block, place = np.nonzero(patched)
    if len(block):
        order = np.arange(len(block)) - np.repeat(np.cumsum(n_patch) - n_patch, n_patch)
        lists = starts[block] + 4 * LANES * width[block].astype(np.int64)
        payload[lists + order] = place
        high = (rest[block, place].astype(np.uint64) >> width[block].astype(np.uint64)).astype("<u4")
        payload[(lists + n_patch[block] + 4 * order)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = (
        np.array([len(doc_ids), len(ids), n_blocks], "<u8"),
        np.array([x or 0 for x in doc_ids], "<i8"),
        known,
        np.array([len(t) for t in tokens], "<u8"),
        starts.astype("<u8"),
        minimum.astype("<u4"),
        width,
        n_patch.astype(np.uint8),
        payload,
    )
    return MAGIC + b"".join(x.tobytes() for x in parts)


class IdFile:
    """One file in memory; ``read`` decodes only the blocks that it needs."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        at = 8

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        n_docs, self.n_ids, n_blocks = map(int, column("<u8", 3))
        ids, known = column("<i8", n_docs), column("u1", n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.n_tokens = column("<u8", n_docs).astype(np.int64)
        self.index = column("<u8", n_blocks).astype(np.int64)
        self.minimum = column("<u4", n_blocks)
        self.width = column("u1", n_blocks)
        self.n_patch = column("u1", n_blocks).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, -1, at) if at < len(data) else np.zeros(0, np.uint8)

    def _blocks(self, first: int, end: int) -> np.ndarray:
        out = np.empty((end - first, BLOCK), np.uint32)
        width, start, n_patch = self.width[first:end], self.index[first:end], self.n_patch[first:end]
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            if not w:
                out[mine] = 0
                continue
            cells = self.payload[start[mine][:, None] + np.arange(4 * LANES * int(w))]
            words = np.ascontiguousarray(cells).view("<u4").reshape(len(mine), LANES * int(w))
            out[mine] = _unpack_bits(words, int(w))
        block = np.repeat(np.arange(end - first), n_patch)
        if len(block):
            order = np.arange(len(block)) - np.repeat(np.cumsum(n_patch) - n_patch, n_patch)
            lists = start[block] + 4 * LANES * width[block].astype(np.int64)
            place = self.payload[lists + order]
            cells = self.payload[(lists + n_patch[block] + 4 * order)[:, None] + np.arange(4)]
            high = np.ascontiguousarray(cells).view("<u4")[:, 0].astype(np.uint64)
            out[block, place] |= (high << width[block].astype(np.uint64)).astype(np.uint32)
        return (out + self.minimum[first:end, None]).reshape(-1)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        first, end = start // BLOCK, -(-(start + n) // BLOCK)
        return self._blocks(first, end)[start - first * BLOCK : start - first * BLOCK + n]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_id_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    spaced: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    percentile: float = PERCENTILE,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all documents in ascending order of id below ``path``; return the manifest.

    ``path`` must be on storage that driver and executors share. Documents are range-partitioned by
    id; each task writes its files under names nobody else uses and hands them on only when
    closed, and the manifest (Parquet, committed as a whole) names those of the successful attempts. So a
    lost executor costs a rerun of its tasks and leaves a file at most that nothing refers to.

    Null ids come first; a null text is empty and is its end id alone; repeated ids are neighbours in any
    order; no documents make an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, spaced)
        part = TaskContext.get().partitionId()
        store, root = _file_system(path)
        names = [n.split(":")[0].strip() for n in MANIFEST_DDL.replace(" ", ":").split(",:")]
        place = 0
        ids: list = []
        tokens: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal place
            data = encode_file(ids, tokens, percentile)
            file = f"part-{part:06d}-{place:05d}-{uuid.uuid4().hex}.pfor"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(posixpath.join(root, f"_{file}")) as out:
                out.write(data)
            store.move(posixpath.join(root, f"_{file}"), posixpath.join(root, file))
            row = (part, place, file, len(ids), size, len(data))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            place += 1
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                new = encoder.encode(some.column(1).to_pylist(), end_id)
                for doc_id, t in zip(some.column(0).to_pylist(), new, strict=True):
                    ids.append(doc_id)
                    tokens.append(t)
                    size += len(t)
                    if size >= file_ids:
                        yield closed()
                        ids, tokens, size = [], [], 0
        if ids:
            yield closed()

    spark = docs.sparkSession
    ordered = with_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, MANIFEST_DDL).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest")


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: id, ids of all documents before it, number and ids (binary, uint32).

    A row of the manifest is a task's work, so a file is the unit of memory and of recovery.
    """
    manifest = spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)  # files, not documents
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(posixpath.join(root, file)) as source:
                    held = IdFile(source.read())
                ends = np.cumsum(held.n_tokens)
                starts = ends - held.n_tokens
                for at in range(0, len(held.doc_ids), 512):
                    upto = min(at + 512, len(held.doc_ids))
                    ids = held.read(int(starts[at]), int(ends[upto - 1] - starts[at])).astype("<u4")
                    cuts = starts[at:upto] - starts[at]
                    yield pa.record_batch(
                        [
                            pa.array(held.doc_ids[at:upto], pa.int64()),
                            pa.array(starts[at:upto] + start, pa.int64()),
                            pa.array(held.n_tokens[at:upto], pa.int64()),
                            pa.array([ids[a : a + n].tobytes() for a, n in zip(cuts, held.n_tokens[at:upto], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return placed.repartition(max(1, files)).mapInArrow(run, DOCS_DDL)
