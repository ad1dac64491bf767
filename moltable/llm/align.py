"""Two tokenizations of the same texts, aligned by their bytes, and how often ids meet across the corpus."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.llm.encode import Index, Ragged
from moltable.runtime import stage

CACHED_SEGMENTS = 400_000  # segments a worker remembers; it starts anew beyond. Changes no result
CACHED_PAIRS = 4_000_000  # id pairs of them
SLICE_CHARS = 500_000
HELD_PAIRS = 400_000  # most frequent id pairs whose counts travel to the tasks; all others are joined
B_BITS = 32  # an id pair is one number: the id of A, and that of B in the lowest bits

#: Neither tokenizer has a token across a space that stands between two other characters and is part of what follows.
_CUT = re.compile(r"(?<=\S) (?=\S)")

def skip_equal(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from ``i`` in ``a`` and ``j`` in ``b`` are equal one by one: probes that double, then halve."""
    step, done = 1, 0
    room = min(len(a) - i, len(b) - j)
    while done < room:
        step = min(step, room - done)
        if a[i + done : i + done + step] != b[j + done : j + done + step]:
            break
        done += step
        step *= 2
    else:
        return done
    while step > 1:  # the first unequal end is within the last ``step``
        half = step // 2
        if a[i + done : i + done + half] == b[j + done : j + done + half]:
            done += half
            step -= half
        else:
            step = half
    return done


def diagonal_groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Where each group ends, among the tokens of A and of B; ``a``, ``b``: rising ends of tokens over the same bytes.

    A group lies between ends that both share. While ends are equal at the present shift of the two indices,
    every token of A is one of B: such stretches are jumped over by probes that double. Where they part, the
    side that is behind takes the next token until both ends meet again; that group is irregular, and its surplus
    changes the shift.
    """
    in_a: list[int] = []
    in_b: list[int] = []
    i = j = 0
    while i < len(a) and j < len(b):
        run = skip_equal(a, b, i, j)
        in_a += range(i + 1, i + run + 1)
        in_b += range(j + 1, j + run + 1)
        i, j = i + run, j + run
        if i == len(a) or j == len(b):
            break
        while a[i] != b[j]:
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = i + 1, j + 1
        in_a.append(i)
        in_b.append(j)
    return in_a, in_b


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet, printable character to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


def _bytes_a(tokenizer) -> list[bytes]:
    table = _byte_level()
    spelled = tokenizer.get_vocab()
    out = [b""] * (max(spelled.values()) + 1)
    for token, at in spelled.items():
        out[at] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def _bytes_b(model) -> list[bytes]:
    out = []
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(at) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Alignments of texts, each distinct segment aligned once.

    A segment is a space and what follows up to the next space between two non-blanks. Both tokenizers end a
    token there, so no group crosses segments and the tokens of a text are those of its segments.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.joined, self.a = Tokenizer.from_file(path_a), Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content: i for i, t in self.a.get_added_tokens_decoder().items() if t.content.startswith("<|")}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = _bytes_a(self.a), _bytes_b(self.b)
        self.width_a, self.width_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.named_a, self.named_b = (list(map(str, range(len(t)))) for t in (self.bytes_a, self.bytes_b))
        self._reset()

    def _reset(self) -> None:
        self.parts, self.pairs = Index(), Ragged(np.int64)
        self.facts: list[np.ndarray] = []
        self.texts: list[str] = []

    def _ids_a(self, parts: list[str]) -> list[list[int]]:
        """Ids of A of each part after a space; parts are joined by a special token, which is looked for before all else."""
        if self.mark is None or any("<|" in p for p in parts):
            return [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        (got,) = self.joined.encode_batch_fast([" " + (self.mark + " ").join(parts)], add_special_tokens=False)
        ids = got.ids
        marks = [-1, *np.flatnonzero(np.array(ids) == self.mark_id).tolist(), len(ids)]
        return [ids[x + 1 : y] for x, y in itertools.pairwise(marks)]

    def _align(self, parts: list[str]) -> None:
        """Remember these parts, aligned as one long pair of tokenizations. A part that bytes do not spell has no tokens."""
        ids_a, ids_b = self._ids_a(parts), self.b.encode(parts, num_threads=1)
        spelled_a, spelled_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for n, part in enumerate(parts):
            whole = b" " + part.encode()
            if b"".join(map(spelled_a, ids_a[n])) != whole or b"".join(map(spelled_b, ids_b[n])) != whole:
                ids_a[n], ids_b[n] = [], []
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        stops = [np.cumsum([len(x) for x in ids]) for ids in (ids_a, ids_b)]
        ends = [np.cumsum(width[flat]).tolist() for width, flat in ((self.width_a, flat_a), (self.width_b, flat_b))]
        in_a, in_b = (np.array(g, np.int64) for g in diagonal_groups(*ends))
        n_a, n_b = np.diff(in_a, prepend=0), np.diff(in_b, prepend=0)
        links = n_a * n_b
        bounds = np.searchsorted(in_a, stops[0], "right")  # groups up to the end of each part
        before = np.concatenate([[0], np.cumsum(links)])
        n_links = np.diff(before[bounds], prepend=0)
        group = np.repeat(np.arange(len(links)), links)
        nth = np.arange(len(group)) - before[group]
        left = flat_a[(in_a - n_a)[group] + nth // n_b[group]]
        right = flat_b[(in_b - n_b)[group] + nth % n_b[group]]
        self.pairs.extend((left << B_BITS) + right, n_links)
        facts = [np.diff(stops[0], prepend=0), np.diff(stops[1], prepend=0), np.diff(bounds, prepend=0), n_links]
        self.facts.append(np.stack(facts, axis=1))
        names_a = list(map(self.named_a.__getitem__, flat_a.tolist()))
        names_b = list(map(self.named_b.__getitem__, flat_b.tolist()))
        i = j = 0
        texts = []
        for u, v in zip(in_a.tolist(), in_b.tolist(), strict=True):
            if u - i == v - j == 1:
                texts.append(names_a[i] + "|" + names_b[j])
            else:
                texts.append(",".join(names_a[i:u]) + "|" + ",".join(names_b[j:v]))
            i, j = u, v
        at = 0
        for stop in bounds.tolist():
            self.texts.append(";".join(texts[at:stop]))
            at = stop

    def _numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))

    def _align_new(self) -> np.ndarray:
        """Align what is new; the facts of all parts remembered."""
        new, self.parts.new = self.parts.new, []
        for at in range(0, len(new), 1000):
            self._align(new[at : at + 1000])
        if len(self.facts) > 1:
            self.facts = [np.concatenate(self.facts)]
        return self.facts[0] if self.facts else np.zeros((0, 4), np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """((tokens of A, of B, groups, links) of each text; groups as text; an id pair per link, text after text)."""
        if len(self.parts) > CACHED_SEGMENTS or self.pairs.used > CACHED_PAIRS:
            self._reset()
        found = [self._numbers(_CUT.split(t)) if t else np.zeros(0, np.int64) for t in texts]
        facts = self._align_new()
        odd = [n for n, own in enumerate(found) if len(own) and not facts[own, 0].all()]
        for n in odd:  # some part is not spelled exactly: the text is one part
            found[n] = self._numbers([texts[n]])
        facts = self._align_new() if odd else facts
        every = np.concatenate(found)
        bounds = np.cumsum([0, *map(len, found)])
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(facts[every], axis=0)])
        named = self.texts.__getitem__
        return np.diff(running[bounds], axis=0), [";".join(map(named, own.tolist())) for own in found], self.pairs.gather(every)[0]


@functools.cache
def _worker_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED_DDL = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups string, pairs array<bigint>, times array<int>"
)
_NAMES = [c.strip().split(" ")[0] for c in ALIGNED_DDL.split(", ")]


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of A (a byte-level vocabulary) and B (a sentence-piece model) cover each whole text.

    (row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times): ``groups`` lists the ids between the byte offsets where
    tokens of both end, as ``a1,a2|b1;a3|b2,b3``; every token of A in a group is linked with every token of B in it;
    ``pairs`` holds each linked pair of ids once (see ``B_BITS``), ``times`` how often. ``row`` tells rows of one run apart,
    and is of use only once the result is written. Both tokenizers read a space and the text, without special tokens.
    Texts stay where they are: no shuffle.

    A text that is null or empty, or whose tokens do not spell these bytes in A or in B, has no tokens, groups or links. A null
    id stays null; repeated rows are aligned each; a text of any length is read whole. Other columns are not
    read. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at])
                while end < len(texts) and chars + len(texts[end]) <= SLICE_CHARS:
                    chars += len(texts[end])
                    end += 1
                yield _batch(batch.column(0).slice(at, end - at), row + at, *aligner.align(texts[at:end]))
                at = end
            row += batch.num_rows

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).mapInArrow(run, ALIGNED_DDL)


def _batch(ids: pa.Array, row: int, facts: np.ndarray, texts: list[str], pairs: np.ndarray) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(texts)), facts[:, 3])
    order = np.lexsort((pairs, owner))
    pairs, owner = pairs[order], owner[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(pairs))).astype(np.int32)
    offsets = pa.array(np.searchsorted(owner[heads], np.arange(len(texts) + 1)).astype(np.int32))
    return pa.record_batch(
        [
            pa.array(np.arange(row, row + len(texts))),
            ids,
            *(pa.array(facts[:, n]) for n in range(4)),
            pa.array(texts, pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(pairs[heads])),
            pa.ListArray.from_arrays(offsets, pa.array(times)),
        ],
        names=_NAMES,
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows a pair is linked, and whether no other pair of its A id is linked in more.

    Counted in the tasks first, so a pair that all rows hold costs a row per task.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stage(counts.withColumn("a", F.shiftright("pair", B_BITS)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # an id of A has as many pairs as B has ids, at most
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def with_pair_counts(aligned: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """``aligned`` (written, so that rows keep their numbers) without its pairs, with n_best and count_sum of its links.

    The counts of the ``held`` most frequent pairs travel to the tasks, a bounded table; by their frequency these
    are nearly all links. Links of the other pairs, each in few rows, are joined with their counts. So no pair
    that a large share of the rows holds is ever a join key.
    """
    spark = aligned.sparkSession
    counts = stage(pair_counts(aligned), "counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(held).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(
        (top["pair"].to_numpy(), top["n"].to_numpy().astype(np.int64), top["best"].to_numpy(zero_copy_only=False).astype(bool))
    )
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    ddl = ", ".join(f"{c} {types[c]}" for c in kept)
    extra = "n_best bigint, count_sum bigint, rare array<struct<pair: bigint, times: int>>"
    rare_type = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            own = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner[hit], times[hit] * numbers[at[hit]])
            chosen = hit.copy()
            chosen[hit] = best[at[hit]]
            np.add.at(n_best, owner[chosen], times[chosen])
            missed = ~hit
            offsets = pa.array(np.searchsorted(owner[missed], np.arange(batch.num_rows + 1)).astype(np.int32))
            rare = pa.StructArray.from_arrays([pa.array(own[missed]), pa.array(times[missed].astype(np.int32))], fields=list(rare_type))
            columns = [batch.column(c) for c in kept]
            yield pa.record_batch(
                [*columns, pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(offsets, rare)],
                names=[*kept, "n_best", "count_sum", "rare"],
            )

    scored = stage(aligned.mapInArrow(run, f"{ddl}, {extra}"), "linked")
    rare = scored.select("row", F.inline("rare")).join(counts, "pair")
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    out = scored.drop("rare").join(sums, "row", "left")
    return out.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
        }
    ).drop("_best", "_sum", "row")
