"""Word-piece counts by a linear longest-match automaton that builds no pieces."""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moltable.llm.columns import with_text

CACHED_WORDS = 400_000  # words a worker remembers; it starts anew beyond
CACHED_LENGTH = 64  # characters; longer words are counted each time
START, INSIDE, NONE = 0, 1, -1
#: Words are cut around each of these: ASCII punctuation.
_PARTS = re.compile(r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+")


class LongestMatch:
    """Number of pieces of the greedy longest-match-first segmentation of a word.

    The pieces that begin words and those that continue them are two tries in one table of states. Where a state has
    no edge for the next character, its failure link leads to the state that the rest of the text read so far
    reaches once the greedy pieces before it are cut off; their number stands beside the link. So every
    character is read once, and each link taken pops at least one piece.
    """

    def __init__(self, first: Iterable[str], inside: Iterable[str]) -> None:
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        parents: list[tuple[int, str]] = [(NONE, ""), (NONE, "")]
        for root, pieces in ((START, first), (INSIDE, inside)):
            for piece in pieces:
                at = root
                for ch in piece:
                    step = self.edges[at].get(ch)
                    if step is None:
                        step = self.edges[at][ch] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                        parents.append((at, ch))
                    at = step
                if at != root:
                    ends[at] = True
        self.link = [NONE] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([*self.edges[START].values(), *self.edges[INSIDE].values()])
        while queue:
            at = queue.popleft()
            queue.extend(self.edges[at].values())
            if ends[at]:
                self.link[at], self.popped[at] = INSIDE, 1
                continue
            before, ch = parents[at]
            count, reach = self.popped[before], self.link[before]
            while reach != NONE and ch not in self.edges[reach]:
                count += self.popped[reach]
                reach = self.link[reach]
            if reach != NONE:
                self.link[at], self.popped[at] = self.edges[reach][ch], count

    def count(self, word: str) -> int:
        """Pieces of the word, 0 if it has none (no sequence of pieces spells it greedily)."""
        edges, link, popped = self.edges, self.link, self.popped
        at = START
        total = 0
        for ch in word:
            step = edges[at].get(ch)
            while step is None:
                if link[at] == NONE:
                    return 0
                total += popped[at]
                at = link[at]
                step = edges[at].get(ch)
            at = step
        while at > INSIDE:
            if link[at] == NONE:
                return 0
            total += popped[at]
            at = link[at]
        return total


class _Counts(dict):
    """(pieces, unknown words) of blank-separated words, packed into one number."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        pieces = unknown = 0
        for part in _PARTS.findall(word):
            n = self.automaton.count(part)
            pieces += n or 1
            unknown += not n
        packed = (pieces << 32) + unknown
        if len(word) <= CACHED_LENGTH:
            self[word] = packed
        return packed


def split_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that continue one) of a sentence-piece model file.

    Its pieces mark the start of a word by U+2581. Control, unknown and byte pieces spell no text and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inside = [], []
    for at in range(model.get_piece_size()):
        if model.is_control(at) or model.is_unknown(at) or model.is_byte(at):
            continue
        piece = model.id_to_piece(at)
        if piece.startswith("▁"):
            first.append(piece[1:])
        else:
            inside.append(piece)
    return [p for p in first if p], [p for p in inside if p]


@functools.cache
def _worker_counts(path: str) -> _Counts:
    return _Counts(LongestMatch(*split_vocabulary(path)))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are runs of anything but ASCII blanks, cut around each ASCII punctuation mark; a word that the vocabulary cannot
    spell greedily is one unknown token. Texts stay where they are: no shuffle. A worker keeps the
    counts of a bounded number of words.

    A null or empty text has no words and no tokens; a null id stays null; repeated rows are counted
    each; a word of any length is read once. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _worker_counts(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                rows = []
                for text in some.column(1).to_pylist():
                    if len(counts) > CACHED_WORDS:
                        counts.clear()
                    words = [w.decode() for w in text.encode().split()] if _odd_blank(text) else text.split()
                    packed = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
                    rows.append((len(words), int((packed >> 32).sum()), int((packed & 0xFFFFFFFF).sum())))
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.record_batch([some.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return with_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


#: Characters that ``str.split`` takes for blanks and ``bytes.split`` does not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _odd_blank(text: str) -> bool:
    return _ODD.search(text) is not None
