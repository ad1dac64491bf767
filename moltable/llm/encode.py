"""Token ids of many texts, each distinct segment encoded once per worker."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

CACHED_PIECES = 300_000  # pieces a worker remembers; beyond, those used once are forgotten. Changes no id
SLICE_CHARS = 2_000_000  # characters looked up between two calls of the tokenizer

_AFTER_SPACE = re.compile(r" (?=\s)")
_SEGMENTS = re.compile(r"\s*\S+|\s+")
# Letters, marks, single spaces and single line ends, between which both vocabularies' patterns always cut. Apostrophes (of
# contractions), the brackets of special tokens, digits and all other characters leave a segment whole.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape('!"#$%&()*+,-./:;=?@[]_{|}~')
_ODD = re.compile(rf"[^{_LETTERS}{_MARKS} \n]")
_PLAIN_BYTES = bytes(b for b in range(256) if not _ODD.match(chr(b)))
_SPACED_PIECES = re.compile(rf" ?(?:[{_LETTERS}]+|[{_MARKS}]+)|\n")
_PIECES = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+")


def _first_odd(text: str) -> re.Match | None:
    try:
        if not text.encode("latin-1").translate(None, _PLAIN_BYTES):
            return None
    except UnicodeEncodeError:
        pass
    return _ODD.search(text)


def _wide_blank(text: str) -> bool:
    """Whether a plain text has two blanks in a row or ends in one."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith((" ", "\n"))


class Index(dict):
    """Numbers keys in the order of their first use and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Ragged:
    """Rows of different lengths, appended in batches and gathered by number."""

    def __init__(self, kind: type) -> None:
        self.flat = np.zeros(1 << 16, kind)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def extend(self, values, lengths: np.ndarray) -> None:
        rows, used = self.rows + len(lengths), self.used + len(values)
        while rows > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = values
        self.lengths[self.rows : rows] = lengths
        self.starts[self.rows : rows] = self.used + np.cumsum(lengths) - lengths
        self.rows, self.used = rows, used

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of these rows one after the other, where each row ends)."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - n), n) + np.arange(total)], ends


class SegmentEncoder:
    """``tokenizers`` ids of whole texts, by pieces that the tokenizer never looks across.

    ``spaced``: the tokenizer joins a space to the word after it (byte-level vocabularies). Its
    pattern then always has a boundary before a space that a non-blank follows, so texts are cut
    there; texts with a blank after a space are cut only between a non-blank and a blank. Otherwise the
    tokenizer drops blanks, and texts are cut at every space. Texts or segments of plain letters and marks are cut
    between letters and marks too, as both patterns do. All this gives the ids of the whole text.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.cut = (_SPACED_PIECES if spaced else _PIECES).findall
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content.startswith("<|")}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.ids = Index(), Ragged(np.uint32)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that were used again, at most half of those remembered."""
        uses = self.uses
        least = max(2, int(np.partition(uses, -CACHED_PIECES // 2)[-CACHED_PIECES // 2]) + 1)
        kept = np.flatnonzero(uses >= least)
        names = list(self.pieces)
        ids, _ = self.ids.gather(kept)
        lengths = self.ids.lengths[kept]
        self._reset()
        for at in kept:
            self.pieces[names[at]] = len(self.pieces)
        self.ids.extend(ids, lengths)
        self.uses = np.ones(len(kept), np.int64)

    def _cut_plain(self, text: str) -> list[str]:
        return [text] if _wide_blank(text) else self.cut(text)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text that the tokenizer never looks across."""
        odd = _first_odd(text)
        if odd is None and not _wide_blank(text):
            return self.cut(text)
        if _AFTER_SPACE.search(text):
            return _SEGMENTS.findall(text) if self.spaced else text.split(" ")
        out: list[str] = []
        at = 0
        while odd is not None:
            start, end = max(at, text.rfind(" ", at, odd.start())), text.find(" ", odd.end())
            if start > at:
                out += self._cut_plain(text[at:start])
            at = len(text) if end < 0 else end
            out.append(text[start:at])
            odd = _ODD.search(text, at)
        return out + self._cut_plain(text[at:]) if at < len(text) else out

    def _encode_new(self) -> None:
        """Ids of the pieces that are new.

        Pieces are joined by a special token: its text is looked for before anything else, and what lies between
        two of them is encoded by itself.
        """
        new, self.pieces.new = self.pieces.new, []
        encode = self.tokenizer.encode_batch_fast
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            if self.mark is None or any("<|" in s for s in some):
                each = [e.ids for e in encode(some, add_special_tokens=False)]
                self.ids.extend([x for ids in each for x in ids], np.array([len(x) for x in each], np.int64))
            else:
                (got,) = encode([self.mark.join(some)], add_special_tokens=False)
                ids = np.array(got.ids, np.int64)
                marks = np.concatenate([[-1], np.flatnonzero(ids == self.mark_id), [len(ids)]])
                self.ids.extend(ids[ids != self.mark_id], np.diff(marks) - 1)

    def _some(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        if len(self.pieces) > CACHED_PIECES:
            self._forget()
        number = self.pieces.__getitem__
        each = []
        for text in texts:
            pieces = self._pieces(text)
            each.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.pieces.new:
            self._encode_new()
        used = np.concatenate(each)
        counts = np.bincount(used, minlength=len(self.pieces))
        counts[: len(self.uses)] += self.uses
        self.uses = counts
        ids, ends = self.ids.gather(used)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]
        last = np.array([end_id], np.uint32)
        return [np.concatenate([ids[a:b], last]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text, ``end_id`` appended."""
        out: list[np.ndarray] = []
        some: list[str] = []
        chars = 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= SLICE_CHARS:
                out += self._some(some, end_id)
                some, chars = [], 0
        return out + self._some(some, end_id) if some else out


@functools.cache
def worker_encoder(path: str, spaced: bool) -> SegmentEncoder:
    """The encoder of this Python worker; tasks of one worker share it."""
    return SegmentEncoder(path, spaced)
