"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.llm.columns import held_out, with_text

TRAIN_DOCS = 3000  # labelled documents of each label that the model is fitted on, at most
TRAIN_LINES = 64  # documents with more lines are not fitted on; all are scored
STEPS, RATE, PENALTY = 200, 0.1, 1e-3
LONG_WORD = 25
SYMBOLS, ENDS, BANGS, BARS = b"#*$%&<>=~^@\\{}[]", b".,;:?", b"!", b"|"
_LETTERS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
OWN = 17  # features of a line by itself
FEATURES = 3 * OWN + 2


def _share(data: bytes, of: bytes, n: int) -> float:
    return min(1.0, (len(data) - len(data.translate(None, of))) / n) if n else 0.0


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x ``OWN`` features, characters of each line + 1) of a whole text; an empty text is one empty line."""
    lines = text.split("\n")
    out = np.zeros((len(lines), OWN), np.float32)
    seen: set[bytes] = set()
    for at, line in enumerate(lines):
        data = line.encode()
        words = data.split()
        n = len(words)
        row = out[at]
        if not n:
            row[0] = 1
            continue
        solid = sum(map(len, words))
        repeats = sum(map(eq, words, words[1:]))
        distinct = len(set(words))
        row[1] = _share(data, SYMBOLS, n)
        row[2] = _share(data, _LETTERS, solid)
        row[3] = _share(data, _DIGITS, solid)
        row[4] = _share(data, ENDS, n)
        row[5] = _share(data, BANGS, n)
        row[6] = _share(data, BARS, n)
        row[7] = repeats / n
        row[8] = 1 - distinct / n
        row[9] = min(1.0, solid / n / 20)
        row[10] = min(1.0, math.log1p(n) / 8)
        row[11] = n <= 3
        row[12] = words[-1][-1:] in b".!?"
        row[13] = data in seen
        row[14] = max(map(len, words)) > LONG_WORD
        row[15] = row[1] > 0.2
        row[16] = row[7] > 0.2
        seen.add(data)
    return out, np.array([len(line) + 1 for line in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it, and whether it is the first or last."""
    edge = np.zeros((1, OWN), np.float32)
    ends = np.zeros((len(own), 2), np.float32)
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), ends])


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Place of the first line of each document, longest first, and for each step the lines that are at it."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    firsts = starts[order]
    return firsts, [firsts[:n] + t for t, n in enumerate(active)]


def messages(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of "good" for each line: from itself and the lines before it, and from the lines after it.

    ``unary`` has the log-odds of lines alone, document after document; ``moves[i, j]`` scores a line of label i before one of
    label j. All documents advance one line per step.
    """
    _, steps = _steps(lengths)
    ahead, back = unary.copy(), np.zeros_like(unary)
    for now, following in zip(steps, steps[1:], strict=False):
        a = ahead[now[: len(following)]]
        ahead[following] += np.logaddexp(a + moves[1, 1], moves[0, 1]) - np.logaddexp(a + moves[1, 0], moves[0, 0])
    for now, following in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
        b = unary[following] + back[following]
        back[now[: len(following)]] = np.logaddexp(b + moves[1, 1], moves[1, 0]) - np.logaddexp(b + moves[0, 1], moves[0, 0])
    return ahead, back


@dataclasses.dataclass(frozen=True)
class LineModel:
    weights: np.ndarray  # FEATURES + 1, the last for a constant
    moves: np.ndarray  # 2 x 2

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Chance that each line is good, given all lines of its document."""
        ahead, back = messages(features @ self.weights[:-1] + self.weights[-1], lengths, self.moves)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> LineModel:
    """Maximum conditional likelihood, each line labelled as its document, with a squared penalty.

    ``features`` has the lines of all documents one after the other. Documents of either label weigh the same in
    sum, and so do a document's lines.
    """
    y = np.repeat(labels, lengths).astype(np.float64)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weight = np.repeat(share / lengths, lengths)
    later = np.ones(len(y), bool)
    later[np.cumsum(lengths) - lengths] = False
    later = np.flatnonzero(later)
    x = np.hstack([features, np.ones((len(features), 1), np.float32)]).astype(np.float64)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        moves = theta[-4:].reshape(2, 2)
        unary = x @ theta[:-4]
        ahead, back = messages(unary, lengths, moves)
        p = 1 / (1 + np.exp(-(ahead + back)))
        slope = np.zeros_like(theta)
        slope[:-4] = x.T @ (weight * (p - y))
        a, b = ahead[later - 1], unary[later] + back[later]
        joint = np.stack([moves[0, 0] + 0 * a, moves[0, 1] + b, moves[1, 0] + a, moves[1, 1] + a + b])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
        seen = np.stack([(1 - y[later]), 0 * y[later], 0 * y[later], y[later]])
        slope[-4:] = ((joint - seen) * weight[later]).sum(axis=1)
        slope += PENALTY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineModel(theta[:-4], theta[-4:].reshape(2, 2))


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for text in batch.column("text").to_pylist():
            cells.append(line_features(text)[0].tobytes() if text.count("\n") < TRAIN_LINES else None)
        yield pa.record_batch([batch.column("label"), pa.array(cells, pa.binary())], names=["label", "cells"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> LineModel | float:
    """The model fitted on ``train_docs`` documents of each label at most, none of them held out.

    Which ones depends on a hash of their ids alone. They are bounded in number and lines, so their features
    are gathered and fitted on the driver. Where a label is missing, the share of label 1 (or one half) is returned.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col(label_col).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = []
    for label in (0, 1):
        one = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen += [(r["doc_id"], label) for r in one.collect()]
    spark = docs.sparkSession
    picked = spark.createDataFrame(chosen, "doc_id bigint, label int")  # 2 * train_docs rows at most
    texts = with_text(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("label", "text")
    rows = [r for r in texts.mapInArrow(_text_features, "label int, cells binary").collect() if r["cells"] is not None]
    rows.sort(key=lambda r: (r["label"], bytes(r["cells"])))  # the order of arrival must not matter
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    own = [np.frombuffer(r["cells"], np.float32).reshape(-1, OWN) for r in rows]
    return fit(np.vstack([with_neighbours(o) for o in own]), np.array([len(o) for o in own]), y)


def score_documents(docs: DataFrame, model: LineModel | float, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and ``quality``: the chances that its lines are good, weighted by length.

    Each whole text is scored where it lies; the model, a few hundred bytes, travels with the task. A
    null or empty text is one empty line. Repeated rows score alike. A given column ``quality`` is replaced. No rows
    give none.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != "quality"])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")
    whole = "text" in kept.columns
    given = docs.select(row) if whole else docs.select(row, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column("row").field("text") if whole else some.column("text")
                texts = [t or "" for t in texts.to_pylist()]
                if isinstance(model, float):
                    scores = np.full(len(texts), model)
                else:
                    parts = [line_features(t) for t in texts]
                    lengths = np.array([len(w) for _, w in parts])
                    good = model.marginals(np.vstack([with_neighbours(o) for o, _ in parts]), lengths)
                    weights = np.concatenate([w for _, w in parts])
                    starts = np.cumsum(lengths) - lengths
                    scores = np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)
                yield pa.record_batch([some.column("row"), pa.array(np.clip(scores, 0, 1))], names=["row", "quality"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", kept.schema), T.StructField("quality", T.DoubleType())])
    return given.mapInArrow(run, schema).select("row.*", "quality")
