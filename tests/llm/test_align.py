"""Alignment of two tokenizations against plain programs."""

import collections
import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")

from moltable.llm import align  # noqa: E402
from moltable.runtime import stage  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "plain words of a text", "plain words of a text", "Two  blanks \n  and\nlines \t x", "don't stop<|endoftext|>now </s> <s>",
    "Ünï cödé — 漢字 ﬁ ſ İ x y \x1c z\x00   q 　 r", "a ▁ b▁c", "🙂🙂 flags 🇩🇪 zero‍width", "x" * 3000, "1234567890 " * 300, "\n\n\n", "\t\ta b", "the " * 4000,
    "unbelievable internationalisation of counterrevolutionaries",
]


def test_groups_by_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(500):
        n = int(rng.integers(1, 200))
        a, b = (sorted({n, *rng.choice(n, int(rng.integers(0, n)), replace=False).tolist()} - {0}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted(set(a) - set(rng.choice(a, min(len(a) - 1, 2), replace=False).tolist()) | {n})
        ends = sorted(set(a) & set(b))
        assert align.diagonal_groups(a, b) == ([a.index(e) + 1 for e in ends], [b.index(e) + 1 for e in ends])


def test_probes_find_the_first_unequal_end():
    for n in (0, 1, 2, 3, 5, 8, 13, 100):
        for cut in range(n + 1):
            a, b = list(range(n + 3)), [*range(cut), *range(1000, 1000 + n - cut)]
            assert align.skip_equal(a, b, 0, 0) == cut


def _plain(texts):
    """(n_a, n_b, groups, links) of each text by whole encodings and common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    in_a, in_b = align._bytes_a(a), align._bytes_b(b)
    out = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(in_a[t] for t in x) != whole or b"".join(in_b[t] for t in y) != whole:
            x, y = [], []
        ends_a, ends_b = np.cumsum([len(in_a[t]) for t in x]).tolist(), np.cumsum([len(in_b[t]) for t in y]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((x[i:u], y[j:v]))
            i, j = u, v
        out.append((len(x), len(y), groups, [(p, q) for gx, gy in groups for p in gx for q in gy]))
    return out


def _expected(rows):
    plain = _plain([t for _, t in rows])
    counts = collections.Counter(link for *_, links in plain for link in set(links))
    highest = collections.defaultdict(int)
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    out = []
    for (i, _), (n_a, n_b, groups, links) in zip(rows, plain, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[link] == highest[link[0]] for link in links)
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), text))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("held", [align.HELD_PAIRS, 5, 0])
def test_documents(spark, held):
    rows = [*enumerate(TEXTS), (None, "no id here"), (7, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, 1, 2, "g") for i, t in rows], "doc_id bigint, text string, row int, n_a int, groups string").repartition(3)
    aligned = stage(align.align_documents(docs, A, B), "aligned")
    assert aligned.select("row").distinct().count() == len(rows)
    got = [tuple(r) for r in align.with_pair_counts(aligned, held).select(*NAMES, "groups").collect()]
    assert sorted(got, key=repr) == sorted(_expected(rows), key=repr)
    assert align.with_pair_counts(stage(align.align_documents(docs.where("false"), A, B), "aligned"), held).count() == 0


def test_query(spark, data, monkeypatch):
    from moltable.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_diagonal_skipping"](spark, data).select(*NAMES, "groups_sha256").collect()]
    want = [(*w, t and hashlib.sha256(t.encode()).hexdigest()) for *w, t in _expected(rows)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("segments, pairs", [(2, 10**6), (10**6, 3)])
def test_forgotten_segments_change_nothing(monkeypatch, segments, pairs):
    texts = [t or "" for t in TEXTS] * 3
    facts, groups, links = align.Aligner(A, B).align(texts)
    monkeypatch.setattr(align, "CACHED_SEGMENTS", segments)
    monkeypatch.setattr(align, "CACHED_PAIRS", pairs)
    some = align.Aligner(A, B)
    each = [some.align([t]) for t in texts]
    assert (np.concatenate([f for f, _, _ in each]) == facts).all()
    assert [g for _, gs, _ in each for g in gs] == groups
    assert (np.concatenate([p for _, _, p in each]) == links).all()
