"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from moltable.llm import periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs, period after period: maximal stretches that agree with themselves, multiples of smaller periods left out."""
    n, runs, known = len(words), [], []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(s <= i and i + length <= s + m and q % p == 0 and p < q for s, m, p in known):
                runs.append((i, length, q))
                known.append((i, length, q))
            i = max(j, i + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _de_bruijn(order):
    """Every string of ``order`` bits once round the circle: all shorter grams of a period occur often in it."""
    seen, out, state = set(), [], "0" * order
    while state not in seen:
        seen.add(state)
        nxt = state[1:] + "1"
        state = nxt if nxt not in seen else state[1:] + "0"
        out.append(state[-1])
    return out


def test_runs_by_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(400):
        words = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60))).tolist()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = rng.integers(0, 4, int(rng.integers(1, 9))).tolist() * int(rng.integers(2, 8))
        assert periodic.find_runs(np.array(words, np.int64)) == brute(words), (trial, words)


def test_long_periods_of_frequent_grams():
    for order in (6, 8):
        words = [int(b) for b in _de_bruijn(order) * 5 + ["1", "1", "0"]]
        assert periodic.find_runs(np.array(words, np.int64)) == brute(words)


def test_very_long_runs():
    n = 400_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    period = np.arange(50_001)
    assert periodic.find_runs(np.concatenate([[-1], np.tile(period, 4), [-2]])) == [(1, 200_004, 50_001)]


def _collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


TEXTS = [
    None, "", " \n", "a", "a a a a a", "a a a a a a", "b a a a a a a c", "x y x y x y x", "x y\tx\ny x y  x y", "a b c " * 4 + "a", "one two three four five six " * 3,
    "ab " * 20_000, "é ü é ü é ü é ü\x1c", " ".join(f"w{i % 50}" for i in range(230)), "a a a a a a b a a a a a a b a a a a a a b a a a a a a b a a a a a a b",
]


@pytest.mark.parametrize("slice_chars", [periodic.SLICE_CHARS, 10])
def test_texts(spark, slice_chars, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_CHARS", slice_chars)
    rows = [*enumerate(TEXTS), (None, "no id no id no id no id"), (5, TEXTS[5])]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id bigint, text string, runs string, collapsed int").repartition(2)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    want = []
    for i, t in rows:
        words = WORDS.findall(t or "")
        runs = [(0, 20_000, 1)] if t == "ab " * 20_000 else brute(words)
        want.append((i, len(words), runs, _collapsed(words, runs)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def _planted(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query(spark, data):
    from moltable.llm.queries import QUERIES

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, data).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = _planted(d["doc_id"], d["text"])
        if len(words) > 1500:
            continue
        runs, r = brute(words), got[d["doc_id"]]
        some += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None, None, None)))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()
    assert some > 10
