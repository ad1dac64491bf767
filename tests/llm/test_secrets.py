"""The randomness battery, its limits, and the linear passes over spans against plain programs."""

import math
import random
import re
import string

import pytest

pytest.importorskip("moltable.llm")

from pyspark.sql import functions as F  # noqa: E402

from moltable.llm import secrets  # noqa: E402

BASE64 = string.ascii_letters + string.digits + "+/"


def _tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def _battery(core):
    """(p_random, ln of p_structured) of a string without padding, or None where no encoding holds it."""
    for alphabet, rate in secrets.ENCODINGS.values():
        if set(core) <= set(alphabet):
            break
    else:
        return None
    k, n = len(alphabet), len(core)
    x = [alphabet.index(c) for c in core]
    chi = k / n * sum(x.count(v) ** 2 for v in set(x)) - n
    spread = 2 / (9 * (k - 1))
    p_uniform = _tail(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    high = [v >= k / 2 for v in x]
    both = 2 * sum(high) * (n - sum(high))
    p_runs = 0.0
    if both > n:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        p_runs = 2 * _tail(abs(runs - (1 + both / n)) / math.sqrt(both * (both - n) / (n * n * (n - 1))))
    mean = sum(x) / n
    scatter = sum((v - mean) ** 2 for v in x)
    p_serial = 0.0
    if scatter:
        r = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / scatter
        p_serial = 2 * _tail(abs(r + 1 / (n - 1)) * math.sqrt(n - 1))
    extra = n * (k * rate - 1)
    p = _tail((k - 1 + extra - chi) / math.sqrt(2 * (k - 1) + 4 * extra))
    return 3 * min(p_uniform, p_runs, p_serial), -math.log(max(p, 1e-300)) * secrets.BINS_PER_UNIT


def _plain_candidates(text):
    """(start, end, core) by the rules that the module states."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_-]))?", text):
        core = m[0].rstrip("=")
        found = {(m.start(), m.end(), core)}
        for separators in secrets.SEPARATORS:
            at = 0
            for part in re.split(separators, core):
                if len(part) >= secrets.MIN_LENGTH:
                    end = m.end() if at + len(part) == len(core) else m.start() + at + len(part)
                    found.add((m.start() + at, end, part))
                at += len(part) + 1
        out += [f for f in found if re.search("[A-Za-z0-9]", f[2]) and not re.fullmatch("[0-9]+", f[2])]
    return sorted(out)


def _texts(seed):
    r = random.Random(seed)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = []
    for i in range(40):
        lines = [word(BASE64 + "-_", r.randint(15, 300)) for _ in range(r.choice([0, 1, 3, 200]))]
        lines += [word(string.hexdigits.lower()[:16], r.randint(20, 70)) for _ in range(3)]
        lines += [word(string.ascii_lowercase[:3], 30), "1" * 25, "NAME=" + word(BASE64, 40) + "==", "é token: " + word(BASE64, 30)]
        r.shuffle(lines)
        texts.append(("\n" if i % 2 else " é ").join(lines))
    return texts


def test_battery_and_limits_as_a_plain_program(spark):
    texts = _texts(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = docs.select("doc_id", secrets._candidates(F.col("text")).alias("c")).collect()
    assert len(got) == len(texts)
    bins = {}
    for row in got:
        want = [(s, e, b) for s, e, core in _plain_candidates(texts[row["doc_id"]]) if (b := _battery(core))]
        have = sorted(row["c"], key=lambda c: (c["start"], c["end"]))
        assert [(c["start"], c["end"]) for c in have] == [(s, e) for s, e, _ in sorted(want, key=lambda w: w[:2])]
        for c, (_, _, (p_random, at)) in zip(have, sorted(want, key=lambda w: w[:2]), strict=True):
            assert c["p_random"] == pytest.approx(p_random, abs=3e-6)
            if at < 200:  # above, the polynomial's 1e-7 shows
                assert c["bin"] in {math.floor(at - 0.1), math.floor(at), math.floor(at + 0.1)}
            bins.setdefault(c["length_class"], []).append(c["bin"])
    limits = {}
    for length_class, found in bins.items():
        ok = [b for b in set(found) if math.exp(-b / secrets.BINS_PER_UNIT) <= secrets.FDR * sum(x >= b for x in found) / len(found)]
        if ok:
            limits[length_class] = min(ok)
    assert limits and secrets.discovery_limits(docs) == limits


def test_spans_and_redaction_as_a_plain_program(spark):
    """More spans than a chunk holds: what covers what, and what is put in their place."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(12))] + [(90, ""), (91, None)], "doc_id bigint, text string")
    limits = dict.fromkeys(range(12), 15)
    plain = secrets._plain(F.col("text"))
    found = docs.withColumn("base", secrets._base(plain)).withColumn("ok", secrets._accepted(secrets._candidates(plain), limits))
    base_and_ok = {r["doc_id"]: r for r in found.collect()}
    with_spans = secrets.with_secrets(docs, limits)
    rows = with_spans.select("doc_id", "secret_spans", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("out")).collect()
    most = 0
    for row in rows:
        text, base, ok = (base_and_ok[row["doc_id"]][c] for c in ("text", "base", "ok"))
        covers = lambda b, c: b["start"] <= c["start"] and c["end"] <= b["end"]
        new = [
            c
            for c in ok
            if not any(covers(b, c) for b in base)
            and not any(covers(a, c) and a["end"] - a["start"] > c["end"] - c["start"] for a in ok)
        ]
        want = sorted([(s["start"], s["kind"], s["end"]) for s in base] + [(c["start"], 3, c["end"]) for c in new])
        assert [(s["start"], s["kind"], s["end"]) for s in row["secret_spans"]] == want
        most = max(most, len(want))
        at, out = 0, ""
        for start, _, end in want:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert row["out"] == (None if text is None else out + text[at:])
    assert most > secrets._CHUNK
