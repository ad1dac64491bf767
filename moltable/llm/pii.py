"""Personal data: fixed formats, and candidates that boosted trees judge by format and context."""

from __future__ import annotations

import dataclasses
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.llm.boosting import Trees, boost, calibrate, threshold_for
from moltable.llm.columns import with_text

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40  # characters looked at on either side
SAMPLE_DOCS = 300  # documents that lend the examples their surroundings, at most
EXAMPLES = 1500  # of each kind, half of them true
PRECISION = 0.98
DIGITS = 19  # digits of a candidate, and so groups of digits, at most
PIECE = 4096  # candidates whose features are held at once
SEED = 11

# The base formats, fixed by contract. Each but phone and card is written so that a failing run is read over once:
# a run that no match can begin in is consumed whole, which changes no match.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(?:(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))?")
_IP = re.compile(r"([0-9]+)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches that do not overlap, failing ones dropped, by kind and start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text) if m[1]]
    if not _HAS_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m[2] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


_HAS_DIGIT = re.compile("[0-9]")

# High-recall generators. They propose overlapping spans; the trees decide.
_DIGIT_GROUP = re.compile(r"\+?\(?[0-9]+\)?")
_GROUP_GAP = re.compile(r"[\x20]?[.\x20/-]?[\x20]?")
_HEX_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_AT = r"\x20?(?:[\[({]\x20?(?:at|AT|@)\x20?[\])}]|@)\x20?|\x20(?:at|AT)\x20"
_DOT = r"\x20?(?:[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}])\x20?|\x20(?:dot|DOT)\x20|\."
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_AT})[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT})[A-Za-z0-9-]{{1,63}}){{1,5}}")
# A part of every match of _SPELLED, and quickly looked for: a text without it has none.
_SPELLED_HINT = re.compile(rf"(?:{_AT})[A-Za-z0-9-]{{1,63}}(?:{_DOT})[A-Za-z0-9-]")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) proposed for a text; a span may be proposed as several kinds."""
    out = []
    if _SPELLED_HINT.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if not _HAS_DIGIT.search(text):
        return out
    if ":" in text:
        out += [("ip", *m.span()) for m in _HEX_IP.finditer(text)]
    run: list[tuple[int, int, int]] = []  # neighbouring groups: start, end, digits

    def close() -> None:
        for i in range(len(run)):
            total = 0
            for j in range(i, len(run)):
                total += run[j][2]
                if total > DIGITS:
                    break
                if j - i == 3:
                    out.append(("ip", run[i][0], run[j][1]))
                if 13 <= total:
                    out.append(("card", run[i][0], run[j][1]))
                if 7 <= total <= 15:
                    out.append(("phone", run[i][0], run[j][1]))

    for m in _DIGIT_GROUP.finditer(text):
        if run and not _GROUP_GAP.fullmatch(text, run[-1][1], m.start()):
            close()
            run = []
        run.append((m.start(), m.end(), sum(c.isdigit() for c in m[0])))
        if len(run) > 64:  # spans of at most DIGITS groups: the older ones have been seen from every start
            close()
            run = run[-DIGITS:]
    close()
    return list(dict.fromkeys(out))


_CUES = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "whatsapp", "contact", "téléphone", "telefon", "teléfono"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "carte", "karte", "tarjeta"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "client", "adresse"),
    "email": ("mail", "e-mail", "contact", "write", "reach", "correo"),
    "other": ("version", "order", "invoice", "isbn", "id", "no", "date", "page", "pages", "total", "price", "ref", "section", "eur", "usd", "release"),
}
_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    words = {w.lower() for w in _WORDS.findall(before[before.find(" ") + 1 :] if len(before) == CONTEXT else before)}
    cues = [float(any(w in cue for w in words)) for cue in _CUES.values()]
    seps = [span.count(c) for c in " -./:()+"]
    near = [float(c.isalnum()) for c in (before[-1:], after[:1])]
    joined = [float(c in "-./:_#$€%=&") and 1.0 * bool(c) for c in (before[-1:], after[:1])]
    spelled = span.lower()
    return [
        len(span),
        len(digits),
        len(groups),
        *(sizes + [0, 0, 0, 0])[:4],
        max(sizes),
        min(sizes),
        float(len(digits) > 1 and luhn(digits)),
        float(len(groups) == 4 and all(int(g[:9]) <= 255 for g in groups)),
        float(digits[:1] in ("3", "4", "5", "6")) if digits else 0.0,
        float(digits[:1] == "0"),
        float(len(set(sizes)) == 1),
        float(2 <= len(groups) <= 3 and any(len(g) == 4 and "1900" <= g <= "2099" for g in groups)),
        len(set(digits)) / max(1, len(digits)),
        *seps,
        *near,
        *joined,
        *cues,
        float("@" in span),
        float(" at " in spelled or "(at" in spelled or "[at" in spelled or "{at" in spelled),
        float(" dot " in spelled or "dot)" in spelled or "dot]" in spelled or "dot}" in spelled),
        float(len(re.split(r"[^A-Za-z0-9]+", span)[-1])),
        float(sum(c.isalpha() for c in span)) / max(1, len(span)),
    ]


@dataclasses.dataclass(frozen=True)
class Judge:
    """Trees, calibration and threshold of one kind."""

    trees: Trees
    scale: tuple[float, float]
    threshold: float

    def chances(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.trees.margin(x) + b, -30, 30)))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _card_number(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(str(rng.randint(0, 9)) for _ in range(rng.choice((13, 14, 14, 14))))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _true_span(rng: random.Random, kind: str) -> str:
    if kind == "email":
        name = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
        host = rng.choice(("mail", "example", "post", "firm", "uni"))
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" @ ", "."), ("@", ".")))
        return f"{name}{at}{host}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"
    if kind == "ip":
        if rng.random() < 0.5:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
    if kind == "card":
        n = _card_number(rng)
        sep = rng.choice((" ", "-", ".", ""))
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if len(n) == 16 else sep.join((n[:4], n[4:10], n[10:]))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    forms = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"00{rng.randint(30, 49)} {a} {b}{c}", f"0{a} {b}{c}")
    return rng.choice(forms)


def _false_span(rng: random.Random, kind: str) -> str:
    if kind == "email":
        word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
        return rng.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"@{word()}", f"{word()} at the {word()} dot"))
    day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2049)
    forms = [
        f"{day:02}.{month:02}.{year}", f"{year}-{month:02}-{day:02}", f"{day}/{month}/{year}", f"{year}-{month:02}-{day:02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        f"{_number(rng, 2)} {_number(rng, 3)} {_number(rng, 3)}", f"{_number(rng, rng.randint(5, 9))}", f"{_number(rng, rng.randint(10, 20))}",
        f"978-{rng.randint(0, 9)}-{_number(rng, 4)}-{_number(rng, 4)}-{rng.randint(0, 9)}", f"{rng.randint(0, 12)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
        f"{rng.randint(0, 12)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}.{_number(rng, 4)}", f"{_number(rng, 3)} - {_number(rng, 3)}", f"{year}-{year + 1}, {_number(rng, 3)}",
        f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", f"{_number(rng, 3)}-{_number(rng, 2)}", " ".join(_number(rng, rng.randint(1, 3)) for _ in range(rng.randint(3, 6))),
        f"{_number(rng, 4)} {_number(rng, 4)} {_number(rng, 4)} {_number(rng, 4)}", f"{_number(rng, 4)}/{_number(rng, 3)}/{_number(rng, 4)}",
    ]
    return rng.choice(forms)


def train(contexts: list[str], seed: int = SEED) -> dict[str, Judge]:
    """A judge for each kind, from drawn examples set into the given surroundings.

    True examples are personal data in the base formats and in others that people use; false ones are dates, times, versions,
    prices, serial and running numbers and prose. Both kinds are put through the candidate generators, and a
    candidate counts as true if it is a true example's whole span. Two thirds fit the trees, the rest calibrates
    them and sets the threshold that keeps ``PRECISION`` there.
    """
    rng = random.Random(seed)
    filler = contexts or ["a note about the day and its work"]
    judges = {}
    for kind in KINDS:
        rows, labels, part = [], [], []
        for at in range(EXAMPLES):
            true = at % 2 == 0
            cue = rng.choice(_CUES[kind] if rng.random() < 0.5 else _CUES["other"]) + rng.choice((" ", ": ", " is ")) if rng.random() < (0.3 if true else 0.4) else ""
            if not true and cue and rng.random() < 0.8:
                cue = rng.choice(_CUES["other"]) + " "
            other = rng.choice([k for k in KINDS if k != kind])
            span = _true_span(rng, kind) if true else _false_span(rng, kind) if rng.random() < 0.8 else _true_span(rng, other)
            left, right = rng.choice(filler), rng.choice(filler)
            text = f"{left} {cue}{span}{rng.choice((' ', '. ', ', ', ') '))}{right}"
            start = len(left) + 1 + len(cue)
            for k, a, b in candidates(text):
                if k == kind and a < start + len(span) and b > start:
                    rows.append(features(text, k, a, b))
                    labels.append(float(true and (a, b) == (start, start + len(span))))
                    part.append(at % 3)
        x, y, part = np.array(rows), np.array(labels), np.array(part)
        trees = boost(x[part > 0], y[part > 0])
        margin = trees.margin(x[part == 0])
        scale = calibrate(margin, y[part == 0])
        chance = 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -30, 30)))
        judges[kind] = Judge(trees, scale, max(0.5, threshold_for(chance, y[part == 0], PRECISION)))
    return judges


def find_spans(text: str, judges: dict[str, Judge]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): the judges' choices are added where they overlap no base span, likeliest first."""
    base = base_spans(text)
    if not (_HAS_DIGIT.search(text) or _SPELLED_HINT.search(text)):
        return base, base
    scored = []
    proposed = candidates(text)
    for kind in KINDS:
        mine = [(a, b) for k, a, b in proposed if k == kind]
        for at in range(0, len(mine), PIECE):
            some = mine[at : at + PIECE]
            chances = judges[kind].chances(np.array([features(text, kind, a, b) for a, b in some]))
            scored += [(-c, a - b, a, b, kind) for c, (a, b) in zip(chances, some, strict=True) if c >= judges[kind].threshold]
    taken = bytearray(len(text) if scored else 0)  # 1 where a character is part of a span
    for _, a, b in base if scored else ():
        taken[a:b] = b"\1" * (b - a)
    added = []
    for _, _, a, b, kind in sorted(scored):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def train_on(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, Judge]:
    """Judges whose examples stand in pieces of some documents, chosen by a hash of their ids."""
    texts = with_text(docs).where("doc_id is not null and text <> ''")
    # A piece of at most 400 characters of each: the middle, so that the driver gets little whatever the texts' lengths.
    piece = F.expr("substring(text, greatest(1, cast(length(text) / 2 as int) - 200), 400)")
    chosen = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", piece.alias("piece")).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    pieces = [" ".join(r["piece"].split()[1:-1]) for r in rows]
    clean = [p for p in pieces if p and not _HAS_DIGIT.search(p) and "@" not in p]
    return train([p[:200] for p in clean])


def find_personal_data(docs: DataFrame, judges: dict[str, Judge], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans) per row of ``docs``: arrays of (kind, start, end) in code points, by kind, then start.

    Whole texts are searched where they lie; nothing is shuffled. The judges, some kilobytes, travel with the task.
    A null or empty text has no spans; a null id stays null; repeated rows are searched each; no rows give
    none.
    """
    ddl = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t, judges) for t in batch.column(1).to_pylist()]
            sides = [
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[side]] for f in found], kind) for side in (0, 1)
            ]
            yield pa.record_batch([batch.column(0), *sides], names=["doc_id", "base_spans", "spans"])

    return with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, base_spans {ddl}, spans {ddl}")
