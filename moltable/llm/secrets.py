"""Secret scans: fixed formats, and strings that a battery of randomness tests finds as random as keys are.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltable.llm.columns import with_text

# Formats of the base kinds, fixed by contract, in the order in which equal starts are listed.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

MIN_LENGTH = 20  # characters below which the tests say nothing
# A run ends before an inner =, as in NAME=VALUE; what no key character follows is padding and belongs to it.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+(?:=++(?![A-Za-z0-9+/_-]))?"
# A run is tested whole, if an encoding holds it, and in parts: a key may stand behind a path, a name or a word.
SEPARATORS = ("[_-]", "[+/]", "[/_-]", "[+/_-]")
FDR = 0.01  # share of wrong finds allowed in each class of lengths
RANDOM_LEVEL = 0.001  # a truly random string fails the battery this often
BINS_PER_UNIT, BINS = 20, 2000  # of -ln(p)
LENGTHS = (32, 48, 96)  # classes of lengths: below the first, below the second, ...

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the narrowest alphabet to the widest: (its characters, coincidence rate of structured strings in it).
#: Identifiers, words and numbers repeat a character at about these rates, random strings at one in the alphabet's size.
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", 0.15),
    "HEX": (_DIGITS + "ABCDEF", 0.15),
    "upper letters": (_UPPER, 0.065),
    "lower letters": (_LOWER, 0.065),
    "base32": (_UPPER + "234567", 0.065),
    "lower": (_DIGITS + _LOWER, 0.065),
    "upper": (_DIGITS + _UPPER, 0.065),
    "letters": (_LOWER + _UPPER, 0.06),
    "alnum": (_DIGITS + _LOWER + _UPPER, 0.06),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 0.06),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", 0.06),
}
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_CHUNK = 128  # elements of an array that running values and cuts of a text treat at once; changes no result


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(values: Column) -> Column:
    """An array in pieces of _CHUNK elements; none for an empty array."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(_CHUNK))
    pieces = lambda: F.transform(starts, lambda at: F.slice(values, at, F.lit(_CHUNK)))
    return F.when(F.size(values) > 0, pieces()).otherwise(F.slice(F.array(values), 1, 0))


def _running(values: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """Running values of an array of ints: step(step(start, first), second) and so on; ``step`` is associative.

    An array grows by being copied, so it grows within chunks, and the chunks' totals among themselves.
    """
    none = F.array().cast("array<int>")

    def grown(chunk: Column) -> Column:
        return F.aggregate(
            chunk, none, lambda got, v: F.array_append(got, step(F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(start)), v))
        )

    def put_together(inner: Column) -> Column:
        totals = F.transform(inner, lambda c: F.element_at(c, -1))
        before = lambda totals: F.array_insert(totals, 1, F.lit(start))
        shifted = _let(grown(totals), lambda t: F.slice(before(t), F.lit(1), F.size(t)))
        return F.flatten(F.zip_with(inner, shifted, lambda c, b: F.transform(c, lambda v: step(b, v))))

    return _let(F.transform(_chunks(values), grown), put_together)


def _ends(parts: Column, between: int = 0) -> Column:
    """Where each part of a text ends, parts being ``between`` characters apart."""
    lengths = F.transform(parts, lambda part: F.length(part) + between)
    return F.transform(_let(lengths, lambda n: _running(n, lambda a, b: a + b)), lambda end: end - between)


def _found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array of (start, end, match); ``text`` holds no marks of its own."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))

    def odd(parts: Column) -> Column:  # between, match, between, match, ..., between
        spans = F.zip_with(
            parts,
            _ends(parts),
            lambda part, end: F.struct((end - F.length(part)).alias("start"), end.alias("end"), part.alias("match")),
        )
        return F.filter(spans, lambda s, i: i % 2 == 1)

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), _let(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1), odd)).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """Chance that a normal deviate exceeds ``z``; a published polynomial, good to 1e-7."""
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(x: Column) -> Column:
        series = _let(
            1 / (1 + 0.2316419 * x), lambda t: reduce(lambda acc, c: acc * t + F.lit(c), reversed(coefficients), F.lit(0.0)) * t
        )
        return F.exp(-x * x / 2) / 2.5066282746310002 * series

    return _let(z, lambda z: _let(_let(F.abs(z), tail), lambda p: F.when(z >= 0, p).otherwise(1 - p)))


def _chi_square_tail(chi: Column, df: Column) -> Column:
    """Chance that a chi-squared variable exceeds ``chi`` (cube-root approximation)."""
    return _let(2 / (9 * df), lambda spread: _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _grow(array: Column, **new) -> Column:
    """The array of structs with more fields, each a function of the struct."""
    return F.transform(array, lambda c: reduce(lambda s, kv: s.withField(kv[0], kv[1](c)), new.items(), c))


def _parts(run: Column) -> Column:
    """The run without padding, and its parts between separators, as array of (start, end, core); the last keeps the padding."""

    def cut(core: Column, separators: Column) -> Column:
        def spans(parts: Column) -> Column:
            return F.zip_with(
                parts,
                _ends(parts, between=1),
                lambda part, end: F.struct(
                    (run["start"] + end - F.length(part)).alias("start"),
                    F.when(end == F.length(core), run["end"]).otherwise(run["start"] + end).alias("end"),
                    part.alias("core"),
                ),
            )

        return F.filter(_let(F.split(core, separators, -1), spans), lambda s: F.length(s["core"]) >= MIN_LENGTH)

    def all_cuts(core: Column) -> Column:
        whole = F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"), core.alias("core")))
        cuts = F.flatten(F.transform(F.array(*map(F.lit, SEPARATORS)), lambda separators: cut(core, separators)))
        return F.when(core.rlike(SEPARATORS[-1]), F.array_distinct(F.concat(whole, cuts))).otherwise(whole)

    return _let(F.regexp_replace(run["match"], "=+$", ""), all_cuts)


def _candidates(text: Column) -> Column:
    """Long runs of key characters, but for plain numbers, and parts of such runs, each with its battery of tests.

    ``p_random`` is the smallest p-value, times their number, of three tests of randomness in the
    inferred encoding: uniform use of the alphabet, runs above and below its middle, serial correlation.
    ``p_structured`` is the chance that a structured string of this length uses its alphabet so evenly.
    """
    runs = _found(text, CANDIDATE)
    runs = F.flatten(F.transform(runs, _parts))
    runs = F.filter(runs, lambda c: c["core"].rlike("[A-Za-z0-9]") & ~c["core"].rlike("^[0-9]+$"))

    def encoding(c: Column) -> Column:
        out = F.lit(None)
        for alphabet, rate in reversed(list(ENCODINGS.values())):
            inside = c["core"].rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]+$")
            out = F.when(inside, F.struct(F.lit(alphabet).alias("alphabet"), F.lit(rate).alias("rate"))).otherwise(out)
        return out

    runs = _grow(runs, encoding=encoding)
    runs = _grow(runs, alphabet=lambda c: c["encoding"]["alphabet"], rate=lambda c: c["encoding"]["rate"])
    runs = F.filter(runs, lambda c: c["alphabet"].isNotNull())  # a mix of + and - or / and _ is no encoding; its parts are
    runs = _grow(
        runs,
        k=lambda c: F.length(c["alphabet"]).cast("double"),
        n=lambda c: F.length(c["core"]).cast("double"),
        x=lambda c: F.transform(
            F.filter(F.split(c["core"], ""), lambda ch: ch != ""),
            lambda ch: (F.call_function("instr", c["alphabet"], ch) - 1).cast("double"),
        ),
    )
    runs = _grow(
        runs,
        squares=lambda c: F.aggregate(
            F.array_distinct(c["x"]), F.lit(0.0), lambda acc, v: acc + F.pow(c["n"] - F.size(F.array_remove(c["x"], v)), F.lit(2))
        ),
        mean=lambda c: _total(c["x"]) / c["n"],
        above=lambda c: F.size(F.filter(c["x"], lambda v: v >= c["k"] / 2)).cast("double"),
        turns=lambda c: _total(
            F.zip_with(
                F.slice(c["x"], F.lit(1), F.size(c["x"]) - 1),
                F.slice(c["x"], F.lit(2), F.size(c["x"]) - 1),
                lambda a, b: ((a >= c["k"] / 2) != (b >= c["k"] / 2)).cast("double"),
            )
        ),
    )
    runs = _grow(
        runs,
        scatter=lambda c: _total(F.transform(c["x"], lambda v: (v - c["mean"]) * (v - c["mean"]))),
        serial=lambda c: _total(
            F.zip_with(
                F.slice(c["x"], F.lit(1), F.size(c["x"]) - 1),
                F.slice(c["x"], F.lit(2), F.size(c["x"]) - 1),
                lambda a, b: (a - c["mean"]) * (b - c["mean"]),
            )
        ),
        chi=lambda c: c["k"] / c["n"] * c["squares"] - c["n"],
    )

    def p_uniform(c: Column) -> Column:
        return _chi_square_tail(c["chi"], c["k"] - 1)

    def p_runs(c: Column) -> Column:
        n, above = c["n"], c["above"]

        def p(both: Column) -> Column:
            spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
            z = F.abs(c["turns"] + 1 - (1 + both / n)) / spread
            return F.when(both > n, 2 * _upper_tail(z)).otherwise(F.lit(0.0))

        return _let(2 * above * (n - above), p)

    def p_serial(c: Column) -> Column:
        z = F.abs(c["serial"] / c["scatter"] + 1 / (c["n"] - 1)) * F.sqrt(c["n"] - 1)
        return F.when(c["scatter"] > 0, 2 * _upper_tail(z)).otherwise(F.lit(0.0))

    def p_structured(c: Column) -> Column:
        extra = c["n"] * (c["k"] * c["rate"] - 1)
        mean, spread = c["k"] - 1 + extra, F.sqrt(2 * (c["k"] - 1) + 4 * extra)
        return _upper_tail((mean - c["chi"]) / spread)

    def length_class(c: Column) -> Column:
        # Words and names without digits are many: they are classes of their own and do not decide on keys with digits.
        digits, capitals = c["core"].rlike("[0-9]"), c["core"].rlike("[A-Z]")
        letters = F.when(digits, 0).when(capitals, 1).otherwise(2)
        return reduce(lambda acc, at: acc + (c["n"] >= at).cast("int"), LENGTHS, letters * (len(LENGTHS) + 1))

    return F.transform(
        runs,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            length_class(c).alias("length_class"),
            (3 * F.least(p_uniform(c), p_runs(c), p_serial(c))).alias("p_random"),
            F.least(
                F.floor(-F.log(F.greatest(p_structured(c), F.lit(1e-300))) * BINS_PER_UNIT), F.lit(BINS)
            ).cast("int").alias("bin"),
        ),
    )


def _plain(text: Column) -> Column:
    """The text with other characters for the two marks: no pattern holds them, and no position moves."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, _OTHER * 2)


def discovery_limits(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[int, int]:
    """Smallest accepted bin of ``p_structured`` for each class of lengths, over all candidates of all texts.

    The step-up rule for the false-discovery rate, per class of lengths (with digits, without, in small letters only) so that
    many short strings do not decide on long ones: accept the p-values up to the largest p with p <= rate * rank / number. Ranks are
    counts of bins of -ln(p), every p taken as the largest of its bin, so the driver gets a row per class.
    """
    one = docs.select(F.explode(_candidates(_plain(F.col(text_col)))).alias("c"))
    counts = one.groupBy("c.length_class", "c.bin").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("length_class")
    downwards = per_class.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("*", F.sum("n").over(downwards).alias("rank"), F.sum("n").over(per_class).alias("m"))
    accepted = ranked.where(F.exp(-F.col("bin") / F.lit(BINS_PER_UNIT)) <= fdr * F.col("rank") / F.col("m"))
    rows = accepted.groupBy("length_class").agg(F.min("bin").alias("bin")).collect()  # 3 * (len(LENGTHS) + 1) at most
    return {r["length_class"]: r["bin"] for r in rows}


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(kind).alias("name")
        ),
    )


def _base(plain: Column) -> Column:
    assign = F.filter(
        _found(plain, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_VALUE
    )
    access = F.filter(_found(plain, ACCESS), lambda s: F.length(s["match"]) >= ACCESS_LENGTH)
    spans = (_spans(assign, "assign"), _spans(access, "access"), _spans(_found(plain, HEX), "hex"))
    return F.array_sort(F.concat(*spans))


def _accepted(candidates: Column, limits: dict[int, int]) -> Column:
    def passes(c: Column) -> Column:
        least = F.lit(BINS + 1)
        for length_class, bin_ in sorted(limits.items()):
            least = F.when(c["length_class"] == length_class, F.lit(bin_)).otherwise(least)
        return (c["p_random"] >= RANDOM_LEVEL) & (c["bin"] >= least)

    return F.filter(candidates, passes)


def with_secrets(docs: DataFrame, limits: dict[int, int], text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: arrays of (start, kind, end, name), by start, then kind.

    ``secret_spans`` holds the base spans and the accepted random strings that neither a base span nor a longer accepted
    string covers. A null or empty text has none. Given columns of these two names are replaced; all others stay.
    """
    plain = _plain(F.col(text_col))
    found = docs.withColumn("base_spans", _base(plain)).withColumn("secret_spans", _accepted(_candidates(plain), limits))
    return found.withColumn(
        "secret_spans", F.array_sort(F.concat(F.col("base_spans"), _spans(_uncovered(F.col("base_spans"), F.col("secret_spans")), "random")))
    )


def _uncovered(base: Column, accepted: Column) -> Column:
    """The accepted strings that no base span and no longer accepted string covers.

    By start, then longest first, then base spans first: what covers a span comes before it, so it is covered if one
    before it ends no earlier. One pass over the spans, not each against all.
    """
    order = lambda s, mine: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("down"), F.lit(mine).alias("mine"), s["end"].alias("end")
    )

    def fresh(spans: Column) -> Column:
        reached = F.array_insert(_running(F.transform(spans, lambda s: s["end"]), F.greatest), 1, F.lit(0))
        seen = F.zip_with(spans, F.slice(reached, F.lit(1), F.size(spans)), lambda s, at: s.withField("reached", at))
        return F.filter(seen, lambda s: s["mine"] & (s["reached"] < s["end"]))

    every = F.concat(F.transform(base, lambda s: order(s, False)), F.transform(accepted, lambda s: order(s, True)))
    return _let(F.array_sort(every), fresh)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, base_spans, secret_spans) of every row of ``docs``; see ``with_secrets``.

    Two passes over the texts and no shuffle of them: the first counts the p-values of all candidates, the second
    applies the limits. A null or empty text has no spans; a null id stays null; repeated
    rows are scanned each; no rows give none.
    """
    given = with_text(docs, id_col, text_col)
    return with_secrets(given, discovery_limits(given, fdr=fdr)).select("doc_id", "base_spans", "secret_spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by ``mark``; null stays null."""

    def piece(part: Column, first: Column, s: Column) -> Column:
        between = F.substring(part, s["at"] - first + 1, s["start"] - s["at"])
        return F.when(s["start"] >= s["at"], F.concat(between, F.lit(mark))).otherwise("")

    def pieces(chunk: Column) -> Column:
        # A position in a text is found by counting from its start, so the part of a chunk is cut out first.
        first, last = F.get(chunk, F.lit(0))["at"], F.element_at(chunk, -1)["start"]
        return _let(F.substring(text, first + 1, last - first), lambda part: F.transform(chunk, lambda s: piece(part, first, s)))

    def put_together(reached: Column) -> Column:
        before = F.slice(F.array_insert(reached, 1, F.lit(0)), F.lit(1), F.size(reached))
        seen = F.zip_with(spans, before, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
        cut = _let(seen, lambda seen: F.flatten(F.transform(_chunks(seen), pieces)))
        rest = F.substring(text, F.element_at(reached, -1) + 1, F.length(text))
        return F.concat(F.array_join(cut, ""), rest)

    done = _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), put_together)
    return F.when(F.size(spans) > 0, done).otherwise(text)
