"""Secret scans in DataFrame functions only.

Known shapes are found by their patterns. Further candidates are long runs of
key characters; over each runs a window of ``WINDOW`` characters whose Shannon
entropy is kept by incremental counts (one character comes, one goes), against
a threshold for the candidate's character class. Candidates on the allow-list
(plain words, numbers, identifiers such as UUIDs, placeholders) are left alone,
as are spans inside one already found.

Only documents that hold a match pay for positions. Spans are in code points,
end exclusive.

Defined cases: null texts are empty and hold nothing; overlapping kinds are all
reported; repeated rows are scanned each for itself; extra columns stay, as do
those named as the new ones (see ``found_names``); an empty table gives no rows.
A step of a window costs the candidate's alphabet (67 characters at most), not
the window, and a candidate's characters are numbered once, so very long
candidates cost their length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh

WINDOW = 20
#: Fixed values: (rank of the kind, class of the whole candidate, bits per character from which a window counts), the first class that fits.
CLASSES = (
    (3, "^([0-9a-f]+|[0-9A-F]+)$", 3.05),
    (5, "^[0-9A-Fa-f]+$", 3.2),
    (6, "^([0-9a-z]+|[0-9A-Z]+)$", 3.7),
    (4, "", 4.01),
)
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of fewer characters are dropped and hold no shorter one, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Candidates that are no secrets.
ALLOWED = (
    r"^[A-Za-z_/=+-]+$", r"^[0-9_/=+-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6,})",
)
#: A worded slug or path is no secret; a piece of it that mixes letters and digits is a key from this length on.
PIECE = 10
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_mixed_hex", "entropy_alnum")
SPAN = "struct<start:int,rank:int,end:int>"


def nothing() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def located(text: Column, pattern: str, rank: Column, keep: Column | None = None) -> Column:
    """Spans of the non-overlapping matches, leftmost first; ``keep`` says which match stays."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = keep if keep is not None else F.transform(matches, lambda m: F.lit(True))
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"), matches.alias("found"), kept.alias("keep"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["found"])
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(row["keep"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), nothing().alias("out")), step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(nothing())


def base_spans(text: Column) -> Column:
    """Spans of the known shapes."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 6)
    return F.sort_array(F.concat(located(text, ASSIGN, F.lit(0), long_enough), located(text, ACCESS, F.lit(1)), located(text, HEX, F.lit(2))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_spans(candidate: Column, bits: Column) -> Column:
    """Merged windows (begin, end) of a candidate whose entropy reaches ``bits``."""

    def coded(chars: Column) -> Column:
        alphabet = F.array_distinct(chars)
        numbered = lambda a: F.transform(chars, lambda c: (F.array_position(a, c) - 1).cast("int"))
        return let(alphabet, lambda a: let(numbered(a), lambda codes: let(bits, lambda least: coded_spans(codes, F.size(a), least))))

    return let(F.split(candidate, ""), coded)


def coded_spans(codes: Column, letters: Column, bits: Column) -> Column:
    """The same of a candidate's characters as numbers below ``letters``."""
    # c * log2(c) for a count c: the entropy of a window is log2(n) - sum(c * log2(c)) / n.
    weigh = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    # The run that may still grow stands apart, so that the list is copied once a run, not once a window.
    state = F.struct(F.array_repeat(F.lit(0), letters).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("b"), F.lit(-1).alias("e"), F.expr("cast(array() as array<struct<b:int,e:int>>)").alias("out"))
    rows = F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.coalesce(F.get(codes, i - WINDOW), F.lit(-1)).alias("go"), i.alias("i")))

    def step(s: Column, r: Column) -> Column:
        counts = F.transform(s["counts"], lambda n, k: n + (k == r["come"]).cast("int") - (k == r["go"]).cast("int"))
        came = F.get(s["counts"], r["come"])
        added = s["sum"] + F.get(weigh, came + 1) - F.get(weigh, came)
        # After the arrival, so that one character for the same one changes nothing.
        left = F.get(s["counts"], r["go"]) + (r["go"] == r["come"]).cast("int")
        total = F.when(r["go"] >= 0, added - F.get(weigh, left) + F.get(weigh, left - 1)).otherwise(added)
        begin, end = r["i"] - (WINDOW - 1), r["i"] + 1

        def placed(total: Column) -> Column:
            passes = (begin >= 0) & (F.lit(log2(WINDOW)) - total / WINDOW >= bits)
            apart = passes & (s["e"] < begin)
            ended = F.when(apart & (s["e"] >= 0), F.concat(s["out"], F.array(F.struct(s["b"].alias("b"), s["e"].alias("e"))))).otherwise(s["out"])
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(apart, begin).otherwise(s["b"]).alias("b"), F.when(passes, end).otherwise(s["e"]).alias("e"), ended.alias("out"))

        return let(total, placed)

    return F.aggregate(rows, state, step, lambda s: F.when(s["e"] >= 0, F.concat(s["out"], F.array(F.struct(s["b"].alias("b"), s["e"].alias("e"))))).otherwise(s["out"]))


def slug(candidate: Column) -> Column:
    """Whether the candidate is words joined by - _ or /, the last of which may hold digits if it is short or has no letters.

    The pieces are looked at one by one, so the work follows the length.
    """

    def of(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        words = ~F.exists(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: ~p.rlike("^[a-z]+$"))
        key = last.rlike("[a-z]") & last.rlike("[0-9]") & (F.length(last) >= PIECE)
        return (F.size(pieces) > 1) & words & last.rlike("^[a-z0-9]+$") & ~key

    return let(F.split(F.regexp_replace(candidate, "^/|/$", ""), "[-_/]", -1), of)


def suspicious(candidate: Column) -> Column:
    return ~(reduce(lambda a, b: a | b, [candidate.rlike(p) for p in ALLOWED]) | slug(candidate))


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in candidates that are not on the allow-list."""

    def of_class(candidate: Column, k: int) -> Column:
        out = F.lit(CLASSES[-1][k])
        for c in CLASSES[-2::-1]:
            out = F.when(candidate.rlike(c[1]), c[k]).otherwise(out)
        return out

    pieces, matches = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"), matches.alias("found"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        windows = F.when(suspicious(row["found"]), window_spans(row["found"], of_class(row["found"], 2))).otherwise(F.expr("cast(array() as array<struct<b:int,e:int>>)"))
        spans = F.transform(windows, lambda w: F.struct((start + w["b"]).alias("start"), of_class(row["found"], 0).alias("rank"), (start + w["e"]).alias("end")))
        return F.struct((start + F.length(row["found"])).alias("at"), F.concat(state["out"], spans).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), nothing().alias("out")), step)["out"]
    return F.when(text.rlike(CANDIDATE), found).otherwise(nothing())


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``base`` and ``spans``: arrays of (start, rank of the kind, end) in order.

    Where ``docs`` has such a column itself, the new one is called as ``found_names`` says.
    """
    text = F.coalesce("text", F.lit(""))
    base, spans = found_names(docs)
    entropy = fresh([*docs.columns, base, spans], "entropy")
    both = docs.withColumn(base, base_spans(text)).withColumn(entropy, entropy_spans(text))
    added = F.filter(entropy, lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return both.withColumn(spans, F.sort_array(F.concat(base, added))).drop(entropy)


def found_names(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns ``base`` and ``spans`` that ``scan`` adds: with an underscore after them for each clash."""
    base = fresh(docs.columns, "base")
    return base, fresh([*docs.columns, base], "spans")


def named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        apart = (s["start"] > state["at"]) | (state["at"] == 0)
        gap = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substr(text, end["at"] + 1)))
