"""Secrets in whole texts, with DataFrame functions only.

Base kinds are patterns. The method adds spans by entropy: candidate strings (runs of at least 20
letters and digits of the usual encodings) get a character class, and a window slides over each.
The window's counts are kept incrementally, five bits a character packed into a few integers: a step
adds one character, drops one, and corrects the sum of c * log2(c) for those two, from which the
window's Shannon entropy follows. Windows at or above the threshold of their class are merged into
spans. Windows that overlap an allow-listed part and spans that lie in a base span are suppressed;
the rest of such a candidate is scored, and base spans always stay.

Long texts take time in proportion to their length: running sums and scans go over blocks of CHUNK
elements, so that no array is copied as a whole at each step.

Everything is one projection: no exchange, no Python. Positions are code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds in the order of their listing.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
CANDIDATE = r"[A-Za-z0-9+/]{20,}={0,2}"
# Parts that mark the windows around them as a placeholder or as an ordinary sequence.
ALLOWED = r"(?i)example|sample|placeholder|dummy|xxxxx|0123456789|abcdefghij|qwertyui|(.)\1{7}"


@dataclass(frozen=True)
class EntropyClass:
    """name: kind of its spans; whole: pattern of a candidate; window: characters; bits: least entropy."""

    name: str
    whole: str
    window: int
    bits: float


# The first class whose pattern a candidate fits is its class; each asks for letters and digits.
CLASSES = (
    EntropyClass("entropy_hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", 16, 2.75),
    EntropyClass("entropy_alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])([0-9a-z]+|[0-9A-Z]+)$", 20, 3.4),
    EntropyClass("entropy_base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*$", 20, 3.6),
)
# The characters of candidates; a character's place is its number.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
PER_LONG, COUNT_BITS = 12, 5  # counts of a window (at most 31) packed into one integer, and their bits
CHUNK = 128  # elements of a block of a scan
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast(_SPANS)


def _blocks(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / F.lit(CHUNK)).cast("int")
    return F.when(F.size(values) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array of int: ``combine`` (associative, 0 neutral) of all elements up to each, itself included."""
    none = F.array().cast("array<int>")

    def scan(block: Column, head: Column, before: bool) -> Column:
        def step(acc: Column, v: Column) -> Column:
            now = combine(acc["at"], v)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(acc["at"] if before else now)).alias("out"))

        return F.aggregate(block, F.struct(head.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0), True), lambda b, head: scan(b, head, False)))

    return let(values, lambda v: let(_blocks(v).cast("array<array<int>>"), of))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _placed(text: Column, pattern: str, keep: Callable[[Column], Column], hits: Column) -> Column:
    """struct(start, end, text) of the matches that ``keep`` takes, by their position.

    Matches and the gaps between them alternate, so running lengths are the positions.
    """

    def place(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda gap, hit: F.length(gap) + F.length(hit)), _sum)
        spans = F.zip_with(ends, found, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("text")))
        return F.filter(spans, lambda x: keep(x["text"]))

    empty = F.array().cast("array<struct<start: int, end: int, text: string>>")
    return let(hits, lambda found: F.when(F.size(found) == 0, empty).otherwise(place(found)))


def _of_kind(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _allowed(candidate: Column) -> Column:
    """The allow-listed parts of a candidate, by position in it."""
    return _placed(candidate, ALLOWED, lambda hit: F.lit(True), F.regexp_extract_all(candidate, F.lit(ALLOWED), 0))


def _merged(runs: Column) -> Column:
    """Runs (start, end) in ascending order of both, those that overlap or touch in one."""
    begins = F.filter(runs, lambda x, i: F.coalesce(F.get(runs, i - 1)["end"] < x["start"], F.lit(True)))
    ends = F.filter(runs, lambda x, i: F.coalesce(F.get(runs, i + 1)["start"] > x["end"], F.lit(True)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


_LONGS = -(-len(SYMBOLS) // PER_LONG)
_LARGEST = max(k.window for k in CLASSES)


def _symbols(text: Column) -> Column:
    """For each character the packed integer that counts it, the place of its bits there, and a one in that place."""
    def of(number: Column) -> Column:
        shift = (number % PER_LONG * COUNT_BITS).cast("int")
        return F.struct(F.floor(number / PER_LONG).cast("int").alias("at"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    return F.transform(F.split(text, ""), lambda ch: let(F.position(ch, F.lit(SYMBOLS)) - 1, of))


def _windows(candidate: Column) -> Column:
    """Spans (start, kind, end) of a candidate's windows of high entropy, merged."""
    chosen = F.lit(None)
    for k in reversed(CLASSES):
        own = F.struct(F.lit(k.window).alias("window"), F.lit(k.bits).alias("bits"), F.lit(KINDS.index(k.name)).alias("kind"))
        chosen = F.when(candidate["text"].rlike(k.whole), own).otherwise(chosen)
    term = lambda c: c * math.log2(c) if c else 0.0
    # what the sum of c * log2(c) gains by one more, and by one less, of a character that stands c times
    steps = F.struct(
        F.array(*[F.lit(term(c + 1) - term(c)) for c in range(_LARGEST + 1)]).alias("more"),
        F.array(*[F.lit(term(max(c - 1, 0)) - term(c)) for c in range(_LARGEST + 1)]).alias("less"),
    )

    def spans(k: Column, step: Column) -> Column:
        w = k["window"]

        def block(symbols: Column, allowed: Column, c: Column) -> Column:
            """Runs of the windows that end in one block; the windows before its first character are read again."""
            head, tail = c * CHUNK, F.least(F.size(symbols), (c + 1) * CHUNK)
            begin = F.greatest(head - (w - 1), F.lit(0))
            count = lambda counts, x: F.call_function("shiftright", counts[x["at"]], x["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

            def dropped(acc: Column, i: Column) -> Column:
                """The counts and the sum without the character that leaves the window, if there is one."""
                leaves = lambda x: F.struct(
                    (acc["total"] + step["less"][count(acc["counts"], x)]).alias("total"), F.transform(acc["counts"], lambda v, n: F.when(n == x["at"], v - x["one"]).otherwise(v)).alias("counts")
                )
                return F.when(i - w >= begin, let(symbols[i - w], leaves)).otherwise(F.struct(acc["total"].alias("total"), acc["counts"].alias("counts")))

            def slide(acc: Column, i: Column, near: Column) -> Column:
                comes = lambda now, x: F.struct(
                    (now["total"] + step["more"][count(now["counts"], x)]).alias("total"), F.transform(now["counts"], lambda v, n: F.when(n == x["at"], v + x["one"]).otherwise(v)).alias("counts")
                )
                return let(let(dropped(acc, i), lambda now: let(symbols[i], lambda x: comes(now, x))), lambda now: judged(acc, now, i, near))

            def judged(acc: Column, now: Column, i: Column, near: Column) -> Column:
                clear = ~F.exists(near, lambda x: (x["start"] <= i) & (x["end"] > i - (w - 1)))
                high = (i >= head) & (i >= w - 1) & (F.log2(w.cast("double")) - now["total"] / w >= k["bits"]) & clear
                run = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))

                def out(new: Column) -> Column:
                    """new: 0 for a window that is not high, 1 for one that begins a run, 2 for one that goes on with it."""
                    return F.struct(
                        now["counts"].alias("counts"), now["total"].alias("total"),
                        F.when(new == 1, i - (w - 1)).otherwise(acc["start"]).alias("start"), F.when(new > 0, i + 1).otherwise(acc["end"]).alias("end"),
                        F.when((new == 1) & (acc["end"] > 0), F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"),
                    )

                return let(F.when(~high, 0).when(acc["end"] > i - w, 2).otherwise(1), out)

            start = F.struct(
                F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("start"), F.lit(0).alias("end"),
                F.array().cast("array<struct<start: int, end: int>>").alias("runs"),
            )
            last = lambda acc: F.when(acc["end"] > 0, F.concat(acc["runs"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["runs"])
            near = F.filter(allowed, lambda x: (x["start"] < tail) & (x["end"] > begin))
            return let(near, lambda some: F.aggregate(F.sequence(begin, tail - 1), start, lambda acc, i: slide(acc, i, some), last))

        def scan(symbols: Column, allowed: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(symbols) - 1) / F.lit(CHUNK)).cast("int"))
            return let(F.flatten(F.transform(blocks, lambda c: block(symbols, allowed, c))), _merged)

        runs = let(_symbols(candidate["text"]), lambda c: let(_allowed(candidate["text"]), lambda a: scan(c, a)))
        return F.transform(runs, lambda r: F.struct((candidate["start"] + r["start"]).alias("start"), k["kind"].alias("kind"), (candidate["start"] + r["end"]).alias("end")))

    return let(chosen, lambda k: F.when(k.isNull(), _none()).otherwise(let(steps, lambda step: spans(k, step))))


def _outside(added: Column, base: Column) -> Column:
    """The spans of ``added`` that lie in none of ``base``: no base span that begins before has its end behind theirs."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("added"), s["end"].alias("end"), s["kind"].alias("kind")))

    def of(every: Column) -> Column:
        reach = running(F.transform(every, lambda s: F.when(s["added"] == 0, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        own = F.zip_with(every, reach, lambda s, end: F.when((s["added"] == 1) & (s["end"] > end), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.filter(own, lambda s: s.isNotNull())

    return F.when(F.size(added) == 0, _none()).otherwise(let(F.array_sort(F.concat(mark(base, 0), mark(added, 1))), of))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return let(names, lambda name: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_assign, n_access, n_hex, base, spans.

    base, spans: kind:start:end of the base spans and of all spans, by start, then kind, then end,
    comma-joined; '' without any. Null texts count as empty. Null ids and repeated rows are each
    scanned and returned. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    always = lambda hit: F.lit(True)
    value = lambda hit: F.length(F.regexp_extract(hit, "^" + ASSIGN, 2)) >= ASSIGN_LEAST
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 0)
    found = docs.select(
        F.col(id_col).alias("id"),
        _placed(text, ASSIGN, value, every(ASSIGN)).alias("assign"),
        _placed(text, ACCESS, always, every(ACCESS)).alias("access"),
        _placed(text, HEX, always, every(HEX)).alias("hex"),
        _placed(text, CANDIDATE, lambda hit: hit.rlike("[0-9]"), every(CANDIDATE)).alias("candidates"),
    )
    base = F.array_sort(F.concat(*[_of_kind(F.col(k), k) for k in KINDS[:3]]))
    high = F.flatten(F.transform(F.col("candidates"), _windows))
    both = let(base, lambda b: F.struct(b.alias("base"), let(high, lambda h: _outside(h, b)).alias("added")))
    rows = found.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], both.alias("both"))
    return rows.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex",
        _written(F.col("both.base")).alias("base"),
        _written(F.array_sort(F.concat(F.col("both.base"), F.coalesce(F.col("both.added"), _none())))).alias("spans"),
    )
