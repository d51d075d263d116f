"""Secret scans with DataFrame functions only.

Three patterns give the base spans. The method adds spans: a window slides over candidate strings (runs of
token characters); its Shannon entropy and the classes of its characters are kept up by incremental counts,
and windows that reach the threshold of their own class are joined to spans where they overlap. The
allow-list judges windows and spans, never the whole candidate: known placeholders and UUIDs are blanked
before the window passes, so that only what stands beside them counts, and spans that are plain numbers or
words go. Base spans are never suppressed.

Positions are code points, end exclusive. They come from the pieces between matches: a text split by a
pattern and the pattern's matches alternate, so running sums of both lengths are the starts.

Cases: null text is empty and has no span; a null ``doc_id`` is kept; rows that repeat are scanned each;
spans of different kinds may overlap, those of one kind don't; ties in start go by kind as listed in
``KINDS``; an empty table gives no rows; further columns of ``docs`` stay, except ones named like the
results of ``scan``.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import let
from .storage import table

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # same spans as AKIA[A-Z0-9]+ with 16 characters or more
HEX = "[0-9a-f]{32,}"  # same spans as [0-9a-f]+ with 32 characters or more

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
HEX_CODES, ALNUM_CODES = 22, 62  # the first of the alphabet
# bits that a window must reach by the class of its characters
LEAST_HEX, LEAST_ALNUM, LEAST_BASE64 = 3.0, 3.7, 3.8
# Looks random but isn't secret: (pattern, its length), blanked before the window passes ...
_HEX = "[0-9a-fA-F]"
MASKED = (
    (f"(?<!{_HEX}){_HEX}{{8}}(-{_HEX}{{4}}){{3}}-{_HEX}{{12}}(?!{_HEX})", 36),
    ("(?i)placeholder", 11), ("(?i)changeme", 8), ("(?i)example", 7), ("(?i)dummy", 5), ("(?i)xxxx", 4), ("0000000", 7), ("1234567", 7),
)
# ... and what a whole span may be: a number, or words and paths (lower-case, capitalized or upper-case; cut off at the ends).
ALLOWED = (
    "^[0-9_=+/-]+$",
    # possessive, as a repeated group that may be entered again takes a stack frame each time; giving back never helps here
    "^[A-Za-z]?(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[_=+/-]|(?<![A-Za-z])[A-Za-z](?![A-Za-z]))*+[A-Za-z]?$",
)
_FIELD, _FIELDS = 5, 12  # bits of a count, counts in a number


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of ``(start, kind, end)`` of the pattern's matches whose ``group`` has ``least`` characters or more.

    Starts are running sums. They are taken over blocks of about the square root of their number, as an array
    that grows is copied at each step: ``n`` matches cost ``n * sqrt(n)`` moves of a pointer, and one pass over the text.
    """
    found = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.char_length)
    lengths = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("piece"), found(0).alias("match"), found(group).alias("value"))
    no_parts = F.expr("cast(array() as array<array<struct<start:int,kind:int,end:int>>>)")

    def one(s: Column, x: Column) -> Column:
        start = s["at"] + x["piece"]
        end = start + x["match"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    def summed(all_lengths: Column) -> Column:
        n = F.size(all_lengths) - 1  # the last piece stands behind the last match
        size = F.ceil(F.sqrt(n)).cast("int")

        def block(s: Column, k: Column) -> Column:
            own = F.slice(all_lengths, k * size + 1, F.least(size, n - k * size))
            inside = F.aggregate(own, F.struct(s["at"].alias("at"), _none().alias("spans")), one)
            return let(inside, lambda t: F.struct(t["at"].alias("at"), F.concat(s["parts"], F.array(t["spans"])).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), no_parts.alias("parts"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), start, block, lambda s: F.flatten(s["parts"]))

    renamed = F.transform(lengths, lambda x: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), let(renamed, summed)).otherwise(_none())


def _slot(code: Column) -> tuple[Column, Column]:
    return F.floor(code / _FIELDS).cast("int"), (code % _FIELDS * _FIELD).cast("int")


def _count(counts: Column, code: Column) -> Column:
    word, shift = _slot(code)
    return F.call_function("shiftright", F.get(counts, word), shift).bitwiseAND(F.lit((1 << _FIELD) - 1)).cast("int")


def _change(counts: Column, code: Column, by: int) -> Column:
    word, shift = _slot(code)
    return F.transform(counts, lambda x, k: F.when(k == word, x + F.call_function("shiftleft", F.lit(1).cast("long"), shift) * by).otherwise(x))


def windows(string: Column, width: int = WINDOW, least: Column | None = None) -> Column:
    """``(bits, spans)``: the highest Shannon entropy of any ``width`` (below 32) successive characters of ``ALPHABET``,
    and the joined windows ``(start, end)`` that reach ``least``, by default that of their class.

    One character enters and one leaves at each step. Only their two counts change, packed in a few numbers,
    and with them the sum of c log2 c and how many characters aren't hexadecimal or alphanumeric.
    """
    f = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)))
    span = "struct<start:int,end:int>"

    def passed(codes: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _FIELDS)).alias("counts"),
            F.lit(0.0).alias("sum"), F.lit(0).alias("beyond_hex"), F.lit(0).alias("beyond_alnum"), F.lit(0.0).alias("best"),
            F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.expr(f"cast(array() as array<{span}>)").alias("spans"),
        )

        def step(s: Column, i: Column) -> Column:
            came, left = F.get(codes, i), F.when(i >= width, F.get(codes, i - width))
            gone = left.isNotNull()
            c_in, c_out = _count(s["counts"], came), _count(s["counts"], left)
            total = s["sum"] + F.when(left.eqNullSafe(came), 0.0).otherwise(F.get(f, c_in + 1) - F.get(f, c_in) + F.when(gone, F.get(f, c_out - 1) - F.get(f, c_out)).otherwise(0.0))
            grown = _change(s["counts"], came, 1)
            beyond = lambda name, first: s[name] + (came >= first).cast("int") - F.coalesce((left >= first).cast("int"), F.lit(0))
            return let(F.struct(
                F.when(gone, _change(grown, left, -1)).otherwise(grown).alias("counts"), total.alias("sum"),
                beyond("beyond_hex", HEX_CODES).alias("beyond_hex"), beyond("beyond_alnum", ALNUM_CODES).alias("beyond_alnum"),
            ), lambda t: judged(s, t, i))

        def judged(s: Column, t: Column, i: Column) -> Column:
            bits = F.when(i >= width - 1, math.log2(width) - t["sum"] / width).otherwise(0.0)
            own = least if least is not None else F.when(t["beyond_hex"] == 0, LEAST_HEX).when(t["beyond_alnum"] == 0, LEAST_ALNUM).otherwise(LEAST_BASE64)
            hit = (i >= width - 1) & (bits >= own)
            first = i - (width - 1)
            joins = (s["start"] >= 0) & (first <= s["end"])
            closed = F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
            return F.struct(
                t["counts"].alias("counts"), t["sum"].alias("sum"), t["beyond_hex"].alias("beyond_hex"), t["beyond_alnum"].alias("beyond_alnum"), F.greatest(s["best"], bits).alias("best"),
                F.when(hit & ~joins, first).otherwise(s["start"]).alias("start"), F.when(hit, i + 1).otherwise(s["end"]).alias("end"),
                F.when(hit & ~joins & (s["start"] >= 0), closed).otherwise(s["spans"]).alias("spans"),
            )

        # in blocks of about the square root of the length, as what a step returns is copied with the spans it holds
        n = F.size(codes)
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
        names = ("counts", "sum", "beyond_hex", "beyond_alnum", "best", "start", "end")

        def block(s: Column, k: Column) -> Column:
            inside = F.aggregate(F.sequence(k * size, F.least((k + 1) * size, n) - 1), s["state"], step)
            return let(inside, lambda t: F.struct(
                F.struct(*(t[c].alias(c) for c in names), F.expr(f"cast(array() as array<{span}>)").alias("spans")).alias("state"),
                F.concat(s["parts"], F.array(t["spans"])).alias("parts"),
            ))

        def joined(s: Column) -> Column:
            rest = F.array(F.struct(s["state"]["start"].alias("start"), s["state"]["end"].alias("end")))
            closed = F.flatten(s["parts"])
            return F.struct(s["state"]["best"].alias("bits"), F.when(s["state"]["start"] < 0, closed).otherwise(F.concat(closed, rest)).alias("spans"))

        begin = F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{span}>>)").alias("parts"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), begin, block, joined)

    return let(F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), passed)


def window_entropy(string: Column, width: int = WINDOW) -> Column:
    """The highest entropy of a window; strings shorter than ``width`` give 0."""
    return windows(string, width)["bits"]


def random_spans(string: Column) -> Column:
    """The spans ``(start, end)`` of a candidate that look random and that the allow-list doesn't cover."""
    masked = string
    for pattern, length in MASKED:
        masked = F.regexp_replace(masked, pattern, "0" * length)

    def kept(characters: Column) -> Column:
        # from an array, as a substring of a string is counted off from its beginning
        own = lambda x: F.array_join(F.slice(characters, x["start"] + 1, x["end"] - x["start"]), "")
        return F.filter(windows(masked)["spans"], lambda x: let(own(x), lambda t: ~functools.reduce(operator.or_, (t.rlike(rule) for rule in ALLOWED))))

    return let(F.split(string, ""), kept)


def scan(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``added``: arrays of ``(start, kind, end)``; ``kind`` indexes ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = _spans(text, ASSIGN, 0, 2, ASSIGN_VALUE)
    found = docs.withColumn("base", F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    strings = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    placed = F.zip_with(_spans(text, CANDIDATE, 3), strings, lambda at, string: F.transform(
        random_spans(string), lambda x: F.struct((at["start"] + x["start"]).alias("start"), F.lit(3).alias("kind"), (at["start"] + x["end"]).alias("end"))
    ))
    return found.withColumn("added", F.when(text.rlike(CANDIDATE), F.flatten(placed)).otherwise(_none()))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
