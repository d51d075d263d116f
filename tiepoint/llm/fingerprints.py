"""Document fingerprints with DataFrame functions only: invertible Bloom lookup sketches of paragraphs.

A text's distinct paragraphs are hashed: lines, cut also after every sentence in them (``.``, ``!`` or ``?``
and a space). What is then still longer than ``LONG`` characters is cut after the words whose hash is a
multiple of ``WORDS``; long pieces thus fall into the same parts wherever they stand. A digest carries its
own check bits.

A fingerprint deals the digests by their low bits over a power of two of small tables, ``SHARE`` digests each
or so. A table has cells ``(count, xor of digests)``; each digest is in three of them. A table that can't be
peeled by itself is kept in a larger form beside, so every fingerprint can be inverted.

Two fingerprints are compared without their texts or digest lists. Halves of the tables add up to the
tables for one bit less, down to a single one, so both are first brought to as many tables. These subtract
cell by cell: what both versions hold cancels. The single table is peeled first (a cell with one digest
left gives it up, which frees others); where that fails, the two it consists of, and so on: the work follows
the difference. What can't be peeled in the smallest common tables is inverted in both fingerprints.

Cases: null text is empty; an empty text has one empty paragraph; equal texts have equal fingerprints and
likeness 1; repeated paragraphs count once; a single document is its own next one; rows that share a
``doc_id`` go by their text's hash; a null ``doc_id`` is the smallest; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table

PARAGRAPH = r"\n|(?<=[.!?])\x20"
LONG = 256  # characters; a longer piece without line or sentence ends is cut after some of its words
WORDS = 16  # words in each of its parts, about
PART = 5  # cells in each third of a table
SHARE = 5  # digests in a table, about
LARGER = ((10, 1), (20, 2), (20, 3), (20, 4), (20, 5))  # cells in each third and salt, for what PART can't hold
CHECK_BITS = 20
LEAST_EMPTY = 3  # cells of a difference that is peeled; a matter of time only
BUCKETS = 4  # ranges of documents for each shuffle partition


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(piece: Column) -> Column:
    """A long piece cut after the words whose hash says so, in place of the space that follows."""
    marked = F.transform(F.split(piece, "\x20", -1), lambda w: F.concat(w, F.when(F.pmod(F.xxhash64(w), F.lit(WORDS)) == 0, "\n").otherwise(" ")))
    return let(F.array_join(marked, ""), lambda x: F.split(F.left(x, F.char_length(x) - 1), "\n", -1))


def paragraphs(text: Column) -> Column:
    pieces = F.split(text, PARAGRAPH, -1)
    return F.flatten(F.transform(pieces, lambda p: F.when(F.char_length(p) > LONG, _parts(p)).otherwise(F.array(p))))


def _check(body: Column) -> Column:
    return F.xxhash64(body).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the text's paragraphs: a hash, and ``CHECK_BITS`` that follow from it."""
    key = lambda p: let(F.shiftrightunsigned(F.xxhash64(p), CHECK_BITS), lambda body: F.shiftleft(body, CHECK_BITS).bitwiseOR(_check(body)))
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), key)))


CELL = "struct<n:int,key:bigint>"


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _places(key: Column, part: Column, salt: Column) -> Column:
    """One cell in each third of a table, as bits of a number."""

    def bits(g: Column) -> Column:
        a, b, c = (_shift_left(F.lit(1).cast("long"), F.pmod(F.shiftright(g, 20 * t), part).cast("int") + part * t) for t in range(3))
        return a.bitwiseOR(b).bitwiseOR(c)

    return let(F.xxhash64(key, salt), bits)


def _entries(keys: Column, part: Column, salt: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("key"), _places(k, part, salt).alias("places")))


def _cell(n: Column, key: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"))


def _add(x: Column, y: Column, sign: int = 1) -> Column:
    return _cell(x["n"] + y["n"] * sign, x["key"].bitwiseXOR(y["key"]))


def _in(e: Column, cell: Column) -> Column:
    return F.getbit(e["places"], cell) == F.lit(1).cast("byte")


def _cells(entries: Column, part: Column) -> Column:
    zero = _cell(F.lit(0), F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), part * 3 - 1), lambda j: F.aggregate(entries, zero, lambda s, e: F.when(_in(e, j), _add(s, e)).otherwise(s)))


def _is_empty(c: Column) -> Column:
    return (c["n"] == 0) & (c["key"] == 0)


def peel(cells: Column, part: Column, salt: Column) -> Column:
    """The digests ``(n, key)`` that a table or a difference holds; null if cells stay that can't be peeled.

    Every digest that is taken out leaves a cell empty for good, so there are no more rounds than cells.
    """

    def is_pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["key"].bitwiseAND(F.lit((1 << CHECK_BITS) - 1)) == _check(F.shiftrightunsigned(c["key"], CHECK_BITS)))

    def round_(s: Column, _: Column) -> Column:
        def remove(found: Column) -> Column:
            left = F.transform(s["cells"], lambda c, j: F.aggregate(found, c, lambda x, e: F.when(_in(e, j), _add(x, e, -1)).otherwise(x)))
            return F.struct(left.alias("cells"), F.concat(s["found"], F.transform(found, lambda e: _cell(e["n"], e["key"]))).alias("found"), (F.size(found) == 0).alias("done"))

        pure = F.array_distinct(F.filter(s["cells"], is_pure))
        placed = F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"), _places(c["key"], part, salt).alias("places")))
        return F.when(s["done"], s).otherwise(let(placed, remove))

    start = F.struct(cells.alias("cells"), F.expr(f"cast(array() as array<{CELL}>)").alias("found"), F.lit(False).alias("done"))
    end = lambda s: F.when(F.forall(s["cells"], _is_empty), s["found"])
    return F.aggregate(F.sequence(F.lit(1), part * 3), start, round_, end)


def _peels(entries: Column) -> Column:
    """Whether a table of these entries peels: decided by their places alone.

    ``once`` and ``more`` gather the cells that some entry and that several are in; entries with a cell of their
    own leave, and so on. Every step but the last takes one out at least."""

    def left(own: Column) -> Column:
        zero = F.lit(0).cast("long")
        seen = F.aggregate(own, F.struct(zero.alias("once"), zero.alias("more")), lambda s, e: F.struct(
            s["once"].bitwiseOR(e["places"]).alias("once"), s["more"].bitwiseOR(s["once"].bitwiseAND(e["places"])).alias("more")))
        return let(seen, lambda s: F.filter(own, lambda e: e["places"].bitwiseAND(F.bitwise_not(s["more"])) == 0))

    rest = F.aggregate(_times(F.size(entries)), F.struct(entries.alias("own"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(
        let(left(s["own"]), lambda x: F.struct(x.alias("own"), ((F.size(x) == 0) | (F.size(x) == F.size(s["own"]))).alias("done")))))
    return (F.size(entries) <= 1) | (F.size(rest["own"]) == 0)


def _bits(n: Column) -> Column:
    """The power of two of tables for ``n`` digests."""
    return F.ceil(F.log2(F.greatest(F.lit(1.0), n / SHARE))).cast("int")


def sketch(keys: Column) -> Column:
    """The fingerprint: an array of ``(cells, part, salt, larger)``, one for each value of the digests' low bits.

    ``larger`` is the table of ``part`` and ``salt`` that peels where ``cells`` doesn't; else it is empty.
    Digests are dealt in two steps, so that the work doesn't grow with the square of a text's length.
    """
    none = F.expr(f"cast(array() as array<{CELL}>)")
    base = (F.lit(PART), F.lit(0))

    def larger(own: Column) -> Column:
        tries = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("salt")) for p, s in LARGER))

        def next_(s: Column, t: Column) -> Column:
            made = let(_entries(F.transform(own, lambda e: e["key"]), t["part"], t["salt"]), lambda e: F.struct(
                t["part"].alias("part"), t["salt"].alias("salt"), F.when(_peels(e), _cells(e, t["part"])).otherwise(none).alias("larger"), _peels(e).alias("done")))
            return F.when(s["done"], s).otherwise(made)

        return F.aggregate(tries, F.struct(F.lit(0).alias("part"), F.lit(0).alias("salt"), none.alias("larger"), F.lit(False).alias("done")), next_)

    def table_of(own: Column) -> Column:
        plain = lambda c: F.struct(c.alias("cells"), F.lit(PART).alias("part"), F.lit(0).alias("salt"), none.alias("larger"))
        grown = lambda c: let(larger(own), lambda x: F.struct(c.alias("cells"), x["part"].alias("part"), x["salt"].alias("salt"), x["larger"].alias("larger")))
        return let(_cells(own, F.lit(PART)), lambda c: F.when(_peels(own), plain(c)).otherwise(grown(c)))

    def dealt(entries: Column, bits: Column) -> Column:
        low = F.floor(bits / 2).cast("int")
        number = lambda e: F.shiftright(e["key"], CHECK_BITS).bitwiseAND(_shift_left(F.lit(1).cast("long"), bits) - 1)
        upto = lambda b: F.sequence(F.lit(0), _shift_left(F.lit(1), b) - 1)
        tagged = F.transform(entries, lambda e: e.withField("i", number(e)))
        high_of = lambda e: F.call_function("shiftright", e["i"], low)
        low_of = lambda e: e["i"].bitwiseAND(_shift_left(F.lit(1).cast("long"), low) - 1)
        groups = lambda all_: F.transform(upto(bits - low), lambda h: let(F.filter(all_, lambda e: high_of(e) == h), lambda own: F.transform(upto(low), lambda k: F.filter(own, lambda e: low_of(e) == k))))
        return F.flatten(let(tagged, groups))

    lists = let(_entries(keys, *base), lambda entries: F.when(F.size(keys) <= SHARE, F.array(F.transform(entries, lambda e: e.withField("i", F.lit(0).cast("long"))))).otherwise(dealt(entries, _bits(F.size(keys)))))
    return F.transform(lists, table_of)


def _fold(tables: Column) -> Column:
    """The tables for one low bit less."""
    half = (F.size(tables) / 2).cast("int")
    return F.zip_with(F.slice(tables, F.lit(1), half), F.slice(tables, half + 1, half), lambda x, y: F.zip_with(x, y, lambda c, d: _add(c, d)))


def _times(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(1), F.lit(40)), F.lit(1), F.least(n, F.lit(40)))


def _inverted(sketch_: Column, i: Column, width: Column) -> Column:
    """All digests of a fingerprint whose low bits, ``width`` values of them, are ``i``."""
    tables = F.transform(F.sequence(i, F.size(sketch_) - 1, width), lambda k: F.get(sketch_, k))

    def keys(t: Column) -> Column:
        # a fingerprint's own counts are true: cells that hold one digest show it, and mostly that is all of them
        def of(cells: Column) -> Column:
            alone = F.array_distinct(F.transform(F.filter(cells, lambda c: c["n"] == 1), lambda c: c["key"]))
            all_ = F.aggregate(cells, F.lit(0), lambda x, c: x + c["n"])
            return let(alone, lambda a: F.when(F.size(a) * 3 == all_, a).otherwise(F.transform(peel(cells, t["part"], t["salt"]), lambda e: e["key"])))

        return let(F.when(F.size(t["larger"]) > 0, t["larger"]).otherwise(t["cells"]), of)

    return F.flatten(F.transform(tables, keys))


def difference(a: Column, b: Column) -> Column:
    """How many digests are in one of two fingerprints only."""
    width = F.least(F.size(a), F.size(b))
    brought = lambda x: F.aggregate(_times((F.log2(F.size(x)) - F.log2(width)).cast("int")), F.transform(x, lambda t: t["cells"]), lambda s, _: _fold(s))
    less = F.zip_with(brought(a), brought(b), lambda x, y: F.zip_with(x, y, lambda c, d: _add(c, d, -1)))
    levels = F.aggregate(_times(F.log2(width).cast("int")), F.array(less), lambda s, _: F.concat(F.array(_fold(F.get(s, F.lit(0)))), s))

    def step(s: Column, level: Column) -> Column:
        w = F.size(level)
        halves = lambda i: F.array(i, i + (w / 2).cast("int"))
        pending = F.when(w == 1, s["failed"]).otherwise(F.flatten(F.transform(s["failed"], halves)))
        # with few cells empty a table holds too much to be peeled: that isn't tried
        tried = F.transform(pending, lambda i: F.struct(i.alias("i"), let(F.get(level, i), lambda t: F.when(F.size(F.filter(t, _is_empty)) >= LEAST_EMPTY, F.size(peel(t, F.lit(PART), F.lit(0))))).alias("n")))
        failed = lambda t: F.transform(F.filter(t, lambda x: x["n"].isNull()), lambda x: x["i"])
        return let(tried, lambda t: F.struct(failed(t).alias("failed"), F.aggregate(t, s["found"], lambda n, x: n + F.coalesce(x["n"], F.lit(0))).alias("found")))

    def rest(s: Column) -> Column:
        both = lambda i: let(F.struct(_inverted(a, i, width).alias("a"), _inverted(b, i, width).alias("b")), lambda y: F.size(F.array_except(y["a"], y["b"])) + F.size(F.array_except(y["b"], y["a"])))
        return F.aggregate(s["failed"], s["found"], lambda n, i: n + both(i))

    return F.aggregate(levels, F.struct(F.array(F.lit(0)).alias("failed"), F.lit(0).alias("found")), step, rest)


def count(sketch_: Column) -> Column:
    """How many digests a fingerprint holds: each is in three cells."""
    return F.aggregate(sketch_, F.lit(0), lambda s, t: s + F.aggregate(t["cells"], F.lit(0), lambda x, c: x + c["n"])) / 3


def likeness(a: Column, b: Column) -> Column:
    """Shared digests by all digests of two fingerprints, from the size of their difference."""
    n = count(a) + count(b)
    return let(difference(a, b), lambda d: (n - d) / (n + d))


def shown(sketch_: Column) -> Column:
    """A fingerprint as a string; ``parse`` takes it back. Empty cells are empty between their dashes."""
    cells = lambda x: F.array_join(F.transform(x, lambda c: F.when((c["n"] == 0) & (c["key"] == 0), "").otherwise(F.concat_ws(".", c["n"].cast("string"), F.hex(c["key"])))), "-")
    table_ = lambda t: F.when(F.size(t["larger"]) == 0, cells(t["cells"])).otherwise(F.concat_ws("/", cells(t["cells"]), t["part"], t["salt"], cells(t["larger"])))
    return F.array_join(F.transform(sketch_, table_), ";")


def parse(fingerprint: Column) -> Column:
    """The fingerprint that ``shown`` has written."""
    cell = lambda c: let(F.split(c, "[.]", -1), lambda x: F.when(c == "", _cell(F.lit(0), F.lit(0).cast("long"))).otherwise(_cell(F.get(x, F.lit(0)).try_cast("int"), F.conv(F.get(x, F.lit(1)), 16, -10).try_cast("long"))))
    cells = lambda text: F.transform(F.split(text, "-", -1), cell)
    none = F.expr(f"cast(array() as array<{CELL}>)")

    def table_(text: Column) -> Column:
        return let(F.split(text, "/", -1), lambda x: F.struct(
            cells(F.get(x, F.lit(0))).alias("cells"), F.coalesce(F.get(x, F.lit(1)).cast("int"), F.lit(PART)).alias("part"), F.coalesce(F.get(x, F.lit(2)).cast("int"), F.lit(0)).alias("salt"),
            F.when(F.size(x) == 1, none).otherwise(cells(F.get(x, F.lit(3)))).alias("larger"),
        ))

    return F.transform(F.split(fingerprint, ";", -1), table_)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``own``, their fingerprint, and ``next_text`` and ``after``, text and fingerprint of the
    next document in descending ``doc_id``.

    Documents are dealt by ranges of ``doc_id`` between quantiles, so a window sees one range at a time.
    The last of a range takes the first text of the next range that has any: a row for each range.
    """
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    cuts = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # the range's number: how many quantiles lie below, found by halving
    def rank(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("at") <= F.lit(cuts[mid]), rank(lo, mid)).otherwise(rank(mid + 1, hi))

    rows = ranged = rows.withColumn("part", rank(0, len(cuts)) if len(cuts) <= 256 else F.expr(f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < at))"))
    # fingerprints are made behind the shuffle and before the window: once for each text
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").withColumn("own", sketch_of(F.col("text")))
    order = [F.desc("at"), F.desc(F.xxhash64("text"))]
    within = Window.partitionBy("part").orderBy(*order)
    linked = rows.withColumns({"next_text": F.lead("text").over(within), "after": F.lead("own").over(within)})
    firsts = ranged.groupBy("part").agg(F.max_by("text", F.struct("at", F.xxhash64("text"))).alias("first_text"))
    by = Window.orderBy(F.desc("part"))
    wrap = firsts.select("part", F.lead("first_text").over(by).alias("below"), F.first("first_text").over(by).alias("whole_first"))
    edges = wrap.select("part", F.coalesce("below", "whole_first").alias("edge_text")).withColumn("edge", sketch_of(F.col("edge_text")))
    return linked.join(edges, "part", "left").select("doc_id", "text", "own", F.coalesce("next_text", "edge_text").alias("next_text"), F.coalesce("after", "edge").alias("after"))


def edited_text(text: Column, following: Column) -> Column:
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(pairs: DataFrame) -> DataFrame:
    """From the rows of ``with_next``: fingerprints of each text, its edit and the next, and the likenesses to both."""
    pairs = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    pairs = pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "own", sketch_of(F.col("edited")).alias("edit"), "after",
    )
    return pairs.withColumns({"near_edited": likeness(F.col("own"), F.col("edit")), "near_next": likeness(F.col("own"), F.col("after"))})


def sketch_of(text: Column) -> Column:
    return let(digests(text), sketch)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(with_next(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        shown(F.col("own")).alias("fingerprint"), shown(F.col("edit")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
