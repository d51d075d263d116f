"""Near-duplicate groups: MinHash bands find candidates, odd sketches filter them, full sets confirm them.

A document's set holds its distinct shingles of five words (ASCII letters lower-cased; a shorter document's
whole sequence). Documents are linked if their sets' Jaccard similarity is ``SIMILARITY`` or more.

1. One pass over the texts gives each document's set size, a 128-bit hash of its set, ``ROWS * BANDS``
   MinHash samples folded to ``BANDS`` band keys, and the odd sketch: a parity bitmap in which each sample
   flips one bit. Documents with equal sets are one class from here on, so copies make no pairs.
2. In each band bucket every class is a candidate with the bucket's smallest class: a star, not all pairs.
   The XOR population count of two odd sketches estimates their similarity closely when it is high;
   candidates well below the threshold go. Each class's best candidate is compared on the full sets.
3. Connected components of the confirmed links. The classes in buckets that still hold several components
   are indexed by their shingles, rarest first among these classes. A second star, around each bucket's
   class with the fewest shingles of its own alone, is confirmed and the components are taken again.
4. Classes of different components that may still be linked are found exactly, without their buckets: of
   two sets as similar as that, the first shared shingle in this order lies so early in both that enough
   others can follow it. Only that prefix of each set is joined, never two classes of the component that
   holds most of a shingle's list. Sketches and then full sets decide, and the components are taken a last time.

Every pair that shares a band is thus in one component, refuted by its sketches, by its prefixes (exactly)
or on its full sets.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^40 = 2.5e-7; its sketches refute it
with probability 4.7e-8 (``sketch_loss``), less above.

Cases: null or empty text, or text without words: an empty set, linked with nothing, other rows of its id
included; a null ``doc_id`` is
the smallest id, and a component that holds it has a null ``component_id``; rows that share a ``doc_id``
(null too) are one document: their texts, equal or not, are in one component, and ``keep_one`` keeps or
drops them together; an empty table gives no rows; further columns are ignored by ``components`` and kept
by ``keep_one``.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.operators.components import connected_components

from .storage import materialize, table
from .words import PIECE, mix, randoms, windows, word_chunks

SHINGLE = 5
SIMILARITY = (75, 100)
ROWS, BANDS = 4, 40
SKETCH_BITS = 512
SKETCH_LEAST = 0.5  # candidates whose sketches estimate less are dropped
GROUP = 128  # members compared with one leader in one task
BROADCAST_IDS = 500_000  # ids (8 bytes) that may be broadcast to pick texts; beyond, a shuffled join

_NULL = -(1 << 63)
_A = (randoms(ROWS * BANDS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (randoms(ROWS * BANDS, 22) >> np.uint64(32)).astype(np.uint32)
_BAND_FACTORS = randoms(ROWS * BANDS, 23).reshape(BANDS, ROWS) | np.uint64(1)
_BAND_SALT = randoms(BANDS, 24)

SKETCHES = [f"s{k}" for k in range(SKETCH_BITS // 64)]
SIGNED = "node long, doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)


def shingle_sets(texts: pa.Array, k: int = SHINGLE, lower: bool = True):
    """For pieces of a string column: first row, and the sorted distinct shingle hashes of each row."""
    for part in word_chunks(texts, lower=lower, most=PIECE):
        hashes = windows(part.hash, k)
        sets = []
        for a, b in zip(part.first[:-1], part.first[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(hashes[a : b - k + 1]))
            else:
                sets.append(windows(part.hash[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
        yield part.lo, sets


def max_flips(samples: int = ROWS * BANDS, bits: int = SKETCH_BITS, least: float = SKETCH_LEAST) -> int:
    """Population count of the XOR of two odd sketches that corresponds to similarity ``least``."""
    return math.ceil(bits / 2 * (1 - math.exp(-2 * (2 * samples * (1 - least)) / bits)))


def sketch_loss(similarity: float, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS) -> float:
    """Probability that the sketches of a pair of this similarity differ in more bits than ``max_flips``.

    Each sample that differs flips one bit for either side: a walk over the number of odd bits, one step a flip.
    """
    odd = np.zeros(bits + 2)
    odd[0] = 1.0  # by number of odd bits
    most, lost, weight = max_flips(samples, bits), 0.0, similarity**samples
    up, down = 1 - np.arange(bits + 2) / bits, np.arange(bits + 2) / bits
    for k in range(samples + 1):  # samples that differ
        lost += weight * odd[most + 1 :].sum()
        weight *= (samples - k) / (k + 1) * (1 - similarity) / similarity
        for _ in range(2):
            odd = np.append(0, (odd * up)[:-1]) + np.append((odd * down)[1:], 0)
    return float(lost)


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of some non-empty sets."""
    sizes = np.asarray([len(s) for s in sets])
    all_ = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    k1 = mix(np.add.reduceat(mix(all_ ^ np.uint64(0x5BD1E995)), heads) + sizes.astype(np.uint64))
    return k1, np.add.reduceat(mix(all_ + np.uint64(0x632BE59BD9B4E019)), heads)


def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Set hashes, band keys and odd sketches of non-empty sets."""
    k1, k2 = set_hashes(sets)
    all_ = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    short = (all_ >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((ROWS * BANDS, len(sets)), dtype=np.uint32)
    work = np.empty_like(short)
    for k in range(ROWS * BANDS):
        np.multiply(short, _A[k], out=work)
        work += _B[k]
        samples[k] = np.minimum.reduceat(work, heads)
    by_band = samples.astype(np.uint64).reshape(BANDS, ROWS, len(sets))
    bands = mix((by_band * _BAND_FACTORS[:, :, None]).sum(axis=1, dtype=np.uint64) + _BAND_SALT[:, None])
    at = mix(samples.astype(np.uint64) + (np.arange(ROWS * BANDS, dtype=np.uint64)[:, None] << np.uint64(32)))
    place = (at >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    sketch = np.zeros((len(sets), SKETCH_BITS // 64), dtype=np.uint64)
    doc = np.broadcast_to(np.arange(len(sets)), place.shape)
    np.bitwise_xor.at(sketch, (doc.ravel(), (place >> 6).ravel()), np.uint64(1) << (place & 63).astype(np.uint64).ravel())
    return k1, k2, bands.T, sketch


def _list(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``; ``node`` numbers them, so the result must be stored."""

    def run(batches):
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text")):
                sizes = np.asarray([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                k1, k2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sketch = np.zeros((len(sets), len(SKETCHES)), np.int64)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                bands = np.zeros(0, np.int64)
                if len(full):
                    a, b, band, s = sign([sets[k] for k in full])
                    k1[full], k2[full], sketch[full] = a.view(np.int64), b.view(np.int64), s.view(np.int64)
                    bands = np.ascontiguousarray(band).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(lo, len(sets)),
                        batch.column("doc_id").slice(lo, len(sets)),
                        pa.array(sizes, pa.int64()),
                        pa.array(k1),
                        pa.array(k2),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands)),
                        *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(SKETCHES))),
                    ],
                    names=["node", "doc_id", "n_shingles", "k1", "k2", "bands", *SKETCHES],
                )

    return docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", "text").mapInArrow(run, SIGNED)


def sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(class, hashes)``: the sorted shingle hashes of ``wanted(class, doc_id, k1, k2)``, a stored table.

    Texts are found by ``doc_id`` and told apart by the hash of their set. The ids are broadcast only if they are few.
    """
    ids = wanted.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text")):
                if sets := [s for s in sets if len(s)]:
                    k1, k2 = set_hashes(sets)
                    yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _list(sets)], names=["k1", "k2", "hashes"])

    hashed = texts.mapInArrow(run, "k1 long, k2 long, hashes array<long>")
    return hashed.join(wanted.select("class", "k1", "k2"), ["k1", "k2"]).select("class", "hashes").dropDuplicates(["class"])


def _flips(a: str, b: str) -> Column:
    """Population count of the XOR of the sketches of aliases ``a`` and ``b``."""
    return functools.reduce(operator.add, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCHES))


def _alike(a: str, b: str) -> Column:
    """Sizes and sketches of aliases ``a`` and ``b`` allow the similarity."""
    num, den = SIMILARITY
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (small * den >= large * num) & (_flips(a, b) <= max_flips())


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``sets(class, hashes)`` reach the similarity; both are stored tables."""
    num, den = SIMILARITY
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    salted = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / GROUP)).cast("int").alias("salt"))
    left = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("class", "a"), "a")
    right = salted.join(sets, F.col("b") == F.col("class")).select(F.col("a").alias("leader"), F.col("salt").alias("share"), "b", F.col("hashes").alias("other"))

    def compare(leader: pa.Table, members: pa.Table) -> pa.Table:
        linked = []
        if leader.num_rows and members.num_rows:
            own = leader.column("hashes").combine_chunks().values.to_numpy().view(np.uint64)
            lists = members.column("other").combine_chunks()
            values, edges = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                other = values[i:j]
                small, large = (own, other) if len(own) < len(other) else (other, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if den * shared >= num * (len(own) + len(other) - shared):
                    linked.append(k)
        chosen = members.take(pa.array(linked, pa.int64()))
        return pa.table({"a": chosen.column("leader"), "b": chosen.column("b")})

    return left.groupBy("a", "salt").cogroup(right.groupBy("leader", "share")).applyInArrow(compare, "a long, b long")


def prefixes(sets: DataFrame) -> DataFrame:
    """``(class, n, lone, common)``: set size, shingles that no other class of ``sets(class, hashes)`` has, and
    the shared ones that may come first in a linked pair, in the order rarest first that all classes follow."""
    num, den = SIMILARITY
    rows = sets.select("class", F.explode("hashes").alias("hash"))
    held = rows.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1")
    common = rows.join(held, "hash").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("held", "hash"))).alias("common"))
    sized = sets.select("class", F.size("hashes").alias("n")).join(common, "class", "left").withColumn("lone", F.col("n") - F.coalesce(F.size("common"), F.lit(0)))
    most = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")  # of a linked pair's first shared shingle, either way round
    cut = F.slice(F.coalesce("common", F.expr("cast(array() as array<struct<held:bigint,hash:bigint>>)")), F.lit(1), F.greatest(F.lit(0), most - F.col("lone")).cast("int"))
    return sized.select("class", "n", "lone", F.transform(cut, lambda x: x["hash"]).alias("common"))


def prefix_pairs(rest: DataFrame) -> DataFrame:
    """``(a, b)`` of different ``part`` that may be linked, by ``rest(class, part, n, lone, common)``; a stored table."""
    num, den = SIMILARITY
    lists = rest.select("class", "part", "n", "lone", F.posexplode("common").alias("k", "hash")).select("hash", "class", "part", "n", (F.col("lone") + F.col("k")).alias("at"))
    shares = lists.groupBy("hash", "part").agg(F.count("*").alias("held"))
    # stored, so that the join below has no aggregate on its keys and a hot shingle's list can be split
    several = shares.groupBy("hash").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    several = materialize(several.select("hash", "main"), "several")
    lists = materialize(lists.join(several, "hash").withColumn("minor", F.col("part") != F.col("main")).drop("main"), "lists")
    # what can still be shared from a shingle on must be enough: (den + num) * left >= num * (both sizes)
    enough = lambda x, y: (F.col(f"{x}.n") - F.col(f"{x}.at")) * (den + num) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * num
    first = lists.where((F.col("n") - F.col("at")) * (den + num) >= F.col("n") * (2 * num)).alias("x")  # of the smaller set
    y = lists.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class")))
    met = first.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.minor") | F.col("y.minor")) & ordered & enough("x", "y") & enough("y", "x"))
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """``(band, class, part)`` of the buckets that hold several components."""
    named = shared.join(found, F.col("class") == F.col("node"), "left").select("band", "class", F.coalesce("component", "class").alias("part"))
    several = named.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("band")
    return named.join(several, "band", "left_semi")


def same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of rows that share a ``doc_id`` and differ."""
    repeated = signed.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x < y").select("doc_id")
    own = signed.select("doc_id", "k1", "k2").join(repeated, "doc_id", "left_semi").distinct().join(classes, ["k1", "k2"]).select("doc_id", "class")
    return own.join(own.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("a < class").select("a", F.col("class").alias("b"))


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``."""
    keep = lambda df: materialize(df, "near")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text")
    signed = materialize(signatures(docs), "signatures")
    full = signed.where("n_shingles > 0")
    # a class is named by its first row's node, which stands for it
    classes = keep(full.groupBy("k1", "k2").agg(F.min("node").alias("class"), F.min("doc_id").alias("first_id")))
    rows = keep(full.join(classes.select("class"), F.col("node") == F.col("class"), "left_semi").withColumnRenamed("node", "class"))
    named = rows.select("class", "doc_id", "k1", "k2")
    sketches = rows.select("class", "n_shingles", *SKETCHES)
    banded = rows.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("class").alias("leader"), F.max("class").alias("last")).where("leader < last")
    shared = keep(banded.join(shared.select("band", "leader"), "band").select("band", "leader", "class"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted = keep(named.join(ends, "class", "left_semi"))
        return confirm(pairs, keep(sets_of(wanted, docs)))

    stars = shared.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    near = stars.join(sketches.alias("x"), F.col("a") == F.col("x.class")).join(sketches.alias("y"), F.col("b") == F.col("y.class"))
    best = near.where(_alike("x", "y")).groupBy("b").agg(F.min(F.struct(_flips("x", "y").alias("flips"), "a")).alias("best"))
    tested = keep(best.select("best.a", "b"))
    links = keep(confirmed(tested).unionByName(same_id(signed.where("n_shingles > 0"), classes)))
    found = keep(connected_components(links, keep, "a", "b"))

    mixed = keep(_mixed(shared, found))
    wanted = keep(named.join(mixed.select("class").distinct(), "class", "left_semi"))
    sets = keep(sets_of(wanted, docs))
    ranked = keep(prefixes(sets))
    # a second star, around each bucket's most typical class
    rest = keep(mixed.join(ranked.select("class", "lone"), "class").join(sketches, "class"))
    heads = rest.groupBy("band").agg(F.min_by(F.struct("class", "part", "n_shingles", *SKETCHES), F.struct("lone", "class")).alias("x"))
    spokes = rest.alias("y").join(heads, "band").where((F.col("x.part") != F.col("y.part")) & _alike("x", "y"))
    best = spokes.groupBy(F.col("y.class").alias("b")).agg(F.min(F.struct(_flips("x", "y").alias("flips"), F.col("x.class").alias("a"))).alias("best"))
    tested_too = keep(best.select("best.a", "b").join(tested, ["a", "b"], "left_anti"))
    links = keep(links.unionByName(confirm(tested_too, sets)))
    found = keep(connected_components(links, keep, "a", "b"))
    # what still may be linked across components
    parts = _mixed(shared.join(wanted.select("class"), "class", "left_semi"), found).select("class", "part").distinct()
    cross = prefix_pairs(keep(ranked.join(parts, "class")))
    done = tested.unionByName(tested_too).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cross.join(done, ["a", "b"], "left_anti").join(sketches.alias("x"), F.col("a") == F.col("x.class")).join(sketches.alias("y"), F.col("b") == F.col("y.class"))
    late = keep(confirm(keep(cross.where(_alike("x", "y")).select("a", "b")), sets))
    if late.limit(1).count():
        found = keep(connected_components(links.unionByName(late), keep, "a", "b"))

    own = found.join(classes.select("class", "first_id"), F.col("node") == F.col("class")).select("class", "component", "first_id")
    least = own.groupBy("component").agg(F.min("first_id").alias("component_id"))
    grouped = keep(own.join(least, "component").select("class", "component_id"))
    of_class = classes.join(grouped, "class", "left").select("k1", "k2", F.coalesce("component_id", "first_id").alias("component"))
    done = full.join(of_class, ["k1", "k2"]).select("doc_id", "n_shingles", "component")
    done = done.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    null = lambda c: F.nullif(F.col(c), F.lit(_NULL))
    return done.select(null("doc_id").alias("doc_id"), "n_shingles", null("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest document of each component, columns unchanged."""
    gone = components(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_nd_doc")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_nd_doc"]), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))
