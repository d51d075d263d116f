"""Importance resampling towards a target distribution, over hashed word n-grams.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lowering A-Z; features are all runs of one and two
successive words of a text, joined by one space; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``BUCKETS``. A bucket's gain is the smoothed log ratio of its share among the target's features to its share
among the corpus's. A document weighs the mean gain of its features; Gumbel noise from a hash of its id makes
the highest scores a sample without replacement in which a document's chance follows its weight.

CRCs of all features of a piece of text are computed at once. A CRC is linear in its bytes but for a constant
of the length, so each byte adds what a table says for its value and its distance from the feature's end, and
``bitwise_xor.reduceat`` folds these over the spans. Spans longer than the table are cut into blocks counted
from their end, and neighbouring blocks are folded pairwise: the left one moves on by the right one's length,
which is another linear map.

Bucket counts cover every text of both sides; what the driver holds is two numbers a bucket. Texts are never
shuffled; the order of scores comes from one range sort of five numbers a document. Memory is some 60 bytes a
byte of a piece of ``PIECE`` bytes, and 6 bytes a byte of a single longer text.

Cases: a null or empty text has no features, weight 0, and is never drawn; a null ``doc_id`` is hashed as the
empty string and sorts first; rows that repeat are drawn each; of equal scores the smaller ``doc_id`` comes
first, then the smaller weight and number of features; an empty target gives every document the gains of
``t = 0``; an empty table gives no rows; further columns are ignored by ``weigh`` and ``draw``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIECE = 1 << 20  # bytes of text whose features are hashed at once

_U = np.uint32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.zeros(256, dtype=bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---- CRC-32 of many spans ------------------------------------------------------------------------

DISTANCES = 64


def _first_table() -> np.ndarray:
    """What one byte leaves in the register (the reflected polynomial of CRC-32)."""
    left = np.arange(256, dtype=_U)
    for _ in range(8):
        left = np.where(left & 1, (left >> 1) ^ _U(0xEDB88320), left >> 1)
    return left


_BYTE = _first_table()


def _after_zero(register: np.ndarray) -> np.ndarray:
    """The register after one more byte of zero."""
    return (register >> 8) ^ _BYTE[register & _U(255)]


def _position_table() -> np.ndarray:
    """Row d: what each byte value adds when d bytes follow it."""
    rows = [_BYTE]
    for _ in range(DISTANCES - 1):
        rows.append(_after_zero(rows[-1]))
    return np.concatenate(rows)


_AT = _position_table()


def _move(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The register after as many zero bytes as ``tables`` stand for, byte by byte of the register."""
    moved = tables[0][register & _U(255)]
    for k in range(1, 4):
        moved = moved ^ tables[k][(register >> _U(8 * k)) & _U(255)]
    return moved


def _moves(levels: int) -> list[np.ndarray]:
    """Tables of a move by ``DISTANCES * 2**level`` zero bytes."""
    one = np.stack([np.arange(256, dtype=_U) << _U(8 * k) for k in range(4)])
    for _ in range(DISTANCES):
        one = _after_zero(one)
    found = [one]
    while len(found) < levels:
        found.append(_move(found[-1], found[-1]))
    return found


_MOVES = _moves(24)  # spans of up to a gigabyte


def _constants(lengths: np.ndarray) -> np.ndarray:
    """What the length alone adds: the initial register moved on by so many zeros, inverted at the end."""
    longest = int(lengths.max()) if len(lengths) else 0
    short = np.empty(DISTANCES, dtype=_U)
    register = _U(0xFFFFFFFF)
    for k in range(DISTANCES):
        short[k] = register
        register = _after_zero(register)
    found = short[lengths % DISTANCES]
    level = 0
    while longest >= DISTANCES << level:
        far = (lengths // DISTANCES >> level & 1).astype(bool)
        found[far] = _move(_MOVES[level], found[far])
        level += 1
    return ~found


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``: spans in order, none empty, none overlapping another."""
    lengths = end - start
    if not len(lengths):
        return np.zeros(0, dtype=_U)
    blocks = -(-lengths // DISTANCES)
    long = blocks > 1
    if long.any():
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        behind = np.repeat(blocks, blocks) - 1 - (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
        stop = np.repeat(end, blocks) - DISTANCES * behind
        begin = np.maximum(stop - DISTANCES, np.repeat(start, blocks))
    else:
        begin, stop = start, end
    # bytes between spans take part as well, in sums of their own that are left out
    whole = data[begin[0] : stop[-1]]
    away = np.repeat(stop - 1 - begin[0], np.append(begin[1:], stop[-1]) - begin) - np.arange(len(whole))
    added = np.append(_AT[np.maximum(away, 0) * 256 + whole], _U(0))
    edges = np.empty(2 * len(begin), dtype=np.int64)
    edges[::2], edges[1::2] = begin - begin[0], stop - begin[0]
    folded = np.bitwise_xor.reduceat(added, edges)[::2]
    if not long.any():
        return folded ^ _constants(lengths)
    found = np.empty(len(lengths), dtype=_U)
    found[~long] = folded[first[~long]]
    which = np.flatnonzero(long)
    values = folded[np.repeat(long, blocks)]
    blocks = blocks[which]
    level = 0
    while len(which):
        # pairs from the end of each span; an odd first block stays alone
        at = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        half = (blocks + 1) // 2
        new = np.concatenate([[0], np.cumsum(half)[:-1]])
        place = np.arange(int(half.sum())) - np.repeat(new, half)
        right = np.repeat(at + blocks - 1, half) - 2 * (np.repeat(half, half) - 1 - place)
        paired = right > np.repeat(at, half)
        values, before = values[right], values[right[paired] - 1]
        values[paired] ^= _move(_MOVES[level], before)
        level += 1
        done = half == 1
        found[which[done]] = values[new[done]]
        values, which, blocks = values[np.repeat(~done, half)], which[~done], half[~done]
    return found ^ _constants(lengths)


# ---- features of texts ---------------------------------------------------------------------------


class Features(NamedTuple):
    """Features of some words of the rows from ``lo`` to ``hi``: each one's row (less ``lo``) and bucket; words by row."""

    lo: int
    hi: int
    row: np.ndarray
    bucket: np.ndarray
    words: np.ndarray


def features(texts: pa.Array, piece: int = PIECE) -> Iterator[Features]:
    """All features of a string column, in pieces: several rows, or part of a longer one."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, "right")) - 1)
        yield from _piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], piece)
        lo = hi


def _piece(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, piece: int) -> Iterator[Features]:
    ink = _INK[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:-1]
    ends[:-1] &= ~ink[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    size = np.cumsum(end - start + 1)
    done = 0
    while done < len(start):
        # a later part of the rows begins with the last word of the one before it, for the pair across
        first = max(done - 1, 0)
        stop = max(done + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + piece, "right")))
        s, e, r = start[first:stop], end[first:stop], row[first:stop]
        lengths = e - s
        at = np.cumsum(lengths + 1) - (lengths + 1)
        words = np.full(int((lengths + 1).sum()), 32, dtype=np.uint8)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words[np.repeat(at, lengths) + inside] = _LOWER[data[np.repeat(s, lengths) + inside]]
        fresh = done - first
        rows, crcs = [r[fresh:]], [crc32_spans(words, at, at + lengths)[fresh:]]
        for odd in (0, 1):
            k = np.arange(odd, len(s) - 1, 2)
            same = r[k] == r[k + 1]
            rows.append(r[k][same])
            crcs.append(crc32_spans(words, at[k], at[k + 1] + lengths[k + 1])[same])
        yield Features(lo, hi, np.concatenate(rows), np.concatenate(crcs) % _U(BUCKETS), np.bincount(r[fresh:], minlength=hi - lo))
        done = stop


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``text``: tasks add up their own, one number a bucket is gathered."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in features(batch.column("text")):
                total += np.bincount(part.bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums:
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, for each bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.asarray([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            n_words, n_features, sums = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for part in features(batch.column("text")):
                n_words[part.lo : part.hi] += part.words
                n_features[part.lo : part.hi] += np.bincount(part.row, minlength=part.hi - part.lo)
                # sums of whole numbers, exact in doubles up to 2^53
                sums[part.lo : part.hi] += np.bincount(part.row, weights=gain[part.bucket], minlength=part.hi - part.lo).astype(np.int64)
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise in thousandths, from the hash of ``seed`` and ``doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (null: not drawn) to ``scored``, a stored table: ``percent`` of the rows of ``least_words`` or more.

    Rows are sorted by range; a row's place is its place in its range behind the sizes of the ranges before.
    Ranges and their sizes both grow with the square root of the rows, and a row a range is broadcast.
    """
    long_enough = F.col("n_words") >= least_words
    rows, eligible = scored.count(), scored.where(long_enough).count()
    order = [F.when(long_enough, 0).otherwise(1), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words")]
    ranged = scored.repartitionByRange(max(1, math.isqrt(rows) // 32), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = materialize(ranged.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "scores")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_place") + 1
    drawn = placed.join(F.broadcast(bases), "_part")
    return drawn.select(*scored.columns, F.when(rank <= percent * eligible // 100, rank).alias("rank"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gain = gains(counts(docs), counts(table(spark, sf_dir, "benchmark")))
    scored = materialize(with_score(weigh(docs, gain)), "weights")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """
WITH bytes AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS left_by
  FROM range(256) r(b)
), both_sides AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM both_sides
), features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(hex(f)) // 2), lambda i: (instr('0123456789ABCDEF', hex(f)[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(f)[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, left_by[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), bytes
), placed AS (
  SELECT side, r, bucket FROM features JOIN hashed USING (f)
), totals AS (
  SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM placed
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g
  FROM (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket), totals
), weights AS (
  SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM ranked
"""
