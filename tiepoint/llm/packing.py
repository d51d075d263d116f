"""Best-fit packing with a swap-based local search.

Pieces of at most ``capacity`` tokens go into as few sequences as possible. Pieces are dealt by hash over
groups of bounded size; each group is packed best fit, longest first, and then improved: an underfull
sequence is emptied by moving its pieces into other gaps or by exchanging one or two of its pieces for
one or two others so that the sum of squared fills rises. What stays underfull in the groups is merged
and packed again, many groups into one, until a round has a single group or no longer shrinks. Full
pieces are sequences of their own and are never dealt.

Only ``(doc_id, piece, length)`` moves: no text or token is shuffled.

Cases: a null text is an empty one (its end id alone makes one piece); a null ``doc_id`` is kept; rows
that repeat are packed once each (``row_id`` tells them apart); an empty table gives no rows; ties in
fit go to the first sequence; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table
from .tokens import encoded

GROUP_PIECES = 8_000  # pieces packed together in one task, about
UNDERFULL = 32  # sequences that miss over a 32nd of their tokens are packed again
DONORS = 24  # of the least full sequences of a group, tried in turn when one is stuck
STEPS = 4  # steps for each sequence of a group
LISTED = 64  # pieces of a sequence whose pairs are listed and sorted at once; of longer ones each pair is searched for


# ---- tokens to pieces ---------------------------------------------------------------------------

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Cut every document's ids (``end_id`` appended) at multiples of ``capacity``."""

    def cut(batches):
        for batch in batches:
            for part, ids, offsets in encoded(batch, "text", tokenizer, end_id):
                values = memoryview(ids).cast("B")
                length = np.diff(offsets)
                pieces = -(-length // capacity)
                k = np.repeat(np.arange(len(length)), pieces)
                piece = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                size = np.minimum(length[k] - start, capacity)
                at = 4 * (offsets[:-1][k] + start)
                crc = [zlib.crc32(values[a:b]) for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_id").take(take),
                        part.column("doc_id").take(take),
                        pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, size, crc)),
                    ],
                    names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES)


# ---- one group ----------------------------------------------------------------------------------


def _best_pair(items: list[tuple[int, int]], most: int) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
    """Two of the ascending ``items`` whose lengths come closest to ``most`` from below."""
    best, i, j = None, 0, len(items) - 1
    while i < j:
        both = items[i][0] + items[j][0]
        if both > most:
            j -= 1
        else:
            if best is None or both > best[0]:
                best = (both, items[i], items[j])
            i += 1
    return best


class Bins:
    """Sequences of one group: for each, the lengths in it (of single pieces or of merged sequences)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (length, index), ascending
        self.gap: list[int] = []
        self.by_gap: list[tuple[int, int]] = []  # (gap, bin), ascending

    def _gap(self, b: int, gap: int) -> None:
        if b < len(self.gap):
            self.by_gap.pop(bisect.bisect_left(self.by_gap, (self.gap[b], b)))
            self.gap[b] = gap
        else:
            self.gap.append(gap)
        bisect.insort(self.by_gap, (gap, b))

    def put(self, b: int, item: tuple[int, int]) -> None:
        if b == len(self.items):
            self.items.append([])
            self._gap(b, self.capacity)
        bisect.insort(self.items[b], item)
        self._gap(b, self.gap[b] - item[0])

    def take(self, b: int, item: tuple[int, int]) -> None:
        self.items[b].pop(bisect.bisect_left(self.items[b], item))
        self._gap(b, self.gap[b] + item[0])

    def fit(self, length: int, skip: int = -1) -> int:
        """The fullest sequence with room for ``length``; -1 if none."""
        at = bisect.bisect_left(self.by_gap, (length, -1))
        while at < len(self.by_gap):
            if self.by_gap[at][1] != skip:
                return self.by_gap[at][1]
            at += 1
        return -1

    def best_fit(self, items: list[tuple[int, int]]) -> None:
        for item in sorted(items, key=lambda x: (-x[0], x[1])):
            b = self.fit(item[0])
            self.put(len(self.items) if b < 0 else b, item)

    # -- local search

    def _exchange(self, low: int) -> bool:
        """One step that takes tokens out of ``low`` into a fuller sequence: a move, one for one or two for one."""
        own = self.items[low]
        for item in reversed(own):
            b = self.fit(item[0], skip=low)
            if b >= 0 and item[0] - self.gap[b] > -self.gap[low]:  # the sum of squared fills rises
                self.take(low, item)
                self.put(b, item)
                return True
        pairs = [(x[0] + y[0], x, y) for i, x in enumerate(own) for y in own[i + 1 :]] if len(own) <= LISTED else []
        pairs.sort()

        def pair_within(most: int) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
            if len(own) > LISTED:
                return _best_pair(own, most)
            at = bisect.bisect_right(pairs, (most, (1 << 62,))) - 1
            return pairs[at] if at >= 0 else None

        for gap, b in reversed(self.by_gap):
            if b == low or not gap:
                continue
            best: tuple[int, list, list] | None = None
            for out in self.items[b]:
                # the longest of low's pieces (or pairs) that fits when ``out`` leaves; it must be longer than ``out``
                at = bisect.bisect_right(own, (out[0] + gap, 1 << 62)) - 1
                if at >= 0 and (won := own[at][0] - out[0]) > 0 and (best is None or won > best[0]):
                    best = (won, [own[at]], [out])
                two = pair_within(out[0] + gap)
                if two is not None and (won := two[0] - out[0]) > 0 and (best is None or won > best[0]):
                    best = (won, [*two[1:]], [out])
            if best is None:
                theirs = self.items[b]
                for i, x in enumerate(theirs):
                    for y in theirs[i + 1 :]:
                        at = bisect.bisect_right(own, (x[0] + y[0] + gap, 1 << 62)) - 1
                        if at >= 0 and (won := own[at][0] - x[0] - y[0]) > 0 and (best is None or won > best[0]):
                            best = (won, [own[at]], [x, y])
            # sum of squared fills: b gains and low loses ``won``; that rises while low isn't the fuller one
            if best is not None and (self.capacity - gap) + best[0] > (self.capacity - self.gap[low]):
                for item in best[1]:
                    self.take(low, item)
                for item in best[2]:
                    self.take(b, item)
                for item in best[1]:
                    self.put(b, item)
                for item in best[2]:
                    self.put(low, item)
                return True
        return False

    def improve(self) -> None:
        """Empty the least full sequences one after another; where one is stuck, steps between other underfull
        ones may free it. Ends at the lower bound, when no step is left, or after ``STEPS`` steps for each sequence."""
        least = -(-sum(x[0] for own in self.items for x in own) // self.capacity)
        used = sum(bool(x) for x in self.items)
        steps = STEPS * max(used, 1)
        while used > least and steps:
            lowest = sorted((b for b, own in enumerate(self.items) if own and self.gap[b]), key=lambda b: (-self.gap[b], b))[:DONORS]
            for low in lowest:
                if self._exchange(low):
                    steps -= 1
                    used -= not self.items[low]
                    break
            else:
                return
            # stay with the least full one as long as it gives pieces away
            while steps and self.items[lowest[0]] and self._exchange(lowest[0]):
                steps -= 1
                used -= not self.items[lowest[0]]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length in one group."""
    bins = Bins(capacity)
    bins.best_fit([(int(x), k) for k, x in enumerate(lengths)])
    bins.improve()
    number = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    for b, own in enumerate(bins.items):
        at = 0
        for length, k in reversed(own):
            number[k], offset[k] = b, at
            at += length
    return number, offset


# ---- many groups --------------------------------------------------------------------------------


def _packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        number, offset = pack_group(rows["length"].to_numpy(), capacity)
        fill = np.bincount(number, weights=rows["length"]).astype(np.int64)
        return pd.DataFrame({
            "unit": rows["unit"],
            "bin": (rows["grp"].to_numpy(np.int64) << 32) | number,
            "place": offset,
            "fill": fill[number],
        })

    return pack


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (unique ``unit``, ``length`` from 1 to ``capacity``).

    ``pieces`` must be a stored table. The first round packs groups dealt by hash; each further one deals the
    pieces of all sequences that stay well below full anew, a few for each group, and is kept where it needs
    fewer sequences for them.
    """
    spread = 10 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(rows: DataFrame, groups: int, salt: int, first: int) -> DataFrame:
        grp = F.pmod(F.xxhash64("unit", F.lit(salt)), F.lit(groups)).cast("long") + F.lit(first)
        # by a set number, as groups are small in bytes and long in time
        dealt = rows.select("unit", "length", grp.alias("grp")).repartition(min(groups, spread), "grp")
        return materialize(dealt.groupBy("grp").applyInPandas(_packer(capacity), "unit long, bin long, place long, fill long"), "packed")

    used = lambda rows: rows.select("bin").distinct().count()
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    placed, first, salt = packed(short, groups, 1, 0), groups, 1
    underfull = F.col("fill") < capacity - capacity // UNDERFULL
    while groups > 1:
        loose = short.join(placed.where(underfull).select("unit"), "unit", "left_semi")
        groups, salt = max(1, -(-loose.count() // group_pieces)), salt + 1
        again = packed(loose, groups, salt, first)
        first += groups
        if used(again) >= used(placed.where(underfull)):
            break
        placed = materialize(placed.where(~underfull).unionByName(again), "packed")
    # full pieces are numbered below zero, the others from zero on: no number is used twice
    whole = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    dealt = short.join(placed, "unit").select(*pieces.columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return dealt.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` whole, cut at ``capacity`` and pack: a row for each piece."""
    cut = pieces_of(docs, tokenizer, end_id, capacity).withColumn("unit", F.monotonically_increasing_id())
    packed = pack(materialize(cut, "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row_id")


def sequences(tokens: DataFrame, packed: DataFrame) -> DataFrame:
    """Join ``tokens(row_id, piece, ids)`` to their places: one row for each sequence, its ids in order."""
    parts = packed.join(tokens, ["row_id", "piece"]).groupBy("sequence_id")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, end_id=0, capacity=2048).drop("row_id")
