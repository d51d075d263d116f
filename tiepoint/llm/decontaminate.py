"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact check.

Items and documents are words (ASCII letters lower-cased) in shingles of five. A document is compared with
an item over every window of as many words as the item has (the whole document if it is shorter). Windows
that share no shingle with any item have similarity 0 and aren't fingerprinted. The others get a SimHash of
``BITS`` bits, which is looked up in a multi-index over ``BITS // 32`` blocks. Of two fingerprints within
``RADIUS`` some block has at most ``FLIPS`` flips, and some byte of that block at most ``FLIPS // 4``; so the
table of each byte (every value, the items near it) gives the items that a block may be near, and the
block's own flips are counted for those alone. By the pigeonhole principle every item within ``RADIUS`` of a
window is found, and few others: a random item passes with probability 0.028. What the index gives within
the radius is compared exactly: the weighted Jaccard similarity of the shingles, a shingle's weight being how
often it occurs.

At similarity 0.75 about 17 % of the bits differ, 44 with a standard deviation of 6; the radius lies 4.6 of
those above. A longer or more similar window lies further inside.

The items are a stated query set: they are broadcast to the tasks in blocks of at most ``BLOCK_BYTES`` of
text, and all documents are scanned for each block; a worker builds a block's index itself (``BITS * 32``
bytes an item). Documents aren't shuffled.

Cases: null or empty texts on either side match nothing; items of fewer than five words match only
documents that have the same words and no others; a null ``doc_id`` or ``item_id`` is kept; rows that
repeat are reported each; of equally similar windows the first is reported; empty tables give no rows;
further columns are ignored by ``matches`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table
from .words import PIECE, mix, windows, within, word_chunks

SHINGLE = 5
SIMILARITY = 0.75
BITS, RADIUS = 256, 71
FLIPS = RADIUS // (BITS // 32)  # in a block of 32 bits
BLOCK_BYTES = 2 << 20

MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long"

_BYTES = BITS // 8
_NEAR = np.bitwise_count(np.bitwise_xor.outer(np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8))) <= FLIPS // 4


def _sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums, for each bit, of +1 where a shingle's hash has it and -1 where not; one row more than shingles."""
    wide = np.stack([mix(shingles + np.uint64(k)) for k in range(BITS // 64)], axis=1)
    signs = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])


def _print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return windows(hashes, SHINGLE if len(hashes) >= SHINGLE else max(len(hashes), 1))


class Items:
    """One block of benchmark items: shingles, fingerprints and the index."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words = [w for p in word_chunks(pa.array(texts, pa.string()), lower=True) for w in np.split(p.hash, p.first[1:-1])]
        own = [k for k, w in enumerate(words) if len(w)]
        self.ids = [ids[k] for k in own]
        self.size = np.asarray([len(words[k]) for k in own], dtype=np.int64)
        shingles = [_shingles(words[k]) for k in own]
        self.bags = [np.unique(s, return_counts=True) for s in shingles]
        prints = [_print(_sums(s)[-1]) for s in shingles]
        self.prints = np.stack(prints) if prints else np.zeros((0, _BYTES), np.uint8)
        # for each byte and value: which items have a value within the flips there
        self.index = np.stack([_NEAR[:, self.prints[:, b]] for b in range(_BYTES)])
        flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(s) for s in shingles])
        order = np.argsort(flat, kind="stable")
        self.shingle, self.item = flat[order], item[order]
        self.top = np.zeros(1 << 16, dtype=bool)
        self.top[(flat >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.top[(shingles >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingle, shingles[at]), max(len(self.shingle) - 1, 0))
        return at[self.shingle[place] == shingles[at]] if len(self.shingle) else at[:0]

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of ``prints`` and of ``items`` that some block brings together."""
        found = np.zeros((len(prints), len(items)), dtype=bool)
        for block in range(0, _BYTES, 4):
            may = functools.reduce(operator.or_, (self.index[b][prints[:, b]][:, items] for b in range(block, block + 4))) & ~found
            w, i = np.nonzero(may)
            flips = np.bitwise_count(prints[w, block : block + 4] ^ self.prints[items[i], block : block + 4]).sum(axis=1)
            found[w[flips <= FLIPS], i[flips <= FLIPS]] = True
        return np.nonzero(found)

    def match(self, words: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """``(item, similarity, start, words)`` of one document, its best window for each item."""
        shingles = _shingles(words)
        n = len(words)
        found: dict[int, tuple[float, int, int]] = {}
        items = np.unique(np.concatenate([self.item[slice(*np.searchsorted(self.shingle, [s, s + np.uint64(1)]))] for s in np.unique(shingles[hits])]))
        lo = max(0, int(hits.min()) - int(self.size[items].max()))
        hi = min(len(shingles), int(hits.max()) + int(self.size[items].max()) + 1)
        sums = _sums(shingles[lo:hi])
        for size in np.unique(self.size[items]):
            span = min(int(size), n)  # words of a window
            inner = max(1, span - SHINGLE + 1)  # its shingles
            # windows that hold a hit
            marks = np.zeros(len(shingles) - inner + 2, dtype=np.int32)
            np.add.at(marks, np.maximum(hits - inner + 1, 0), 1)
            np.add.at(marks, np.minimum(hits, len(shingles) - inner) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            prints = _print(sums[starts - lo + inner] - sums[starts - lo])
            sized = np.flatnonzero(self.size == size)
            w, i = self.near(prints, sized)
            far = np.bitwise_count(prints[w] ^ self.prints[sized[i]]).sum(axis=1)
            close = far <= RADIUS
            for w_, i_ in zip(w[close], sized[i[close]], strict=True):
                start = int(starts[w_])
                similarity = _similarity(shingles[start : start + inner], self.bags[i_])
                if similarity >= SIMILARITY and similarity > found.get(int(i_), (0.0,))[0]:
                    found[int(i_)] = (similarity, start, span)
        return [(i, *x) for i, x in sorted(found.items())]


def _similarity(window: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> float:
    keys, counts = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(bag[0], keys), len(bag[0]) - 1)
    shared = int(np.minimum(counts, bag[1][at])[bag[0][at] == keys].sum())
    return shared / (len(window) + int(bag[1].sum()) - shared)


def _scan(docs: DataFrame, ids: list[int | None], texts: list[str]) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        items = Items(*block.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for part in word_chunks(batch.column("text"), lower=True, most=PIECE):
                shingles = windows(part.hash, SHINGLE)
                at = items.hits(shingles)
                at = at[within(part.first, SHINGLE)[at]]
                row = np.searchsorted(part.first, at, "right") - 1
                for r in np.unique(row):
                    words = part.hash[part.first[r] : part.first[r + 1]]
                    for i, similarity, start, n in items.match(words, at[row == r] - part.first[r]):
                        rows.append((ids[part.lo + r], items.ids[i], similarity, start, n))
                sizes = np.diff(part.first)
                for r in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
                    words = part.hash[part.first[r] : part.first[r + 1]]
                    if len(hits := items.hits(_shingles(words))):
                        for i, similarity, start, n in items.match(words, hits):
                            rows.append((ids[part.lo + r], items.ids[i], similarity, start, n))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return docs.mapInArrow(run, MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)`` of documents that hold an item or nearly so."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        part = _scan(docs, [r["item_id"] for r in own], [r["text"] for r in own])
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that match an item, columns unchanged. Hits are few beside documents, yet not bounded."""
    hit = materialize(matches(docs, benchmark).select(F.col("doc_id").alias("_dc_doc")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_dc_doc"]), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
