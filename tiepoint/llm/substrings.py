"""Removal of repeated passages, anchored at fixed blocks.

A passage of ``window`` words that also starts in a document with a smaller ``doc_id`` is removed. Any
such passage holds one aligned block (a run of ``block`` words at a multiple of ``block``) of the earlier
document, so: every document's aligned blocks are the index, every rolling run of ``block`` words probes
it, and only windows around hits are compared in full (128 bits of hash); hits that overlap extend to the
maximal repeats, which go.

How it is spread. Documents are stored once in batches, ranges of ``doc_id`` of about ``BATCH_BYTES``; rows of
one id may take many batches, as where a third of all ids are null. A batch sends, for each bucket of the hash space, its sorted distinct block hashes (32 bits beside the
bucket's number, as wrong hits cost time only) and gets back one bit for each: whether it anchors a
repeat in another batch. Then it sends the full hashes of the windows at anchors, each with the place of its first document here, and gets
back one bit for each: whether a batch has it in an earlier document. Repeats inside a batch are found there. A
passage that very many documents hold is one entry a batch, so no key is hot. Batches and buckets follow the size of
the input; a batch sends at most one message for each of its hashes, so messages never outgrow the words.

Cases: null or empty text has no words; a null ``doc_id`` is the smallest; rows that share a ``doc_id`` are
one document (they don't remove each other's words); an empty table gives no rows; ``doc_id`` ties aside,
the result doesn't depend on order; further columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, new_path, table
from .words import CHUNK, windows, within, word_chunks

WINDOW = 13
BATCH_BYTES = 8 << 20  # of text
BUCKET_BYTES = 8 << 20  # of text for each bucket of the hash space
MAX_BUCKETS = 50_000  # files of batches; beyond, a task handles several batches, one after another
RESIDUE = 32  # bits of a block hash beside its bucket's number

SENT = "bucket long, batch long, hashes binary, aligned binary"  # windows: in place of flags, the places of their documents
NO_ID = -(1 << 63)  # stands for a null id, before all others
LEAD, BLOCKS, WINDOWS = -1, 0, 1  # stages of what a batch gets back
BITS = "batch long, stage int, bucket long, bits binary"
KEPT = "doc_id long, n_words long, n_removed long, text string"


class Batch:
    """The words of one batch in ``doc_id`` order."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").combine_chunks()
        order = pc.sort_indices(rows.select(["doc_id"]), sort_keys=[("doc_id", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        ids = rows.column("doc_id").combine_chunks()
        texts = rows.column("text").combine_chunks()
        self.ids, self.texts = ids, texts
        parts = list(word_chunks(texts, most=CHUNK))
        self.hash = np.concatenate([p.hash for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([np.diff(p.first) for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        same = np.asarray(ids.fill_null(NO_ID))
        number = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])]) if len(same) else np.zeros(0, np.int64)
        self.doc = np.repeat(number, counts).astype(np.int32)  # of each word
        self.n_docs = int(number[-1]) + 1 if len(number) else 0
        self.at = (np.arange(len(self.hash)) - np.repeat(self.first[:-1], counts)).astype(np.int32)  # in its row

    def blocks(self, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct short hashes of all rolling runs; which are aligned here, which anchor a repeat inside
        the batch; start and number among the distinct ones of each run."""
        starts = np.flatnonzero(within(self.first, block))
        keys = windows(self.hash, block)[starts] >> np.uint64(64 - bits - RESIDUE)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        number = np.empty(len(keys), dtype=np.int64)
        number[order] = group
        aligned = np.zeros(len(heads), dtype=bool)
        aligned[number[self.at[starts] % block == 0]] = True
        inside = np.zeros(len(heads), dtype=bool)
        if len(heads):
            docs = self.doc[starts][order]
            inside = aligned & (np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads))
        return ranked[heads], aligned, inside, starts, number

    def anchored(self, window: int, block: int, starts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that hold an anchor: their starts and both halves of their hash, sorted by hash."""
        hit = np.zeros(len(self.hash) + 1, dtype=np.int32)
        hit[starts[anchors] + 1] = 1
        count = np.cumsum(hit)  # anchors that start before a word
        n = len(self.hash) - window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none.astype(np.uint64)
        span = window - block + 1
        s = np.flatnonzero(within(self.first, window) & (count[span : span + n] > count[:n]))
        a, b = windows(self.hash, window, 1)[s], windows(self.hash, window, 2)[s]
        order = np.lexsort((b, a))
        return s[order], a[order], b[order]


def _places(batch: int, own: Batch, docs: np.ndarray, lead: int) -> np.ndarray:
    """Numbers for documents of a batch that compare, between batches, as the documents do.

    Only the first and the last document of a batch can have rows elsewhere; ``lead`` is the first batch that
    has the first one, where it is the last."""
    places = 2 * batch + (docs == own.n_docs - 1)
    return np.where((docs == 0) & (lead < batch), 2 * lead + 1, places).astype(np.int64)


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _bucket_edges(keys: np.ndarray, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted ``keys`` have and where each begins (one end more)."""
    buckets = (keys >> np.uint64(shift)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return buckets[heads], np.append(heads, len(keys))


def _send_blocks(batch: int, own: Batch, block: int, bits: int) -> pa.Table:
    keys, aligned, _, _, _ = own.blocks(block, bits)
    buckets, edges = _bucket_edges(keys, RESIDUE, bits)
    short = keys.astype(np.uint32)
    return pa.table({
        "bucket": pa.array(buckets, pa.int64()),
        "batch": pa.array(np.full(len(buckets), batch), pa.int64()),
        "hashes": pa.array([short[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
        "aligned": pa.array([np.packbits(aligned[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
    })


def _answer(bucket: int, rows: pa.Table, stage: int, choose) -> pa.Table:
    """``choose(hashes, what came with each: aligned flags or places)`` gives a flag for each hash."""
    batches = rows.column("batch").to_pylist()
    dtype = np.dtype([("a", "<u8"), ("b", "<u8")]) if stage else np.dtype("<u4")
    arrays = [np.frombuffer(x.as_py(), dtype=dtype) for x in rows.column("hashes")]
    sizes = np.asarray([len(x) for x in arrays])
    if stage == WINDOWS:
        beside = [np.frombuffer(x.as_py(), "<i8") for x in rows.column("aligned")]
    else:
        beside = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(rows.column("aligned"), sizes, strict=True)]
    flags = choose(np.concatenate(arrays), np.concatenate(beside))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    kept = [k for k in range(len(batches)) if flags[edges[k] : edges[k + 1]].any()]
    return pa.table({
        "batch": pa.array([batches[k] for k in kept], pa.int64()),
        "stage": pa.array([stage] * len(kept), pa.int32()),
        "bucket": pa.array([bucket] * len(kept), pa.int64()),
        "bits": pa.array([np.packbits(flags[edges[k] : edges[k + 1]]).tobytes() for k in kept], pa.binary()),
    })


def _anchors(keys: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """Hashes that some batch has aligned and that two batches have."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    many = np.diff(np.append(heads, len(keys))) > 1  # a batch has a hash once
    some = np.logical_or.reduceat(aligned[order], heads)
    out = np.empty(len(keys), dtype=bool)
    out[order] = (many & some)[group]
    return out


def _later(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes that another batch has in an earlier document."""
    order = np.lexsort((places, keys["b"], keys["a"]))
    ranked = keys[order]
    new = _runs(ranked["a"], ranked["b"])
    earliest = places[order][np.flatnonzero(new)]
    out = np.empty(len(keys), dtype=bool)
    out[order] = places[order] > earliest[np.cumsum(new) - 1]
    return out


def _flags(bits: pa.Table, stage: int, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros(edges[-1], dtype=bool)
    place = {int(b): k for k, b in enumerate(buckets)}
    for s, bucket, x in zip(*(bits.column(c).to_pylist() for c in ("stage", "bucket", "bits")), strict=True):
        if s == stage:
            k = place[bucket]
            out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=edges[k + 1] - edges[k])
    return out


def _candidates(own: Batch, answers: pa.Table, window: int, block: int, bits: int):
    keys, _, inside, starts, number = own.blocks(block, bits)
    anchors = inside | _flags(answers, BLOCKS, *_bucket_edges(keys, RESIDUE, bits))
    return own.anchored(window, block, starts, anchors[number])


def _send_windows(batch: int, own: Batch, answers: pa.Table, window: int, block: int, bits: int) -> pa.Table:
    s, a, b = _candidates(own, answers, window, block, bits)
    heads = np.flatnonzero(_runs(a, b))
    pairs = np.empty(len(heads), dtype=[("a", "<u8"), ("b", "<u8")])
    pairs["a"], pairs["b"] = a[heads], b[heads]
    earliest = np.minimum.reduceat(own.doc[s], heads) if len(heads) else np.zeros(0, np.int32)
    lead = min((x for stage, x in zip(*(answers.column(c).to_pylist() for c in ("stage", "bucket")), strict=True) if stage == LEAD), default=batch)
    places = _places(batch, own, earliest, lead)
    buckets, edges = _bucket_edges(pairs["a"], 64 - bits, bits)
    return pa.table({
        "bucket": pa.array(buckets, pa.int64()),
        "batch": pa.array(np.full(len(buckets), batch), pa.int64()),
        "hashes": pa.array([pairs[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
        "aligned": pa.array([places[i:j].astype("<i8").tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
    })


def _cut(own: Batch, answers: pa.Table, window: int, block: int, bits: int) -> pa.Table:
    s, a, b = _candidates(own, answers, window, block, bits)
    new = _runs(a, b)
    gone = np.zeros(len(own.hash) + 1, dtype=np.int32)
    if len(s):
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        flags = _flags(answers, WINDOWS, *_bucket_edges(a[heads], 64 - bits, bits))
        earliest = np.minimum.reduceat(own.doc[s], heads)
        out = s[flags[group] | (own.doc[s] > earliest[group])]
        np.add.at(gone, out, 1)
        np.add.at(gone, out + window, -1)
    covered = np.cumsum(gone[:-1]) > 0
    rows, row = [], 0
    for part in word_chunks(own.texts, most=CHUNK):
        n = part.hi - part.lo
        keep = ~covered[own.first[row] : own.first[row + n]]
        kept_first = np.concatenate([[0], np.cumsum(keep)])[part.first]
        start, size = part.start[keep], (part.end - part.start)[keep]
        to = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(to[-1], 32, dtype=np.uint8)
        shift = np.repeat(start - to[:-1], size)
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        out[place] = part.data[place + shift]
        raw = out.tobytes()
        edge = to[kept_first]
        for k in range(n):
            text = raw[edge[k] : max(edge[k], edge[k + 1] - 1)].decode()
            rows.append((int(own.first[row + k + 1] - own.first[row + k]), int(part.first[k + 1] - part.first[k] - (kept_first[k + 1] - kept_first[k])), text))
        row += n
    return pa.table({
        "doc_id": own.ids,
        "n_words": pa.array([r[0] for r in rows], pa.int64()),
        "n_removed": pa.array([r[1] for r in rows], pa.int64()),
        "text": pa.array([r[2] for r in rows], pa.string()),
    })


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` stored in the shared folder in ``n`` buckets by ``batch``, so that grouping by it doesn't shuffle.

    Only tables of the catalog can have buckets: the name is dropped once the files are known."""
    spark = rows.sparkSession
    name = f"tiepoint_batches_{uuid.uuid4().hex}"
    try:
        rows.write.bucketBy(n, "batch").option("path", new_path(spark, "batches")).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _leads(stored: DataFrame) -> DataFrame:
    """For batches whose first document begins in an earlier batch: that batch, in the form of an answer."""
    ends = stored.groupBy("batch").agg(*(f(F.coalesce("doc_id", F.lit(NO_ID))).alias(n) for f, n in ((F.min, "one"), (F.max, "last"))))
    begins = ends.select(F.explode(F.array("one", "last")).alias("one"), F.col("batch").alias("lead")).groupBy("one").agg(F.min("lead").alias("lead"))
    led = ends.join(begins, "one").where("lead < batch")
    return led.select("batch", F.lit(LEAD).cast("int").alias("stage"), F.col("lead").alias("bucket"), F.lit(b"").alias("bits"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: ``text`` holds the kept words, joined by one space."""
    spark = docs.sparkSession
    block = (window + 1) // 2  # any window holds a whole aligned block
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    bits = max(0, int(-(-size // bucket_bytes) - 1).bit_length())
    # the second key divides the rows of one id; numbers follow the files' splits, so a task run again gives the same
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    batched = numbered.repartitionByRange(batches, F.col("doc_id").asc_nulls_first(), "_row").drop("_row").withColumn("batch", F.spark_partition_id().cast("long"))
    kept = _bucketed(batched, min(batches, MAX_BUCKETS))
    stored = kept.groupBy("batch")

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        return _send_blocks(key[0].as_py(), Batch(rows), block, bits)

    def answer_first(key: tuple, rows: pa.Table) -> pa.Table:
        return _answer(key[0].as_py(), rows, BLOCKS, _anchors)

    def second(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _send_windows(key[0].as_py(), Batch(rows), answers, window, block, bits)

    def answer_second(key: tuple, rows: pa.Table) -> pa.Table:
        return _answer(key[0].as_py(), rows, WINDOWS, _later)

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _cut(Batch(rows), answers, window, block, bits)

    sent = stored.applyInArrow(first, SENT)
    anchors = materialize(sent.groupBy("bucket").applyInArrow(answer_first, BITS).unionByName(_leads(kept)), "anchors")
    sent = stored.cogroup(anchors.groupBy("batch")).applyInArrow(second, SENT)
    repeats = materialize(sent.groupBy("bucket").applyInArrow(answer_second, BITS), "repeats")
    return stored.cogroup(anchors.unionByName(repeats).groupBy("batch")).applyInArrow(last, KEPT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
