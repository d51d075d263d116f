"""Line de-duplication with DataFrame functions only.

Line hashes are range partitioned by hash, document and position. The ranges follow the document too, so a hash
that very many documents hold is spread over as many ranges as its lines fill. Each range is stored as a bucket of
its own (few share one), so that it is read back without another shuffle, and sorted once, by hash, document and
position. A stream over the sorted lines yields the first document of every hash; a hash that reached a range from
earlier ones takes its first document from there, as each range hands on the one hash that it ends with.
What later documents repeat becomes a keep bitmap for each document: 64 lines a word, words in which every
line stays left out. Texts aren't shuffled for that; they meet their bitmaps once, at the end.

Cases: null or empty text is one empty line; a line whose key is shorter than ``min_chars`` always stays;
a null ``doc_id`` counts as smaller than all others; rows that share a ``doc_id`` are one document for the
choice of the first, and each keeps its own lines (equal texts get equal bitmaps); an empty table gives no
rows; further columns of ``docs`` are kept by ``apply_bitmaps``, those with this module's own names
(prefix ``_ld_``) excepted.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import in_buckets, materialize, table

SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
MIN_CHARS = 10
LINES = 1_000_000  # of a range at most, about
MAX_BUCKETS = 50_000  # beyond, several ranges share one


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``_ld_doc`` orders documents (null first), ``_ld_row`` tells rows with one ``doc_id`` apart."""
    return docs.withColumns({
        "_ld_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
        "_ld_row": F.xxhash64("text"),
    })


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row ``(_ld_doc, _ld_row, pos, h1, h2)`` for each line with a long enough key; 128 bits of hash."""
    lines = with_row_key(docs).select("_ld_doc", "_ld_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("_ld_doc", "_ld_row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("_ld_doc", "_ld_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def first_documents(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """``lines(_ld_doc, _ld_row, pos, h1, h2)``, a stored table, with ``first_doc``, the smallest document that holds the hash."""
    n = ranges or max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    order = ["h1", "h2", "_ld_doc", "pos"]
    ranged = lines.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    ranged = in_buckets(ranged, min(n, MAX_BUCKETS), "range", "line-ranges")
    # a row for each range: the hash it ends with and the first document that it has for it
    last = ranged.groupBy("range").agg(F.max(F.struct("h1", "h2")).alias("h"), F.min(F.struct("h1", "h2")).alias("g"))
    ends = ranged.join(F.broadcast(last.select("range", "h.h1", "h.h2")), ["range", "h1", "h2"]).groupBy("range", "h1", "h2").agg(F.min("_ld_doc").alias("end_doc"))
    before = Window.partitionBy("h1", "h2").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = last.select("range", "h.h1", "h.h2").join(ends, ["range", "h1", "h2"])
    # a hash begins before a range if an earlier one ends with it; at most one hash of a range does
    heads = last.select("range", "g.h1", "g.h2").withColumn("end_doc", F.lit(None).cast("long")).unionByName(firsts)
    carried = heads.withColumn("earlier_doc", F.min("end_doc").over(before)).where("earlier_doc is not null").groupBy("range", "h1", "h2").agg(F.min("earlier_doc").alias("earlier_doc"))
    stream = Window.partitionBy("range", "h1", "h2").orderBy("_ld_doc", "pos")
    own = ranged.withColumn("own_doc", F.first("_ld_doc").over(stream))
    return own.join(F.broadcast(carried), ["range", "h1", "h2"], "left").withColumn("first_doc", F.coalesce("earlier_doc", "own_doc")).drop("range", "own_doc", "earlier_doc")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, ranges: int | None = None) -> DataFrame:
    """``(_ld_doc, _ld_row, n_dropped, bitmap)`` of the documents that lose lines.

    ``bitmap`` maps a word's number to its 64 bits; bit ``i`` set in word ``w`` drops line ``64 w + i``.
    """
    lines = materialize(line_hashes(docs, min_chars), "line-hashes")
    dropped = first_documents(lines, ranges).where(F.col("_ld_doc") > F.col("first_doc"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = dropped.groupBy("_ld_doc", "_ld_row", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("_ld_doc", "_ld_row").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, and ``_ld_lines``, ``_ld_dropped``: lines before and lost."""
    joined = with_row_key(docs).join(bitmaps, ["_ld_doc", "_ld_row"], "left")
    lines = joined.withColumn("_ld_split", F.split(F.coalesce("text", F.lit("")), "\n"))
    bits = lambda i: F.coalesce(F.try_element_at("bitmap", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    kept = F.filter("_ld_split", lambda x, i: F.getbit(bits(i), i % 64) == 0)
    text = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    done = lines.withColumns({
        "text": text,
        "_ld_lines": F.size("_ld_split").cast("long"),
        "_ld_dropped": F.coalesce("n_dropped", F.lit(0).cast("long")),
    })
    return done.select(*docs.columns, "_ld_lines", "_ld_dropped")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that a document with a smaller ``doc_id`` holds, columns unchanged."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars)).drop("_ld_lines", "_ld_dropped")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS dropped
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
