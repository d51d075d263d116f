import random
import re

import numpy as np
import pyarrow as pa

from tiepoint.llm.substrings import Batch, _places, drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    split = [(i if i is not None else -(1 << 63), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (own, _) in zip(split, rows, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((own, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, batch string, bits string")
    return sorted([tuple(r) for r in drop_repeats(df, **kw).collect()], key=str)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(9, 60))] for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(1, 40))]
        sep = rnd.choice([" ", "\n", "\t ", "  "])
        rows.append((i * 3 % (2 * n), sep.join(text)))
    return rows


def test_one_batch_and_many_agree_with_brute_force(spark):
    rows = corpus(150, 1)
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, batch_bytes=6_000, bucket_bytes=3_000) == want


def test_no_table_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = corpus(30, 2)
    assert run(spark, rows, batch_bytes=6_000, bucket_bytes=3_000) == brute(rows)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_edges(spark):
    long = " ".join(f"v{k % 97}x{k}" for k in range(30_000))
    run13 = " ".join("abcdefghijklm")
    rows = [(1, run13), (2, run13 + " n"), (3, "é " + run13), (4, None), (5, ""), (None, run13), (6, long), (7, "q " + long), (7, long), (2, run13 + " n"), (8, "a b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, batch_bytes=50_000, bucket_bytes=100_000) == brute(rows)


def test_repeats_inside_one_document_stay(spark):
    text = " ".join(["again"] * 40)
    assert run(spark, [(1, text)]) == [(1, 40, 0, text)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_rows_of_one_id_take_many_batches(spark):
    rows = [(i if i is not None and i % 3 else None, t) for i, t in corpus(150, 3)] + [(7, t) for _, t in corpus(60, 4)]
    want = brute(rows)
    assert run(spark, rows, batch_bytes=4_000, bucket_bytes=3_000) == want
    assert run(spark, [(None, t) for _, t in rows], batch_bytes=4_000) == brute([(None, t) for _, t in rows])


def test_places_compare_as_documents_do():
    # documents of three batches: 0 1 2 | 2 | 2 3 4; the second and third batch begin in the first
    ids = [pa.array(x, pa.int64()) for x in ([0, 1, 2], [2], [2, 3, 4])]
    found = []
    for k, x in enumerate(ids):
        own = Batch(pa.table({"doc_id": x, "text": pa.array(["a"] * len(x))}))
        found += zip(x.to_pylist(), _places(k, own, np.arange(own.n_docs), 0).tolist(), strict=True)
    for one, p in found:
        for two, q in found:
            assert (p == q) == (one == two) or {one, two} <= {0, 1} or {one, two} <= {3, 4}
            assert not one < two or p <= q
