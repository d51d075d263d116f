"""Importance resampling: CRCs against zlib, features and draws against brute force, the query against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_ops import LOWER, ODD, SF, docs

from tiepoint.llm import resample, storage

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = ["漢字" * 300 + " x " + "y" * 5000, "é" * 64 + " " + "z" * 63 + "\x00" + "z" * 65]


def words(text):
    return LETTERS.findall((text or "").translate(LOWER))


def bags(text):
    own = words(text)
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in [*own, *(" ".join(p) for p in zip(own, own[1:]))])


def brute(rows, target):
    """Rows of the query, for ``(doc_id, text)`` and the target's texts."""
    s, t = (sum(map(bags, texts), Counter()) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t)))
    scored = []
    for i, x in rows:
        own = bags(x)
        n = sum(own.values())
        weight = sum(c * gain(b) for b, c in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    first = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = Counter()
    for k, r in enumerate(first[: 25 * len(first) // 100]):
        drawn[r[:4], k + 1] += 1
    return Counter(r[:4] for r in scored), drawn


@pytest.mark.parametrize("gaps", [(0,), (0, 1, 7, 400)])
def test_crc_of_spans_equals_zlib(gaps):
    rnd = random.Random(3)
    data = np.frombuffer(rnd.randbytes(60_000), dtype=np.uint8)
    start, end, at = [], [], 5
    while at < 55_000:
        n = rnd.choice([1, 2, 63, 64, 65, 127, 128, 129, 300, 2000])
        start.append(at)
        end.append(at + n)
        at += n + rnd.choice(gaps)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert resample.crc32_spans(data, np.asarray(start), np.asarray(end)).tolist() == want
    assert resample.crc32_spans(data, np.asarray([3]), np.asarray([60_000])).tolist() == [zlib.crc32(data[3:].tobytes())]
    assert len(resample.crc32_spans(data, np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("piece", [1 << 20, 1, 50])
def test_features_in_any_pieces(piece):
    texts = [*ODD[:8], *LONG, None, "A b.C\x7fd É", "word " * 40]
    found = [Counter() for _ in texts]
    n_words = np.zeros(len(texts), int)
    for part in resample.features(pa.array(["off", *texts], pa.string()).slice(1), piece):
        for r, b in zip(part.row.tolist(), part.bucket.tolist(), strict=True):
            found[part.lo + r][b] += 1
        n_words[part.lo : part.hi] += part.words
    assert found == [bags(t) for t in texts]
    assert n_words.tolist() == [len(words(t)) for t in texts]


def run(spark, rows, target):
    table = docs(spark, rows)
    gain = resample.gains(resample.counts(table), resample.counts(spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")))
    drawn = resample.draw(storage.materialize(resample.with_score(resample.weigh(table, gain)), "t"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").collect()


def test_draw_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(k, prose(rnd.randint(10, 40))) for k in range(400)] + [(900 + k, t) for k, t in enumerate([*ODD, *LONG])]
    rows += [(None, prose(30)), (None, prose(30)), (None, None), *[(7, rows[7][1])] * 3, *[(8, prose(25)), (8, prose(25))]]
    for target in ([prose(50) for _ in range(9)], [], [None, ""]):
        got = run(spark, rows, target)
        assert (Counter(tuple(r)[:4] for r in got), Counter((tuple(r)[:4], r.rank) for r in got if r.rank)) == brute(rows, target)


def test_many_ranges_give_one_order(spark, monkeypatch):
    monkeypatch.setattr(resample.math, "isqrt", lambda n: 32 * 7)
    scored = spark.range(5000).selectExpr("id % 4900 as doc_id", "20 + id % 3 - 1 as n_words", "id as n_features", "0L as weight", "id % 11 as score")
    got = resample.draw(storage.materialize(scored, "t"), percent=100).collect()
    own = sorted((r for r in got if r.n_words >= 20), key=lambda r: (-r.score, r.doc_id, r.n_features))
    assert [r.rank for r in own] == [*range(1, len(own) + 1)]
    assert all(r.rank is None for r in got if r.n_words < 20)


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []


def test_a_target_like_some_documents_favours_them(spark):
    rnd = random.Random(2)
    kinds = [["x" + str(k) for k in range(50)], ["y" + str(k) for k in range(50)]]
    rows = [(k, " ".join(rnd.choice(kinds[k % 2]) for _ in range(30))) for k in range(400)]
    got = run(spark, rows, [" ".join(rnd.choice(kinds[1]) for _ in range(200)) for _ in range(20)])
    drawn = [r.doc_id for r in got if r.rank]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 80


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11_query(spark, sf):
    folder = SF.replace("sf0.001", sf)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert sorted(map(tuple, resample.op11(spark, folder).collect())) == sorted(db.sql(resample.ORACLE).fetchall())
