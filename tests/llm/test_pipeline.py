"""The stages of the corpus pipeline one after another, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from test_ops import LOWER, PATH, SF, WORD, crc, near_brute, table_rows
from tiepoint.llm import quality, storage
from tokenizers import Tokenizer


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    first, seen = {}, Counter()
    for i, t in sorted(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            first.setdefault(k, i)
            seen[k] += 1
    stays = lambda i, x: len(key(x)) < 10 or seen[key(x)] < 2 or first[key(x)] == i
    return {i: "\n".join(x for x in (t or "").split("\n") if stays(i, x)) for i, t in rows}


def brute_hits(rows, items):
    """Ids of the documents that hold an item, or nearly so."""
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    items = [(v, bag(v)) for v in (split(u) for u in items) if v]
    found = set()
    for i, t in rows:
        w = split(t)
        own = set(bag(w)) if w else set()
        for v, b in items:
            if len(own & set(b)) < 0.375 * len(b) or min(len(v), len(w)) < 5 and v != w:
                continue
            n = min(len(v), len(w))
            bags = (bag(w[k : k + n]) for k in range(len(w) - n + 1))
            if any(sum((x & b).values()) >= 0.75 * sum((x | b).values()) for x in bags):
                found.add(i)
                break
    return found


def check_packing(rows, capacity=2048):
    """Sequences are filled from 0 without gaps, up to the capacity."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(places)


def test_stages_equal_brute_force(spark):
    docs = storage.table(spark, SF, "documents")
    seen = {"documents": {r.doc_id: r for r in docs.collect()}}
    before = "documents"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = storage.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        assert 0 < len(seen[name]) <= len(seen[before]) and set(seen[name]) <= set(seen[before])
        if name != "line_dedup":  # filters leave the rest as it is
            assert all(seen[before][i] == r for i, r in seen[name].items())
        docs, before = out, name
    assert len(seen["quality_classifier"]) < len(seen["documents"])
    texts = lambda name: [(i, r.text) for i, r in seen[name].items()]
    assert dict(texts("line_dedup")) == brute_lines(texts("quality_classifier"))
    assert set(seen["near_dedup"]) == {r[0] for r in near_brute(texts("line_dedup")) if r[3]}
    assert set(seen["quality_classifier"]) == {r.doc_id for r in quality.op7(spark, SF).collect() if r.predicted}
    items = [u for _, u in table_rows("benchmark", "item_id", "text")]
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - brute_hits(texts("near_dedup"), items)
    whole, want = Tokenizer.from_file(PATH), []
    for i, t in texts("decontamination"):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    assert check_packing(packed) <= 1.02 * sum(r.length for r in packed) / 2048 + 1
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


def tables(spark, folder, documents, labels, benchmark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, length int, key string, band int, score double, pos int, start long"
    rows = [(i, t, None, "s", len(t or ""), "c", 1, "k", 2, 0.5, 3, 4) for i, t in documents]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_with_nulls_repeats_and_further_columns(spark, tmp_path):
    prose = [t for _, t in table_rows("documents", "doc_id", "text")]
    item = "which of these nine rivers reaches the northern sea before all of the others do"
    documents = [(k, t) for k, t in enumerate(prose)]
    documents += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "A row without an id. " * 9), (None, None), (1003, "Some words, then: " + item + ". And more of them."), (5, prose[5]), (5, prose[5])]
    documents += [(1100 + k, " ".join(f"word{j}" for j in range(300)) + f" end{k}") for k in range(40)]
    labels = [(k, k % 3 and 1, 0) for k in range(0, 150, 2)] + [(None, 1, None), (7, None, None), (8, 1, 1), (8, 0, 1)]
    folder = tables(spark, tmp_path, documents, labels, [(1, item), (2, None), (None, ""), (3, item)])
    packed = corpus_pipeline.run(spark, folder).collect()
    check_packing(packed)
    ids = {r.doc_id for r in packed}
    assert 1003 not in ids and len([k for k in ids if k is not None and 1100 <= k]) <= 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, folder), "t")
    left = docs.collect()
    assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    assert Counter(r.doc_id for r in packed if not r.piece) == Counter(r.doc_id for r in left)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0
