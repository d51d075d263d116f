import functools
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_entry import SF, TABLES, shown
from tests.test_merge import feature, keep, pages
from tiepoint import queries
from tiepoint.config import LayerConfig
from tiepoint.sources import artifacts
from tiepoint.sources.storage import new_path
from tiepoint.streaming import incremental


def test_a_batch_writes_what_it_ledgers(spark):
    auth = pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0), feature(11, "{a11}", "kept", 2.0, 2.0)])
    first = pages(spark, [feature(1, "{c1}", "mine", 0.00001, 0.0), feature(2, "{c2}", "far", 1.0, 1.0), feature(3, "{c3}", "lost", None, None)])
    second = pages(spark, [feature(4, "{c4}", "late", 0.00001, 0.0), feature(5, "{c5}", "near", 2.00001, 2.0), feature(6, "{c1}", "again", 0.0, 0.0)])
    source = spark.createDataFrame([(1, 1, "a.jpg"), (4, 2, "b.jpg")], "parent_oid long, id long, name string")
    target = spark.createDataFrame([(10, 8, "other.jpg")], source.schema)
    config, state = LayerConfig("hydrants", 10.67, copy_attachments=True), new_path(spark, "state")
    with pytest.raises(ValueError, match="attachments"):
        incremental.merge_batch(auth, config, state, keep)
    run = incremental.merge_batch(auth, config, state, keep, source, target)
    run(first, 0)
    layer = {r.OBJECTID: r for r in incremental.layer_of(spark, state, auth).collect()}
    assert set(layer) == {10, 11, 12} and (layer[10].Notes, layer[10].lon, layer[12].Notes) == ("mine", 0.00001, "far")
    with pytest.raises(RuntimeError, match="batch=1"):
        run(second, 2)
    run(second, 1)
    run(second, 1)  # again after it was done: nothing changes
    layer = {r.OBJECTID: r for r in incremental.layer_of(spark, state, auth).collect()}
    # the record that the first batch claimed stays as it left it; what comes late to its place is appended
    assert set(layer) == {10, 11, 12, 13} and (layer[10].Notes, layer[13].Notes, layer[11].Notes, layer[11].lon) == ("mine", "late", "kept", 2.00001)
    ledger = {r.captured_global_id: (r.batch, r.action, r.authoritative_oid, r.attachments_status) for r in incremental.state_of(spark, state).collect()}
    assert ledger == {"{c1}": (0, "updated", 10, "1/1"), "{c2}": (0, "created", 12, "0/0"), "{c4}": (1, "created", 13, "1/1"), "{c5}": (1, "updated", 11, "0/0")}
    assert {(r.batch, r.oid) for r in spark.read.parquet(f"{state}/snapshot").collect()} == {(0, 10), (1, 11)}
    assert {r.authoritative_oid for r in artifacts.read_report(spark, f"{state}/report/batch=1").collect()} == {"11", "13"}
    names = {(r.parent_oid, r.name) for r in incremental.attachments_of(spark, state, target).collect()}
    assert len(names) == 3 and {o for o, _ in names} == {10, 13}


def bytes_of(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_rows_that_fail_are_taken_again(spark):
    """No place, a failed write, a failed listing and missing attachments: each row is merged once it can be."""
    auth = pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0), feature(11, "{a11}", " ", 2.0, 2.0), feature(12, "{a12}", " ", 4.0, 4.0)])
    first = [feature(1, "{c1}", "locked", 0.00001, 0.0), feature(2, "{c2}", "unlisted", 2.00001, 2.0), feature(3, "{c3}", "lost", None, None), feature(5, None, "no id", 7.0, 7.0), feature(6, None, "no id, no place", None, None)]
    none = pages(spark, first).where("false")
    source = spark.createDataFrame([(2, 1, "a.jpg")], "parent_oid long, id long, name string")
    target = spark.createDataFrame([(10, 8, "other.jpg")], source.schema)
    config, state = LayerConfig("hydrants", 10.67, copy_attachments=True), new_path(spark, "state")

    def writer(batch):
        def write(planned):
            bad = (F.col("target_oid") == 10) & F.lit(batch < 2)
            return planned.select("action_id", F.col("target_oid").alias("object_id"), F.lit("").alias("global_id"), (~bad).alias("success"), F.when(bad, "locked").alias("error"))

        return write

    unlisted = lambda b: spark.createDataFrame([(2,)] if b == 0 else [], "cap_oid long")
    run = incremental.merge_batch(auth, config, state, keep, source, target, writer, unlisted)
    open_ids = lambda: {r.attributes.OBJECTID: r.since for r in incremental.pending_of(spark, state).collect()}
    run(pages(spark, first), 0)
    assert open_ids() == {1: 0, 2: 0, 3: 0, 6: 0}
    layer = {r.OBJECTID: r.Notes for r in incremental.layer_of(spark, state, auth).collect()}
    assert layer == {10: " ", 11: "unlisted", 12: " ", 13: "no id"}
    run(none, 1)  # nothing arrives; the listing works now
    assert open_ids() == {1: 0, 3: 0, 6: 0} and {r.name for r in incremental.attachments_of(spark, state, target).collect()} == {"other.jpg", "c2_att1_a.jpg"}
    run(pages(spark, [feature(3, "{c3}", "found", 4.00001, 4.0)]), 2)  # the writer works, and one row comes corrected
    assert open_ids() == {6: 0}
    layer = {r.OBJECTID: r.Notes for r in incremental.layer_of(spark, state, auth).collect()}
    assert layer == {10: "locked", 11: "unlisted", 12: "found", 13: "no id"}
    assert {(r.captured_global_id, r.batch) for r in incremental.state_of(spark, state).collect()} == {("{c1}", 2), ("{c2}", 1), ("{c3}", 2)}


def test_a_half_written_batch_does_not_count(spark, monkeypatch):
    auth = pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0)])
    config, state = LayerConfig("hydrants", 10.67), new_path(spark, "state")
    run = incremental.merge_batch(auth, config, state, keep)
    with pytest.raises(ValueError, match="no batch"):
        incremental.pending_of(spark, state)
    with monkeypatch.context() as m:
        m.setattr(incremental, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            run(pages(spark, [feature(1, "{c1}", "first try", 0.00001, 0.0)]), 0)
    assert incremental.last_commit(spark, state) is None and incremental.state_of(spark, state).count() == 0
    assert [r.Notes for r in incremental.layer_of(spark, state, auth).collect()] == [" "]
    run(pages(spark, [feature(1, "{c1}", "second try", 0.00001, 0.0)]), 0)
    assert [r.Notes for r in incremental.layer_of(spark, state, auth).collect()] == ["second try"]
    assert incremental.state_of(spark, state).count() == 1


def test_writes_follow_the_batch_until_a_new_base(spark):
    """A batch of ten rows on 20,000 records writes little; the deltas are folded into a base beyond a share of it."""
    rows = spark.range(20_000).selectExpr(
        "named_struct('OBJECTID', id, 'GlobalID', concat('{a', id, '}'), 'Notes', repeat(sha2(cast(id as string), 256), 3)) as attributes",
        "named_struct('x', -122 + (id % 200) * 0.001, 'y', 40 + id div 200 * 0.001) as geometry",
    )
    auth = keep(rows)
    near = lambda a, b: spark.range(a, b).selectExpr(
        "named_struct('OBJECTID', id, 'GlobalID', concat('{c', id, '}'), 'Notes', 'n') as attributes", "named_struct('x', -122 + (id % 200) * 0.001 + 0.00001, 'y', 40 + id div 200 * 0.001) as geometry"
    )
    config, state = LayerConfig("hydrants", 5.0), new_path(spark, "state")
    run = incremental.merge_batch(auth, config, state, keep)
    whole = spark.read.parquet(auth.inputFiles()[0].rsplit("/", 1)[0])
    layer_bytes = bytes_of(whole.inputFiles()[0].rsplit("/", 1)[0])
    run(near(0, 10), 0)
    assert bytes_of(state) < layer_bytes / 20
    run(near(10, 5_000), 1)
    commit = incremental.last_commit(spark, state)
    assert (commit.base, commit.delta_rows, commit.base_rows) == (-1, 5_000, 20_000)
    run(near(5_000, 5_010), 2)
    commit = incremental.last_commit(spark, state)
    assert (commit.base, commit.delta_rows, commit.base_rows) == (2, 0, 20_000)
    before = bytes_of(state)
    run(near(6_000, 6_010), 3)
    assert bytes_of(state) - before < layer_bytes / 20
    moved = F.abs(F.col("lon") * 1000 - F.round(F.col("lon") * 1000)) > 0.005
    layer = incremental.layer_of(spark, state, auth)
    assert layer.count() == 20_000 == layer.select("OBJECTID").distinct().count()
    assert sorted(r.OBJECTID for r in layer.where(moved).select("OBJECTID").collect()) == [*range(5_010), *range(6_000, 6_010)]


@pytest.mark.parametrize("names", [("stream_ledger", "stream_layer"), ("stream_retries", "stream_retried_layer")])
def test_several_batches_equal_the_sql(spark, names, monkeypatch):
    for source in ("_streamed", "_retried"):
        monkeypatch.setattr(queries, source, functools.cache(getattr(queries, source)))
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in names:
        ours, theirs = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert shown(ours.columns, ours.collect()) == shown(theirs.columns, theirs.fetchall())
    state = (queries._streamed if "ledger" in names[0] else queries._retried)(spark, SF)[0]
    assert incremental.last_commit(spark, state).batch == queries.STREAM_BATCHES - 1
    assert incremental.state_of(spark, state).select(F.countDistinct("batch")).first()[0] == queries.STREAM_BATCHES
