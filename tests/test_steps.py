"""What the steps store and pass on: the work of a merge follows what it changes."""

import pytest

from tiepoint.config import LayerConfig
from tiepoint.operators import assignment, attachments, candidates, ledger as ledgers
from tiepoint.plans import runs
from tiepoint.sources.artifacts import LEDGER
from tiepoint.sources.layers import flatten
from tiepoint.sources.storage import empty, materialize


def keep(df):
    return materialize(df, "test")


def layer(spark, n, prefix, shift):
    return spark.range(n).selectExpr(
        f"named_struct('OBJECTID', id, 'GlobalID', concat('{{{prefix}', id, '}}'), 'Notes', 'n') as attributes",
        f"named_struct('x', -122 + id * 0.001 + {shift}, 'y', 40D) as geometry",
    )


def test_a_merge_stores_what_it_changes_and_not_the_layer(spark):
    stored = []

    def counted(df):
        rows = keep(df)
        stored.append(rows.count())
        return rows

    auth, cap = keep(layer(spark, 2_000, "a", 0.0)), keep(layer(spark, 5, "c", 0.00001))
    done = runs.apply(cap, auth, spark.createDataFrame([], LEDGER), LayerConfig("hydrants", 5.0), "t1", counted)
    assert sorted(stored)[-2:] == [5, 2_000]  # of the layer only the free records, for the join
    assert done.layer.count() == 2_000 and done.snapshot.count() == 5 and done.ledger.count() == 5
    assert {r.GlobalID for r in done.changed.collect()} == {f"{{a{i}}}" for i in range(5)}


def test_components_link_records_only(spark, monkeypatch):
    given = []
    reached = assignment.least_reached

    def watched(edges, checkpoint):
        given.append(edges.collect())
        return reached(edges, checkpoint)

    monkeypatch.setattr(assignment, "least_reached", watched)
    rows = [(10 * q + i, None, (q * 1000 + i * 4) / 111320, 0.0) for q in range(3) for i in range(4)]
    auth = spark.createDataFrame(rows, "OBJECTID long, GlobalID string, lon double, lat double")
    cap = spark.createDataFrame([(100 + o, g, x + 3 / 111320, y) for o, g, x, y in rows], auth.schema)
    pairs = keep(candidates.pairs_within(cap, auth, 10.67))
    found = assignment.assign(pairs, keep).collect()
    assert sorted((r.cap_oid, r.auth_oid) for r in found) == [(100 + o, o) for o, *_ in sorted(rows)]
    assert {x for e in given[0] for x in e} <= {o for o, *_ in rows} and len(given[0]) < pairs.count()


def test_names_are_judged_in_one_pass(spark):
    wanted = spark.createDataFrame([(1, 7, 1, "a", True), (1, 7, 2, "a", True), (1, 7, 3, "b", True), (1, 7, 4, "b", True), (1, 7, 5, None, False)], "cap_oid long, target_oid long, id long, target_name string, valid boolean")
    target = spark.createDataFrame([(7, 70, "a"), (7, 71, "a"), (8, 72, "b"), (7, 73, None)], "parent_oid long, id long, name string")
    known = keep(attachments.judged(wanted, target))
    assert known.count() == 5
    assert [r.target_name for r in attachments.present(known).collect()] == ["a"]
    assert [(r.target_name, r.id) for r in attachments.missing(known).collect()] == [("b", 3)]


@pytest.mark.parametrize("store", [None, keep])
def test_removal_tells_what_was_there(spark, store):
    target = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (1, None, "c"), (2, 10, "d"), (2, 10, "e")], "parent_oid long, id long, name string")
    gone = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 1)], "oid long, id long")
    left, results = attachments.remove(target, gone, store)
    assert sorted(r.name for r in left.collect()) == ["b", "c"]
    assert sorted((r.oid, r.attachment_id, r.success, r.error) for r in results.collect()) == [(1, 10, True, None), (2, 10, True, None), (3, 1, False, "attachment not found")]


def test_candidates_are_stored_by_captured_row(spark):
    """Pairs are stored once, as one row a captured row; a run's ledger entries come without the ledger before it."""
    stored = []

    def counted(df):
        rows = keep(df)
        stored.append(rows.count())
        return rows

    close = lambda prefix, shift: keep(spark.range(12).selectExpr(
        f"named_struct('OBJECTID', id, 'GlobalID', concat('{{{prefix}', id, '}}'), 'Notes', 'n') as attributes",
        f"named_struct('x', (id div 4) * 0.01D + (id % 4) * 4 / 111320D + {shift}, 'y', 0D) as geometry",
    ))
    auth, cap = close("a", 0.0), close("c", 3 / 111320)
    pairs = candidates.pairs_within(flatten(cap), flatten(auth), 10.67).count()
    before = spark.createDataFrame([("hydrants", "{c0}", "created", None, "0/0", "t0")], LEDGER)
    done = runs.apply(cap, auth, before, LayerConfig("hydrants", 10.67), "t1", counted)
    assert max(stored) < pairs
    assert {r.captured_global_id for r in done.entries.collect()} == {f"{{c{i}}}" for i in range(1, 12)}
    assert done.ledger.count() == 12


def test_rivals_for_one_record(spark):
    """Of captured rows with the same only candidate the nearest counts; ties go to the lowest id."""
    rows = [(i, 1, 2.0 if i in (40, 41) else 5.0) for i in range(100)] + [(200, 1, 1.0), (200, 2, 9.0)]
    pairs = spark.createDataFrame(rows, "cap_oid long, auth_oid long, distance_m double")
    found = sorted((r.cap_oid, r.auth_oid) for r in assignment.assign(pairs, keep).collect())
    assert found == [(40, 1), (200, 2)]


def test_statuses_come_from_one_join(spark):
    done = keep(spark.createDataFrame([(1, 7, True), (2, 7, True), (3, 8, False), (4, 9, True)], "cap_oid long, target_oid long, success boolean"))
    wanted = keep(spark.createDataFrame([(1, 7), (1, 7), (1, 7), (2, 7), (3, 8)], "cap_oid long, target_oid long"))
    before = keep(spark.createDataFrame([(7,)], "target_oid long"))
    made = keep(spark.createDataFrame([(7, 71), (7, 70)], "target_oid long, new_id long"))
    told = attachments.with_statuses(done, wanted, before, made)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {r.cap_oid: (r.attachments_status, r.attachments_added, r.attachments_ok) for r in told.collect()}
    assert got == {1: ("3/3", [70, 71], True), 2: ("3/1", [70, 71], False), 3: (None, None, None), 4: ("0/0", [], True)}
    same = {r.cap_oid: (r.attachments_status, r.attachments_added, r.attachments_ok) for r in attachments.statuses(done, wanted, before, made).collect()}
    assert same == {k: v for k, v in got.items() if k != 3}


def test_an_empty_ledger_needs_no_join(spark):
    rows = ledgers.unprocessed(spark.createDataFrame([("{c1}", 1)], "GlobalID string, OBJECTID long"), empty(spark, LEDGER), "hydrants")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 1
