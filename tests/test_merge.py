import json

import pytest
from pyspark.sql import functions as F

from tiepoint.config import LayerConfig
from tiepoint.functions import values
from tiepoint.operators import attachments, ledger as ledgers, merge, rollback as undo, verify as checks
from tiepoint.plans import runs, stored
from tiepoint.sources import artifacts, layers, run_store
from tiepoint.sources.storage import materialize, new_path


def keep(df):
    return materialize(df, "test")


def test_config_checks():
    with pytest.raises(ValueError, match="both or neither"):
        LayerConfig("x", 1.0, type_field_captured="t")
    with pytest.raises(ValueError, match="above 0"):
        LayerConfig("x", 0.0)
    assert LayerConfig("x", 1.0, type_field_captured="t", type_field_authoritative="u").required_fields()[1][-1] == "u"


@pytest.mark.parametrize(("value", "blank"), [(None, True), ("", True), (" \t\n\x0b\x1c\x85 　", True), ("x", False), (" x ", False), ("​", False), ("0", False)])
def test_blank_text(spark, value, blank):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(values.is_blank(F.col("v"), df.schema["v"].dataType)).first()[0] is blank


@pytest.mark.parametrize(("kind", "value"), [("int", 0), ("double", 0.0), ("boolean", False), ("double", float("nan"))])
def test_zero_and_false_are_values(spark, kind, value):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert df.select(values.is_blank(F.col("v"), df.schema["v"].dataType)).first()[0] is False


def filled(spark, cap, auth, cap_schema, auth_schema, field_map):
    c = spark.createDataFrame([cap], cap_schema).alias("c")
    a = spark.createDataFrame([auth], auth_schema).alias("a")
    got = merge.fills(c, a, field_map)
    return c.join(a).select(*(v.alias(t) for t, v in got.items())).first().asDict()


def test_fill_rules(spark):
    schema = "OBJECTID long, GlobalID string, name string, note string, size int, Editor string"
    got = filled(spark, (1, "g", "new", "mine", 5, "me"), (2, "h", "old", "  ", None, None), schema, schema, {})
    assert got == {"name": None, "note": "mine", "size": 5}
    # a mapped pair comes first and the same-named pair wins; the mapped field's own name is suppressed
    got = filled(spark, (1, "x", "y"), (None, None, None), "OBJECTID long, a string, name string", "OBJECTID long, a string, name string", {"a": "name"})
    assert got == {"name": "y"}
    got = filled(spark, (1, "x", None), (None, None, None), "OBJECTID long, a string, name string", "OBJECTID long, a string, name string", {"a": "name"})
    assert got == {"name": "x"}
    # targets that the record lacks are added; other types are cast if that can be
    assert filled(spark, (1, "x"), (2,), "OBJECTID long, a string", "OBJECTID long", {"a": "brand_new"}) == {"brand_new": "x"}
    assert filled(spark, (1, "7"), (2, None), "OBJECTID long, n string", "OBJECTID long, n int", {}) == {"n": 7}
    assert filled(spark, (1, "seven"), (2, None), "OBJECTID long, n string", "OBJECTID long, n int", {}) == {"n": None}


def test_threshold_text(spark):
    row = spark.range(1).select(
        values.threshold_text(F.lit(1.0), F.lit("Meters")).alias("m"), values.threshold_text(F.lit(3.28084), F.lit("FEET")).alias("f")
    ).first()
    assert (row.m, row.f) == ("1.00 m (3.28 ft)", "3.28 ft (1.00 m)")
    with pytest.raises(Exception, match="source_units"):
        spark.range(1).select(values.threshold_text(F.lit(1.0), F.lit("yards"))).collect()


def test_attachment_name(spark):
    got = spark.range(1).select(values.attachment_name(F.lit("{0Fa1b2c3-4d5e-46f7-8899-aabbccddee00}"), F.lit(12), F.lit("field/photos/b.png"))).first()[0]
    assert got == "0Fa1b2c34d5e46f78899aabbccddee00_att12_b.png"


@pytest.mark.parametrize(("status", "ok"), [("2/2", True), ("0/0", True), ("2/3", False), (None, False), ("", False), ("x/y", False), ("1/1/1", False), ("2", False)])
def test_status(spark, status, ok):
    assert spark.createDataFrame([(status,)], "s string").select(values.fully_copied(F.col("s"))).first()[0] is ok


def test_ids(spark):
    df = spark.createDataFrame([(" 7 ", "[1,2]"), ("5.0", "[oops"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(values.oid_of(F.col("a")), values.ids_of(F.col("b"))).collect()] == [(7, [1, 2]), (None, []), (None, [])]


def feature(oid, gid, notes, x, y, wkid=None):
    place = None if x is None and y is None else {"x": x, "y": y, "spatialReference": {"wkid": wkid, "latestWkid": None}}
    return {"attributes": {"OBJECTID": oid, "GlobalID": gid, "Notes": notes}, "geometry": place}


ATTRIBUTES = "OBJECTID long, GlobalID string, Notes string"


def pages(spark, features, per_page=2):
    import os
    import tempfile

    path = tempfile.mkdtemp(prefix="tiepoint-pages-")
    for k in range(0, max(len(features), 1), per_page):
        with open(os.path.join(path, f"page{k}.json"), "w") as f:
            json.dump({"features": features[k : k + per_page]}, f, indent=1)
    return layers.read_pages(spark, path, ATTRIBUTES)


def test_reading_layers(spark):
    raw = pages(spark, [feature(1, "a", None, 1.5, 2.5), feature(2, "b", "n", None, None), feature(3, "c", "n", 1.0, None)])
    assert layers.check_count(raw, 3) == 3
    with pytest.raises(RuntimeError, match="declares 4"):
        layers.check_count(raw, 4)
    layers.check_points(raw)
    with pytest.raises(ValueError, match="point layers"):
        layers.check_points(raw, "esriGeometryPolyline")
    with pytest.raises(ValueError, match="Kind, Size"):
        layers.check_fields(raw, ["OBJECTID", "Kind", "Size"])
    flat = layers.flatten(raw)
    assert sorted((r.OBJECTID, r.lon, r.lat) for r in flat.collect()) == [(1, 1.5, 2.5), (2, None, None), (3, None, None)]
    assert tuple(layers.point_counts(flat).first()) == (1, 2)


def test_report_round_trip(spark):
    one = spark.createDataFrame([("g", 'a "quoted", text', "[1,2]", None)], "captured_global_id string, note string, ids string, x string")
    two = spark.createDataFrame([("h", "line\nbreak", True)], "captured_global_id string, note string, ok boolean")
    path = new_path(spark, "report")
    artifacts.write_report([one, two], path)
    got = {r.captured_global_id: r.asDict() for r in artifacts.read_report(spark, path).collect()}
    assert got["g"]["note"] == 'a "quoted", text' and got["g"]["ids"] == "[1,2]" and got["g"]["ok"] is None
    assert got["h"]["note"] == "line\nbreak" and got["h"]["ok"] == "true"


def test_ledger_files(spark, tmp_path):
    assert artifacts.read_ledger(spark, new_path(spark, "none")).count() == 0
    (tmp_path / "l.json").write_text(json.dumps({"a": {"action": "updated", "authoritative_oid": 5, "attachments_status": "1/1", "run_time": "t"}, "b": {"action": "created", "authoritative_oid": None, "attachments_status": None, "run_time": "t"}}))
    rows = artifacts.import_ledger(spark, f"file://{tmp_path}/l.json", "x")
    assert sorted((r.captured_global_id, r.authoritative_oid) for r in rows.collect()) == [("a", 5), ("b", None)]
    newer = spark.createDataFrame([("x", "a", "created", 6, "0/0", "u"), ("x", None, "created", 7, "0/0", "u")], artifacts.LEDGER)
    path = new_path(spark, "ledger")
    artifacts.write_ledger(ledgers.upsert(rows, newer), path)
    got = artifacts.read_ledger(spark, path, "x")
    assert sorted((r.captured_global_id, r.authoritative_oid) for r in got.collect()) == [("a", 6), ("b", None)]
    assert [r.OBJECTID for r in ledgers.claimed(got, "x").collect()] == [6] and not ledgers.claimed(got, "y").count()


def test_snapshots_with_and_without_a_layer(spark, tmp_path):
    entries = [{"oid": 1, "attributes": {"n": "x"}, "geometry": {"x": 1.0, "y": 2.0}}]
    (tmp_path / "new.json").write_text(json.dumps({"layer": "hydrants", "authoritative_url": "u", "entries": entries}))
    (tmp_path / "old.json").write_text(json.dumps(entries))
    new = artifacts.read_snapshot(spark, f"file://{tmp_path}/new.json", json=True).first()
    old = artifacts.read_snapshot(spark, f"file://{tmp_path}/old.json", json=True).first()
    assert (new.oid, new.layer, new.source, new.geometry.x) == (1, "hydrants", "u", 1.0)
    assert (old.oid, old.layer, old.source) == (1, None, None)


def test_verify_cases(spark):
    def rows(*items):
        return spark.createDataFrame([(i["attributes"]["OBJECTID"], i["attributes"], i["geometry"]) for i in items], f"oid long, attributes struct<OBJECTID:long,GlobalID:string,Notes:string>, geometry {layers.GEOMETRY}")

    saved = rows(feature(1, "g", "n", 0.0, 0.0, 4326), feature(2, "g", "n", 0.0, 0.0, 4326), feature(3, "g", "n", 0.0, 0.0, 4326), feature(4, "g", "n", 0.0, 0.0), feature(5, "g", "n", None, None), feature(6, "g", "n", None, None), feature(7, "g", "n", 0.0, 0.0), feature(8, "g", None, 50.0, 0.0))
    live = rows(feature(1, "z", "n", 0.001, 0.0, 4326), feature(2, "g", "n", 0.00000001, 0.0, 4326), feature(3, "g", "n", 0.0, 0.0, 102100), feature(5, "g", "n", None, None), feature(6, "g", "n", 1.0, 1.0), feature(7, "g", "other", 0.0, 0.0), feature(8, "g", "x", 0.0, 0.0)).drop("oid")
    got = {r.oid: r for r in checks.verify(saved, live).collect()}
    assert [got[k].verified for k in range(1, 9)] == [False, True, False, False, True, False, False, False]
    assert got[1].geometry_mismatch_m == pytest.approx(111.319, abs=1e-3) and got[3].geometry_mismatch_m is None
    assert got[8].geometry_mismatch_m == pytest.approx(5565974.5, abs=1)
    assert not got[4].live_feature_found and got[4].attribute_mismatches == {}
    assert got[7].attribute_mismatches["Notes"].asDict() == {"expected": "n", "actual": "other"}


def test_layer_guard(spark):
    report = lambda name: spark.createDataFrame([("updated", name)], "action string, layer string")
    saved = lambda name: spark.createDataFrame([(1, name)], "oid long, layer string")
    undo.check_layer(report("a"), saved("a"), "a")
    undo.check_layer(report(""), saved("a"), "a")
    for r, s in ((report("b"), saved("a")), (report("a"), saved("b")), (report(None), saved(None))):
        with pytest.raises(undo.LayerMismatch):
            undo.check_layer(r, s, "a")
    undo.check_layer(report(None), saved(None), "a", force=True)


def test_merge_then_second_run_then_rollback(spark):
    cap = pages(spark, [feature(1, "{c1}", "mine", 0.00001, 0.0), feature(2, "{c2}", "far", 1.0, 1.0), feature(3, "{c3}", "lost", None, None), feature(4, None, "nameless", 2.0, 2.0)])
    auth = pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0), feature(11, "{a11}", "kept", 2.0, 2.0)])
    config = LayerConfig("hydrants", 10.67, copy_attachments=True)
    empty = spark.createDataFrame([], artifacts.LEDGER)
    source = spark.createDataFrame([(1, 1, "a.jpg"), (1, 2, "b.jpg"), (2, 5, None)], "parent_oid long, id long, name string")
    target = spark.createDataFrame([(10, 7, "c1_att1_a.jpg"), (10, 8, "other.jpg")], source.schema)
    done = runs.apply(cap, auth, empty, config, "t1", keep, source, target)
    rows = {r.captured_global_id: r for r in done.report.collect()}
    assert set(rows) == {"{c1}", "{c2}", None}
    assert (rows["{c1}"].action, rows["{c1}"].authoritative_oid, rows["{c1}"].attachments_status, rows["{c1}"].ledgered) == ("updated", 10, "2/2", True)
    assert (rows["{c2}"].action, rows["{c2}"].authoritative_oid, rows["{c2}"].attachments_status, rows["{c2}"].ledgered) == ("appended", 12, "0/1", False)
    assert (rows[None].action, rows[None].ledgered) == ("updated", False)
    layer = {r.OBJECTID: r for r in done.layer.collect()}
    assert (layer[10].Notes, layer[10].lon) == ("mine", 0.00001) and layer[11].Notes == "kept" and layer[12].Notes == "far"
    assert [r.captured_global_id for r in done.ledger.collect()] == ["{c1}"]
    names = {(r.parent_oid, r.name) for r in done.attachments.collect()}
    assert (10, "c1_att2_b.jpg") in names and len(names) == 3
    # a new row at the claimed record is appended, not merged
    later = pages(spark, [feature(5, "{c5}", "late", 0.0, 0.0)])
    plan = runs.preview(later, auth, done.ledger, config, keep)
    assert plan.report.first().action == "would_append"
    live = done.layer.select(F.struct("OBJECTID", "GlobalID", "Notes").alias("attributes"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(None).cast("struct<wkid:int,latestWkid:int>").alias("spatialReference")).alias("geometry"))
    back = runs.roll_back(live, done.report, done.snapshot, done.ledger, "hydrants", keep, done.attachments)
    restored = {r.attributes.OBJECTID: r for r in back.layer.collect()}
    assert set(restored) == {10, 11} and restored[10].attributes.Notes == " " and restored[10].geometry.x == 0.0
    assert back.ledger.count() == 0 and back.attachments.count() == 2
    audit = back.audit.first()
    assert (audit.verify_success_count, audit.verify_mismatch_count, audit.verify_error) == (2, 0, None)
    assert audit.authoritative_feature_count_after == audit.expected_feature_count_after == 2
    assert (audit.total_attachments_targeted, audit.total_attachments_removed) == (1, 1)
    path = new_path(spark, "audit")
    artifacts.write_audit(back.audit, back.results, path)
    assert spark.read.json(f"{path}/record").first().feature_count_matches_expected is True
    written = {r.step: (r.n, r.good) for r in spark.read.json(f"{path}/results").groupBy("step").agg(F.count("*").alias("n"), F.count_if(F.coalesce("success", "verified")).alias("good")).collect()}
    assert written == {"restore": (2, 2), "feature_delete": (1, 1), "attachment_delete": (1, 1), "verify": (2, 2)}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        new_path(Session, "x")


def test_failed_listing_is_retried(spark):
    done = spark.createDataFrame([(1, "{c1}", 10, True), (2, "{c2}", 11, True)], "cap_oid long, captured_global_id string, target_oid long, success boolean")
    source = spark.createDataFrame([(1, 1, "a.jpg")], "parent_oid long, id long, name string")
    target = spark.createDataFrame([], source.schema)
    wanted = keep(attachments.expected(done, source))
    _, made = attachments.copy(attachments.plan_copies(wanted, target), source, target)
    bad = spark.createDataFrame([(2,)], "cap_oid long")
    got = {r.cap_oid: r for r in attachments.statuses(done, wanted, attachments.already_there(wanted, target), made, bad).collect()}
    assert (got[1].attachments_status, got[1].attachments_ok) == ("1/1", True)
    assert (got[2].attachments_status, got[2].attachments_ok) == (None, False)


def test_write_results(spark):
    plan = spark.createDataFrame([(1,), (2,), (3,)], "action_id long")
    results = spark.createDataFrame([(1, 0, "{g}", True, "ignored"), (2, 5, None, False, "denied")], "action_id long, object_id long, global_id string, success boolean, error string")
    got = {r.action_id: (r.success, r.result_oid, r.error) for r in merge.write_results(plan, results).collect()}
    assert got == {1: (True, "{g}", None), 2: (False, "5", "denied"), 3: (False, None, "no result")}


def test_faulty_pages_are_named_and_refused(spark, tmp_path):
    kind = "OBJECTID bigint, GlobalID string"
    good = {"count": 1, "features": [{"attributes": {"OBJECTID": 1, "GlobalID": "{a}"}, "geometry": {"x": 1.0, "y": 2.0}}]}
    null = json.dumps(good | {"features": [{"attributes": {"OBJECTID": 1, "GlobalID": "{a}"}, "geometry": None}]})
    texts = {"good": json.dumps(good), "cut": json.dumps(good)[:-9], "in_a_word": null[:-6], "short": json.dumps(good | {"count": 2}), "error": json.dumps({"error": "busy"}), "plain": json.dumps({"features": []})}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    pages = layers.page_files(spark, str(tmp_path), kind)
    found = {r.file.rsplit("/", 1)[1]: (r.declared, r.found, r.fault) for r in layers.page_counts(pages).collect()}
    assert found == {"good.json": (1, 1, None), "cut.json": (None, 0, "unreadable"), "in_a_word.json": (None, 0, "unreadable"), "short.json": (2, 1, "incomplete"), "error.json": (None, 0, "no features"), "plain.json": (None, 0, None)}
    for name, fault in (("cut", "unreadable"), ("short", "incomplete"), ("error", "no features")):
        with pytest.raises(Exception, match=f"{name}.json is {fault}"):
            layers.read_pages(spark, str(tmp_path / f"{name}.json"), kind).collect()
    assert layers.read_pages(spark, str(tmp_path / "good.json"), kind).count() == 1


def test_ids_of_many_ranges_are_whole(spark):
    rows = spark.range(3_000).selectExpr("id * 7 % 3000 as key", "'x' as v")
    for ranges in (None, 1, 9):
        got = merge.allocate_ids(rows, "key", 100, ranges=ranges)
        assert got.columns == ["key", "v", "new_oid"]
        assert {r.key: r.new_oid for r in got.collect()} == {k: 101 + k for k in range(3_000)}
    assert merge.allocate_ids(rows.where("false"), "key", 100).count() == 0


def test_a_verification_that_fails_is_told_and_counts_nothing(spark, monkeypatch):
    live = pages(spark, [feature(1, "{a1}", "new", 0.0, 0.0)])
    snapshot = live.select(F.lit(1).cast("bigint").alias("oid"), "attributes", "geometry", F.lit("hydrants").alias("layer"))
    report = spark.createDataFrame([("updated", "1", "{c1}", "[]", "hydrants")], "action string, authoritative_oid string, captured_global_id string, attachments_added string, layer string")
    ledger = spark.createDataFrame([("hydrants", "{c1}", "updated", 1, "0/0", "t"), ("valves", "{c1}", "updated", 1, "0/0", "t")], artifacts.LEDGER)
    monkeypatch.setattr(runs.checks, "verify", lambda *_: (_ for _ in ()).throw(OSError("no answer")))
    back = runs.roll_back(live, report, snapshot, ledger, "hydrants", keep)
    told = back.audit.first()
    assert (told.verify_success_count, told.verify_mismatch_count, told.verify_error) == (None, None, "no answer")
    assert back.verification is None and told.restore_success_count == 1 and told.ledger_cleared_count == 1
    assert [r.layer for r in back.ledger.collect()] == ["valves"]


def test_plans_refuse_before_they_do_anything(spark):
    cap, auth = pages(spark, [feature(1, "{c1}", "x", 0.0, 0.0)]), pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0)])
    none, config = spark.createDataFrame([], artifacts.LEDGER), LayerConfig("hydrants", 5.0)
    with pytest.raises(RuntimeError, match="declares 3"):
        runs.preview(cap, auth, none, config, keep, declared=(1, 3))
    lines = auth.select("attributes", F.struct(F.lit("p").alias("paths")).alias("geometry"))
    with pytest.raises(ValueError, match="only point layers"):
        runs.preview(cap, lines, none, config, keep)


def test_run_store_shows_finished_runs_only(spark):
    store = new_path(spark, "store")
    cap, auth = pages(spark, [feature(1, "{c1}", "x", 0.00001, 0.0)]), pages(spark, [feature(10, "{a10}", " ", 0.0, 0.0)])
    config = LayerConfig("hydrants", 5.0)
    with pytest.raises(ValueError, match="give its authoritative layer"):
        stored.apply_run(cap, store, config, "t1", "s", keep)
    with pytest.raises(ValueError, match="can't name a directory"):
        stored.apply_run(cap, store, config, "a/b", "s", keep, auth)
    run_store.write_tables(store, "hydrants", "t1", layer=auth.select("attributes"))  # broken off
    with pytest.raises(ValueError, match="no finished run 't1'"):
        stored.roll_back_run(spark, store, "hydrants", "t1", "t2", keep)
    stored.apply_run(cap, store, config, "t1", "s", keep, auth)
    assert stored.state_of(spark, store, "hydrants").layer.first().Notes == "x"
    with pytest.raises(ValueError, match="already"):
        stored.apply_run(cap, store, config, "t1", "s", keep)
    back = stored.roll_back_run(spark, store, "hydrants", "t1", "t2", keep)
    assert back.audit.first().restore_success_count == 1
    state = stored.state_of(spark, store, "hydrants")
    assert (state.run_ts, state.layer.first().Notes, state.ledger.count()) == ("t2", " ", 0)
    with pytest.raises(ValueError, match="undone already"):
        stored.roll_back_run(spark, store, "hydrants", "t1", "t3", keep)
    with pytest.raises(ValueError, match="is a rollback"):
        stored.roll_back_run(spark, store, "hydrants", "t2", "t3", keep)
