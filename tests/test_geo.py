import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.functions import geo
from tiepoint.operators import candidates, verify


@pytest.mark.parametrize(("a", "b", "metres", "within"), [
    ((0, 0), (1, 0), 111319.490793, 1e-5),
    ((0, 0), (0.0001, 0), 11.131949, 1e-6),
    ((-122, 45), (-122, 45.001), 111.131787, 1e-5),
    ((5, 5), (5, 5), 0.0, 1e-9),
    ((0, 0), (0, 90), 10001965.729, 1e-2),
    ((179.9999, 0), (-179.9999, 0), 22.263898, 1e-5),
    ((0, 0), (180, 0), 20003931.459, 1e-2),
])
def test_geodesic(spark, a, b, metres, within):
    got = geo.vincenty(*(np.asarray([float(x)]) for x in (*a, *b)))[0]
    assert got == pytest.approx(metres, abs=within)
    row = spark.range(1).select(geo.geodesic_m(*(F.lit(float(x)) for x in (*a, *b))).alias("d"), geo.geodesic_m(F.lit(None).cast("double"), *(F.lit(1.0),) * 3).alias("n")).first()
    assert row.d == pytest.approx(metres, abs=within) and row.n is None


def test_short_distance_agrees_with_the_geodesic(spark):
    rnd = np.random.default_rng(1)
    lon, lat = rnd.uniform(-180, 180, 500), rnd.uniform(-89.9, 89.9, 500)
    lon2, lat2 = lon + rnd.uniform(-1, 1, 500) * 4e-3, np.clip(lat + rnd.uniform(-1, 1, 500) * 4e-3, -90, 90)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(lon, lat, lon2, lat2, strict=True)], "a double, b double, c double, d double")
    got = df.select(F.max(F.abs(geo.short_distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")) - geo.geodesic_m("a", "b", "c", "d"))).alias("e")).first().e
    assert got < 1e-6


def test_reprojection(spark):
    def of(x, y, a, b):
        c = geo.reproject(F.lit(float(x)), F.lit(float(y)), a, b)
        return tuple(spark.range(1).select(*c).first())

    assert of(-122, 45, 4326, 3857) == pytest.approx((-13580977.8768, 5621521.4862), abs=1e-3)
    assert of(-13580977.8768, 5621521.4862, 102100, 4326) == pytest.approx((-122, 45), abs=1e-8)
    assert of(-123, 45, 4326, 32610) == pytest.approx((500000.0, 4982950.4002), abs=1e-2)
    assert of(*of(-121.3, -33.2, 4326, 32710), 32710, 4326) == pytest.approx((-121.3, -33.2), abs=1e-9)
    assert of(1, 2, 4326, 4326) == (1.0, 2.0)
    with pytest.raises(ValueError, match="unsupported"):
        geo.reproject(F.lit(1.0), F.lit(1.0), 4326, 2154)


def flat(spark, rows):
    return spark.createDataFrame([(i, f"{{{i}}}", t, x, y) for i, t, x, y in rows], "OBJECTID long, GlobalID string, type string, lon double, lat double")


@pytest.mark.parametrize("threshold", [0.7, 10.67, 100.0, 2000.0])
def test_pairs_equal_brute_force(spark, threshold):
    rnd = np.random.default_rng(2)
    step = threshold / 111320
    spots = [(0, 0), (0, 90), (10, -90), (180, 12), (-122, 40)]
    def some(n, kind):
        rows = []
        for k in range(n):
            x, y = spots[k % len(spots)]
            lat = float(np.clip(y + rnd.uniform(-2, 2) * step, -90, 90))
            lon = float(((x + rnd.uniform(-2, 2) * step / max(0.01, math.cos(math.radians(lat)))) + 180) % 360 - 180)
            rows.append((k + 1, kind[k % 3], lon, lat))
        return rows + [(900, "h", None, 1.0), (901, None, 0.0, None)]

    cap, auth = some(40, ["h", "v", None]), some(45, ["h", None, "v"])
    c, a = flat(spark, cap), flat(spark, auth)
    for typed in (False, True):
        got = candidates.pairs_within(c, a, threshold, *(("type", "type") if typed else ()))
        want = {
            (i, j)
            for i, t, x, y in cap for j, u, v, w in auth
            if None not in (x, y, v, w) and (not typed or t == u) and geo.vincenty(*(np.asarray([q]) for q in (x, y, v, w)))[0] <= threshold
        }
        rows = [(r.cap_oid, r.auth_oid) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def sited(rnd, n, spread):
    """``n`` rows, a third of them on one site of ``spread`` metres, the others one by one."""
    step = spread / 111320
    return [(k, "hv"[k % 2], rnd.uniform(0, step), rnd.uniform(0, step)) if k % 3 == 0 else (k, None, 0.001 * (k % 40) + 0.01, 0.001 * (k // 40) + 0.01) for k in range(1, n + 1)]


@pytest.mark.parametrize(("threshold", "spread", "most"), [(10.67, 0.0, 20), (10.67, 30.0, 20), (10.67, 200.0, 5), (0.3, 3.0, 7), (2000.0, 4000.0, 10), (10.67, 30.0, 1)])
def test_crowded_cells_are_divided_and_dealt(spark, threshold, spread, most):
    rnd = np.random.default_rng(5)
    cap, auth = sited(rnd, 150, spread), sited(rnd, 300, spread)
    c, a = flat(spark, cap), flat(spark, auth)
    x, y, v, w = (np.asarray(q) for q in ([r[k] for r in cap for _ in auth] if side == 0 else [r[k] for _ in cap for r in auth] for side, k in ((0, 2), (0, 3), (1, 2), (1, 3))))
    near = geo.vincenty(x, y, v, w) <= threshold
    want = {(i[0], j[0]) for (i, j), d in zip(((i, j) for i in cap for j in auth), near, strict=True) if d}
    for typed in (False, True):
        kinds = ("type", "type") if typed else ()
        rows = [(r.cap_oid, r.auth_oid) for r in candidates.pairs_within(c, a, threshold, *kinds, crowded=most).collect()]
        types = {r[0]: r[1] for r in cap}, {r[0]: r[1] for r in auth}
        assert len(rows) == len(set(rows)) and set(rows) == {(i, j) for i, j in want if not typed or types[0][i] == types[1][j]}


def test_no_key_of_the_distance_join_holds_a_site(spark):
    rnd = np.random.default_rng(6)
    rows = flat(spark, sited(rnd, 6000, 8.0))
    most = 100
    for side in candidates.keyed(rows, rows, 10.67, crowded=most)[:2]:
        keys = [k for k in side.columns if k in {"cx", "cy", "cz", "fx", "fy", "fz", "auth_part", "cap_part"}]
        assert len(keys) == 8
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] < 2 * most


def test_crowded_records_without_captured_points_do_not_travel(spark):
    a = flat(spark, [(k, None, 0.0, 0.0) for k in range(50)] + [(99, None, 1.0, 1.0)])
    kept, _, _ = candidates.keyed(flat(spark, [(1, None, 1.0, 1.0)]), a, 10.67, crowded=10)
    assert [r.auth_oid for r in kept.collect()] == [99]


def test_layers_without_rows_make_no_pair(spark):
    some, none = flat(spark, [(k, None, 0.0, 0.0) for k in range(9)]), flat(spark, [(1, None, None, None)]).limit(0)
    for c, a in ((some, none), (none, some), (none, none)):
        assert candidates.pairs_within(c, a, 10.67, crowded=3).count() == 0


def test_wrong_type_closer(spark):
    cap = flat(spark, [(1, "hydrant", 0.0, 0.0)])
    auth = flat(spark, [(1, "hydrant", 1 / 111320, 0.0), (2, "valve", 0.5 / 111320, 0.0)])
    got = candidates.candidate_lists(candidates.pairs_within(cap, auth, 10.0, "type", "type")).first()
    assert [x.OBJECTID for x in got.candidates] == [1]


@pytest.mark.parametrize(("threshold", "n"), [(10, 1), (50, 2), (200, 3)])
def test_thresholds(spark, threshold, n):
    cap = flat(spark, [(1, None, 0.0, 0.0)])
    auth = flat(spark, [(k, None, d, 0.0) for k, d in enumerate((0.00001, 0.0001, 0.001))])
    assert candidates.pairs_within(cap, auth, float(threshold)).count() == n


def test_equal_distances_go_to_the_lowest_id(spark):
    cap = flat(spark, [(1, None, 0.0, 0.0)])
    auth = flat(spark, [(9, None, 0.00001, 0.0), (3, None, -0.00001, 0.0)])
    pairs = candidates.pairs_within(cap, auth, 5.0)
    assert candidates.nearest(pairs).first().auth_oid == 3
    assert [r.auth_oid for r in candidates.ranked(pairs).orderBy("rank").collect()] == [3, 9]


def test_columns_measure_as_the_helper_does(spark):
    rnd = np.random.default_rng(3)
    rows = [tuple(map(float, (rnd.uniform(-180, 180), rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180), rnd.uniform(-89.9, 89.9)))) for _ in range(300)]
    rows += [(0.0, 0.0, 0.0, 0.0), (179.99, 10.0, -179.99, 10.0), (0.0, 0.0, 179.9, 0.1), (0.0, 30.0, 179.95, -30.0), (10.0, 90.0, 50.0, -90.0), (5.0, 0.0, 6.0, 0.0), (1.0, 45.0, 1.0, 45.00001)]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    columns = [F.col(c) for c in "abcd"]
    got = [r[0] for r in df.select(geo.geodesic_columns(*columns)).collect()]
    assert got[-1] is None
    want = geo.vincenty(*(np.asarray(x) for x in zip(*rows, strict=True)))
    assert np.allclose(got[:-1], want, rtol=1e-10, atol=1e-6)


def test_no_python_in_verification(spark):
    rows = spark.range(3).selectExpr("id as oid", "named_struct('OBJECTID', id, 'Notes', 'x') as attributes", "named_struct('x', id * 0.5, 'y', 1D) as geometry")
    live = rows.select("attributes", F.struct((F.col("geometry.x") * 2).alias("x"), F.col("geometry.y").alias("y")).alias("geometry"))
    found = verify.verify(rows, live)
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r.oid: r.geometry_mismatch_m for r in found.collect()}
    want = geo.vincenty(*(np.asarray(x, dtype=float) for x in ([0, 0.5, 1], [1, 1, 1], [0, 1, 2], [1, 1, 1])))
    assert [got[k] for k in range(3)] == pytest.approx(list(want), abs=1e-6)
