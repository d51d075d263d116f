import itertools
import random

import pytest

from tiepoint.operators import assignment, candidates
from tiepoint.operators.components import connected_components
from tiepoint.sources.storage import materialize


def keep(df):
    return materialize(df, "test")


def brute(pairs):
    """Largest size and least cost over all matchings."""
    best = (0, 0)
    lefts = sorted({a for a, _, _ in pairs})
    cost = {(a, b): c for a, b, c in pairs}
    options = [[None, *[b for a2, b, _ in pairs if a2 == a]] for a in lefts]
    for choice in itertools.product(*options):
        used = [b for b in choice if b is not None]
        if len(used) == len(set(used)):
            total = sum(cost[a, b] for a, b in zip(lefts, choice, strict=True) if b is not None)
            best = max(best, (len(used), -total))
    return best


def test_solver_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        pairs = [(a, b, rnd.choice([rnd.randint(0, 9), rnd.randint(0, 10**7)])) for a in range(n) for b in range(m) if rnd.random() < 0.6]
        found = assignment.solve(pairs)
        cost = {(a, b): c for a, b, c in pairs}
        assert len(set(found.values())) == len(found)
        assert (len(found), -sum(cost[x] for x in found.items())) == brute(pairs)


@pytest.mark.parametrize("shift", [3, 2.5])
def test_row_of_four_goes_to_the_diagonal(spark, shift):
    auth = spark.createDataFrame([(i, f"{{a{i}}}", i * 4 / 111320, 0.0) for i in range(4)], "OBJECTID long, GlobalID string, lon double, lat double")
    cap = spark.createDataFrame([(i, f"{{c{i}}}", (i * 4 + shift) / 111320, 0.0) for i in range(4)], auth.schema)
    pairs = keep(candidates.pairs_within(cap, auth, 10.67))
    rows = assignment.with_override(assignment.assign(pairs, keep), pairs).collect()
    assert sorted((r.cap_oid, r.auth_oid) for r in rows) == [(i, i) for i in range(4)]
    assert [r.assignment_overridden_nearest for r in sorted(rows)] == [True, True, True, False]


def test_diamond(spark):
    spots = [(0, 10), (0, -10), (5, 0), (-5, 0)]
    auth = spark.createDataFrame([(i, None, x / 111320, y / 111320) for i, (x, y) in enumerate(spots)], "OBJECTID long, GlobalID string, lon double, lat double")
    cap = spark.createDataFrame([(i, None, (x + 7) / 111320, (y - 7) / 111320) for i, (x, y) in enumerate(spots)], auth.schema)
    pairs = keep(candidates.pairs_within(cap, auth, 30.0))
    rows = sorted(assignment.with_override(assignment.assign(pairs, keep), pairs).collect())
    assert [r.auth_oid for r in rows] == [0, 1, 2, 3]
    assert sum(r.distance_m for r in rows) == pytest.approx(39.465480, abs=1e-5)
    assert [r.assignment_overridden_nearest for r in rows] == [True, False, False, True]


def test_a_large_component_is_solved_in_a_moment():
    """A dense site: 3,000 points with several candidates each in one component."""
    import time

    rnd = random.Random(7)
    at = [(rnd.random() * 100, rnd.random() * 100) for _ in range(3000)]
    spots = {}
    for k, (x, y) in enumerate((rnd.random() * 100, rnd.random() * 100) for _ in range(3000)):
        spots.setdefault((int(x // 3), int(y // 3)), []).append((k, x, y))
    pairs = []
    for a, (x, y) in enumerate(at):
        for i in range(int(x // 3) - 1, int(x // 3) + 2):
            for j in range(int(y // 3) - 1, int(y // 3) + 2):
                for b, u, v in spots.get((i, j), []):
                    if (d := ((x - u) ** 2 + (y - v) ** 2) ** 0.5) < 2.2:
                        pairs.append((a, b, round(d * 1e6)))
    began = time.perf_counter()
    found = assignment.solve(pairs)
    took = time.perf_counter() - began
    cost = {(a, b): c for a, b, c in pairs}
    assert len(pairs) > 10_000 and len(set(found.values())) == len(found) and took < 10
    # no left that stayed alone has a free right, and no pair of matched ones gains by an exchange
    free = {b for _, b, _ in pairs} - set(found.values())
    assert not [1 for a, b, _ in pairs if a not in found and b in free]
    owner = {b: a for a, b in found.items()}
    for a, b, c in pairs:
        other = owner.get(b)
        if a in found and other is not None and other != a and (other, found[a]) in cost:
            assert cost[a, found[a]] + cost[other, b] <= c + cost[other, found[a]]
        if a in found and b in free:
            assert cost[a, found[a]] <= c


def test_stars_and_the_rest_on_random_layouts(spark):
    rnd = random.Random(3)
    rows, pairs = [], []
    for g in range(30):
        own = {(100 * g + rnd.randint(0, 4), 100 * g + rnd.randint(0, 4)): rnd.randint(1, 999) / 100 for _ in range(rnd.randint(1, 7))}
        pairs.append([(a, b, round(d * 1e6)) for (a, b), d in own.items()])
        rows += [(a, b, d) for (a, b), d in own.items()]
    got = assignment.assign(spark.createDataFrame(rows, "cap_oid long, auth_oid long, distance_m double"), keep).collect()
    for g, own in enumerate(pairs):
        mine = [r for r in got if r.cap_oid // 100 == g]
        assert (len(mine), -sum(round(r.distance_m * 1e6) for r in mine)) == brute(own)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges, keep).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "cap_oid long, auth_oid long, distance_m double")
    assert assignment.assign(empty, keep).collect() == []
