"""Globally optimal one-to-one assignment over candidate pairs: most matches first, then least total distance.

Both parts of the objective add up over the connected components of the pairs, so components are solved
apart. Of captured rows that have one and the same record for their only candidate an aggregate keeps the nearest.
What is left travels as one row a captured row, with its candidates; components are labelled by joins over the
records and dealt over tasks whole. A small helper solves one component at a time on whole micrometres, one
captured row after another along shortest paths. A component is as large as the layout is dense; its task
holds about 200 bytes for each of its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import listed, nearest
from .components import least_reached

MATCHED = "cap_oid bigint, auth_oid bigint, distance_m double"


def solve(pairs: list[tuple[int, int, int]]) -> dict[int, int]:
    """Largest matching of least cost, ``left -> right``, of ``(left, right, cost)`` with costs from 0 on.

    Every left may also stay alone, at a price above all costs together; so the cheapest way to place all
    lefts is the largest matching, and of those the cheapest. Lefts are placed one by one: a shortest path in
    reduced costs leads from the new one over placed ones to a free right or to one that now stays alone, and
    prices are raised so that reduced costs stay non-negative. A search sees its own surroundings only.
    """
    edges: dict[int, list[tuple[int, int]]] = {}
    for left, right, cost in sorted(pairs):
        edges.setdefault(left, []).append((right, cost))
    alone = sum(c for _, _, c in pairs) + 1
    price = {b: 0 for _, b, _ in pairs}
    rent: dict[int, int] = {}
    of_left: dict[int, int] = {}
    of_right: dict[int, int] = {}
    for start, own in edges.items():
        rent[start] = min(c - price[b] for b, c in own)
        reach: dict[int, int] = {}
        back: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        settled: list[tuple[int, int]] = [(start, 0)]  # lefts and their distance
        done: set[int] = set()  # rights whose distance is final
        left, d = start, 0
        best, end = alone - rent[start], None  # what it costs to leave one of the settled lefts alone, and which
        last = start
        while True:
            for b, c in edges[left]:
                if b not in done:
                    new = d + c - rent[left] - price[b]
                    if new < reach.get(b, new + 1):
                        reach[b], back[b] = new, left
                        heapq.heappush(heap, (new, b))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] > best:
                break
            d, b = heapq.heappop(heap)
            if b not in of_right:
                best, end = d, b
                break
            done.add(b)
            left = of_right[b]
            settled.append((left, d))
            if d + alone - rent[left] < best:
                best, last = d + alone - rent[left], left
        for a, x in settled:
            rent[a] += best - x
        for b in done:
            price[b] -= best - reach[b]
        if end is None:
            if last == start:
                continue  # nothing is gained by placing it
            end = of_left.pop(last)
        while True:
            a = back[end]
            before = of_left.get(a)
            of_left[a], of_right[end] = end, a
            if a == start:
                break
            end = before
    return of_left


def _solve_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["component", "cap_oid"], kind="stable")
    component = rows["component"].to_numpy()
    edges = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(rows)]
    caps, out = rows["cap_oid"].tolist(), []
    auths, costs, distances = ([x.tolist() for x in rows[n]] for n in ("auth_oids", "ums", "distances"))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j == i + 1:  # alone: its nearest
            out.append((caps[i], auths[i][0], distances[i][0]))
            continue
        pairs = [(caps[k], b, c) for k in range(i, j) for b, c in zip(auths[k], costs[k], strict=True)]
        own = {caps[k]: k for k in range(i, j)}
        out += [(a, b, distances[own[a]][auths[own[a]].index(b)]) for a, b in solve(pairs).items()]
    return pd.DataFrame(out, columns=["cap_oid", "auth_oid", "distance_m"])


def assign(pairs: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(cap_oid, auth_oid, distance_m)`` of the optimal assignment; ``pairs`` as from ``pairs_within``."""
    return assign_listed(checkpoint(listed(pairs.select("cap_oid", "auth_oid", "distance_m"))), checkpoint)


def assign_listed(lists: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``assign``, of ``candidates.listed``, which is read several times and has one row for each captured row."""
    first = lambda name: F.get("found", F.lit(0))[name].alias(name)
    several = lists.where(F.size("found") > 1)
    # of the rows that have no candidate but the same record only the nearest can get it
    rivals = lists.where(F.size("found") == 1).select("cap_oid", first("auth_oid"), first("um"), first("distance_m"))
    best = rivals.groupBy("auth_oid").agg(F.min(F.struct("um", "cap_oid", "distance_m")).alias("m"))
    alone = best.select("m.cap_oid", F.array("auth_oid").alias("auth_oids"), F.array("m.um").alias("ums"), F.array("m.distance_m").alias("distances"))
    rows = several.select("cap_oid", F.col("found.auth_oid").alias("auth_oids"), F.col("found.um").alias("ums"), F.col("found.distance_m").alias("distances")).unionByName(alone)
    # records that share a captured row are linked to the least of them: the same components, with records for nodes only
    linked = several.select(F.array_min("found.auth_oid").alias("src"), F.explode("found.auth_oid").alias("dst")).where("src <> dst")
    labels = least_reached(linked, checkpoint)
    some = F.get("auth_oids", F.lit(0))
    labelled = rows.withColumn("_some", some).join(labels, F.col("_some") == F.col("node"), "left").withColumn("component", F.coalesce("component", "_some")).drop("node", "_some")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = labelled.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts * 8)))
    return dealt.groupBy("part").applyInPandas(_solve_group, MATCHED)


def with_override(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """``matches`` with ``assignment_overridden_nearest``: whether a nearer candidate than the assigned one exists."""
    near = nearest(pairs).select("cap_oid", F.col("auth_oid").alias("nearest_oid"))
    return matches.join(near, "cap_oid", "left").withColumn("assignment_overridden_nearest", ~F.col("auth_oid").eqNullSafe(F.col("nearest_oid"))).drop("nearest_oid")
