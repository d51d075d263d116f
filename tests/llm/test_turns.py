"""Conversation repair: the agenda against exhaustive search, segments against whole conversations, the query against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from test_ops import SF

from tiepoint.llm import turns

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, part long, pos long, key string, audit string"


def faults(rows):
    """Initials and faults of ``(role, text)`` in order."""
    seen, found = set(), []
    for role, text in rows:
        ink = text.strip(" \t\n\v\f\r")
        found.append("b" if not ink else "d" if (role, text) in seen else "k" if ink[-1] in ".!?" else "t")
        seen.add((role, text))
    return "".join(r[:1] if r[:1] in "sua" and r else "x" for r, _ in rows), "".join(found)


def exhaustive(rows):
    """``(cost, audit, lines)`` of the cheapest edits, by trying all of them with up to two insertions in a place."""
    initials, fault = faults(rows)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    choices = []
    for (role, text), x, f in zip(rows, initials, fault, strict=True):
        own = [("D", 3, None, "")]
        if f not in "bd":
            late = f == "t"
            own += [("R", 2 + late, f"{r}:{text}", r[0]) for r in ("user", "assistant")]
            if x != "x":
                own.append(("K", late, f"{role}:{text}", x))
        choices.append(own)
    for edits in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            parts = [[("I", f"{r}:", r[0]) for r in put[0]]]
            for e, more in zip(edits, put[1:], strict=True):
                parts += [[(e[0], e[2], e[3])], [("I", f"{r}:", r[0]) for r in more]]
            flat = [x for p in parts for x in p]
            if GRAMMAR.fullmatch("".join(x[2] for x in flat)):
                found = cost, "".join(x[0] for x in flat), [x[1] for x in flat if x[1] is not None]
                best = min(best, found) if best else found
    return best


def test_the_agenda_finds_the_cheapest_edits():
    rnd = random.Random(4)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", "u", " ", ""]), rnd.choice(["Yes.", "no", "Well!", "", " \n"])) for _ in range(rnd.randint(0, 3))]
        roles, fault = faults(rows)
        cost, audit = turns.of_conversation(turns.of_rows(roles, fault))
        assert (cost, audit) == exhaustive(rows)[:2], rows
        lines = []
        for (role, text), (lead, stays, new, tail) in zip(rows, turns.decode(roles, audit), strict=True):
            lines += [x for x in (lead, f"{role if new is None else new}:{text}" if stays else None, tail) if x is not None]
        assert "\n".join(lines) == "\n".join(exhaustive(rows)[2])


def test_segments_join_to_the_whole():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randint(1, 40)
        roles, fault = ("".join(rnd.choice(c) for _ in range(n)) for c in ("suax", "kkktbd"))
        cuts = sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 6)))) if n > 1 else []
        own = [turns.of_rows(roles[a:b], fault[a:b]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        assert sorted(turns.of_segments(own)) == sorted(turns.of_rows(roles, fault))
        pair = [turns.of_segments(own[: len(own) // 2]), turns.of_segments(own[len(own) // 2 :])] if len(own) > 1 else own
        assert sorted(turns.of_segments(pair)) == sorted(turns.of_rows(roles, fault))


def test_a_derivation_is_popped_only_once_and_lightest_first():
    edges = {0: [(2, "b", 1), (2, "a", 2)], 1: [(0, "x", 3)], 2: [(0, "z", 3), (1, "", 1)]}
    step = lambda item: [(c, x, (0, to)) for c, x, to in edges.get(item[1], [])]
    assert turns.lightest((0, 0), step, {(0, 3)}) == {(0, 3): (2, "az")}
    assert turns.lightest((0, 3), step, {(0, 0)}) == {}


def brute(rows):
    """Rows of ``(gaps, blank, ..., sha256)`` by conversation, by the weights of the grammar's states."""
    found = {}
    shown = lambda v: " " if v is None else v
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, hashlib.sha256(f"{len(shown(r))}:{shown(r)}:{shown(x)}".encode()).hexdigest(), shown(r), shown(x)) for c, t, r, x in rows if c == conv))
        own_turns = [t for there, t, *_ in own if there]
        texts = [(r, x) for *_, r, x in own]
        roles, fault = faults(texts)
        weights = {0: (0, "", ())}
        put = lambda w, cost, letter, line: (w[0] + cost, w[1] + letter, w[2] + line)

        def inserted(weights):
            for _ in range(3):
                for state, w in list(weights.items()):
                    role, to = turns._FREE[state]
                    new = put(w, 2, "I", (f"{role}:",))
                    weights[to] = min(weights.get(to, new), new)
            return weights

        for (role, text), x, f in zip(texts, roles, fault, strict=True):
            after = {}
            for state, w in inserted(weights).items():
                options = [(state, put(w, 3, "D", ()))]
                if f not in "bd":
                    free, to = turns._FREE[state]
                    options.append((to, put(w, 2 + (f == "t"), "R", (f"{free}:{text}",))))
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, x))
                    if to is not None:
                        options.append((to, put(w, int(f == "t"), "K", (f"{role}:{text}",))))
                for to, new in options:
                    after[to] = min(after.get(to, new), new)
            weights = after
        weights = inserted(weights)
        cost, audit, lines = min(weights[s] for s in (0, 3) if s in weights)
        gaps = max(own_turns) - min(own_turns) + 1 - len(set(own_turns)) if own_turns else 0
        illegal = sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
        found[conv] = (gaps, *(fault.count(c) for c in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", "a") for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [(256, 16), (2, 2)])
def test_repair_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(turns, "PARTITION_BYTES", 3_000)  # several ranges, so that conversations straddle them
    rnd = random.Random(8)
    some = lambda: (rnd.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rnd.choice(["Yes.", "no", "A!\n ", "", None, " \t", "Ünd?", "x:y\nz."]))
    rows = [(c, t, *some()) for c in range(60) for t in rnd.sample(range(12), rnd.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]  # one long conversation
    rows += [(101, 5, "user", "Same.")] * 90 + [(102, None, *some()) for _ in range(5)] + [(None, t % 3, *some()) for t in range(9)]
    rows += [(103, 0, "user", "x" * 200_000 + "."), (103, 1, "assistant", "y " * 100_000)]
    ordered = turns.ordered(table(spark, rows))
    found = turns.repairs(ordered, *size)
    sums = {r.conv.conv_id: r.sha256 for r in turns.checksums(turns.repaired(ordered, found)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums.get(r.conv.conv_id, empty)) for r in found.collect()}
    assert got == brute(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! 3?") for c in range(40) for t in range(5)] + [(None, 3, None, None), (2, None, "user", "a.")]
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            one = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, turns.damage(table(spark, rows)).collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    _, found, lines = turns.repair(table(spark, []))
    assert found.count() == lines.count() == turns.checksums(lines).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_query(spark, sf):
    folder = SF.replace("sf0.001", sf)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(map(tuple, turns.op13(spark, folder).collect())) == sorted(db.sql(turns.ORACLE).fetchall())


def test_op13_of_null_and_dropped_rows(spark, tmp_path):
    """Conversations that lose all their rows stay; nulls in any column; one conversation in several segments."""
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b", ""])) for c in range(300) for t in range(rnd.randint(1, 2))]
    rows += [(None, None, None, None), (5, None, "user", "x."), (6, 4, None, "y."), (7, 3, "user", None)] + [(900, t, ("user", "assistant")[t % 2], f"{t}") for t in range(600)]
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: [(x is not None, x) for x in r]
    got = sorted(map(tuple, turns.op13(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(db.sql(turns.ORACLE).fetchall(), key=key) and len(got) == 302
    assert any(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in got)
