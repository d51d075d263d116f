"""Repair of conversation structure at least cost.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Rows may be kept (K, cost 0), given the
other role (R, 2) or deleted (D, 3; blank and repeated rows must be), and empty user or assistant rows may be
inserted anywhere (I, 2); a truncated row that isn't deleted costs 1 more. Of all edits that give a well-formed
conversation the cheapest are sought, and of those the ones whose initials in order, the audit, come first in
ASCII. The audit determines the repaired conversation.

Knuth's algorithm (1977) finds them: an item says that the rows up to some place are repaired and which state
of the grammar that leads to; deductions lead from item to item, each by an edit that adds to the cost and
lengthens the audit, so no item weighs less than what it was deduced from. An agenda hands out the lightest
item there is; it is final then. Two audits of one item and of equal cost are never a prefix one of the other
(what follows would be insertions, which cost), so weights keep their order when they are lengthened alike.

No conversation is gathered with its texts. Rows are range-sorted by conversation and turn and cut into
segments of at most ``SEGMENT`` rows of one conversation; a segment's lightest derivations between any two
states follow from a letter or two a row. Segments of one conversation are then joined, ``FAN`` neighbours at
a time, by the same agenda, whose deductions are now whole segments: a logarithmic number of rounds. The audit
is read back against the rows by their places. One string of a letter a row is all that a conversation needs
in one task; the checksum of a repaired conversation is a chain over its lines, which one task reads in order,
a batch at a time.

Cases: a null role or text is one space, and such a role can't be kept; an empty role neither; a null turn
comes first; a null ``conv_id`` is one conversation; rows that repeat are rows of their own, and all but the
first of them faults; rows of one turn come in the order of a hash of role and text; a conversation without
rows, or all of whose rows are deleted, is repaired to an empty one; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

SEGMENT = 256  # rows
FAN = 16  # segments joined at once
PARTITION_BYTES = 32 << 20  # of text in each range, about
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1

_SPACE = " \t\n\v\f\r"
# The grammar: at the start, after s, u, a. A conversation may end at the start or after a.
START, S, U, A = range(4)
_ENDS = (START, A)
_NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
# What a row with a free role becomes: the only one of user and assistant that may follow.
_FREE = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
_LEGAL = {"su", "ua", "au"}

Item = tuple[int, int]  # rows or segments behind it, state
Weight = tuple[int, str]  # cost, audit


def lightest(start: Item, deductions: Callable[[Item], Iterable[tuple[int, str, Item]]], goals: set[Item]) -> dict[Item, Weight]:
    """Final weights of those ``goals`` that follow from ``start``."""
    agenda: list[tuple[int, str, Item]] = [(0, "", start)]
    final: dict[Item, Weight] = {}
    missing = set(goals)
    while agenda and missing:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        missing.discard(item)
        for more, letters, reached in deductions(item):
            if reached not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, reached))
    return {g: final[g] for g in goals if g in final}


@functools.lru_cache(maxsize=50_000)
def of_rows(roles: str, faults: str) -> tuple[tuple[int, int, int, str], ...]:
    """``(from, to, cost, audit)`` between states over rows with these initials and faults (b, d, t or k)."""

    def edits(item: Item) -> Iterator[tuple[int, str, Item]]:
        k, state = item
        free = _FREE[state][1]
        yield INSERT[1], INSERT[0], (k, free)
        if k == len(roles):
            return
        yield DELETE[1], DELETE[0], (k + 1, state)
        if faults[k] in "bd":
            return
        more = TRUNCATED if faults[k] == "t" else 0
        yield REROLE[1] + more, REROLE[0], (k + 1, free)
        kept = _NEXT.get((state, roles[k]))
        if kept is not None:
            yield KEEP[1] + more, KEEP[0], (k + 1, kept)

    return _between(len(roles), edits)


def of_segments(segments: list[list[tuple[int, int, int, str]]]) -> tuple[tuple[int, int, int, str], ...]:
    """The same over neighbouring segments, from what is known of each."""
    leads = [{a: [x for x in own if x[0] == a] for a in range(4)} for own in segments]

    def steps(item: Item) -> Iterator[tuple[int, str, Item]]:
        k, state = item
        if k < len(leads):
            for _, to, cost, audit in leads[k][state]:
                yield cost, audit, (k + 1, to)

    return _between(len(segments), steps)


def _between(size: int, deductions) -> tuple[tuple[int, int, int, str], ...]:
    goals = {(size, state) for state in range(4)}
    return tuple((a, to, *w) for a in range(4) for (_, to), w in sorted(lightest((0, a), deductions, goals).items()))


def of_conversation(items: Iterable[tuple[int, int, int, str]]) -> Weight:
    return min((cost, audit) for a, to, cost, audit in items if a == START and to in _ENDS)


def decode(roles: str, audit: str) -> Iterator[tuple[str | None, bool, str | None, str | None]]:
    """For each row: the lines inserted before it, whether it stays, its new role if any, and the lines inserted behind
    it (behind the last row only)."""
    state, k = START, 0
    lead: list[str] = []
    row = None
    for letter in audit:
        if letter == INSERT[0]:
            role, state = _FREE[state]
            lead.append(f"{role}:")
            continue
        if row is not None:
            yield *row, None
        new = None
        if letter == REROLE[0]:
            new, state = _FREE[state]
        elif letter == KEEP[0]:
            state = _NEXT[state, roles[k]]
        row, lead, k = ("\n".join(lead) or None, letter != DELETE[0], new), [], k + 1
    if row is not None:
        yield *row, "\n".join(lead) or None


# ---- tables --------------------------------------------------------------------------------------

_ITEMS = "array<struct<a:int,b:int,cost:long,audit:string>>"
_PLACES = "array<struct<part:long,pos:long,n:long>>"
_PIECE = f"roles string, faults string, first_turn long, last_turn long, n_turns long, items {_ITEMS}, places {_PLACES}"


def _known(conversations: DataFrame) -> DataFrame:
    own = F.struct(F.col("conv_id")).alias("conv")
    text = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    return conversations.select(own, F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by a hash of conversation and turn: rows dropped, emptied,
    stripped of sentence ends, repeated, or given to the user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv.conv_id", "turn")))
    rows = _known(conversations).withColumn("kind", F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20)))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind != 0").select("conv.conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """A stored table ``(conv, turn, role, text, key, part, pos)``: rows in order, their places in ranges."""
    rows = _known(conversations).withColumn("key", F.sha2(F.encode(F.concat_ws(":", F.char_length("role"), "role", "text"), "UTF-8"), 256))
    size = conversations.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100)).first()[0] or 0
    order = [F.asc("conv"), F.asc("turn"), F.asc("key")]
    ranged = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return materialize(ranged.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "turns")


def segments(turns: DataFrame, rows: int = SEGMENT) -> DataFrame:
    """``(conv, part, pos, n, roles, faults, first_turn, last_turn, n_turns)`` for at most ``rows`` rows of one conversation."""
    # the first of equal rows, aggregated before the shuffle
    first = turns.groupBy("conv", "key").agg(F.min(F.struct("part", "pos")).alias("at")).select("at.part", "at.pos", F.lit(True).alias("first"))
    inked = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(F.col("ink") == "", "b").when(F.col("first").isNull(), "d").when(F.col("ink").isin(*".!?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    marked = turns.select("conv", "turn", "part", "pos", F.when(initial.isin(*"sua"), initial).otherwise("x").alias("role"), F.substring(inked, -1, 1).alias("ink"))
    marked = marked.join(first, ["part", "pos"], "left").withColumn("fault", fault)
    own = marked.groupBy("conv", "part", F.expr(f"pos div {rows}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "fault"))).alias("rows"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.size(F.collect_set("turn")).cast("long").alias("n_turns"),
    )
    letters = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "").alias(name + "s")
    return own.select("conv", "part", F.col("rows")[0]["pos"].alias("pos"), F.size("rows").cast("long").alias("n"), letters("role"), letters("fault"), "first_turn", "last_turn", "n_turns")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    return iter(batch.to_pylist())


def _arrow(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _mapped(df: DataFrame, f: Callable[[dict], Iterable[dict]], schema: str, most: int = 5_000) -> DataFrame:
    """``f`` of each row, whose results are handed on in bounded batches."""
    arrow = _arrow(schema, df.sparkSession)

    def run(batches):
        found: list[dict] = []
        for batch in batches:
            for row in _rows(batch):
                for out in f(row):
                    found.append(out)
                    if len(found) >= most:
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)
                        found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(run, schema)


def _item_rows(items: Iterable[tuple[int, int, int, str]]) -> list[dict]:
    return [dict(zip(("a", "b", "cost", "audit"), x, strict=True)) for x in items]


def _solved(row: dict) -> Iterator[dict]:
    kept = {k: row[k] for k in ("conv", "part", "pos", "roles", "faults", "first_turn", "last_turn", "n_turns")}
    places = [{k: row[k] for k in ("part", "pos", "n")}]
    yield kept | {"items": _item_rows(of_rows(row["roles"], row["faults"])), "places": places}


def _joined(row: dict) -> Iterator[dict]:
    own = row["pieces"]
    n_turns, last = 0, None
    for p in own:
        n_turns += p["n_turns"] - (p["n_turns"] > 0 and p["first_turn"] == last)
        last = p["last_turn"] if p["n_turns"] else last
    items = of_segments([[(x["a"], x["b"], x["cost"], x["audit"]) for x in p["items"]] for p in own])
    turns = [p for p in own if p["n_turns"]]
    yield {
        "conv": row["conv"], "idx": row["idx"], "of": row["of"], "roles": "".join(p["roles"] for p in own), "faults": "".join(p["faults"] for p in own),
        "first_turn": turns[0]["first_turn"] if turns else None, "last_turn": last, "n_turns": n_turns,
        "items": _item_rows(items), "places": [x for p in own for x in p["places"]],
    }


def _finished(row: dict) -> Iterator[dict]:
    cost, audit = of_conversation((x["a"], x["b"], x["cost"], x["audit"]) for x in row["items"])
    roles = row["roles"]
    gaps = row["last_turn"] - row["first_turn"] + 1 - row["n_turns"] if row["n_turns"] else 0
    yield {
        "conv": row["conv"], "gaps": gaps, "blank": row["faults"].count("b"), "duplicate": row["faults"].count("d"), "truncated": row["faults"].count("t"),
        "illegal": sum(roles[k : k + 2] not in _LEGAL for k in range(len(roles) - 1)), "cost": cost, "audit": audit, "roles": roles, "places": row["places"],
    }


def _edits(row: dict) -> Iterator[dict]:
    at = ((p["part"], p["pos"] + k) for p in row["places"] for k in range(p["n"]))
    for (part, pos), (lead, stays, role, tail) in zip(at, decode(row["roles"], row["audit"]), strict=True):
        yield {"part": part, "pos": pos, "lead": lead, "stays": stays, "new_role": role, "tail": tail}


def repairs(turns: DataFrame, rows: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """A stored table of one row for each conversation of ``turns``, a table of ``ordered``: ``(conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, roles, places)``."""
    conv = turns.select("conv").schema["conv"].dataType.simpleString()
    solved = _mapped(segments(turns, rows), _solved, f"conv {conv}, part long, pos long, {_PIECE}")
    mine = Window.partitionBy("conv")
    order = mine.orderBy("part", "pos")
    names = [f.split()[0] for f in ("roles", "faults", "first_turn", "last_turn", "n_turns", "items", "places")]
    pieces = materialize(solved.select("conv", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.count("*").over(mine).alias("of"), *names), "pieces")
    while not pieces.where("of > 1").isEmpty():
        group = F.expr(f"idx div {fan}").alias("idx")
        near = pieces.where("of > 1").groupBy("conv", group, F.ceil(F.col("of") / fan).cast("long").alias("of")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("k"), *names))).alias("pieces"))
        pieces = materialize(pieces.where("of = 1").unionByName(_mapped(near, _joined, f"conv {conv}, idx long, of long, {_PIECE}", most=100)), "pieces")
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return materialize(_mapped(pieces, _finished, f"conv {conv}, {counts}, audit string, roles string, places {_PLACES}"), "repairs")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, part, pos, lines)`` in no order: what stands where a row of ``turns`` was, ``role:text`` by line, with the
    rows inserted before it (behind the last as well); rows that leave nothing are left out."""
    edits = _mapped(found.select("roles", "audit", "places"), _edits, "part long, pos long, lead string, stays boolean, new_role string, tail string")
    own = F.when(F.col("stays"), F.concat_ws(":", F.coalesce("new_role", "role"), "text"))
    return turns.join(edits, ["part", "pos"]).select("conv", "part", "pos", F.concat_ws("\n", "lead", own, "tail").alias("lines"), F.coalesce("lead", own, "tail").isNotNull().alias("some")).where("some").drop("some")


def checksums(lines: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of each conversation's lines, joined by line ends, in order of their places."""
    conv = lines.select("conv").schema["conv"].dataType.simpleString()
    order = ["conv", "part", "pos"]
    arrow = _arrow(f"conv {conv}, sha256 string", lines.sparkSession)

    def run(batches):
        at, chain, done = None, None, []
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != at:
                    if chain is not None:
                        done.append({"conv": at, "sha256": chain.hexdigest()})
                    at, chain = own, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(text.as_buffer() if text.is_valid else b"")
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if chain is not None:
            yield pa.RecordBatch.from_pylist([{"conv": at, "sha256": chain.hexdigest()}], schema=arrow)

    return lines.repartition("conv").sortWithinPartitions(*order).select("conv", "lines").mapInArrow(run, f"conv {conv}, sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(turns, repairs, lines)``: the ordered rows, a row for each conversation, and the repaired rows."""
    turns = ordered(conversations)
    found = repairs(turns)
    return turns, found, repaired(turns, found)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    _, found, lines = repair(damage(conversations))
    every = conversations.select(F.struct("conv_id").alias("conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = every.join(found, "conv", "left").join(checksums(lines), "conv", "left")
    return rows.select(
        "conv.conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


# ---- the same in SQL: weights of the four states, row by row -------------------------------------


def _oracle() -> str:
    def add(weight: str, edit: tuple[str, int], line: str = "''", more: str = "0") -> str:
        return f"CASE WHEN {weight} IS NOT NULL THEN {{'c': {weight}.c + {edit[1]} + {more}, 'a': {weight}.a || '{edit[0]}', 't': {weight}.t || {line}}} END"

    def least(*weights: str) -> str:
        return f"list_sort([{', '.join(weights)}], 'ASC', 'NULLS LAST')[1]"

    user, assistant = ("chr(10) || 'user:'", "chr(10) || 'assistant:'")
    into_u = least("u", add("q", INSERT, user), add("s", INSERT, user), add("a", INSERT, user))
    into_a = least("a", add("u1", INSERT, assistant))
    late = f"CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END"
    kept, as_user, as_assistant = ("chr(10) || role || ':' || text", f"{user} || text", f"{assistant} || text")
    stays = lambda weights, initial="": f"CASE WHEN fault NOT IN ('b', 'd'){f" AND role[1] = '{initial}'" if initial else ''} THEN {weights} END"
    keep = lambda w: add(w, KEEP, kept, late)
    new_s = least(add("s", DELETE), stays(keep("q"), "s"))
    new_u = least(add("u1", DELETE), *(x for w in ("q", "s", "a1") for x in (stays(keep(w), "u"), stays(add(w, REROLE, as_user, late)))))
    new_a = least(add("a1", DELETE), stays(keep("u1"), "a"), stays(add("u1", REROLE, as_assistant, late)))
    return f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS left_by
  FROM range(256) r(b)
), known AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), kinds AS (
  SELECT * EXCLUDE (key), xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
    lambda c, b: xor(c >> 8, left_by[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM known, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS i FROM damaged
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'k' ELSE 't' END AS fault,
    role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id
), weights AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, {add("q", DELETE)}, {new_s}, {new_u}, {new_a}
  FROM (
    SELECT *, {into_a} AS a1 FROM (
      SELECT weights.* EXCLUDE (i), turns.i, turns.role, turns.text, turns.fault, {into_u} AS u1
      FROM weights JOIN turns ON turns.conv_id IS NOT DISTINCT FROM weights.conv_id AND turns.i = weights.i + 1
    )
  )
), best AS (
  SELECT conv_id, {least("q", "a1")} AS w FROM (
    SELECT *, {into_a} AS a1 FROM (SELECT weights.*, {into_u} AS u1 FROM weights JOIN counted ON counted.conv_id IS NOT DISTINCT FROM weights.conv_id AND counted.n = weights.i)
  )
)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS every
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM every.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM every.conv_id
"""


ORACLE = _oracle()
