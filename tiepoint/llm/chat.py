"""Chat formatting of reply trees with DataFrame functions.

Messages form trees: each has a parent in its conversation or none. Iterative self-joins double the distance
at which every message knows an ancestor, and add up scores on the way, until all reach their roots: a
logarithmic number of rounds, whatever the branching, with rows of constant width. Leaves then stand for
root-to-leaf paths; they are ranked by their messages' mean score, and only the chosen ones are enumerated,
by joining with the doubled distances in falling order. No conversation is gathered before it is formatted.

Template: ``<|role|>``, a line end, the text, ``</s>`` and a line end for each message. Control strings
inside roles and texts get a backslash behind their first character, and backslashes are doubled; taking
each backslash away and keeping what follows it gives the text back. The loss mask is a list of spans
(code points of the formatted text, end exclusive), one around each assistant text.

Cases: null role or text is empty; rows that repeat are messages of their own, in order of role and text
where turns tie; a null ``conv_id`` is one conversation; a null ``turn`` comes first; a message whose
parent doesn't exist is a root; messages on a cycle have no root and are left out; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

# Control strings that texts may not contain as such.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
_BREAK = r"(<(?=/?s>|<?/?SYS>>|</?SYS>>|\|)|\[(?=/?INST\])|\|(?=>))"
END = "</s>\n"
# Joins of doubled distances between two stored tables of paths.
LEVELS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _BREAK, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of ``(conv_id, turn, role, text)``: each turn answers the one before it."""
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(turns).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """``(conv_id, path, rank, score)``: the ``best`` root-to-leaf paths (all if None) of ``messages``, a stored table
    ``(conv_id, node, parent, role, text, score)``. Ties in score go to the smaller leaf."""
    own = messages.select(F.struct("conv_id").alias("conv"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    above = own.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = own.join(above, ["conv", "parent"], "left")
    hop = linked.select("conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    hops, left = [], 1
    ended = None
    # a message that has an ancestor at a distance of as many messages as there are is on a cycle, or answers one
    most = messages.count()
    while left and (not hops or 1 << (len(hops) - 1) <= most):
        if hops:
            # only messages that haven't reached their root take part; each of them answers a message that is there
            a = hops[-1].where("up is not null")
            b = a.unionByName(ended).select("conv", F.col("node").alias("via"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("steps").alias("further"))
            a, b = a.alias("a"), b.alias("b")
            met = a.join(b, (F.col("a.conv") == F.col("b.conv")) & (F.col("a.up") == F.col("via")))
            hop = met.select(F.col("a.conv").alias("conv"), "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps"))
        seen = Observation()
        hops.append(materialize(hop.observe(seen, F.count("up").alias("left")), "hops"))
        left = seen.get["left"]
        roots = hops[-1].where("up is null")
        ended = roots if ended is None else ended.unionByName(roots)
    inner = hops[0].where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    leaves = ended.join(inner, ["conv", "node"], "left_anti")
    ranked = leaves.select("conv", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("score"), "steps")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    found = materialize(ranked.select("conv", "leaf", "rank", "score", F.col("leaf").alias("at"), F.col("steps").alias("place")), "paths")
    # every distance is a sum of powers of two in one way: each row stays and, where there is one, brings the ancestor at 2^k
    for k in range(len(hops) - 1, -1, -1):
        far = hops[k].where("up is not null").select("conv", F.col("node").alias("at"), "up")
        own, moved = F.struct("at", "place"), F.struct(F.col("up").alias("at"), (F.col("place") - (1 << k)).alias("place"))
        both = F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, moved))
        found = found.join(far, ["conv", "at"], "left").select("conv", "leaf", "rank", "score", F.inline(both))
        if k and k % LEVELS == 0:
            found = materialize(found, "paths")
    paths = found.groupBy("conv", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct("place", "at"))).alias("path"))
    return paths.select("conv.conv_id", F.transform("path", lambda x: x["at"]).alias("path"), "rank", "score")


def format_paths(messages: DataFrame, paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(conv_id, rank, formatted, loss_spans)``: one row for each path."""
    steps = paths.select(F.struct("conv_id").alias("conv"), "rank", F.posexplode("path").alias("pos", "node"))
    texts = messages.select(F.struct("conv_id").alias("conv"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = steps.join(texts, ["conv", "node"]).select(
        "conv", "rank", "pos",
        F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == trained).alias("loss"),
    )
    turns = shown.groupBy("conv", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "body", "loss"))).alias("turns"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        spans = F.when(t["loss"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return turns.select(
        "conv.conv_id", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The messages of a formatted text: array of ``(role, text)``."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(t, F.lit(3), F.instr(t, F.lit("|>\n")) - 3)).alias("role"),
        unescape(F.substring(t, F.instr(t, F.lit("|>\n")) + 3, F.char_length(t))).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: unescape(F.substring(formatted, x["start"] + 1, x["end"] - x["start"]))), "")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = materialize(linear(rows), "messages")
    done = materialize(format_paths(messages, reply_paths(messages)), "formatted")
    read = done.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
