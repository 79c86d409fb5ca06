"""Chat logs: cumulative snapshots collapsed to the longest one, then rendered for training.

Method: cumulative-snapshot collapse. Logging systems store a conversation again each time it grows. Each turn gets a rolling
hash of all turns up to it; a conversation whose last hash is an earlier turn's hash of another one is a prefix of that one.
An anti-join against the set of such prefix hashes retains the maximal conversations, which are then rendered.

Plan: JVM expressions throughout. A turn's hash covers its place, role and text, and the rolling hash is a running
exclusive-or of two independent 64-bit hashes, so a window over the conversation computes it in one pass that spills. Only
hashes go through the windows and joins; the texts of the conversations that stay are read at the end, for the narrow table of
their ids that is stored before.
Conversations that are the same turn for turn are one row (of the smallest id) before the join, and prefix hashes are made
distinct on the map side, so that a first turn or a whole conversation logged very often is one row on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import scratch

#: Around a turn's role and text, and after the text: a common template's markers (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn(role: str, text: str) -> list[Column]:
    """Two hashes of a turn; a null role or text hashes apart from an empty one."""
    told = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*told).alias("d"), F.xxhash64(F.lit("second"), *told).alias("e")]


def hashed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), h and g (the rolling hashes): no text is shuffled.

    Turns stand in the order of ``turn``, nulls first, and of a hash where that is equal; repeated rows are turns of their
    own. Rows without a conversation id are not looked at.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "d", "e")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *_turn(role, text))
    placed = slim.withColumn("place", F.row_number().over(order))
    return placed.select("conv", "place", F.bit_xor(F.xxhash64("place", "d")).over(running).alias("h"), F.bit_xor(F.xxhash64("place", "e")).over(running).alias("g"))


def rendered(role: Column, text: Column) -> Column:
    """One turn; a null role is `unknown`, a null text empty. A marker inside a text loses its bar, so it cannot end a turn."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")
    return F.concat(F.lit(OPEN), F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\s<>|]+", "_"), F.lit("\n"), safe, F.lit(CLOSE))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, n_turns, n_copies (logged conversations with the same turns, itself included) and chat (all turns rendered)
    of each maximal conversation.

    A conversation goes if its turns are the first ones of a longer conversation's; of equal ones that of the smallest id
    stays. A row without a conversation id is a conversation of one turn, named null where no named one is the same. An empty
    table gives an empty result. A conversation must fit a row, as its rendering is one.
    """
    rows = hashed(turns, conv, turn, role, text)
    last = rows.groupBy("conv").agg(F.max_by(F.struct("h", "g"), "place").alias("key"), F.max("place").alias("n_turns"))
    last = last.select("conv", "key.h", "key.g", "n_turns", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("chat"))
    lone = turns.where(F.col(conv).isNull()).select(*_turn(role, text), rendered(F.col(role), F.col(text)).alias("chat"))
    lone = lone.select(F.xxhash64(F.lit(1), "d").alias("h"), F.xxhash64(F.lit(1), "e").alias("g"), "chat").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("chat").alias("chat"))
    every = last.unionByName(lone.select(F.lit(None).cast(turns.schema[conv].dataType).alias("conv"), "h", "g", F.lit(1).alias("n_turns"), "n", "chat"))
    unique = every.groupBy("h", "g", "n_turns").agg(F.min("conv").alias("named"), F.sum("n").alias("n_copies"), F.max("chat").alias("chat"))
    prefixes = rows.withColumn("turns", F.max("place").over(Window.partitionBy("conv"))).where(F.col("place") < F.col("turns"))
    kept = scratch.stored(unique.join(prefixes.select("h", "g").distinct(), ["h", "g"], "left_anti").select(F.col("named").alias("kept"), "n_turns", "n_copies", "chat"), "kept")
    full = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), *_turn(role, text), rendered(F.col(role), F.col(text)).alias("chat")).alias("t"))
    told = full.join(kept.drop("chat"), F.col("conv") == F.col("kept")).groupBy("conv", "n_turns", "n_copies").agg(F.collect_list("t").alias("ts"))
    by_turn = F.array_sort("ts", _in_order)
    told = told.select(F.col("conv").alias(conv), F.col("n_turns").cast("long"), "n_copies", F.array_join(F.transform(by_turn, lambda t: t["chat"]), "").alias("chat"))
    return told.union(kept.where("kept is null").select(F.col("kept").alias(conv), F.col("n_turns").cast("long"), "n_copies", "chat"))


def _in_order(a: Column, b: Column) -> Column:
    """Compares two turns as ``hashed`` orders them."""
    out = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    for c in ("turn", "d", "e"):
        out = out.when(a[c] < b[c], -1).when(a[c] > b[c], 1)
    return out.otherwise(0)
