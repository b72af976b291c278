"""Documents dealt to shards: linked ones together, every shard the same number of rows.

Links are given as groups: members of a group are neighbours of each other. Balanced label propagation moves each linked row
to the shard in which most of its neighbours lie, as far as quotas allow:

- rows with neighbours are first dealt out in turn;
- each round counts a group's members by shard (an aggregation, so a group is never one task and its pairs are never made) and
  joins the counts to the members; every row wishes for the shard of most of its neighbours among those with room;
- a shard takes as many as its quota, those with most neighbours of the same wish first, groups together; the others have
  no place until the next round, when that shard has no room;
- the rows without neighbours, and what has no place after the last round, fill up what is left of the quotas.

A group of more rows than a shard may hold fills one shard and goes on in the next, and smaller groups make room for it as a
whole. Rounds end when nothing changes; `rounds` bounds them, which may cost links but never a row or a quota.

Only counts of shards, and of the ranges in which rows are numbered, come to the driver. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, whole_numbers
from .resampling import text_key
from .shared import discard, materialize

SHARDS = 8
ROUNDS = 30
FREE_ROUNDS = 6  # from then on a round moves half of the rows, so that rows of several groups don't change places for ever
LAW = "rows"


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _starts(sizes: list[int]) -> list[int]:
    out, before = [], 0
    for n in sizes:
        out.append(before)
        before += n
    return out


def _interval(at: Column, sizes: list[int]) -> Column:
    """Which of the intervals of these sizes, laid end to end, holds a place."""
    return F.size(F.filter(whole_numbers(_starts(sizes)[1:]), lambda s: s <= at)) if len(sizes) > 1 else F.lit(0)


def _wishes(members: DataFrame, held: DataFrame, shards: int, room: list[int], stay: Column) -> DataFrame:
    """(row, grp, shard, wish) of each row of members: of its own shard and those with room the one that has most of its
    neighbours, of as many the first in an order of the group's own; null if none has room. grp: the least of its groups.
    Rows for which `stay` holds, a condition on row and shard, wish for their own."""
    placed = members.join(held, "row")
    n = F.array(*[F.count(F.when(F.col("shard") == j, 1)) for j in range(shards)])
    tie = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.pmod(F.xxhash64("grp", j), F.lit(1 << 20)))
    pulls = placed.groupBy("grp").agg(n.alias("n")).select("grp", "n", tie.alias("tie"))
    of = [F.struct(F.sum(F.col("n")[j]).alias("n"), F.min(F.col("tie")[j]).alias("tie"), F.lit(j).alias("j")) for j in range(shards)]
    pulled = placed.join(pulls, "grp").groupBy("row").agg(F.min("grp").alias("grp"), F.max("shard").alias("shard"), F.array(*of).alias("by"))
    open_ = F.array(*[F.lit(r > 0) for r in room])
    best = F.array_max(F.filter("by", lambda b: open_[b["j"]] | b["j"].eqNullSafe(F.col("shard"))))
    return pulled.select("row", "grp", "shard", F.when(stay, F.col("shard")).otherwise(best["j"]).alias("wish"))


def _granted(wishes: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """(row, shard, was): the wish, or null for rows that a shard has no room for; and what is left of the quotas. Of the
    rows that wish for a shard those come first that most members of their group wish for it with, groups together."""
    asked = {r["wish"]: r["count"] for r in wishes.groupBy("wish").count().collect()}
    room = [max(0, q - asked.get(j, 0)) for j, q in enumerate(quota)]
    over = [j for j, q in enumerate(quota) if asked.get(j, 0) > q]
    told = lambda df, shard: df.select("row", shard.alias("shard"), F.col("shard").alias("was"))
    if not over:
        return told(wishes, F.col("wish")), room
    part = wishes.filter(F.col("wish").isin(over))
    pull = part.groupBy("grp", "wish").agg(F.count(F.lit(1)).alias("n"))
    pulled = materialize(part.join(pull, ["grp", "wish"]), "pulled")
    placed = numbered(pulled, [F.asc("wish"), F.desc("n"), F.asc("grp"), F.asc("row")], "at", "asked")
    start = whole_numbers(_starts([asked[j] if j in over else 0 for j in range(len(quota))]))[F.col("wish")]
    first = F.when(F.col("at") - start < whole_numbers(quota)[F.col("wish")], F.col("wish"))
    rest = wishes.filter(~F.col("wish").isin(over) | F.col("wish").isNull())
    return told(placed, first).unionByName(told(rest, F.col("wish"))), room


def propagate(members: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) of each row of members (row long, grp), a table, in which a row may be in several groups: at most
    quotas(rows, shards) of them in each shard, null for rows without a place. rows: how many there are with those that are
    in no group."""
    quota, room = quotas(rows, shards), [1] * shards
    linked = materialize(members.select("row").distinct(), "linked")
    held = materialize(numbered(linked, [F.asc("row")], "at", "dealt").select("row", F.pmod("at", F.lit(shards)).cast("int").alias("shard")), "held")
    discard(linked)
    for k in range(rounds):
        half = F.col("shard").isNotNull() & (F.pmod(F.xxhash64("row", F.lit(k)), F.lit(2)) == 1)
        wishes = materialize(_wishes(members, held, shards, room, half if k >= FREE_ROUNDS else F.lit(False)), "wishes")
        granted, room = _granted(wishes, quota)
        now = materialize(granted, "held")
        discard(held)
        discard(wishes)
        held = now
        if not held.filter(~F.col("shard").eqNullSafe(F.col("was"))).limit(1).count():
            break
    return held.select("row", "shard")


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of each row of docs; rows with equal texts are linked.

    Numbers of rows of shards are at most one apart; slots of a shard run from 0 without a gap. size is the number of UTF-8
    bytes of the text plus 1. A null text is an empty one: size 1, crc 0. Null and repeated ids are rows of their own, other
    columns aren't read. No rows give no rows; of fewer rows than shards the last shards have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), text_key(text).alias("grp"))
    rows = materialize(rows, "rows")
    several = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    members = materialize(rows.select("row", "grp").join(several, "grp"), "members")
    n = rows.count()
    state = propagate(members, n, shards, rounds)
    out = with_slots(rows, state, n, shards)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def with_slots(rows: DataFrame, state: DataFrame, n: int, shards: int) -> DataFrame:
    """The n rows with shard and slot: the shard that state (row, shard) has, and for others what is left of the quotas."""
    state = state.filter("shard is not null")
    held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    room = [q - held.get(j, 0) for j, q in enumerate(quotas(n, shards))]
    free = materialize(rows.select("row", "grp").join(state, "row", "left_anti"), "free")
    placed = numbered(free, [F.asc("grp"), F.asc("row")], "at", "filled").select("row", _interval(F.col("at"), room).alias("shard"))
    everyone = materialize(rows.join(state.unionByName(placed), "row"), "sharded")
    out = numbered(everyone, [F.asc("shard"), F.asc("row")], "at", "slots")
    return out.withColumn("slot", F.col("at") - whole_numbers(_starts(quotas(n, shards)))[F.col("shard")]).drop("at")
