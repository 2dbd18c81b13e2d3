"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with the same group key are linked with each other. Members of a group are alike, so the state of
the propagation is the number of a group's members in each shard, at most ``n_shards`` rows a group however
large it is. In every round a group's members in one shard wish for the shard that holds most of the group;
wishes are granted in exchange for opposite ones and as far as a shard has room below its quota, as shares of
the 64 or so sums that reach the driver. Afterwards documents take their shards by their rank in the group,
and unlinked ones fill the quotas exactly. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import hash_order, hash_share, prefix_sums
from spotweave.session import materialize

ROUNDS = 12
HOT_PARTS = 1000  # groups above one part in so many of all rows number fewer than this, and are broadcast


def _granted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each wish (from, to) that exchange and room allow."""
    exchanged = {ab: min(n, wishes.get(ab[::-1], 0)) for ab, n in wishes.items()}
    coming = [sum(n - exchanged[ab] for ab, n in wishes.items() if ab[1] == to) for to in range(len(room))]
    return {
        ab: (exchanged[ab] + (n - exchanged[ab]) * min(1.0, room[ab[1]] / max(1, coming[ab[1]]))) / n
        for ab, n in wishes.items()
    }


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(group, shard, n, group_rows) after propagation from such a state."""
    k = len(quotas)
    in_group = Window.partitionBy("group")
    for number in range(rounds):
        load = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # one row per shard
        room = [max(0, quotas[s] - load.get(s, 0)) for s in range(k)]
        roomy = [s for s in range(k) if room[s] > 0]
        own = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
        best = F.max(own).over(in_group)
        best_with_room = F.max(F.when(F.col("shard").isin(roomy), own)).over(in_group)
        wish = F.when(F.col("group_rows") <= min(quotas), best).otherwise(best_with_room)
        asked = state.withColumn("_best", wish).withColumn("_own", own)
        asked = asked.withColumn("_to", F.when(F.col("_own") < F.col("_best"), F.col("_best.shard"))).drop("_best", "_own")
        asked = materialize(asked, "shard-wishes")
        wishes = {
            (r["shard"], r["_to"]): r["n"]
            for r in asked.where("_to is not null").groupBy("shard", "_to").agg(F.sum("n").alias("n")).collect()
        }  # at most shards squared rows
        shares = _granted(wishes, room)
        if not any(shares.values()):
            break
        table = F.array(*[F.lit(float(shares.get((a, b), 0.0))) for a in range(k) for b in range(k)])
        share = F.element_at(table, (F.col("shard") * k + F.coalesce("_to", F.lit(0)) + 1).cast("int"))
        moved = F.least("n", F.floor(F.col("n") * share + hash_share(F.lit(number), "group", "shard")).cast("long"))
        moved = F.when(F.col("_to").isNull() | (share == 0), F.lit(0).cast("long")).otherwise(moved)
        asked = asked.withColumn("_moved", moved)
        stay = asked.select("group", "shard", (F.col("n") - F.col("_moved")).alias("n"), "group_rows")
        go = asked.where("_moved > 0").select("group", F.col("_to").alias("shard"), F.col("_moved").alias("n"), "group_rows")
        state = (
            stay.unionByName(go)
            .where("n > 0")
            .groupBy("group", "shard")
            .agg(F.sum("n").alias("n"), F.max("group_rows").alias("group_rows"))
        )
    return state


def shard(docs: DataFrame, group: Column, doc_id: str = "doc_id", n_shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """All columns of ``docs`` with ``_shard`` and ``_slot`` (from 0 without gaps within the shard).

    Numbers of rows per shard differ by one at most. Rows of an equal, non-null ``group`` are linked and stay
    together as far as the quotas allow; a group larger than a shard fills as few shards as propagation finds.
    A null group links with nothing. Repeated rows are rows of their own. An empty table gives an empty table.
    ``docs`` is read several times: give it written and narrow.
    """
    key = F.coalesce(F.concat(F.lit("g"), F.md5(group.cast("string"))), F.concat(F.lit("n"), hash_order(F.lit("one"), doc_id)))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("_group"), hash_order(F.lit("shard"), doc_id).alias("_order")
    ).withColumn("_bucket", F.substring("_order", 1, 3))
    ranked = prefix_sums(rows, ["_group"], ["_bucket"], ["_order"], out="_rank", total="_group_rows")
    ranked = materialize(ranked, "shard-ranks")
    linked = F.col("_group").startswith("g") & (F.col("_group_rows") > 1)
    n_rows = ranked.count()
    quotas = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]

    first = F.pmod(F.xxhash64("_order", "_rank"), F.lit(n_shards)).cast("int")
    state = (
        ranked.where(linked)
        .groupBy(F.col("_group").alias("group"), first.alias("shard"))
        .agg(F.count("*").alias("n"), F.max("_group_rows").alias("group_rows"))
    )
    state = materialize(propagate(state, quotas, rounds), "shard-state")

    load = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # one row per shard
    filled = [min(load.get(s, 0), quotas[s]) for s in range(n_shards)]
    over = [load.get(s, 0) - filled[s] for s in range(n_shards)]
    gaps = [quotas[s] - filled[s] for s in range(n_shards)]
    before = lambda counts: [sum(counts[:s]) for s in range(n_shards)]
    at = lambda values, index: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)

    placed = prefix_sums(
        state.withColumn("_key_bucket", F.substring("group", 2, 3)), ["shard"], ["_key_bucket"], ["group"], "n", "at"
    )
    by_shard = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.withColumn("from", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
        .groupBy(F.col("group").alias("_group"))
        .agg(F.collect_list(F.struct("from", "n", "shard", "at")).alias("_parts"), F.max("group_rows").alias("_rows"))
    )  # at most n_shards parts
    parts = materialize(parts, "shard-parts")
    hot = F.col("_rows") * HOT_PARTS > n_rows
    members = ranked.where(linked)
    in_hot = F.col("_group_rows") * HOT_PARTS > n_rows
    members = (
        members.where(in_hot)
        .join(F.broadcast(parts.where(hot).drop("_rows")), "_group")
        .unionByName(members.where(~in_hot).join(parts.where(~hot).drop("_rows"), "_group"))
    )
    mine = F.filter("_parts", lambda p: (p["from"] <= F.col("_rank")) & (F.col("_rank") < p["from"] + p["n"]))[0]
    members = members.withColumn("_part", mine)
    position = F.col("_part.at") + F.col("_rank") - F.col("_part.from")
    members = members.withColumn("_shard", F.col("_part.shard")).withColumn("_slot", position)
    over_by = F.col("_slot") - at(quotas, F.col("_shard"))
    floating = F.when(over_by >= 0, at(before(over), F.col("_shard")) + over_by)
    members = members.withColumn("_float", floating).drop("_parts", "_part")

    single = ranked.where(~linked).withColumn("_all", F.lit(0))
    single = single.withColumn("_b1", F.substring("_order", 1, 2)).withColumn("_b2", F.substring("_order", 1, 4))
    single = prefix_sums(single, ["_all"], ["_b1", "_b2"], ["_order"], out="_alone")
    single = single.withColumn("_float", F.col("_alone") + sum(over)).withColumns(
        {"_shard": F.lit(None).cast("int"), "_slot": F.lit(None).cast("long")}
    )

    starts = before(gaps)
    into = sum((F.when(F.col("_float") >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    columns = ["row", "_shard", "_slot", "_float"]
    out = members.select(*columns).unionByName(single.select(*columns)).withColumn("_into", into)
    floats = F.col("_float").isNotNull()
    return out.select(
        "row.*",
        F.when(floats, F.col("_into")).otherwise(F.col("_shard")).cast("int").alias("_shard"),
        F.when(floats, F.col("_float") - at(starts, F.col("_into")) + at(filled, F.col("_into")))
        .otherwise(F.col("_slot"))
        .cast("long")
        .alias("_slot"),
    )
