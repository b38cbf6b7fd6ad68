"""Operator 7, sharding by balanced label propagation.

Documents with equal text are linked; every document starts in the shard that its id hashes to, which is its label. In each
round the members of the groups that still lie in several shards are joined with their neighbours' labels of that moment and
ask for the shard that holds most of them, among those with room for them all. Quotas are on net moves: a shard's room is
what is left beside the members that stay and those let in; members that will leave it hold none. Of those that ask for a
shard, a prefix in the order of a hash of group and round is let in, as long as it fits to the row (sums of 4096 ranges of
the hash), takes the shard as its label and stays; the others keep their label, and meet the changed rooms in the next round.
Rounds end when every group lies whole or nobody was let in.

Groups of at least a sixteenth of a shard, of which there are at most sixteen a shard, are settled first, one by one, as a
range of a hash is too coarse for them; one that fits nowhere whole is laid over as few shards as can hold it.

Documents without links cost no edge wherever they go, so they fill what is left, and so do the members of groups that fit
nowhere, in order of group, so that a group is split by them only where a shard ends. Shards then differ by at most one row
(the law `rows`).

All rounds work on one count a group and label, never on pairs or on lists of members, so a group of any size is at most
`shards` rows. The driver sees sums by shard and range of the hash, and the groups of a sixteenth of a shard or more.

Defined cases. A null text is a text of no bytes (size 1), equal to an empty one. Null ids hash alike and are spread by
the final filling. Repeated rows are documents of their own. An empty table gives an empty result; further columns do not
enter it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import buckets_for, cut, table, text_of


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def settle_heavy(groups: list[tuple[int, int, dict[int, int]]], room: list[int]) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
    """Shards of groups (grp, total, members by shard), largest first, and the pieces (shard, rows) of those that fit nowhere whole. Takes their room."""
    whole, pieces = {}, {}
    for grp, total, parts in sorted(groups, key=lambda g: (-g[1], g[0])):
        got, left = [], total
        while left:
            # most members first; ties differ by group
            order = sorted((t for t in range(len(room)) if room[t] > 0), key=lambda t: (-parts.get(t, 0), (t + grp) % len(room)))
            fits = [t for t in order if room[t] >= left]
            to = fits[0] if fits else max(order, key=lambda t: room[t])
            n = min(left, room[to])
            room[to] -= n
            left -= n
            got.append((to, n))
        if len(got) == 1:
            whole[grp] = got[0][0]
        else:
            pieces[grp] = got
    return whole, pieces


#: Ranges of the hash by which members are let in.
RANGES = 4096
#: A group of at least this part of a shard is settled by itself.
HEAVY = 16


def _round(members: DataFrame, room: list[int], turn: int) -> DataFrame:
    """members (grp, label, n) with `total`, the shard `wish` that they ask for (null: none has room for their group), and their place `at` in the order of the round."""
    seen = members.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("parts"), F.sum("n").alias("total"))
    near = members.join(seen, "grp")
    asks = [F.when(F.col("total") <= n, F.struct(F.coalesce(F.element_at("parts", F.lit(t)), F.lit(0).cast("long")).alias("c"), F.xxhash64("grp", F.lit(t)).alias("tie"), F.lit(t).alias("to"))) for t, n in enumerate(room)]
    best = F.greatest(*asks) if len(asks) > 1 else asks[0]
    return near.select("grp", "label", "n", "total", best["to"].alias("wish"), F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(RANGES)).cast("int").alias("at"))


def propagate(members: DataFrame, room: list[int]) -> DataFrame:
    """grp, label: the shard of every group that came to lie whole, by rounds under what room there is. The others are left out."""
    left, room, settled, turn = members, list(room), [], 0
    while True:
        asked = cut(_round(left, room, turn), "asked")
        sums: list[list[int]] = [[0] * RANGES for _ in room]
        for r in asked.filter("wish IS NOT NULL").groupBy("wish", "at").agg(F.sum("n").alias("n")).collect():  # shards x RANGES numbers
            sums[r["wish"]][r["at"]] = r["n"]
        upto, rejected = [], 0
        for t, by_range in enumerate(sums):
            k = 0
            while k < RANGES and by_range[k] <= room[t]:
                room[t] -= by_range[k]
                k += 1
            upto.append(k)
            rejected += sum(by_range[k:])
        let_in = F.col("at") < F.element_at(F.array(*map(F.lit, upto)), F.col("wish") + 1)
        settled.append(asked.filter(let_in).select("grp", F.col("wish").alias("label")).distinct())
        moved = sum(sum(by_range) for by_range in sums) - rejected
        turn += 1
        if not rejected or not moved:
            return reduce(DataFrame.unionByName, settled)
        left = cut(asked.filter(F.col("wish").isNotNull() & ~let_in).select("grp", "label", "n"), "members")


def runs_of(load: list[int], caps: list[int], pieces: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Where the rows of each label go: runs (first row, shard, first slot) by label.

    `load` has the rows of every shard's own label, of every group in pieces, and of those without links, in this order."""
    shards = len(caps)
    used, out = [0] * shards, [[] for _ in load]
    for k, got in enumerate(pieces):
        at = 0
        for to, n in got:
            out[shards + k].append((at, to, used[to]))
            used[to] += n
            at += n
    beyond = []
    for t in range(shards):
        stay = min(load[t], caps[t] - used[t])
        if stay:
            out[t].append((0, t, used[t]))
            used[t] += stay
        beyond.append((t, stay))
    free = sorted((t for t in range(shards) if used[t] < caps[t]), key=lambda t: used[t] - caps[t])
    for label, at in [*beyond, (len(load) - 1, 0)]:
        while at < load[label]:
            to = free[0]
            n = min(load[label] - at, caps[to] - used[to])
            out[label].append((at, to, used[to]))
            used[to] += n
            at += n
            if used[to] == caps[to]:
                free.pop(0)
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard."""
    spark, text = docs.sparkSession, text_of(text_col)
    row = docs.select(F.col(id_col), text.alias("t")).select(id_col, (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.xxhash64("t").alias("grp"), F.monotonically_increasing_id().alias("row"))
    base = cut(row.withColumn("origin", F.pmod(F.xxhash64(id_col, "grp"), F.lit(shards)).cast("int")), "sized")
    caps = quotas(base.count(), shards)

    members = cut(base.groupBy("grp", F.col("origin").alias("label")).agg(F.count(F.lit(1)).alias("n")), "members")
    groups = members.groupBy("grp").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("parts")).filter("total > 1")
    is_heavy = F.col("total") * HEAVY >= min(caps)
    heavy = [(r["grp"], r["total"], dict(r["parts"])) for r in groups.filter(is_heavy).collect()]  # HEAVY a shard at most
    room = list(caps)
    whole, pieces = settle_heavy(heavy, room)
    laid = sorted(pieces)
    found = {**whole, **{g: shards + k for k, g in enumerate(laid)}}
    light = members.join(groups.filter(~is_heavy).select("grp"), "grp", "left_semi")
    labels = propagate(light, room).unionByName(spark.createDataFrame(list(found.items()), "grp long, label int"))
    settled = cut(labels.join(groups.select("grp", "total"), "grp"), "labels")

    rest = shards + len(laid)
    load = [0] * (rest + 1)
    for r in settled.groupBy("label").agg(F.sum("total").alias("n")).collect():
        load[r["label"]] = r["n"]
    load[rest] = sum(caps) - sum(load)
    placed = base.join(members.select("grp", F.col("label").alias("origin")).join(settled.select("grp", "label"), "grp"), ["grp", "origin"], "left").withColumn("label", F.coalesce("label", F.lit(rest)))
    ranked = _rank(placed.select(id_col, "size", "text_crc32", "grp", "label", "row"), ["label", "grp", "row"], buckets_for(base, 4 << 20))

    # Rows are in order of label; each label has runs of rows that go to one shard.
    starts = [sum(load[:k]) for k in range(rest + 1)]
    runs = [(k, starts[k], found) for k, found in enumerate(runs_of(load, caps, [pieces[g] for g in laid])) if found]
    to_runs = F.broadcast(spark.createDataFrame(runs, "label int, start long, runs array<struct<at: long, to: int, slot: long>>"))
    within = F.col("rank") - F.col("start")
    run = F.element_at(F.filter("runs", lambda r: r["at"] <= F.col("rank") - F.col("start")), -1)
    final = ranked.join(to_runs, "label").select(id_col, "size", "text_crc32", within.alias("within"), run.alias("run"))
    return final.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.to").alias("shard"), (F.col("run.slot") + F.col("within") - F.col("run.at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _rank(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """rows with `rank`, their gapless position from 0 in the order of keys: a range partitioning, then counts per partition."""
    dealt = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    done = cut(dealt, "ranked").withColumn("pid", F.shiftright("at", 33))
    sizes = done.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy("pid").collect()  # one row a partition
    before, pairs = 0, []
    for r in sizes:
        pairs.append((r["pid"], before))
        before += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(pairs, "pid long, before long"))
    return done.join(offsets, "pid").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
