"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards.

Documents of one group (equal texts) are linked. Every document begins in a shard by its id's hash. In each round a
group's documents want to go to the shard that holds most of the group; a join finds them, quotas from the shards' free
places decide which share of each move between two shards is allowed, and a hash picks the movers. At last documents
without links fill the shards to counts that are at most one apart. Everything is DataFrame operations; what reaches the
driver are the loads of the shards and the moves between each two of them, whatever the corpus.

A group's documents are held in cells, at most CELLS for a group, by a hash of the id. The members of a cell move
together, so a group that holds a third of all rows costs no more than a thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, whole

CELLS, BINS, ROUNDS = 1024, 1024, 8


def _chance(*columns: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def _of(values: list[float], index: Column) -> Column:
    """The value at this index, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def quotas(flow: dict[tuple[int, int], int], load: list[int], limit: list[int]) -> dict[tuple[int, int], float]:
    """Which share of each flow to allow so that no shard that gains ends above its limit."""
    share = {e: 1.0 for e in flow}
    for _ in range(200):
        gain, loss = [0.0] * len(load), [0.0] * len(load)
        for (a, b), n in flow.items():
            gain[b] += share[a, b] * n
            loss[a] += share[a, b] * n
        over = {b: max(0.0, (limit[b] - load[b] + loss[b]) / gain[b]) for b in range(len(load)) if gain[b] > 0 and load[b] + gain[b] - loss[b] > limit[b] + 0.5}
        if not over:
            return share
        for a, b in flow:
            if b in over:
                share[a, b] *= over[b] if over[b] > 1e-6 else 0.0
    return {e: 0.0 for e in flow}


def propagated(cells: DataFrame, shards: int, limit: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(group, cell, n, shard) after label propagation over the cells (group, cell, n) of linked documents.

    limit: places of each shard. A group larger than half a shard does not move as one: its cells are picked one by one,
    and those in a shard without free places stay there. Ends when nothing may move.
    """
    state = stored(cells.withColumn("shard", (F.col("cell") % shards).cast("int")))
    for turn in range(rounds):
        load = [0] * shards
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r.shard] = r.n
        open_ = [s for s in range(shards) if load[s] < 0.98 * limit[s]]
        if not open_:
            break
        tally = state.groupBy("group", "shard").agg(F.sum("n").alias("n"))
        held = F.struct("n", F.xxhash64("group", "shard"))
        want = tally.groupBy("group").agg(F.max_by("shard", F.when(F.col("shard").isin(open_), held)).alias("want"), F.sum("n").alias("members"), F.max(F.when(F.col("shard").isin(open_), F.lit(1))).alias("some"))
        large = F.col("members") > max(limit) / 2
        spread = F.lit(open_[0]) if len(open_) == 1 else _of([float(x) for x in open_], F.pmod(F.xxhash64("group"), F.lit(len(open_)))).cast("int")
        want = want.select("group", F.when(F.col("some").isNull(), spread).otherwise(F.col("want")).alias("want"), large.alias("large"))
        moving = state.join(want, "group").withColumn("want", F.when(F.col("large") & ~F.col("shard").isin(open_), F.col("shard")).otherwise(F.col("want")))
        flow = {(r.shard, r.want): r.n for r in moving.where("shard <> want").groupBy("shard", "want").agg(F.sum("n").alias("n")).collect()}
        share = quotas(flow, load, limit)
        if not any(share[e] * n >= 1 for e, n in flow.items()):
            break
        grid = [share.get((a, b), 0.0) for a in range(shards) for b in range(shards)]
        picked = F.when(F.col("large"), _chance(F.lit(turn), F.col("group"), F.col("cell"))).otherwise(_chance(F.lit(turn), F.col("group")))
        goes = (F.col("shard") != F.col("want")) & (picked < _of(grid, F.col("shard") * shards + F.col("want")))
        after = stored(moving.select("group", "cell", "n", F.when(goes, F.col("want")).otherwise(F.col("shard")).cast("int").alias("shard")))
        drop_stored(state)
        state = after
    return state


def sharded(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 16, rounds: int = ROUNDS, group: Column | None = None) -> DataFrame:
    """(id, size, text_crc32, group, shard, slot): all documents in shards whose counts are at most one apart.

    size: UTF-8 bytes of the text plus 1; null texts count as empty, and are in one group with empty ones. slot: place in
    the shard, from 0 without gaps. Groups are equal texts, or those of the column `group` (null: no links). Groups keep
    together as far as the counts allow; ties between shards go by hash. Repeated ids and rows are placed row by row, null
    ids too. Of a text only its length and two hashes are kept, however long it is. Extra columns are not looked at,
    whatever their names (but for `group`). Empty tables give empty ones.
    """
    rows = docs.select(F.col(id).alias("id"), F.octet_length(whole(text)).cast("long").alias("size"), F.crc32(whole(text)).alias("crc"), (F.xxhash64(whole(text)) if group is None else F.xxhash64(group)).alias("group"), (F.lit(True) if group is None else group.isNotNull()).alias("linked"))
    rows = stored(rows.withColumn("size", F.col("size") + 1).withColumn("cell", F.pmod(F.xxhash64(F.lit(3), "id", "crc"), F.lit(CELLS)).cast("int")))
    total = rows.count()
    limit = [total // shards + (s < total % shards) for s in range(shards)]
    cells = stored(rows.where("linked").groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n")))
    several = cells.groupBy("group").agg(F.sum("n").alias("members")).where("members > 1").select("group")
    placed = propagated(cells.join(several, "group", "left_semi"), shards, limit, rounds)
    rows = rows.join(placed.select("group", "cell", F.col("shard").alias("near"), F.lit(True).alias("linked")), ["group", "cell", "linked"], "left").withColumn("near", F.coalesce("near", F.lit(shards)))
    return filled(rows, shards, limit).select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "group", "shard", "slot")


def filled(rows: DataFrame, shards: int, limit: list[int]) -> DataFrame:
    """rows with shard and slot. Rows near a shard (near < shards) keep it while it has places; the others, and rows
    without a shard, fill the free places in order.

    Ranks come in two levels: counts of the hash's parts by shard give each part's first rank, so a task ranks only one
    part of a shard. The counts, shards times BINS rows, are broadcast; the loads reach the driver.
    """
    rows = rows.withColumn("order", F.xxhash64(F.lit(5), "group", "cell")).withColumn("bin", F.shiftrightunsigned("order", 54))
    counts = stored(rows.groupBy("near", "bin").agg(F.count(F.lit(1)).alias("n")))
    load = [0] * (shards + 1)
    for r in counts.groupBy("near").agg(F.sum("n").alias("n")).collect():
        load[r.near] = r.n
    kept = [min(load[s], limit[s]) for s in range(shards)]
    free = [limit[s] - kept[s] for s in range(shards)]
    starts = [sum(free[:s]) for s in range(shards)]  # ranks of the rows to place at which a shard's free places begin
    loose = [sum(load[t] - kept[t] for t in range(s)) for s in range(shards + 1)]  # rows to place from the shards before
    first = F.sum("n").over(Window.partitionBy("near").orderBy("bin")) - F.col("n")
    counts = counts.select("near", "bin", first.alias("first"))
    rank = F.row_number().over(Window.partitionBy("near", "bin").orderBy("order", "id", "crc", "size")) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(counts), ["near", "bin"]).withColumn("rank", F.col("first") + F.col("rank"))
    stays = F.col("near").cast("int") < shards
    stays = stays & (F.col("rank") < _of([*map(float, kept), 0.0], F.col("near")))
    place = F.col("rank") - F.when(F.col("near") < shards, _of([*kept, 0], F.col("near"))).otherwise(F.lit(0)) + _of(loose, F.col("near"))
    ranked = ranked.withColumn("place", F.when(~stays, place))
    target = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("place"))) - 1
    # of shards that begin at the same rank only the last has free places
    ranked = ranked.withColumn("shard", F.when(stays, F.col("near")).otherwise(target).cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(_of(kept, F.col("shard")) + F.col("place") - _of(starts, F.col("shard")))
    return ranked.withColumn("slot", slot.cast("long"))
