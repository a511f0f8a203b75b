"""Group-preserving stratified split with exact sizes, and its leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.operators.ranking import number_rows, number_rows_within
from folioworks.session import cut_lineage


def interleave(df: DataFrame, stratum: str, order: list[Column], name: str = "turn") -> DataFrame:
    """Position of each row inside its stratum; ordering by (turn, stratum) is the round robin."""
    return number_rows_within(df, stratum, order, name)


def eligibility(docs: DataFrame, target: str = vocab.TARGET_DOCUMENT_TYPE) -> DataFrame:
    """Adds the reason a document is left out of the split; NULL means eligible."""
    reason = F.when(F.col("document_type").isNull(), "no truth record").when(
        F.col("document_type") != target, F.concat(F.lit("non-target document type "), "document_type")
    )
    return docs.withColumn("excluded", reason)


def _assign(rank: Column, bounds: list[tuple[str, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, upto in reversed(bounds):
        out = F.when(rank <= upto, name).otherwise(out)
    return out


def group_split(docs: DataFrame, sizes: dict[str, int], seed: int = vocab.SPLIT_SEED, id_: str = "file", group: str = "group", stratum: str = "stratum") -> DataFrame:
    """(id, group, stratum, partition): sizes met exactly, groups whole, strata mixed, one answer per seed.

    Groups of several documents go first, the largest before smaller ones. How many groups of a size go to which partition
    is settled on the table of sizes and their counts, which has few rows; the groups of one size are then numbered with
    their strata in turn, in seeded order, and cut at those counts. Single documents then fill what is left, taken by their
    place inside their stratum so every partition gets its mix.
    """
    if any(v <= 0 for v in sizes.values()):
        raise ValueError("every partition needs a positive size")
    total = docs.count()
    if total != sum(sizes.values()):
        raise ValueError(f"split sizes add up to {sum(sizes.values())} but {total} documents are eligible")
    names = sorted(sizes, key=lambda k: -sizes[k])
    groups = docs.groupBy(group).agg(F.count("*").alias("_n"), F.min(stratum).alias("_s"))
    many = cut_lineage(groups.where("_n > 1"))
    table = many.groupBy("_n").agg(F.count("*").alias("groups")).orderBy(F.desc("_n")).collect()  # one row per size
    room, placed = place_all([(r["_n"], r["groups"]) for r in table], sizes)
    cuts = []
    for n, taken in placed:
        upto = 0
        for k in names:
            cuts.append((n, k, upto, upto + taken[k]))
            upto += taken[k]
    shuffled = F.xxhash64(F.lit(seed), F.col(group))
    lane = F.concat_ws("|", "_n", F.coalesce("_s", F.lit("")))
    turned = number_rows_within(many.withColumn("_lane", lane), "_lane", [shuffled, F.col(group)], "_turn")
    ranked = number_rows_within(turned, "_n", [F.col("_turn"), F.col("_s"), F.col(group)], "_nth")
    # a row per size and partition, joined: as one expression a few hundred sizes are too deep to compile
    limits = docs.sparkSession.createDataFrame([c for c in cuts if c[3] > c[2]], "_n long, partition string, _lo long, _hi long")
    multi = ranked.join(F.broadcast(limits), "_n").where("_nth > _lo and _nth <= _hi").select(group, "partition")

    single = docs.join(groups.where("_n = 1").select(group), group, "left_semi")
    turn = number_rows_within(single, stratum, [F.xxhash64(F.lit(seed), F.col(id_)), F.col(id_)], "_turn")
    counts = single.groupBy(stratum).agg(F.count("*").alias("_of"))
    ranked = turn.join(counts, stratum).withColumn("_share", (F.col("_turn") - 0.5) / F.col("_of"))
    # walk the strata in step: the k-th share of every stratum sits together, then spread over the room left
    lane = number_rows(ranked, [F.col("_share"), F.col(stratum), F.col(id_)], "_rank")
    seats, upto = [], 0
    for k in names:
        upto += room[k]
        seats.append((k, upto))
    n_single = max(upto, 1)
    # a stride through the ordered lane gives each partition documents from the whole range of shares
    lane = lane.withColumn("_seat", number_seat(F.col("_rank"), n_single))
    filled = number_rows(lane, [F.col("_seat"), F.col(id_)], "_fill").select(id_, group, stratum, _assign(F.col("_fill"), seats).alias("partition"))
    together = docs.join(multi, group).select(id_, group, stratum, "partition")
    return filled.unionByName(together)


def number_seat(rank: Column, n: int) -> Column:
    """Golden-ratio stride: consecutive ranks land far apart, so equal slices sample the order evenly."""
    return (rank * F.lit(0.6180339887498949)) % 1.0


def place_size(size: int, groups: int, room: dict[str, int], wanted: dict[str, int]) -> dict[str, int]:
    """How many of the groups of one size go to each partition; `room` is lowered.

    Each partition gets its share by the room it has, then single groups go where most room is left.
    """
    free = sum(room.values())
    out = {k: min(room[k] // size, groups * room[k] // max(free, 1)) for k in room}
    for k, n in out.items():
        room[k] -= n * size
    for _ in range(groups - sum(out.values())):
        k = max(room, key=lambda p: (room[p], wanted[p]))
        if room[k] < size:
            raise RuntimeError(f"cannot place a group of {size} documents")
        out[k] += 1
        room[k] -= size
    return out


def place_all(table: list[tuple[int, int]], sizes: dict[str, int]) -> tuple[dict[str, int], list[tuple[int, dict[str, int]]]]:
    """(room left for single documents, groups of each size for each partition) of a table of (size, groups), largest first.

    Sizes are placed one by one; where the last ones find no room for a whole group that way, `fill_exactly` settles all of them.
    """
    room = dict(sizes)
    try:
        return room, [(n, place_size(n, groups, room, sizes)) for n, groups in table]
    except RuntimeError:
        for share in (1.0, 0.9, 0.5, 0.0):
            found = fill_exactly(table, sizes, share)
            if found:
                return found
        raise


def fill_exactly(table: list[tuple[int, int]], sizes: dict[str, int], share: float):
    """Every partition gets `share` of its part of each size; of the groups left over, each but the largest partition gets a set
    that fills it but for the single documents there are. None where there is no such set. Sets are sums in a bit string."""
    total, room = sum(sizes.values()), dict(sizes)
    names = sorted(sizes, key=lambda k: (sizes[k], k))
    out = {n: {k: int(share * groups * sizes[k] / total) for k in sizes} for n, groups in table}
    for n, got in out.items():
        for k in sizes:
            room[k] -= n * got[k]
    left = {n: groups - sum(out[n].values()) for n, groups in table}
    single = total - sum(n * groups for n, groups in table)
    for k in names[:-1]:
        items = []  # (size, groups) in lots of 1, 2, 4 ... groups
        for n, groups in left.items():
            lot = 1
            while groups:
                lot = min(lot, groups)
                items.append((n, lot))
                groups, lot = groups - lot, lot * 2
        within = (1 << (room[k] + 1)) - 1
        sums = [1]
        for n, lot in items:
            sums.append((sums[-1] | (sums[-1] << (n * lot))) & within)
        at = sums[-1].bit_length() - 1  # the largest sum that fits
        if room[k] - at > single:
            return None
        single -= room[k] - at
        room[k] -= at
        for (n, lot), before in zip(reversed(items), reversed(sums[:-1])):
            if not before >> at & 1:
                at -= n * lot
                out[n][k] += lot
                left[n] -= lot
    rest = sum(n * groups for n, groups in left.items())
    if rest > room[names[-1]]:
        return None
    room[names[-1]] -= rest
    for n, groups in left.items():
        out[n][names[-1]] += groups
    return room, list(out.items())


def split_leaks(assigned: DataFrame, groups: DataFrame, id_: str = "file", group: str = "group") -> DataFrame:
    """Groups found in more than one partition."""
    g = groups.select(id_, F.col(group).alias("_g"))
    return (
        assigned.select(id_, "partition").join(g, id_).groupBy("_g")
        .agg(F.countDistinct("partition").alias("n_partitions"), F.count("*").alias("members"))
        .where("n_partitions > 1").withColumnRenamed("_g", group)
    )


def excluded_links(excluded: DataFrame, assigned: DataFrame, groups: DataFrame, id_: str = "file", group: str = "group") -> DataFrame:
    """Left-out documents that share a group with documents of the split, with those partitions."""
    e = excluded.select(id_).join(groups.select(id_, group), id_)
    # one row per (group, partition), so a large group is counted before the join
    inside = assigned.select(id_, "partition").join(groups.select(id_, group), id_).groupBy(group, "partition").agg(F.count("*").alias("linked"))
    return e.join(inside, group).select(id_, group, "partition", "linked")


def within_partition_groups(assigned: DataFrame, groups: DataFrame, id_: str = "file", group: str = "group") -> DataFrame:
    """Groups with several members inside one partition: not leakage, but correlated samples."""
    return (
        assigned.select(id_, "partition").join(groups.select(id_, group), id_).groupBy("partition", group)
        .agg(F.count("*").alias("members")).where("members > 1")
    )


def split_summary(assigned: DataFrame, stratum: str = "stratum") -> DataFrame:
    return assigned.groupBy("partition", stratum).agg(F.count("*").alias("n"))


def training_rows(assigned: DataFrame, partition: str) -> DataFrame:
    """Rows of one partition for training; the held-out one is refused before any plan is built."""
    if partition == "test":
        raise ValueError("training must never read the test partition")
    return assigned.where(F.col("partition") == partition)
