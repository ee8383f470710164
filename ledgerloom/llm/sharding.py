"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the moves of fewest bytes.

Method.  Only the sizes of the old shards come to the driver, a number for each.  A minimum-cost flow from old shards
to new ones (staying costs nothing, a moved byte costs one or what `cost` says) gives blocks: so many bytes of old
shard i go to new shard j.  Inside an old shard the documents stand in hash-random order; a distributed prefix sum
gives each its place, and the place of its middle byte picks the block.  Then slots are numbered the same way.  New
shards differ from the mean by less than one document for each block they are made of.  At last the shards that gain
or lose a document are written anew from whole rows; the others keep their files.

Law `bytes`: sizes near equal.  Null text: 16 bytes, its crc32 null.  A null source lies in the old shard of the empty
name.  Rows alike in every column share their places in any order.  No documents: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, random_key, running_before

OLD_SHARDS, NEW_SHARDS, SEED = 32, 40, 23
#: Copies of one row that a task numbers at a time; buckets that tell where rows alike may be; bytes of texts in a file.
COPIES, BUCKETS, FILE_BYTES = 4096, 1 << 16, 1 << 27
#: What a row is known by, and the names it has on the way.
ALIKE = {"doc_id": "__id", "size": "__size", "text_crc32": "__crc", "old_shard": "__old"}


def cheapest_transfers(sizes: list[int], capacities: list[int],
                       cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Units from i to j of least total cost, by successive shortest paths; capacities must hold all sizes."""
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards cannot hold the old ones")
    left, room = list(sizes), list(capacities)
    flow: dict[tuple[int, int], int] = {}
    price = {(i, j): cost(i, j) for i in range(len(left)) for j in range(len(room))}
    while any(left):
        # Distances from the old shards with something left; forward arcs are open, backward ones where flow lies.
        near = {("old", i): 0 for i, x in enumerate(left) if x}
        came: dict = {}
        changed = True
        while changed:
            changed = False
            for (i, j), p in price.items():
                if ("old", i) in near and near[("old", i)] + p < near.get(("new", j), 1 << 62):
                    near[("new", j)], came[("new", j)], changed = near[("old", i)] + p, ("old", i), True
                if flow.get((i, j)) and ("new", j) in near and near[("new", j)] - p < near.get(("old", i), 1 << 62):
                    near[("old", i)], came[("old", i)], changed = near[("new", j)] - p, ("new", j), True
        end = min((j for j in range(len(room)) if room[j] and ("new", j) in near), key=lambda j: (near[("new", j)], j))
        path, node = [], ("new", end)
        while node in came:
            path.append((came[node], node))
            node = came[node]
        start = node[1]
        amount = min([left[start], room[end], *(flow[(b[1], a[1])] for a, b in path if a[0] == "new")])
        for a, b in path:
            arc, sign = ((a[1], b[1]), 1) if a[0] == "old" else ((b[1], a[1]), -1)
            flow[arc] = flow.get(arc, 0) + sign * amount
        left[start] -= amount
        room[end] -= amount
    return {arc: x for arc, x in flow.items() if x}


def old_place(shards: int = OLD_SHARDS) -> Column:
    """The layout that is taken over: every source in one shard, by the hash of its name."""
    return F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def _known_by(old_shard: Column | None) -> dict[str, Column]:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return {"doc_id": F.col("doc_id"), "size": size, "text_crc32": F.crc32(F.col("text").cast("binary")),
            "old_shard": old_place() if old_shard is None else old_shard}


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """The rows with _copy, from 0 within rows alike in every column: counted, then dealt out again in runs of COPIES."""
    runs = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    spread = runs.hint("rebalance")
    first = F.col("_run") * COPIES
    copy = F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1))
    return spread.withColumn("_copy", copy).drop("_n", "_run")


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = NEW_SHARDS, seed: int = SEED,
            capacities: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), old_shard and place_key.

    place_key is the row's place in the hash order, in which a shard's slots rise.
    """
    order = ["doc_id", "size", "text_crc32", "_copy"]
    copies = _numbered_copies(docs.select(*[c.alias(n) for n, c in _known_by(old_shard).items()]))
    slim = durable(copies.withColumn("_key", random_key(*[F.col(c) for c in order], seed=seed)))
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in slim.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [sizes.get(i, 0) for i in range(max([*sizes, 0]) + 1)]
    if capacities is None:
        share, over = divmod(sum(supply), shards)
        capacities = [share + (j < over) for j in range(shards)]
    blocks: dict[int, list[tuple[int, int]]] = {}
    for (i, j), amount in sorted(cheapest_transfers(supply, capacities).items()):
        blocks.setdefault(i, []).append((j, amount))
    rows = [(i, [sum(x for _, x in own[:k]) for k in range(1, len(own))], [j for j, _ in own])
            for i, own in blocks.items()]
    # As many rows as old shards, together at most as many cuts as old and new shards.
    cuts = F.broadcast(spark.createDataFrame(rows, "old_shard int, cuts array<bigint>, news array<int>"))
    placed = running_before(slim, ["old_shard"], "_key", order, {"start": "size"}).join(cuts, "old_shard")
    middle = F.col("start") + F.floor(F.col("size") / 2)
    block = F.size(F.filter("cuts", lambda c: c <= middle)) + 1
    placed = placed.withColumn("shard", F.element_at("news", block)).withColumn("_one", F.lit(1).cast("long"))
    numbered = running_before(placed, ["shard"], "_key", order, {"slot": "_one"})
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                           "old_shard", F.col("_key").alias("place_key"))


def _nth(rows: DataFrame, same: list[str], *named: str) -> DataFrame:
    """rows with __nth, their number among rows alike in the columns; they differ in those named, and no task gets all."""
    keyed = rows.withColumns({"__key": random_key(*[F.col(c) for c in named], seed=SEED), "__one": F.lit(1).cast("long")})
    return running_before(keyed, same, "__key", list(named), {"__nth": "__one"}).drop("__key", "__one")


def _alike(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"{c}_"]) for c in columns])


def _crowded(known: DataFrame, repeats: DataFrame, same: list[str]) -> Column:
    """Whether a row of known may have rows alike it: its bucket has some.  All that is sent is one bit a bucket."""
    bucket = F.pmod(F.xxhash64(*same), F.lit(BUCKETS)).cast("int")
    full = {r[0] for r in repeats.select(bucket.alias("b")).distinct().collect()}
    marks = "".join("1" if b in full else "0" for b in range(BUCKETS)) if full else "0"
    return F.substring(F.lit(marks), (bucket if full else F.lit(0)) + 1, F.lit(1)) == "1"


def _places_of_crowded(rows: DataFrame, places: DataFrame, spots: DataFrame, same: list[str]) -> DataFrame:
    """rows with shard and __key: one that is alone takes its place, rows alike are numbered, as their places are."""
    found = rows.join(spots, _alike(rows, spots, same))
    alone = found.where("__n = 1").drop("__n")
    shared_rows = found.where("__n > 1").drop("__n", "shard", "__key").withColumn("__row", F.monotonically_increasing_id())
    shared_rows = _nth(durable(shared_rows), same, "__row").drop(*[f"{c}_" for c in same])
    keys = spots.where("__n > 1").select(*[F.col(f"{c}_").alias(c) for c in same])
    shared = _nth(places.join(keys, _alike(keys, places, same), "left_semi"), [f"{c}_" for c in same], "shard", "slot")
    shared = shared.select(*[f"{c}_" for c in same], F.col("__nth").alias("__nth_"), "shard", F.col("place_key").alias("__place"))
    numbered = shared_rows.join(shared, _alike(shared_rows, shared, [*same, "__nth"])).withColumn("__key", F.col("__place"))
    return alone.select(*rows.columns, "shard", "__key").unionByName(numbered.select(*rows.columns, "shard", "__key"))


def rewrite_affected(docs: DataFrame, assigned: DataFrame, folder: str, old_shard: Column | None = None, seed: int = SEED) -> list[int]:
    """Write the new files of the shards that gain or lose a document, a folder each, and return those shards.

    Shards that keep just what they had are not touched.  assigned is what reshard gave for the same documents and seed.  A row's
    text moves once: each block of the flow is a stretch of the hash order, so a row finds its shard from the stretches'
    ends (at most old times new shards, sent to all tasks), and its slot from its number in a range of that order and
    the slot where the range begins.  Ranges hold about FILE_BYTES, a file each.  Only rows that may have others alike in
    id, size, crc32 and old shard look their places up, so ids may be null or repeat and every row is written once.
    """
    same = list(ALIKE.values())
    touched = sorted(r[0] for r in assigned.where("shard <> old_shard")
                     .select(F.explode(F.array("shard", "old_shard"))).distinct().collect())
    if not touched:
        return touched
    spans = assigned.withColumn("at", F.struct("place_key", "doc_id", "size", "text_crc32")).groupBy("old_shard", "shard").agg(
        F.min("at").alias("low"), F.max("at").alias("high"))
    spans = spans.groupBy(F.col("old_shard").alias("__from")).agg(F.collect_list(F.struct("low", "high", "shard")).alias("__spans"))
    known = docs.withColumns({ALIKE[n]: c for n, c in _known_by(old_shard).items()}).drop("shard", "slot", "old_shard")
    places = assigned.select(*[F.col(n).alias(f"{a}_") for n, a in ALIKE.items()], "shard", "slot", "place_key")
    spots = places.groupBy(*[f"{c}_" for c in same]).agg(
        F.count(F.lit(1)).alias("__n"), F.min("shard").alias("shard"), F.min("place_key").alias("__key"))
    crowded = _crowded(known, spots.where("__n > 1").select(*[F.col(f"{c}_").alias(c) for c in same]), same)
    key = random_key(F.col("__id"), F.col("__size"), F.col("__crc"), F.lit(0), seed=seed)
    at = F.struct(F.col("__key").alias("place_key"), F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"))
    own = known.where(~crowded).withColumn("__key", key).join(F.broadcast(spans), F.col("__old") == F.col("__from"))
    own = own.withColumn("shard", F.filter("__spans", lambda s: (s["low"] <= at) & (at <= s["high"]))[0]["shard"])
    rows = own.select(*known.columns, "shard", "__key").unionByName(_places_of_crowded(known.where(crowded), places, spots, same))
    total = assigned.agg(F.sum("size")).first()[0]
    bits = max(0, math.ceil(math.log2(total / (FILE_BYTES * len(touched)))))
    starts = assigned.groupBy(F.col("shard").alias("__shard"), F.shiftright("place_key", 60 - bits).alias("__in")).agg(F.min("slot").alias("__start"))
    rows = rows.where(F.col("shard").isin(touched)).withColumn("__range", F.shiftright("__key", 60 - bits)).repartition("shard", "__range")
    order = W.partitionBy("shard", "__range").orderBy("__key", "__id", "__size", "__crc")
    rows = rows.withColumn("__nth", F.row_number().over(order)).join(
        starts, (F.col("shard") == F.col("__shard")) & (F.col("__range") == F.col("__in")))
    columns = [*[c for c in docs.columns if c not in ("shard", "slot", "old_shard")], F.col("__old").alias("old_shard"), "shard",
               (F.col("__start") + F.col("__nth") - 1).alias("slot")]
    (rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder))
    return touched


def resharded_files(docs: DataFrame, folder: str, old_shard: Column | None = None) -> DataFrame:
    """The assignment after its affected files are written: rows of those as read back from them, the others' as assigned.

    moved tells whether a row left its old shard.
    """
    assigned = durable(reshard(docs, old_shard))
    touched = rewrite_affected(docs, assigned, folder, old_shard)
    if touched:
        written = docs.sparkSession.read.parquet(folder)
        read = _known_by(F.col("old_shard"))
        seen = written.select(*[read[c].alias(c) for c in ("doc_id", "size", "text_crc32")], F.lit("bytes").alias("law"),
                              F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
        assigned = seen.unionByName(assigned.drop("place_key").where(~F.col("shard").isin(touched)))
    return assigned.drop("place_key").withColumn("moved", F.col("shard") != F.col("old_shard"))
