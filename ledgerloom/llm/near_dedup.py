"""Near-duplicate documents by an LSH forest over MinHash signatures, with every link confirmed on the full sets.

Method.  Documents with the same shingle set are one node.  A node's signature of 128 minima is read as 32 sorted
orders of four values each.  In an order, the nodes next to each other that share a longest common prefix form a
region; a region begins at depth two and, where more than `region_rows` nodes share the prefix, goes down to three and
then four values.  A region that is still larger is cut into blocks and every pair of blocks is compared, so no
partner is dropped.  A pair of similarity 0.85 shares a region with probability 1 - (1 - 0.85^2)^32 (over 1 - 1e-17),
in the deepest regions 1 - (1 - 0.85^4)^32 (over 1 - 1e-10); at 0.8 that is over 1 - 1e-7.

Two passes keep the rows few.  The first compares signatures inside regions and joins nodes whose estimate is within
`margin` of the threshold into families (4.8 standard errors at the asked percent, so a true link is missed about once in a million).  The
second reads the full shingle sets of the members of families only, compares all of a family exactly, block against
block, and gives for each task a spanning forest of the confirmed links, never all pairs of a group.

Null or empty text, or white space alone: an empty set, linked with nothing.  A null doc_id is compared like any other
and names its group only if no member has an id.  Repeated rows are copies.  No documents: no rows.  A text is found
again by a hash of its bytes, not by doc_id, so ids may be null or repeat with other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, whole_groups
from ledgerloom.llm.components import components
from ledgerloom.llm.wordhash import pieces, shingle_sets

ORDERS, DEPTH = 32, 4
MINIMA = ORDERS * DEPTH
_MULTIPLY = np.random.default_rng(77).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            values, at = shingle_sets(part.column("text"))
            count = np.diff(at)
            full = np.flatnonzero(count)
            minima = np.zeros((part.num_rows, MINIMA), np.uint32)
            lanes = np.zeros((part.num_rows, 2), np.uint64)
            if len(full):
                start = at[full]
                for k in range(MINIMA):
                    minima[full, k] = np.minimum.reduceat(values * _MULTIPLY[k], start) >> np.uint64(32)
                lanes[full, 0] = np.add.reduceat(values, start)
                lanes[full, 1] = np.add.reduceat(values * (values >> np.uint64(7)) * _MULTIPLY[0], start)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("at"), pa.array(count, pa.int64()),
                pa.array([lanes[i].tobytes() if count[i] else None for i in range(part.num_rows)], pa.binary()),
                pa.array([minima[i].tobytes() if count[i] else None for i in range(part.num_rows)], pa.binary()),
            ], ["doc_id", "at", "n_shingles", "node", "signature"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node and order: the first two, three and four values of its signature as one number each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, MINIMA)
        for o in range(ORDERS):
            v = minima[:, o * DEPTH:(o + 1) * DEPTH].astype(np.uint64)
            two = (v[:, 0] << np.uint64(32)) | v[:, 1]
            three = (two ^ (v[:, 2] << np.uint64(16))) * _MULTIPLY[1] + v[:, 2]
            four = (three ^ (v[:, 3] << np.uint64(16))) * _MULTIPLY[2] + v[:, 3]
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.array(np.full(len(v), o, np.int32)),
                *[pa.array(x.view(np.int64)) for x in (two, three, four)]], ["node", "o", "p2", "p3", "p4"])


def _stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of n items is joined to, over the given pairs."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _joined(nodes: list[bytes], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    label = _stars(len(nodes), left, right)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([
        pa.array([nodes[i] for i in moved], pa.binary()), pa.array([nodes[i] for i in label[moved]], pa.binary()),
    ], ["a", "b"])


def _similar_signatures(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["region"]):
            region = whole.column("region").to_numpy()
            nodes = whole.column("node").to_pylist()
            minima = np.frombuffer(b"".join(whole.column("signature").to_pylist()), np.uint32).reshape(-1, MINIMA)
            left, right = [], []
            start = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            longest = int(np.diff(np.r_[start, len(region)]).max())
            for step in range(1, longest):
                i = np.flatnonzero(region[:-step] == region[step:])
                for part in np.array_split(i, len(i) // 20_000 + 1):
                    close = (minima[part] == minima[part + step]).sum(1) >= least * MINIMA
                    left.append(part[close])
                    right.append(part[close] + step)
            if left:
                yield _joined(nodes, np.concatenate(left), np.concatenate(right))
    return compare


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    had: set[bytes] = set()
    for batch in batches:
        fresh = []
        for node in batch.column("node").to_pylist():
            fresh.append(node not in had)
            had.add(node)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        for part in pieces(batch, "text"):
            values, at = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([
                part.column("node"), part.column("region"),
                pa.array([values[at[i]:at[i + 1]].tobytes() for i in range(part.num_rows)], pa.large_binary()),
            ], ["node", "region", "shingles"])


def _exact_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one block whose full sets meet the threshold, from exact intersection counts."""
    size = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        found = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                 if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])
                 and _meets(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j], percent)]
        pairs = np.array(found, int).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # only shingles that two of the block have can meet
    row = np.repeat(np.arange(len(sets)), size)
    keep = times[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    meet = np.zeros((len(sets), len(sets)), np.float64)
    width = 8192
    for low in range(0, int(shared[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        meet += has @ has.T
    left, right = np.nonzero(np.triu(_meets(meet, size[:, None], size[None, :], percent), 1))
    return left, right


def _meets(both, one, other, percent: int):
    return 100 * both >= percent * (one + other - both)


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["family"]):
            family = np.array(whole.column("family").to_pylist(), object)
            nodes = whole.column("node").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in whole.column("shingles").to_pylist()]
            start = np.r_[np.flatnonzero(np.r_[True, family[1:] != family[:-1]]), len(family)]
            left, right = [], []
            for low, high in zip(start[:-1], start[1:], strict=True):
                if high - low > 1:
                    i, j = _exact_pairs(sets[low:high], percent)
                    left.append(i + low)
                    right.append(j + low)
            if left:
                yield _joined(nodes, np.concatenate(left), np.concatenate(right))
    return confirm


def _block_pairs(frame: DataFrame, size: str, block_rows: int):
    """Array of (i, j) block pairs that a row of a group of `size` rows takes part in; one block if it is small."""
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return frame.withColumn("_own", own).withColumn("_pair", F.explode(F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.concat_ws("-", F.least(k, F.col("_own")), F.greatest(k, F.col("_own"))))))


def text_key(text: Column) -> Column:
    """What a row's text is found again by; it does not depend on doc_id, which may be null or repeat."""
    return F.xxhash64(text, F.octet_length(text))


def near_duplicates(docs: DataFrame, percent: int = 85, margin: float | None = None, region_rows: int = 1024,
                    family_rows: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), and two more:

    text_key (text_key() of the row's text) and stands, whether the row is the one that stands for its group: of smallest
    doc_id, then of smallest text_key; rows alike in both all stand.  Rows without shingles have no group and all stand.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of distinct 5-word shingles.
    """
    if margin is None:
        margin = 4.8 * (percent / 100 * (1 - percent / 100) / MINIMA) ** 0.5
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = ids.withColumn("at", text_key(F.col("text")))
    signed = durable(ids.mapInArrow(_signatures, "doc_id long, at long, n_shingles long, node binary, signature binary"))
    slim = signed.select("doc_id", "at", "n_shingles", "node")
    nodes = durable(signed.where("node IS NOT NULL").groupBy("node")
                    .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("one"),
                         F.first("signature").alias("signature"))
                    .select("node", F.col("one.doc_id").alias("first_id"), "one.at", "signature"))

    places = nodes.select("node", "signature").mapInArrow(
        _prefixes, "node binary, o int, p2 long, p3 long, p4 long")
    places = durable(places)
    two = places.groupBy("o", "p2").agg(F.count("*").alias("n2")).where("n2 > 1")
    three = places.groupBy("o", "p2", "p3").agg(F.count("*").alias("n3")).where(f"n3 > {region_rows}")
    in_two = places.join(two, ["o", "p2"])
    in_three = in_two.join(three, ["o", "p2", "p3"], "left")
    deep = in_three.withColumn("region", F.expr(
        f"CASE WHEN n2 <= {region_rows} THEN xxhash64(o, 2, p2) WHEN n3 IS NULL THEN xxhash64(o, 3, p2, p3)"
        " ELSE xxhash64(o, 4, p2, p3, p4) END"))
    deep = durable(deep.select("node", "region"))
    sizes = deep.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    blocked = _block_pairs(deep.join(sizes, "region"), "n", region_rows)
    blocked = blocked.select("node", F.xxhash64("region", "_pair").alias("region"))
    compared = (blocked.join(nodes.select("node", "signature"), "node")
                .repartition("region").sortWithinPartitions("region")
                .mapInArrow(_similar_signatures(percent / 100 - margin), "a binary, b binary"))
    families = components(compared)

    confirmed = components(_exact_links(ids, nodes, families, percent, family_rows))
    named = nodes.select("node", "first_id", F.col("at").alias("first_at")).join(confirmed, "node", "left").select(
        "node", "first_id", "first_at", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min(F.struct(
        F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("component_id"), F.col("first_at").alias("component_at"),
        F.col("node").alias("component_node"))).alias("one"))
    named = named.join(smallest, "label").select("node", "one.component_id", "one.component_at", F.col("one.component_node").alias("head"))
    joined = slim.join(named, "node", "left")
    stands = (F.col("node") == F.col("head")) & (F.col("at") == F.col("component_at")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
        F.col("at").alias("text_key"), F.coalesce(stands, F.col("node").isNull()).alias("stands"))


def _exact_links(ids, nodes, families, percent: int, family_rows: int) -> DataFrame:
    """Links between members of a family that their full shingle sets confirm, as a forest for each task."""
    size = families.groupBy("label").agg(F.count("*").alias("n"))
    members = families.join(size, "label").join(nodes.select("node", "first_id", F.col("at").alias("_at")), "node")
    # One document stands for a node, found by its text's hash and its id or the lack of one; copies of that row all
    # meet it and a task keeps one of them.
    texts = ids.join(members, (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = texts.select("node", F.struct("label", "n").alias("region"), "text")
    sets = texts.mapInArrow(_sets, "node binary, region struct<label binary, n bigint>, shingles binary")
    sets = sets.select("node", "region.label", "region.n", "shingles")
    pairs = _block_pairs(sets, "n", family_rows)
    pairs = pairs.select("node", F.concat(F.hex("label"), F.lit(":"), "_pair").alias("family"), "shingles")
    return (pairs.repartition("family").sortWithinPartitions("family")
            .mapInArrow(_confirmed(percent), "a binary, b binary"))
