"""The trie of rebuilt conversations, from fingerprints that are combined without rebuilding any text.

Method.  A conversation's turns t1, t2, ... have the fingerprint sum(h(ti) * B**i) modulo a prime.  With its length it is
an element of a monoid: (n, a) * (m, b) = (n + m, a + B**n * b), so a prefix of a rebuilt conversation is the product of
the base's head and of a stretch of the own turns, and that stretch is the difference of two prefixes of the stored
conversation.  Four primes give 124 bits.  Texts are read for the turns' hashes and lengths alone; a prefix is a few
numbers and the place of its last turn in the stored conversations.

Prefixes of one depth and fingerprint are a node.  That is verified, not assumed: all turns of one hash must equal the
stored turn that stands for them, and all prefixes of a node must have one parent and one last turn, which makes their
sequences equal turn by turn.  If either fails anywhere, all is done again with other hashes.

A node's smallest member owns it.  From the first node it owns a conversation owns all below, so what a subtree holds of
distinct nodes is a sum over its members, as is the count of its leaves; no step goes level by level.

Scale.  Turns are placed by sorted ranges, in which a conversation of any length is cut between tasks; its parts are joined
by the same product.  Sums over nodes are added up before the shuffle, joins are between unique keys or ones that
Spark can split.  SHA-256 has to be fed in order, so the ids of one node's ends pass through one task, as strings of the
up to 4096 ids of one range, never held together.  Nothing is sent to the driver but one row for each verification.

Turns stand in order of turn (null first), then role, then text; turns alike in all count each.  Rows without conv_id
belong to no conversation and take no part.  Null role or text is empty.  No conversations: no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable

#: Every conversation takes the first crc32 % (HEAD + 1) turns of the first of its hundred.
HEAD, FAMILY = 5, 100
#: Primes below 2**31, so that products fit a long, and a base for each.
PRIMES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353), (2_147_483_587, 1_234_567), (2_147_483_579, 7_654_321))
ENDS = "depth long, k0 long, k1 long, ends_sha256 string"
NODE = ["depth", "k0", "k1"]
ID_RANGE_BITS = 12


def turn_hashes(seed: int) -> list[Column]:
    """128 bits of a turn."""
    return [F.xxhash64(F.lit(2 * seed + i), "role", "text") for i in range(2)]


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent modulo prime, by table for small exponents and by squares beyond."""
    small = F.array(*[F.lit(pow(base, i, prime)).cast("long") for i in range(64)])
    squares = F.array(*[F.lit(pow(base, 1 << i, prime)).cast("long") for i in range(48)])

    used = F.filter(squares, lambda _, bit: F.getbit(exponent, bit) == 1)
    large = F.aggregate(used, F.lit(1).cast("long"), lambda done, square: done * square % prime)
    return F.when(exponent < 64, F.get(small, exponent.cast("int"))).otherwise(large)


def _factors(h0: Column, h1: Column) -> list[Column]:
    """What a turn puts in each of the four sums, never zero."""
    halves = [h0, F.shiftright(h0, 31), h1, F.shiftright(h1, 31)]
    return [F.pmod(h, F.lit(p - 1)) + 1 for h, (p, _) in zip(halves, PRIMES, strict=True)]


def _packed(sums: list[Column]) -> tuple[Column, Column]:
    return sums[0] * (1 << 31) + sums[1], sums[2] * (1 << 31) + sums[3]


def stored(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def one_turn_each(rows: DataFrame, hashes: list[Column]) -> bool:
    """Whether all turns of one hash equal the stored turn that stands for them."""
    turn = F.struct("role", "text")
    different = rows.groupBy(*[h.alias(f"h{i}") for i, h in enumerate(hashes)]).agg(F.min(turn).alias("stands"), F.max(turn).alias("other"))
    return different.where("stands <> other").isEmpty()


def placed_turns(rows: DataFrame, hashes: list[Column]) -> DataFrame:
    """conv_id, pos (from 1), h0, h1, chars of the turn, and over the turns up to it: so_far (chars) and e0 to e3."""
    key = ["conv_id", "turn", "role", "text"]
    # The last key tells apart only rows that are alike, so that many of them can lie in several ranges.
    ranged = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*key, "any").sortWithinPartitions(*key)
    slim = durable(ranged.select("conv_id", F.monotonically_increasing_id().alias("place"),
                                 hashes[0].alias("h0"), hashes[1].alias("h1"), F.length("text").cast("long").alias("chars")))
    n = len(PRIMES)
    slim = slim.withColumn("part", F.shiftright("place", 33))
    order = W.partitionBy("conv_id", "part").orderBy("place")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    slim = slim.withColumns({"pos": F.row_number().over(order).cast("long")})
    slim = slim.withColumns({f"t{i}": f * _power(b, F.col("pos"), p) % p
                             for i, (f, (p, b)) in enumerate(zip(_factors(F.col("h0"), F.col("h1")), PRIMES, strict=True))})
    slim = slim.withColumns({"so_far": F.sum("chars").over(so_far)} | {f"e{i}": F.sum(f"t{i}").over(so_far) % PRIMES[i][0] for i in range(n)})
    slim = slim.drop(*[f"t{i}" for i in range(n)])
    # A conversation that lies in several ranges: the product of the parts before.
    parts = slim.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "so_far", *[f"e{i}" for i in range(n)])).alias("all"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"n0": F.coalesce(F.sum("all.pos").over(earlier), F.lit(0)),
                               "c0": F.coalesce(F.sum("all.so_far").over(earlier), F.lit(0))})
    moved = {f"m{i}": F.col(f"all.e{i}") * _power(b, F.col("n0"), p) % p for i, (p, b) in enumerate(PRIMES)}
    parts = parts.withColumns(moved).withColumns({f"b{i}": F.coalesce(F.sum(f"m{i}").over(earlier), F.lit(0)) % PRIMES[i][0] for i in range(n)})
    later = parts.where("n0 > 0").select("conv_id", "part", "n0", "c0", *[f"b{i}" for i in range(n)])
    joined = slim.join(later, ["conv_id", "part"], "left")
    whole = [F.when(F.col("n0").isNull(), F.col(f"e{i}")).otherwise((F.col(f"b{i}") + F.col(f"e{i}") * _power(b, F.col("n0"), p)) % p).alias(f"e{i}")
             for i, (p, b) in enumerate(PRIMES)]
    zero = F.lit(0).cast("long")
    return joined.select("conv_id", (F.col("pos") + F.coalesce("n0", zero)).alias("pos"), "h0", "h1", "chars",
                         (F.col("so_far") + F.coalesce("c0", zero)).alias("so_far"), *whole)


def rebuilt(turns: DataFrame) -> DataFrame:
    """A row for each conversation: taken (turns of the base), skipped (own turns), length, chars, and the base's head."""
    sums = [f"e{i}" for i in range(len(PRIMES))]
    head = F.when(F.col("pos") <= HEAD, F.struct("pos", "h0", "h1", "chars", "so_far", *sums))
    each = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sum("chars").alias("own_chars"), F.sort_array(F.collect_list(head)).alias("own"))
    each = durable(each.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % FAMILY))
    bases = each.where("conv_id = base_id").select(F.col("conv_id").alias("base"), F.col("own").alias("head"))
    both = each.join(bases, F.col("base_id") == F.col("base"), "left")
    both = both.withColumn("asked", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int"))
    both = both.withColumn("head", F.slice(F.coalesce("head", F.expr("slice(own, 1, 0)")), F.lit(1), F.greatest("asked", F.lit(0))))
    zero = F.lit(0).cast("long")
    own_at = F.get("own", F.least("asked", F.col("n").cast("int")) - 1)
    base_at = F.get("head", F.size("head") - 1)
    both = both.withColumns({f"own_{c}": F.coalesce(own_at[c], zero) for c in ("so_far", *sums)}
                            | {f"base_{c}": F.coalesce(base_at[c], zero) for c in ("so_far", *sums)})
    left = F.greatest(F.col("n") - F.col("asked"), F.lit(0))
    return both.select(
        "conv_id", "base_id", "head", "asked", F.size("head").alias("taken"), (F.size("head") + left).cast("long").alias("length"),
        (F.col("base_so_far") + F.col("own_chars") - F.col("own_so_far")).alias("all_chars"), "own_so_far", "base_so_far",
        *[f"own_{c}" for c in sums], *[f"base_{c}" for c in sums])


def prefixes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one too: its node's key, its parent's, its last turn."""
    n = len(PRIMES)
    carried = ["length", "all_chars"]
    zero = F.lit(0).cast("long")

    def finished(rows: DataFrame, sums: list[Column]) -> DataFrame:
        rows = rows.withColumns({f"x{i}": s for i, s in enumerate(sums)})
        parents = [F.pmod(F.col(f"x{i}") - f * _power(b, F.col("depth"), p), F.lit(p))
                   for i, (f, (p, b)) in enumerate(zip(_factors(F.col("h0"), F.col("h1")), PRIMES, strict=True))]
        k0, k1 = _packed([F.col(f"x{i}") for i in range(n)])
        p0, p1 = _packed(parents)
        return rows.select("conv_id", "depth", k0.alias("k0"), k1.alias("k1"), p0.alias("p0"), p1.alias("p1"), "h0", "h1", "chars", "so_far",
                           "turn_conv_id", "turn_place", *carried)

    roots = plans.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("k0", "k1", "p0", "p1", "h0", "h1", "chars", "so_far")],
                         F.lit(None).cast("long").alias("turn_conv_id"), F.lit(None).cast("long").alias("turn_place"), *carried)
    heads = plans.select("conv_id", "base_id", *carried, F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.h0", "t.h1", "t.chars", "t.so_far", F.col("base_id").alias("turn_conv_id"),
        F.col("t.pos").alias("turn_place"), *carried, *[F.col(f"t.e{i}").alias(f"e{i}") for i in range(n)])
    own = turns.join(plans.drop("head"), "conv_id").where(F.col("pos") > F.col("asked"))
    # Own turns after the skipped ones stand in places moved by taken - asked, of which there are HEAD + 1.
    back = [F.array(*[F.lit(pow(b, -i, p)).cast("long") for i in range(HEAD + 1)]) for p, b in PRIMES]
    stretch = [F.pmod(F.col(f"e{i}") - F.col(f"own_e{i}"), F.lit(p)) * F.get(back[i], F.col("asked") - F.col("taken")) % p
               for i, (p, _) in enumerate(PRIMES)]
    tails = own.withColumns({f"s{i}": (F.col(f"base_e{i}") + s) % PRIMES[i][0] for i, s in enumerate(stretch)}).select(
        "conv_id", (F.col("pos") - F.col("asked") + F.col("taken")).alias("depth"), "h0", "h1", "chars",
        (F.col("base_so_far") + F.col("so_far") - F.col("own_so_far")).alias("so_far"), F.col("conv_id").alias("turn_conv_id"),
        F.col("pos").alias("turn_place"), *carried, *[f"s{i}" for i in range(n)])
    return roots.unionByName(finished(heads, [F.col(f"e{i}") for i in range(n)])).unionByName(finished(tails, [F.col(f"s{i}") for i in range(n)]))


def grouped(rows: DataFrame) -> DataFrame:
    """Nodes with their smallest member, and whether all their prefixes have one parent and one last turn."""
    told = ["p0", "p1", "h0", "h1", "chars", "so_far"]
    first = F.min(F.struct("conv_id", "turn_conv_id", "turn_place")).alias("first")
    nodes = rows.groupBy(*NODE).agg(first, F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in told], *[F.max(c).alias(f"{c}_") for c in told])
    alike = F.lit(True)
    for c in told:
        alike = alike & (F.col(c) == F.col(f"{c}_"))
    return nodes.select(*NODE, "first.*", "n_convs", *told, alike.alias("alike"))


def verified(conversations: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Prefixes and nodes by the first hashes, from seed on, of which equal ones stand for equal sequences only."""
    rows = stored(conversations)
    for attempt in count(seed):
        hashes = turn_hashes(attempt)
        turns = durable(placed_turns(rows, hashes))
        found = durable(prefixes(turns, durable(rebuilt(turns))))
        nodes = durable(grouped(found))
        if nodes.where("NOT alike").isEmpty() and one_turn_each(rows, hashes):
            return found, nodes.drop("alike")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node, of strings of ids that come in order of node and range."""
    key, digest, done = None, None, []

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            **{c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(NODE)}, "ends_sha256": pa.array([r[3] for r in rows], pa.string())})

    for batch in batches:
        for depth, k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if (depth, k0, k1) != key:
                if digest is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, k0, k1), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) >= 10_000:
            yield told(done)
            done = []
    if digest is not None:
        done.append((*key, digest.hexdigest()))
    if done:
        yield told(done)


def end_digests(rows: DataFrame) -> DataFrame:
    """For each node at which conversations end, the SHA-256 of their ids in order."""
    ends = rows.where("depth = length").withColumn("id_range", F.shiftright("conv_id", ID_RANGE_BITS))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    strings = ends.groupBy(*NODE, "id_range").agg(ids)
    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "id_range").drop("id_range").mapInArrow(_digests, ENDS)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations.

    turn_conv_id and turn_place (from 1) say where the node's last turn is stored.
    """
    rows, nodes = verified(conversations)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(
        F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # A conversation's first own node, the chars before it, and whether the last of its own nodes is a leaf.
    owners = durable(nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", (F.col("so_far") - F.col("chars")).alias("before"))).alias("own"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).select("conv_id", "own.*", "leaf").withColumnsRenamed({"depth": "own_depth"}))
    joined = rows.join(owners, "conv_id", "left")
    from_here = F.col("all_chars") - F.col("so_far") + F.col("chars")
    own_here = F.when(F.col("own_depth").isNull(), 0).when(F.col("depth") >= F.col("own_depth"), from_here).otherwise(F.col("all_chars") - F.col("before"))
    sums = joined.groupBy(*NODE).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(from_here - own_here).alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    nobody = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, NODE).join(end_digests(rows), NODE, "left").join(parents, ["depth", "p0", "p1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "turn_conv_id", "turn_place")


#: The same rows in DuckDB's SQL, with whole sequences as keys; crc32 bit by bit.
ORACLE = r"""
WITH o AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, n, conv_id - conv_id % 100 AS b,
           xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, y: CASE WHEN y >= 0 THEN xor(a, y) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h
    FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
p AS (SELECT c.*, least(c.h, coalesce(base.n, 0)) AS k FROM c LEFT JOIN c AS base ON base.conv_id = c.b),
s AS (
    SELECT p.conv_id, o.pos AS d, o.r, o.t, p.b AS turn_conv_id, o.pos AS turn_place FROM p JOIN o ON o.conv_id = p.b AND o.pos <= p.k
    UNION ALL
    SELECT p.conv_id, o.pos - p.h + p.k, o.r, o.t, p.conv_id, o.pos FROM p JOIN o ON o.conv_id = p.conv_id AND o.pos > p.h),
l AS (SELECT p.conv_id, coalesce(max(d), 0) AS len FROM p LEFT JOIN s ON s.conv_id = p.conv_id GROUP BY p.conv_id),
x AS (
    SELECT conv_id, d, list({'r': r, 't': t}) OVER (PARTITION BY conv_id ORDER BY d) AS q, length(t) AS chars, turn_conv_id, turn_place FROM s
    UNION ALL
    SELECT conv_id, 0, [], 0, NULL, NULL FROM p),
n AS (
    SELECT d, q, min(x.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           arg_min(x.turn_conv_id, x.conv_id) AS turn_conv_id, arg_min(x.turn_place, x.conv_id) AS turn_place,
           sha256(coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) FILTER (len = d), '')) AS ends_sha256
    FROM x JOIN l ON l.conv_id = x.conv_id GROUP BY d, q),
k AS (SELECT d - 1 AS d, q[1:len(q) - 1] AS q, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.q = n.q),
up AS (SELECT a AS d, q[1:a] AS q, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * chars AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m)),
u AS (SELECT d, q, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY d, q)
SELECT m.conv_id, m.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256, m.turn_conv_id, m.turn_place::BIGINT AS turn_place
FROM m JOIN u ON u.d = m.d AND u.q = m.q LEFT JOIN m AS parent ON parent.d = m.d - 1 AND parent.q = m.q[1:len(m.q) - 1]
"""
