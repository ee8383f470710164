"""The trie of rebuilt conversations against whole sequences, and its hard rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_trie
from ledgerloom.llm.conversation_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k0 string"


def plain(rows):
    """Every node by its whole sequence of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(own.get(rest, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    total = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [total[s] for s in children[seq]]
        total[seq] = (sum(b[0] for b in below) if below else 1,
                      sum(b[1] for b in below) + ((len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0))
    out = []
    for seq, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(seq))
        out.append((min(convs), len(seq), min(members[seq[:-1]]) if seq else None, len(convs), len(children[seq]), *total[seq],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def made(seed, convs=260, texts=3):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é😀", None, "bb" * texts]))
            for c in range(-30, convs) if rng.random() < 0.8 for t in range(rng.choice([1, 2, 3, 9]))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert got(trie(table)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def test_ties_nulls_and_copies(spark):
    rows = made(3)
    rows += [(None, 1, "user", "nobody")] * 3 + [(5, 1, "user", "again")] * 4
    assert got(trie(frame(spark, rows))) == plain(rows)


def test_one_long_conversation_over_several_ranges(spark):
    rows = [(200, i // 3, "user", f"t{i % 7}") for i in range(3000)] + made(5, 230)
    rows = [r for r in rows if r[0] is not None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows come in one range
    try:
        assert got(trie(frame(spark, rows).repartition(5))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_hashes_of_other_turns_are_found_out(spark, monkeypatch):
    good = conversation_trie.turn_hashes
    asked = []

    def weak(seed):
        asked.append(seed)
        return [F.length("text").cast("long"), F.lit(3).cast("long")] if seed == 1 else good(seed)

    monkeypatch.setattr(conversation_trie, "turn_hashes", weak)
    rows = made(7, 40)
    assert got(trie(frame(spark, rows))) == plain(rows)
    assert asked == [1, 2]


def test_many_ends_of_one_node_and_turnless(spark):
    # Copies over several ranges of ids, and conversations shorter than what they skip with no base to take from.
    rows = [(c, 0, "user", "same") for c in range(0, 20_000, 17)]
    assert got(trie(frame(spark, rows))) == plain(rows)


def test_long_text_and_nothing(spark):
    rows = [(0, 0, "user", "x" * 500_000), (0, 1, "user", "y"), (1, 0, "user", "x" * 500_000), (1, 1, "user", "z")]
    assert got(trie(frame(spark, rows))) == plain(rows)
    assert trie(frame(spark, [])).collect() == []
    assert trie(frame(spark, [(None, 1, "user", "nobody")])).collect() == []
