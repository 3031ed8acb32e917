"""The prefix trie against brute force, over few and many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusward.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    ends = lambda key: hashlib.sha256(",".join(str(c) for c in members[key] if len(built[c]) == len(key)).encode()).hexdigest()
    return sorted((m[0], len(key), members[key[:-1]][0] if key else None, len(m), kids[key], leaves[key], saved[key], ends(key)) for key, m in members.items())


def found(frame):
    return sorted(map(tuple, frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def some(seed, n, words, copies=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3000), n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    rows += [(5000 + 100 * i, t, "user", f"same {t}") for i in range(copies) for t in range(3)]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 23])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed, partitions):
    # copies of one conversation, and of its beginnings, over many partitions
    rows = some(seed, 120, ["a", "bé", None, ""], copies=60)
    rows += [(20000 + 100 * i, t, "user", f"same {t}") for i in range(30) for t in range(1 + i % 3)]
    sequences = trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(trie.prefix_trie(sequences)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(7, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "tool", "x"), (None, 1, "user", "y"), (8, 0, "user", "z"), (108, 2**40, "user", "z" * 10000), (-3, 1, "user", "n")]
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("p")).withColumn("digests", F.lit(1)).withColumn("h", F.lit("q"))
    built = {r.conv_id: len(r.chars) for r in trie.rebuilt(extra).collect()}
    h = zlib.crc32(b"7") % 6
    assert built[7] == max(0, 4 - h) and None not in built
    assert sum(1 for r in found(trie.prefix_trie(trie.rebuilt(extra))) if r[1] == 0) == 1


def test_an_empty_table_has_no_nodes(spark):
    assert found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame([], SCHEMA)))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    # ids whose h is at least 1 and whose block's first conversation is absent
    rows = [(c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    assert found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
    assert brute(rows)[0][:6] == (rows[0][0], 0, None, len(rows), 0, 1)


def test_a_long_conversation(spark):
    rows = [(100 * i, t, "user", str(t % 7)) for i in range(3) for t in range(3000)]
    nodes = found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert len(nodes) == 3001 and {r[3] for r in nodes} == {3}
    assert max(nodes, key=lambda r: r[1])[7] == hashlib.sha256(b"0,100,200").hexdigest()
