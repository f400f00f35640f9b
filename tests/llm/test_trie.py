import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from vellumark.llm import trie
from vellumark.llm.queries import op11_trie


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest())


def rebuilt(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return out


def brute(rows):
    members, children = defaultdict(list), defaultdict(set)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * words
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(parts)
    return sorted(map(tuple, trie.prefix_trie(trie.rebuild(trie.turn_arrays(df))).collect()), key=str)


def test_conversations_agree_with_plain_nodes_and_duckdb(spark, sf):
    sf = f"{sf}/../sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op11_trie(spark, sf)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(con.execute(f"select {', '.join(out.columns)} from ({trie.SQL})").fetchall(), key=str) == got


@pytest.mark.parametrize("parts", [1, 13])
def test_shared_turns_over_partitions(spark, parts):
    """Few different turns, so that nodes are shared and reach over partitions; hot copies; absent bases; turnless conversations; ties, repeats and nulls."""
    rng = random.Random(parts)
    rows = [(rng.randrange(400) if c % 3 else None if c % 31 == 0 else c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", "", None, " x\ty z "])) for c in range(900)]
    rows += [(20 * (1000 + c), t, "user", f"same turn {t}") for c in range(300) for t in range(6)]
    rows += [(20 * 5000 + 19, t, "user", f"deep {t}") for t in range(700)] + [(20 * 5000 + 17, t, "user", f"deep {t}") for t in range(650)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert nodes(spark, rows, 3) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges(spark):
    assert nodes(spark, [(None, 1, "user", "x")]) == []
    one = [(7, None, None, None)]
    assert nodes(spark, one) == brute(one)
    assert nodes(spark, [(3, 0, "user", "word " * 300_000), (4, 0, "user", "word " * 300_000)]) == brute([(3, 0, "user", "word " * 300_000), (4, 0, "user", "word " * 300_000)])
    same = [(k, 0, "user", "hot") for k in range(2000)]
    assert nodes(spark, same) == brute(same)
