import zlib
from collections import defaultdict

from vellumark.llm.sharding import shard_by_bytes


def check(docs, rows, shards=24):
    want = sorted((d.doc_id if d.doc_id is not None else -1, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.size
    target, largest = sum(size.values()) / shards, max(r.size for r in rows)
    assert all(abs(size[s] - target) <= 2 * largest + 0.02 * target for s in range(shards))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs.collect(), shard_by_bytes(docs).collect())


def test_groups_stay_together_unless_hot(spark):
    rows = [(k, f"text {k // 2}" * 20, 1) for k in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shard_by_bytes(docs).collect()
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    check(docs.collect(), out)


def test_groups_of_all_sizes_stay_whole(spark):
    """Groups below and above a hundredth of a shard, up to nearly a shard, stay whole, and shards are near equal; only a group of more than a shard is cut."""
    rows = [(k, f"only {k} " * 8) for k in range(3000)] + [(10_000 + 1000 * g + k, f"group {g} " * 10) for g in range(30) for k in range(4 * g)] + [(90_000 + k, "hot " * 20) for k in range(2500)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, law string").repartition(12)
    out = shard_by_bytes(docs, 8).collect()
    check(docs.collect(), out, 8)
    size, where = defaultdict(int), defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        where[r.text_crc32, r.size].add(r.shard)
    target = sum(size.values()) / 8
    assert all(abs(size[s] - target) <= 0.03 * target for s in range(8))
    assert sorted(len(s) for s in where.values() if len(s) > 1) == [3] and len(where) == 3030


def test_very_long_text(spark):
    rows = [(1, "long " * 400_000, "x"), (2, "short", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    check(docs.collect(), shard_by_bytes(docs, 4).collect(), 4)


def test_hot_text_and_edges(spark):
    rows = [(k, "hot text", 1) for k in range(500)] + [(k, f"cold {k}", 1) for k in range(500, 1000)] + [(None, None, 1), (5, "", 1), (5, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    check(docs.collect(), shard_by_bytes(docs).collect())
    assert shard_by_bytes(docs.where("false")).collect() == []
