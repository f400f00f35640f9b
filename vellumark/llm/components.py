"""Connected components of an edge table, without gathering edges anywhere.

Each task first reduces its own edges to stars (a union-find over what it holds), then
large-star and small-star rounds (Kiveris et al., 2014) run as joins and aggregations
until a round changes nothing. Every round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import drop, table

#: Edges that one union-find takes before it emits its stars.
EDGES_AT_ONCE = 200_000


class UnionFind:
    """Smallest member as root; grows with the nodes it has been given."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.up[high] = low
            self.up.setdefault(low, low)

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf, n = UnionFind(), 0

    def out() -> pa.RecordBatch:
        a, b = uf.stars()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uf.join(a, b)
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield out()
            uf, n = UnionFind(), 0
    yield out()


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node long, component long): the smallest node reachable.

    Nulls and self loops are ignored; a node without an edge has no row; repeated edges count once.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a != b")
    e = table(e.mapInArrow(_stars, "a long, b long").distinct(), "stars")
    mark = _mark(e)
    while mark[0]:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = table(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        drop(e)
        e, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
