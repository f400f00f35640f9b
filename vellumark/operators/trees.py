"""Interval labels of trees: an entry's descendants are a range of numbers, so a subtree is looked up without an ancestor closure.

Entries are numbered in display order (parent first, siblings by their order). An entry keeps its own number ``pre`` and the last of its subtree, ``last``: n rows, whatever the depth.
Sizes of subtrees and sums along paths come from pointers that double their reach each round, so a tree of depth d takes log2(d) rounds of joins on ids. Entries on a cycle
are one node of the labelled tree: they share a label, being each other's descendants. Entries whose parent isn't there are roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.operators.ordered import Ordered
from vellumark.plans.checkpoints import cut


#: Depth up to which nobody asks whether there is a cycle.
FEW_ROUNDS = 60


def _parents(toc: DataFrame) -> DataFrame:
    """(id, up): the parent if it is there."""
    known = toc.select(F.col("id").alias("up")).distinct()
    return toc.where("parent_id is not null").select("id", F.col("parent_id").alias("up")).join(known, "up", "left_semi").select("id", "up")


def _cycles(up: DataFrame) -> DataFrame:
    """(id, cycle) of entries on cycles: the cycle's smallest id.

    Pointers with a way on are kept and doubled. Those of a tree run out after log2(depth) rounds; once pointers reach farther than there are entries, what is
    left ends on a cycle.
    """
    jump = cut(up.select("id", F.col("up").alias("to"), F.least("id", "up").alias("low")))
    far, entries = 1, jump.count()
    while far <= entries and not jump.isEmpty():
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        jump = cut(jump.join(ahead, "to").select("id", F.col("next").alias("to"), F.least("low", "next_low").alias("low")))
        far *= 2
    return jump.select(F.col("to").alias("id")).distinct().join(jump, "id").select("id", F.col("low").alias("cycle"))


def _doubled(jump: DataFrame) -> DataFrame:
    ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return jump.join(ahead, "to").select("id", F.col("next").alias("to"))


def _sizes(nodes: DataFrame) -> DataFrame | None:
    """(node, up) to (node, size): entries of each subtree; None if there is a cycle."""
    sizes = nodes.select("node", F.lit(1).cast("long").alias("size"))
    jump, far = cut(nodes.where("up is not null").select(F.col("node").alias("id"), F.col("up").alias("to"))), 1
    while not jump.isEmpty():
        if far > FEW_ROUNDS and far > nodes.count():
            return None
        # What lies less than 2^k below is counted; the entry 2^k above takes it over.
        more = jump.join(sizes.withColumnRenamed("node", "id"), "id").groupBy("to").agg(F.sum("size").alias("more"))
        sizes = cut(sizes.join(more.withColumnRenamed("to", "node"), "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        jump, far = cut(_doubled(jump)), far * 2
    return sizes


def _sums_to_root(steps: DataFrame) -> DataFrame:
    """(node, up, step) to (node, pre): the sum of steps from the root."""
    sums = steps.select("node", F.col("up").alias("to"), F.col("step").alias("pre"))
    while not sums.where("to is not null").isEmpty():
        ahead = sums.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("pre").alias("more"))
        sums = cut(sums.join(ahead, "to", "left").select("node", F.col("next").alias("to"), (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre")))
    return sums.select("node", "pre")


def label(toc: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``id, pre, last, cyclic`` of entries ``id, parent_id`` and the columns of ``order`` (siblings' order, before the id)."""
    order = order or []
    up = cut(_parents(toc))
    entries = cut(toc.select("id", *order).join(up, "id", "left").select("id", F.col("id").alias("node"), "up", F.lit(False).alias("cyclic"), *order))
    sizes = _sizes(entries)
    if sizes is None:
        # A cycle hangs on nothing and is ordered as its smallest entry.
        cycles = cut(_cycles(up))
        above = cycles.select(F.col("id").alias("up"), F.col("cycle").alias("up_cycle"))
        entries = entries.join(cycles, "id", "left").join(above, "up", "left")
        parent = F.when(F.col("cycle").isNull(), F.coalesce("up_cycle", "up"))
        entries = cut(entries.select("id", F.coalesce("cycle", "id").alias("node"), parent.alias("up"), F.col("cycle").isNotNull().alias("cyclic"), *order))
        sizes = _sizes(entries.where("id = node"))
    # Siblings in order, the roots as children of nothing: what comes before each.
    sized = entries.where("id = node").select("node", "up", *order).join(sizes, "node")
    steps = Ordered(sized, "up", [*order, "node"]).sums({"earlier": F.col("size")}, strict=True).rows()
    steps = cut(steps.select("node", "up", "size", (F.col("earlier") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("step")))
    placed = steps.select("node", "size").join(_sums_to_root(steps), "node").select("node", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))
    return entries.select("id", "node", "cyclic").join(placed, "node").select("id", "pre", "last", "cyclic")


def below(labels: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """Labels of what lies in the subtrees of ``ids`` (column id), those included unless ``strict``.

    Ranges of subtrees are nested or apart, so an entry is inside one if the farthest end of those that began before it isn't passed.
    """
    tops = labels.join(ids.select("id").distinct(), "id", "left_semi")
    rows = labels.select("pre", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("until"), "id", "last", "cyclic")
    # A top's own row comes behind its mark, or before it where it doesn't count as below itself.
    marks = tops.select("pre", F.lit(2 if strict else 0).alias("kind"), F.col("last").alias("until"), F.col("id"), F.lit(None).cast("long").alias("last"), "cyclic")
    reach = Ordered(rows.unionByName(marks), None, ["pre", "kind", "id"]).most({"reach": F.col("until")}).rows()
    inside = (F.col("reach") >= F.col("pre")) & F.col("reach").isNotNull()
    if not strict:
        return reach.where((F.col("kind") == 1) & inside).select("id", "pre", "last", "cyclic")
    # Entries of a cycle are below each other: below a top of theirs, unless it is the only one and their own.
    around = tops.where("cyclic").groupBy("pre").agg(F.count(F.lit(1)).alias("tops"))
    own = tops.where("cyclic").select("id", F.lit(1).alias("own"))
    rows = reach.where("kind = 1").join(around, "pre", "left").join(own, "id", "left")
    return rows.where(inside | (F.coalesce("tops", F.lit(0)) > F.coalesce("own", F.lit(0)))).select("id", "pre", "last", "cyclic")


def holding(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """Entries that are or have below them one of ``hits`` (column id): ``id, expanded`` (a child is such an entry too)."""
    hit = hits.select("id", F.lit(1).cast("long").alias("hit")).distinct()
    by_place = labels.join(hit, "id", "left").groupBy("pre").agg(F.sum("hit").alias("here"))
    counted = Ordered(by_place, None, ["pre"]).sums({"until": F.col("here")}).rows()
    counted = cut(counted.select("pre", F.coalesce("here", F.lit(0)).alias("here"), "until"))
    ends = counted.select(F.col("pre").alias("last"), F.col("until").alias("at_last"))
    rows = labels.join(counted, "pre").join(ends, "last")
    deeper = F.col("at_last") - F.col("until")
    kept = rows.where((F.col("here") > 0) | (deeper > 0))
    return kept.select("id", ((deeper > 0) | F.col("cyclic")).alias("expanded"))
