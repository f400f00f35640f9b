"""Tables of contents: order, parents, trees, reachability and filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.operators import trees
from vellumark.operators.ordered import Ordered
from vellumark.plans.checkpoints import cut


def dedupe(toc: DataFrame, key: str = "source_id", order: str = "pos") -> DataFrame:
    """First occurrence of each non-empty URL in order; entries without one stay; ``sort_order`` from 0."""
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    first = Window.partitionBy(key, F.when(blank, F.concat(F.lit("\u0001"), F.col(order))).otherwise(F.col("url"))).orderBy(order)
    kept = toc.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("sort_order", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


#: Levels looked at in one pass.
LEVELS = 32


def resolve_parents(toc: DataFrame, key: str = "source_id", order: str = "sort_order") -> DataFrame:
    """Adds ``parent_pos``, the place in the source's order (from 0) of the latest earlier entry with the parent's URL, else of the open entry one level up.

    The entry one level up is open if it is the nearest one before with a smaller level at all. For each level a running place of what is below it is kept, in passes of ``LEVELS`` levels
    over rows that are spread over tasks; there are as many levels as the deepest tree has. A source of any size is no task of its own.
    """
    places = Ordered(toc, key, [order]).sums({"__pos": F.lit(1)}, strict=True).settled()
    narrow = places.rows().select(key, F.col("__pos").alias("pos"), "level", "url", F.when(F.col("parent_url") != "", F.col("parent_url")).alias("parent_url"))

    # The nearest smaller level, as (place, level), by levels that occur.
    levels = sorted(r["level"] for r in narrow.select("level").distinct().collect() if r["level"] is not None)
    here = F.struct("pos", "level")
    found = None
    for k in range(0, len(levels), LEVELS):
        some = levels[k : k + LEVELS]
        below = narrow.where(F.col("level") <= some[-1]).select(key, "pos", "level")
        o = Ordered(below, key, ["pos"]).most({f"below_{j}": F.when(F.col("level") < v, here) for j, v in enumerate(some)}, strict=True)
        nearest = F.coalesce(*[F.when(F.col("level") == v, F.col(f"below_{j}")) for j, v in enumerate(some)])
        up = o.rows().where(F.col("level") >= some[0]).select(key, "pos", nearest.alias("near"))
        up = up.where(F.col("near.level").isNotNull()).select(key, "pos", "near")
        found = up if found is None else found.unionByName(up)

    # The latest earlier entry of the same URL: entries and those that look for one, by URL and place.
    named = narrow.where("url is not null and url != ''").select(key, F.col("url").alias("u"), "pos", F.lit(1).alias("kind"))
    asked = narrow.where("parent_url is not null").select(key, F.col("parent_url").alias("u"), "pos", F.lit(0).alias("kind"))
    both = named.unionByName(asked).select(key, "pos", "kind", F.struct(key, "u").alias("name"))
    by_url = Ordered(both, "name", ["pos", "kind"]).before({"by_url": F.when(F.col("kind") == 1, F.col("pos"))}).rows().where("kind = 0 and by_url is not null").select(key, "pos", "by_url")

    out = places.rows().withColumnRenamed(key, "__key")
    if found is not None:
        near = found.select(F.col(key).alias("__k1"), F.col("pos").alias("__p1"), "near")
        out = out.join(near, F.col("__key").eqNullSafe(F.col("__k1")) & (F.col("__pos") == F.col("__p1")), "left").drop("__k1", "__p1")
    else:
        out = out.withColumn("near", F.lit(None).cast("struct<pos:bigint,level:int>"))
    by_url = by_url.select(F.col(key).alias("__k2"), F.col("pos").alias("__p2"), "by_url")
    out = out.join(by_url, F.col("__key").eqNullSafe(F.col("__k2")) & (F.col("__pos") == F.col("__p2")), "left").drop("__k2", "__p2").withColumnRenamed("__key", key)
    open_entry = F.when((F.col("level") > 0) & (F.col("near.level") == F.col("level") - 1), F.col("near.pos"))
    return out.select(*toc.columns, F.coalesce("by_url", open_entry).alias("parent_pos"))


def ancestors(toc: DataFrame) -> DataFrame:
    """(id, ancestor, distance) with each entry at distance 0: joins that double the reach, until no entry has an ancestor so far up.

    Entries are joined by id, never collected; each pair counts once with its least distance, so cycles end.
    """
    up = toc.select("id", "parent_id").where("parent_id is not null")
    up = up.join(toc.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))
    own = toc.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    reach, far = cut(own.unionByName(up)), 1
    while (reach.agg(F.max("distance")).first()[0] or 0) >= far:
        # Everything up to ``far`` is known; what is twice as far is one join away.
        a = reach.select("id", F.col("ancestor").alias("mid"), F.col("distance").alias("d1"))
        b = reach.select(F.col("id").alias("mid"), "ancestor", F.col("distance").alias("d2"))
        reach = cut(a.join(b, "mid").select("id", "ancestor", (F.col("d1") + F.col("d2")).alias("distance")).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        far *= 2
    return reach


def roots(toc: DataFrame) -> DataFrame:
    """(id, root): the topmost ancestor, itself if it has none; one row an entry, whose pointer doubles its reach each round.

    An entry that ends in a cycle has the smallest id that it leads to.
    """
    known = toc.select(F.col("id").alias("parent_id"))
    jump = toc.select("id", "parent_id").join(known.withColumn("there", F.lit(True)), "parent_id", "left").select("id", F.when(F.col("there"), F.col("parent_id")).alias("up"))
    jump = cut(jump.select("id", F.coalesce("up", "id").alias("to"), F.col("up").isNull().alias("top"), F.least("id", F.coalesce("up", "id")).alias("low")))
    left, far, entries = 1, 1, jump.count()
    while left and far <= 2 * entries:
        b = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("top").alias("next_top"), F.col("low").alias("next_low"))
        jump = cut(jump.join(b, "to").select("id", F.col("next").alias("to"), F.col("next_top").alias("top"), F.least("low", "next_low").alias("low")))
        left, far = jump.where("not top").count(), far * 2
    return jump.select("id", F.when(F.col("top"), F.col("to")).otherwise(F.col("low")).alias("root"))


def descendants(toc: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids reachable from ``ids`` (column id), those included: ranges of interval labels."""
    return trees.below(cut(trees.label(toc)), ids).select("id")


def filter_tree(toc: DataFrame, q: str) -> DataFrame:
    """Entries whose title, or a descendant's, holds ``q`` (any case): kept, with whether a child is kept. A blank ``q`` keeps none."""
    if not q.strip():
        return toc.where(F.lit(False)).select("id", F.lit(False).alias("expanded"))
    hits = toc.where(F.contains(F.lower(F.col("title")), F.lit(q.lower()))).select("id")
    return trees.holding(cut(trees.label(toc)), hits)


def visible(toc: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Entries without a collapsed strict ancestor."""
    hidden = trees.below(cut(trees.label(toc)), collapsed, strict=True).select("id")
    return toc.join(hidden, "id", "left_anti")


def suffix_duplicates(rows: DataFrame, key: str, partition: str, order: str) -> DataFrame:
    """The n-th of equal keys (n from 2) gets ``-n``."""
    n = F.row_number().over(Window.partitionBy(partition, key).orderBy(order))
    return rows.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, F.concat(key, F.lit("-"), "__n")).otherwise(F.col(key))).drop("__n")


def islands(rows: DataFrame, value: str, partition: str, order: list[str]) -> DataFrame:
    """Adds ``island``: numbers runs of equal neighbours (nulls are equal), from 0."""
    w = Window.partitionBy(partition).orderBy(*order)
    new = (F.row_number().over(w) > 1) & ~F.lag(value).over(w).eqNullSafe(F.col(value))
    return rows.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w)).drop("__new")


def version_boundary(rows: DataFrame, partition: str, order: list) -> DataFrame:
    """Marks rows whose version differs from the previous row's, both given."""
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("boundary", F.coalesce(F.lag("version").over(w) != F.col("version"), F.lit(False)))


LIMITS = {"articles": 50, "size": 10 << 20, "tokens": 100_000}


def _starts(units: DataFrame, limit: float) -> DataFrame:
    """(seg, unit) of units that open a group, of ``seg, unit, m``: each segment's units in order, a group as long as its sum stays within the limit.

    Each unit points to the one that would open the next group if it opened one: the first behind it whose running sum is over its own by more than the limit. In one order of all sums, units
    and what they look for stand beside each other. From the first unit of a segment the pointers are followed by doubling their reach.
    """
    sums = Ordered(units, "seg", ["unit"]).sums({"until": F.col("m")}).rows()
    data = sums.select("seg", F.col("until").cast("double").alias("v"), F.lit(0).alias("kind"), "unit")
    asks = sums.select("seg", (F.col("until") - F.col("m") + F.lit(float(limit))).alias("v"), F.lit(1).alias("kind"), "unit")
    # A sum that equals what is looked for still fits, and stands before it. A unit that is too large alone is passed by: the next group opens behind it at the earliest.
    o = Ordered(data.unionByName(asks), "seg", ["v", "kind", "unit"]).after({"found": F.when(F.col("kind") == 0, F.col("unit"))})
    follow = Ordered(units.select("seg", "unit"), "seg", ["unit"]).after({"follow": F.col("unit")}).rows().select("seg", "unit", "follow")
    found = o.rows().where("kind = 1").select("seg", "unit", "found")
    jump = found.where("found is not null").join(follow.where("follow is not null"), ["seg", "unit"]).select("seg", "unit", F.greatest("found", "follow").alias("to"))
    jump = cut(jump)
    starts = cut(units.groupBy("seg").agg(F.min("unit").alias("unit")))
    while not jump.isEmpty():
        starts = cut(starts.unionByName(starts.join(jump, ["seg", "unit"]).select("seg", F.col("to").alias("unit"))))
        ahead = jump.select("seg", F.col("unit").alias("to"), F.col("to").alias("next"))
        jump = cut(jump.join(ahead, ["seg", "to"]).select("seg", "unit", F.col("next").alias("to")))
    return starts


#: Articles of a source up to which, in all sources, a fold over each source's numbers splits them.
SHORT = 2000


def _folded(narrow: DataFrame, limit: float, key: str, order: str) -> DataFrame:
    """The split of sources of at most ``SHORT`` articles, as a fold over an array of each one's numbers."""
    xs = narrow.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__m").alias("m")))).alias("__x"))

    def state(group, filled, out):
        return F.struct(group.alias("group"), filled.alias("filled"), out.alias("out"))

    def step(s, x):
        opens = (F.size(s["out"]) == 0) | (s["filled"] + x["m"] > limit)
        group = F.when(opens, s["group"] + 1).otherwise(s["group"])
        return state(group, F.when(opens, x["m"]).otherwise(s["filled"] + x["m"]), F.concat(s["out"], F.array(group)))

    start = state(F.lit(-1), F.lit(0).cast("long"), F.array().cast("array<int>"))
    groups = F.aggregate("__x", start, step, lambda s: s["out"])
    return xs.select(key, F.inline(F.arrays_zip(F.col("__x.o").alias("o"), groups.alias("g")))).select(key, F.col("o").alias(order), F.col("g").alias("group_no"))


def greedy_split(articles: DataFrame, split_by: str | None, limit: float | None = None, chapter: str | None = None, key: str = "source_id", order: str = "ord") -> DataFrame:
    """Adds ``group_no``: articles of each source in order, in files within a limit. An article is never cut.

    ``chapter``: whole chapters (runs of equal neighbours) to a group while they fit; one that alone exceeds the limit is split by itself, and closes its last group. No task has a source of its own.
    """
    if split_by not in LIMITS:
        return articles.withColumn("group_no", F.lit(0))
    most = limit or LIMITS[split_by]
    measure = {"articles": F.lit(1), "size": F.col("content_size_bytes"), "tokens": F.col("estimated_tokens")}[split_by]
    narrow = articles.select(key, order, F.coalesce(measure.cast("long"), F.lit(0).cast("long")).alias("__m"), *([F.struct(F.col(chapter)).alias("__c")] if chapter else []))
    if chapter is None and (narrow.groupBy(key).count().agg(F.max("count")).first()[0] or 0) <= SHORT:
        return _numbered(articles, _folded(narrow, most, key, order), key, order)
    rows = Ordered(narrow, key, [order]).sums({"__row": F.lit(1)}, strict=True).settled()
    if chapter is None and split_by == "articles":
        numbers = rows.rows().select(key, order, F.floor(F.col("__row") / max(1, int(most))).cast("int").alias("group_no"))
        return _numbered(articles, numbers, key, order)
    if chapter is None:
        opened = _starts(rows.rows().select(F.struct(key).alias("seg"), F.col("__row").alias("unit"), F.col("__m").alias("m")), most).select(F.col(f"seg.{key}").alias("__k"), F.col("unit").alias("__u"))
    else:
        # Chapters, and those larger than the limit as segments of their own with rows as units; between them chapters are units.
        runs = rows.before({"__last": F.col("__c")}).sums({"__run": F.when((F.col("__row") > 0) & ~F.col("__last").eqNullSafe(F.col("__c")), 1).otherwise(0)}).settled()
        chapters = runs.rows().groupBy(key, "__run").agg(F.sum("__m").alias("total"), F.min("__row").alias("unit"))
        large = (F.col("total") > most).cast("int")
        parts = Ordered(chapters.withColumn("large", large), key, ["__run"]).before({"before": F.col("large")}).sums({"part": F.when((F.col("large") == 1) | (F.coalesce("before", F.lit(0)) == 1), 1).otherwise(0)}).settled()
        small = parts.rows().where("large = 0").select(F.struct(key, "part").alias("seg"), "unit", F.col("total").alias("m"))
        cut_up = parts.rows().where("large = 1").select(F.col(key).alias("__k"), F.col("__run").alias("__r"), "part")
        inner = runs.rows().join(cut_up, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r"))).select(F.struct(key, "part").alias("seg"), F.col("__row").alias("unit"), F.col("__m").alias("m"))
        opened = _starts(cut(small.unionByName(inner)), most).select(F.col(f"seg.{key}").alias("__k"), F.col("unit").alias("__u"))
    marked = rows.rows().join(opened.withColumn("__opens", F.lit(1)), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__row") == F.col("__u")), "left").select(key, order, "__row", "__opens")
    numbers = Ordered(marked, key, ["__row"]).sums({"__g": F.col("__opens")}).rows().select(key, order, (F.col("__g") - 1).cast("int").alias("group_no"))
    return _numbered(articles, numbers, key, order)


def _numbered(articles: DataFrame, numbers: DataFrame, key: str, order: str) -> DataFrame:
    numbers = numbers.select(F.col(key).alias("__k"), F.col(order).alias("__o"), "group_no")
    return articles.join(numbers, F.col(key).eqNullSafe(F.col("__k")) & F.col(order).eqNullSafe(F.col("__o"))).drop("__k", "__o")


def budget_take(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """In order, takes a row if its cost fits in what is left of the budget, else passes over it.

    Sequential, so one task walks a key's numbers; keys are spread.
    """
    narrow = rows.select(key, order, F.col(cost).cast("long").alias("c"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        left, taken = budget, []
        for c in group["c"].tolist():
            fits = c <= left
            left -= c if fits else 0
            taken.append(fits)
        return pd.DataFrame({key: group[key], order: group[order], "taken": taken})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return narrow.groupBy(key).applyInPandas(walk, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, taken boolean")


def generic_parents(urls: DataFrame, key: str = "source_id") -> DataFrame:
    """``parent_url``: the URL without its last segment, if it is in the set (with a slash first, then bare)."""
    up = F.regexp_replace(F.regexp_replace("url", "/$", ""), "[^/]*$", "")
    known = urls.select(key, F.col("url").alias("__u")).distinct()
    out = urls.withColumn("__slash", up).withColumn("__bare", F.regexp_replace(up, "/$", ""))
    out = out.join(known.withColumnRenamed("__u", "__slash").withColumn("__a", F.lit(True)), [key, "__slash"], "left").join(known.withColumnRenamed("__u", "__bare").withColumn("__b", F.lit(True)), [key, "__bare"], "left")
    return out.withColumn("parent_url", F.when(F.col("__a"), F.col("__slash")).when(F.col("__b"), F.col("__bare"))).drop("__slash", "__bare", "__a", "__b")
