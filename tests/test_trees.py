"""Ordered scans, parents, splits and interval labels against plain versions, with few rows a partition."""

import random

import pytest
from pyspark.sql import functions as F

from vellumark.operators import toc as TC
from vellumark.operators import trees
from vellumark.operators.ordered import Ordered


@pytest.fixture
def wide(spark):
    """Many partitions, none merged: keys reach over several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_values(wide):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, rng.randrange(100)])) for k in range(200)]
    o = Ordered(wide.createDataFrame(rows, "k string, n int, v int"), "k", ["n"])
    o = o.sums({"s": F.col("v")}).sums({"t": F.col("v")}, strict=True).most({"m": F.col("v")}).before({"p": F.col("v")}).after({"x": F.col("v")})
    assert o.df.select("__part").distinct().count() == 5
    got = {(r.k, r.n): (r.s, r.t, r.m, r.p, r.x) for r in o.rows().collect()}
    for key in ("a", "b", None):
        mine = sorted((n, v) for k, n, v in rows if k == key)
        for i, (n, _) in enumerate(mine):
            upto, earlier, later = ([v for _, v in part if v is not None] for part in (mine[: i + 1], mine[:i], mine[i + 1 :]))
            assert got[key, n] == (sum(upto), sum(earlier), max(upto, default=None), earlier[-1] if earlier else None, later[0] if later else None)


def plain_parents(levels, urls, above):
    out, by_url, open_at = [], {}, {}
    for k, level in enumerate(levels):
        up = by_url.get(above[k]) if above[k] else None
        if up is None and level > 0:
            up = open_at.get(level - 1)
        out.append(up)
        open_at = {lv: at for lv, at in open_at.items() if lv < level} | {level: k}
        if urls[k]:
            by_url[urls[k]] = k
    return out


def plain_groups(sizes, limit):
    out, group, filled, n = [], 0, 0, 0
    for s in sizes:
        if n and filled + s > limit:
            group, filled, n = group + 1, 0, 0
        out.append(group)
        filled, n = filled + s, n + 1
    return out


def plain_chapters(sizes, chapters, limit):
    runs = []
    for k, c in enumerate(chapters):
        if runs and chapters[runs[-1][0]] == c:
            runs[-1].append(k)
        else:
            runs.append([k])
    out, group, filled = [0] * len(sizes), -1, None
    for run in runs:
        total = sum(sizes[k] for k in run)
        if filled is not None and filled + total <= limit:
            filled += total
        elif total > limit:
            inner = plain_groups([sizes[k] for k in run], limit)
            for k, g in zip(run, inner, strict=True):
                out[k] = group + 1 + g
            group, filled = group + 1 + inner[-1], None
            continue
        else:
            group, filled = group + 1, total
        for k in run:
            out[k] = group
    return out


def parents_of(spark, tables):
    rows = [(s, k, lv, u, a) for s, entries in tables.items() for k, (lv, u, a) in enumerate(entries)]
    out = TC.resolve_parents(spark.createDataFrame(rows, "source_id string, sort_order int, level int, url string, parent_url string"))
    got = {(r.source_id, r.sort_order): r.parent_pos for r in out.collect()}
    assert len(got) == len(rows)
    return {s: [got[s, k] for k in range(len(entries))] for s, entries in tables.items()}


def test_parents_of_known_tables(wide):
    tables = {
        "a": [(0, "a", None), (1, "b", "a"), (0, "c", None), (1, "d", "b")],
        "b": [(0, "a", None), (1, None, None), (2, "c", None), (1, "d", None), (2, "e", None)],
        "c": [(0, "a", None), (2, "b", None)],
        "d": [(0, "a", None), (1, "a", None), (1, "x", "a")],
        "e": [(0, "", ""), (1, "x", "none")],
    }
    assert parents_of(wide, tables) == {"a": [None, 0, None, 1], "b": [None, 0, 1, 0, 3], "c": [None, None], "d": [None, 0, 1], "e": [None, 0]}


def test_parents_of_any_tables_and_deep_ones(wide, monkeypatch):
    monkeypatch.setattr(TC, "LEVELS", 4)
    rng = random.Random(1)
    urls = [None, "", *(f"u{k}" for k in range(6))]
    tables = {f"s{k}": [(rng.randrange(6), rng.choice(urls), rng.choice([None, None, *urls])) for _ in range(n)] for k, n in enumerate([1, 7, 150])}
    tables["deep"] = [(k, None, None) for k in range(14)] + [(13 - k, None, None) for k in range(14)]
    assert parents_of(wide, tables) == {s: plain_parents(*map(list, zip(*e, strict=True))) for s, e in tables.items()}


def groups_of(spark, tables, limit, chapters=False):
    rows = [(s, k, m, c) for s, entries in tables.items() for k, (m, c) in enumerate(entries)]
    df = spark.createDataFrame(rows, "source_id string, ord int, estimated_tokens int, chapter string").withColumn("content_size_bytes", F.col("estimated_tokens"))
    got = {(r.source_id, r.ord): r.group_no for r in TC.greedy_split(df, "tokens", limit, chapter="chapter" if chapters else None).collect()}
    assert len(got) == len(rows)
    return {s: [got[s, k] for k in range(len(entries))] for s, entries in tables.items()}


@pytest.mark.parametrize("short", [0, 2000])
def test_splits(wide, monkeypatch, short):
    monkeypatch.setattr(TC, "SHORT", short)
    one = lambda sizes, c=None: [(m, (c or ["1"] * len(sizes))[k]) for k, m in enumerate(sizes)]
    tables = {"a": one([500, 500, 3000, 500, 500]), "b": one([30] * 8), "c": one([3000]), "d": one([0, 0, 2000, 0, 0, 1, 2000, 0])}
    assert groups_of(wide, tables, 2000) == {s: plain_groups([m for m, _ in e], 2000) for s, e in tables.items()}
    rng = random.Random(2)
    any_sizes = {f"s{k}": one([rng.choice([0, 1, 5, 40, 90, 130, 400]) for _ in range(n)], [rng.choice("12") if rng.random() < 0.3 else str(j // 9) for j in range(n)]) for k, n in enumerate([1, 2, 9, 250])}
    assert groups_of(wide, any_sizes, 100) == {s: plain_groups([m for m, _ in e], 100) for s, e in any_sizes.items()}
    assert groups_of(wide, any_sizes, 300, True) == {s: plain_chapters([m for m, _ in e], [c for _, c in e], 300) for s, e in any_sizes.items()}


def test_a_large_source_is_spread(spark):
    df = spark.range(200_000).select(F.lit("s").alias("source_id"), F.col("id").alias("ord"), (F.col("id") * 7919 % 1000).cast("int").alias("content_size_bytes"), F.lit(0).alias("estimated_tokens"))
    out = TC.greedy_split(df.repartition(8), "size", 50_000)
    assert "Pandas" not in out._jdf.queryExecution().toString()
    got = [r.group_no for r in out.orderBy("ord").select("group_no").collect()]
    assert got == plain_groups([k * 7919 % 1000 for k in range(200_000)], 50_000)


def plain_ancestors(up):
    out = {}
    for x in up:
        seen, at = set(), up.get(x)
        while at in up and at not in seen:
            seen.add(at)
            at = up[at]
        out[x] = seen
    return out


def forest(spark, up):
    return spark.createDataFrame([(k, v, f"entry {k}") for k, v in up.items()], "id string, parent_id string, title string")


@pytest.mark.parametrize("kind", ["any", "chain", "cycles"])
def test_subtrees_are_ranges(wide, kind):
    rng = random.Random(3)
    if kind == "any":
        up = {f"n{k}": None if k == 0 or rng.random() < 0.1 else f"n{rng.randrange(k)}" for k in range(120)} | {"lost": "nowhere"}
    elif kind == "chain":
        up = {f"n{k}": f"n{k - 1}" if k else None for k in range(1000)}
    else:
        up = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "self": "self", "under": "self", "r": None, "s": "r"} | {f"t{k}": f"t{k - 1}" if k else "c" for k in range(40)}
    toc, ancestors = forest(wide, up), plain_ancestors(up)
    labels = trees.label(toc).collect()
    assert len(labels) == len(up) and all(x.pre <= x.last for x in labels)
    at = {x.id: x for x in labels}
    assert all((at[a].pre <= at[x].pre <= at[a].last) == (a == x or a in ancestors[x]) for x in list(up)[:60] for a in list(up)[:60])
    some = ["n0", "n7", "n50", "a", "d", "self", "t5"]
    ids = wide.createDataFrame([(x,) for x in some if x in up], "id string")
    assert {r.id for r in TC.descendants(toc, ids).collect()} == {x for x in up if x in some or ancestors[x] & set(some)}
    if kind != "chain":
        assert {r.id for r in TC.visible(toc, ids).collect()} == {x for x in up if not (ancestors[x] - {x}) & set(some)}
        hits = {x for x in up if "7" in f"entry {x}" or x in ("t9", "under")}
        got = {r.id: r.expanded for r in trees.holding(trees.label(toc), wide.createDataFrame([(x,) for x in hits], "id string")).collect()}
        kept = hits | {a for x in hits for a in ancestors[x]}
        assert got == {x: any(up[c] == x for c in kept) for x in kept}


def test_display_order(wide):
    toc = wide.createDataFrame([("r", None, 0), ("x", "r", 2), ("y", "r", 1), ("z", "y", 0), ("q", None, 1)], "id string, parent_id string, sort_order int")
    assert [r.id for r in trees.label(toc, ["sort_order"]).orderBy("pre").collect()] == ["r", "y", "z", "x", "q"]
    assert trees.label(toc.limit(0), ["sort_order"]).count() == 0
