import numpy as np

from tests.llm import brute
from vellumark.llm import embeddings
from vellumark.llm.hnsw import Graph


def clustered(rng, n, dim=24):
    centres = rng.standard_normal((n // 8, dim))
    rows = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.3, 2.0], (n, 1))
    rows[: n // 5] = centres[0] + rng.standard_normal((n // 5, dim)) * 0.1
    return rows.astype("f4")


def plain(rows, threshold=0.9):
    x = {k: np.asarray(v, "f8") / np.linalg.norm(np.asarray(v, "f8")) for k, v in rows.items()}
    links = {a: sum(1 for b in x if b != a and x[a] @ x[b] >= threshold) for a in x}
    return links, brute.components(x, lambda a, b: x[a] @ x[b] >= threshold)


def test_several_shards(spark, monkeypatch):
    x = clustered(np.random.default_rng(1), 600)
    x[10] = x[11] = x[12]
    x[13] = x[12] * 2
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "SHARD", 200)
    monkeypatch.setattr(embeddings, "WIDE", 100)
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    links, comps = plain(dict(enumerate(x)))
    assert len(got) == 600
    found, all_ = sum(r.n_links for r in got.values()), sum(links.values())
    assert 0.99 <= found / all_ <= 1 and all(r.n_links <= links[k] for k, r in got.items())
    assert sum(got[k].component_id == comps[k] for k in got) >= 595
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "x"), (2, v, "x"), (3, None, "x"), (4, [0.0, 0.0, 0.0], "x"), (5, [1.0, None, 2.0], "x"), (6, [1.0, float("nan"), 2.0], "x"), (7, [1.0, float("inf"), 2.0], "x"), (8, [], "x"), (9, [1.0, 2.0], "x"), (10, [2.0, 4.0, 6.0], "x"), (None, v, "x"), (10, [2.0, 4.0, 6.0], "x"), (11, [-1.0, -2.0, -3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(df).collect()]
    assert len(got) == len(rows)
    assert sorted(g for g in got if g[0] in (1, 2, 10)) == [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False)]
    assert all((n, c, kept) == (0, k, True) for k, n, c, kept in got if k in (3, 4, 5, 6, 7, 8, 9, 11))
    assert embeddings.near_embeddings(df.where("false")).collect() == []


def unit(x):
    x = np.asarray(x, "f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_of_the_graph():
    """Own vectors and those of another shard; wide ones are named, the others' links found."""
    x, y = unit(clustered(np.random.default_rng(2), 3000)), unit(clustered(np.random.default_rng(2), 1500))
    graph = Graph(x.astype("f4"), np.arange(len(x)))
    for q, own in ((x, True), (y, False)):
        found, wide = embeddings.linked(graph, q.astype("f4"), np.float32(0.9), own)
        near = q @ x.T >= 0.9
        if own:
            np.fill_diagonal(near, False)
        near[wide] = False
        want = np.flatnonzero(near)
        assert len(want) > 1000 and np.isin(want, found).mean() >= 0.98
    assert set(range(600)) <= set(embeddings.linked(graph, x.astype("f4"), np.float32(0.9), True)[1].tolist())


def test_links_count_at_both_ends(monkeypatch):
    """Sums of links are twice the distinct pairs, found by narrow beams or not, in blocks or not, and copies count."""
    rng = np.random.default_rng(3)
    x = unit(clustered(rng, 900))
    for wide, recall in ((1000, 0.0), (1000, 0.99), (48, 0.99)):
        monkeypatch.setattr(embeddings, "WIDE", wide)
        monkeypatch.setattr(embeddings, "RECALL", recall)
        monkeypatch.setattr(embeddings, "OWN_BEAM", 4)
        parts = [x[:500], x[500:]]
        graphs = [Graph(p.astype("f4"), np.arange(len(p))) for p in parts]
        ones, total = np.ones(900, "i8"), np.zeros(900, "i8")
        links, label = embeddings.compare(parts[0], parts[1], ones, 0.9, graphs)
        total += links
        assert links[:500].sum() == links[500:].sum()
        for k, part in enumerate(parts):
            mine, _ = embeddings.compare(part, None, ones[: len(part)], 0.9, graphs[k : k + 1])
            assert mine.sum() % 2 == 0
            total[k * 500 : k * 500 + len(part)] += mine
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        assert (total <= near.sum(axis=1)).all() and (recall == 0 or total.sum() >= 0.99 * near.sum())
    counts = rng.integers(1, 4, 500)
    links, _ = embeddings.compare(parts[0], None, counts, 0.9, graphs[:1])
    assert links.sum() >= 0.99 * (near[:500, :500] @ counts).sum() and (links <= near[:500, :500] @ counts).all()


def test_audit_leaves_out_the_query_itself():
    """Without the graph's help a query that finds nothing but itself doesn't make recall look good."""
    x = unit(clustered(np.random.default_rng(4), 400)).astype("f4")
    own = np.arange(400) * 400 + np.arange(400)
    assert embeddings._recall(x, x, own, np.arange(400), np.float32(0.9), True) == 0.0


def test_vectors_go_to_few_cells_and_each_link_counts_in_one(monkeypatch):
    """Cells instead of all pairs of shards: few places a vector, nearly all links share a cell, none counts twice, wide ones included."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x[2000:2600] = x[rng.integers(0, 100, 600)] + rng.standard_normal((600, 64)) * 0.12
    x[2600:2800] = x[7] + rng.standard_normal((200, 64)) * 0.2
    x = unit(x)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    pivots = embeddings._apart(x[200:224], 0.9)
    a = np.arange(0, 3000, 6)
    rows = [{"a": k, "need": int(embeddings._needed(x[[i]], x[[j]], pivots)[0]), "n": 1} for k, i in enumerate(a) for j in np.flatnonzero(near[i])]
    margin = embeddings._margin(rows, x[a], pivots, 0.9)

    class Shared:
        value = {64: pivots}

    row, cell = embeddings._cells(Shared, {64: margin}, 64, x)
    assert len(pivots) == 24 and len(row) < 5 * len(x)
    cells = np.full((len(x), 24), -1)
    for i, c in zip(row, cell, strict=True):
        cells[i, c] = c
    for wide in (384, 48):
        monkeypatch.setattr(embeddings, "WIDE", wide)
        total = np.zeros(len(x), "i8")
        for c in range(24):
            own = np.flatnonzero(cells[:, c] == c)
            total[own] += embeddings.compare(x[own], None, np.ones(len(own), "i8"), 0.9, [Graph(x[own].astype("f4"), own)], cells[own], c)[0]
        assert (total <= near.sum(axis=1)).all() and total.sum() >= 0.98 * near.sum()
