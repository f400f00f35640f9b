import numpy as np

from vellumark.llm import decontam as D


def brute(index, text, least):
    """(window, segment) of all scores over every window and segment."""
    words, out = D.normal(text), set()
    for w in range(len(words) // D.SEGMENT + 1):
        terms = {index.ids[x] for x in words[w * D.SEGMENT : (w + 2) * D.SEGMENT] if x in index.ids}
        score = np.zeros(index.n)
        for t in terms:
            for k in range(index.first[t], index.first[t + 1]):
                score[index.segment[k]] += index.part[k]
        out |= {(w, int(s)) for s in np.flatnonzero(score >= least - 1e-9)}
    return out


def test_bounds_lose_nothing(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = D.Index(items)
    for d in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        words = D.normal(d.text)
        pairs = sorted({(w, index.ids[x]) for k, x in enumerate(words) if x in index.ids for w in {k // D.SEGMENT, max(0, k // D.SEGMENT - 1)}})
        for least in (0.2, 0.6):
            win, seg, _ = index.search(np.array([p[0] for p in pairs], "i8"), np.array([p[1] for p in pairs], "i8"), least)
            assert set(zip(win.tolist(), seg.tolist(), strict=True)) == brute(index, d.text, least)


def test_pivots_and_parts_lose_nothing(monkeypatch):
    """Common and rare words, many segments that tie, windows in parts of a few entries: the same as exhaustive scoring."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(words[min(299, int(k))] for k in rng.exponential(30, n))
    items = [(k, pick(int(rng.integers(1, 200)))) for k in range(60)]
    items += [(100, items[3][1]), (101, items[3][1])]
    index = D.Index(items)
    for text in [pick(900), f"{pick(50)} {items[3][1]} {pick(300)} {items[7][1]}", " ".join(words)]:
        own = D.normal(text)
        pairs = sorted({(w, index.ids[x]) for k, x in enumerate(own) if x in index.ids for w in {k // D.SEGMENT, max(0, k // D.SEGMENT - 1)}})
        for least in (0.1, 0.4, 0.8):
            for parts in (50, 2_000_000):
                monkeypatch.setattr(D, "PARTS", parts)
                win, seg, score = index.search(np.array([p[0] for p in pairs], "i8"), np.array([p[1] for p in pairs], "i8"), least)
                assert sorted(zip(win.tolist(), seg.tolist(), strict=True)) == sorted(brute(index, text, least)) and (score >= least - 1e-6).all()


def test_slices_score_like_the_whole(spark, monkeypatch):
    """Document frequencies are those of all items, however many slices there are."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_id, round(r.score, 9), r.start_word) for r in D.find_leaks(docs, items).collect())
    monkeypatch.setattr(D, "SLICE", 700)
    assert sorted((r.doc_id, r.item_id, round(r.score, 9), r.start_word) for r in D.find_leaks(docs, items).collect()) == whole


def test_finds_exactly_the_leaks(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    grams = [(r.item_id, D.grams(D.normal(r.text), 5)) for r in items.collect()]
    want = set()
    for d in docs.collect():
        own = D.grams(D.normal(d.text), 5)
        want |= {(d.doc_id, k) for k, g in grams if len(g & own) >= 0.8 * len(g)}
    assert want and got == want
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {k for k, _ in want}


def test_long_items_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    item = ". ".join(" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)) for _ in range(15))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x"), (4, item)], "item_id long, text string")
    rows = [(1, f"before {item} after", "x"), (2, None, "x"), (3, "", "x"), (1, "clean", "x"), (None, item, "x"), (4, "q " * 130_000 + item, "x"), (5, item[: len(item) // 3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for size in (D.SLICE, 100):
        monkeypatch.setattr(D, "SLICE", size)
        assert sorted({(r.doc_id or 0, r.item_id) for r in D.find_leaks(docs, items).collect()}) == [(0, 1), (0, 4), (1, 1), (1, 4), (4, 1), (4, 4)]
    assert D.find_leaks(docs.where("false"), items).collect() == []
    assert D.find_leaks(docs, items.where("false")).collect() == []
    assert sorted(r.doc_id or 0 for r in D.drop_leaks(docs, items).collect()) == [0, 2, 3, 5]
