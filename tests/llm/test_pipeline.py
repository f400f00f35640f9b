import numpy as np

import corpus_pipeline
from tests.llm import brute
from vellumark.llm import decontam, paragraphs, quality, simhash


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.table(stage(spark, before, sf), "test")
        old, new = {r.doc_id: r for r in before.collect()}, after.collect()
        if name != "packing":
            assert after.columns == columns and {r.doc_id for r in new} <= set(old) and len({r.doc_id for r in new}) == len(new)
        kept = {r.doc_id for r in new}
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert kept == {r.doc_id for r in quality.score(before, labels).collect() if r.predicted}
        if name == "near-duplicates":
            # Near copies are those with an exact Jaccard coefficient of 0.8 of their five-word shingles.
            words = {k: (r.text or "").encode("utf-8", "surrogatepass").lower().split() for k, r in old.items()}
            sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
            assert kept == set(brute.components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])).values())
        if name == "benchmark decontamination":
            grams = [decontam.grams(decontam.normal(r.text), 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {k for k, r in old.items() for g in grams if len(g & decontam.grams(decontam.normal(r.text), 5)) >= 0.8 * len(g)}
            assert kept == set(old) - leaks
        if name == "packing":
            assert kept == set(old)
        before = after


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_near_duplicates_are_those_of_brute_force_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {k: (t or "").encode("utf-8", "surrogatepass").lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    near = brute.components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(near.values())


def odd_documents(spark):
    """Nulls, empties, repeats, shared ids, ties, a long text, and columns named like the stages' own."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8))) for _ in range(n))
    one, two, shared = words(120), words(130), words(80)
    texts = [(1, one), (2, one), (2, two), (2, two), (3, None), (4, ""), (5, ""), (6, shared), (7, f"{words(60)} {shared} {words(60)}"), (None, words(90)), (None, None), (8, words(30_000)), (9, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, h string, __spans string, g long"
    return spark.createDataFrame([(k, t, None, "s", None if t is None else len(t), "x", "x", "x", "x", 1) for k, t in texts], names)


def test_stages_take_odd_documents(spark, sf):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    got = sorted(((r.doc_id, r.text[:9] if r.text else r.text) for r in kept.collect()), key=str)
    texts = {r.text for r in docs.where("doc_id = 2").collect()}
    # Of id 2 one text is a copy of 1, the other stays once; the empty ones are one group; rows without an id stay.
    assert kept.columns == docs.columns and [k for k, _ in got if k is not None] == [1, 2, 3, 6, 7, 8] and sum(k is None for k, _ in got) == 2
    assert {r.text for r in kept.where("doc_id in (1, 2)").collect()} == texts
    for stage in (corpus_pipeline.substring_stage, corpus_pipeline.decontamination_stage):
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns and out.count() == kept.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() >= (1 if name == "quality classifier" else 6)
        assert stage(spark, docs.where("false"), sf).collect() == []


def test_substring_stage_is_the_plain_one(spark):
    """Every word of a later copy of a passage of 20 words goes, and no other word."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    pick = lambda n: rng.choice(words, n).tolist()
    passages = [pick(int(rng.integers(20, 70))) for _ in range(6)]
    texts = [[w for k in range(3) for w in (*pick(int(rng.integers(5, 40))), *passages[int(rng.integers(6))])] for _ in range(30)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split() for r in paragraphs.drop_repeats(docs).collect()}
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        for a in range(len(t) - 19):
            run = t[a : a + 20]
            if any(run == o[b : b + 20] for o in texts[:k] for b in range(len(o) - 19)):
                gone[a : a + 20] = [True] * 20
        want = [w for w, g in zip(t, gone, strict=True) if not g]
        # A gap of up to four words is bridged, so a few words more can go; a word beside a passage can by chance be that of a copy it was not compared with.
        assert -8 <= len(got[k]) - len(want) <= 2
