import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumark.llm import paragraphs as P


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(n)]


def planted(seed=1, copies=6):
    """Clean texts, and a passage of 55 words in some of them, in the middle of lines."""
    rng = np.random.default_rng(seed)
    passage = words(rng, 55)
    texts = [words(rng, int(rng.integers(40, 200))) for _ in range(40)]
    for k in range(copies):
        at = int(rng.integers(0, len(texts[k])))
        texts[k][at:at] = passage
    return passage, [" ".join(t) for t in texts]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_planted_passages(spark):
    for seed in range(3):
        passage, texts = planted(seed)
        rows = P.repeated_spans(frame(spark, texts)).collect()
        assert {r.doc_id for r in rows} == set(range(6)) and all(r.keeps for r in rows if r.doc_id == 0)
        for r in rows:
            assert set(texts[r.doc_id].split()[r.at : r.at + r.n_words]) <= set(passage)
        for k in range(1, 6):
            assert sum(r.n_words for r in rows if r.doc_id == k and not r.keeps) >= 10
        kept = {r.doc_id: r for r in P.drop_repeats(frame(spark, texts)).collect()}
        assert len(kept) == 40 and all(kept[k].text == t for k, t in enumerate(texts) if k == 0 or k >= 6)
        assert all(" ".join(passage) not in kept[k].text and kept[k].n_chars == len(kept[k].text) for k in range(1, 6))


def test_against_all_windows(spark, sf):
    """Documents that share 50 words with another are found; of others only such as share 20."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in P.repeated_spans(docs).collect()}

    def sharing(n):
        at = {}
        for d in docs.collect():
            w = d.text.lower().split()
            for k in range(len(w) - n + 1):
                at.setdefault(tuple(w[k : k + n]), set()).add(d.doc_id)
        return {d for s in at.values() if len(s) > 1 for d in s}

    assert len(sharing(50) - got) <= 0.02 * len(got) and len(got - sharing(20)) <= 0.02 * len(got)


def test_edges(spark):
    long = " ".join(words(np.random.default_rng(7), 90))
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, long, "x"), (4, long, "x"), (5, f"{long}\n\n{long}", "x"), (None, long, "x"), (6, "w " * 100_000, "x"), (7, f"head {long}", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = P.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {4, 5, 7} and 4 in {r.doc_id for r in got if r.keeps}
    assert P.repeated_spans(docs.where("false")).collect() == []
    kept = P.drop_repeats(docs).collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, 4, None, 5, 6, 7} and [r.text for r in kept if r.doc_id == 4] == [long, long]


def test_passage_in_every_text(spark):
    """Batches link their texts to their own first, and those to the first of all; nothing but the first stays."""
    passage, texts = planted(9, copies=40)
    docs = frame(spark, texts).repartition(8)
    for rows in ("7", "1000"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = P.passage_components(P.repeated_spans(docs)).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        gone = {}
        for r in got:
            gone[r.doc_id] = gone.get(r.doc_id, 0) + (0 if r.keeps else r.n_words)
        assert set(gone) == set(range(40)) and gone[0] == 0 and all(gone[k] >= 55 for k in range(1, 40)) and {r.component_id for r in got} == {0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=25))
def test_forest_connects_similar_sets(sets):
    arrays = [np.array(sorted(s), "u4") for s in sets]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = P.similar(arrays, 0.8)
    for a, b in links:
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b)
        up[root(a)] = root(b)
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert root(a) == root(b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBé \n\t\x0b\u00a0", max_size=12), max_size=6), st.integers(0, 3))
def test_words_are_runs_of_bytes(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    low, text, starts, ends = P.word_bounds(column)
    want = [(k, w) for k, t in enumerate(texts[min(skip, len(texts)) :]) for w in t.encode().lower().split()]
    assert [(int(k), bytes(low[a:b])) for k, a, b in zip(text, starts, ends)] == want
    h = P.word_hashes(low, starts, ends)
    assert len(set(h.tolist())) == len({w for _, w in want})


def test_recall_at_the_threshold(spark):
    """Passages of 30 to 100 words, copies edited down to a Jaccard coefficient just over 0.8: at least 0.95 are found, whole."""
    rng, texts, want = np.random.default_rng(5), [], []

    def jaccard(a, b):
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    while len(want) < 300:
        passage = words(rng, int(rng.integers(30, 101)))
        copy = list(passage)
        for _ in range(3):
            after, at, kind = list(copy), int(rng.integers(len(copy))), int(rng.integers(3))
            after[at : at + (kind != 2)] = [] if kind == 1 else ["edited"]
            copy = after if jaccard(passage, after) >= 0.8 else copy
        want.append((len(texts) + 1, len(copy), passage != copy))
        texts += [" ".join([*words(rng, 30), *passage, *words(rng, 30)]), " ".join([*words(rng, 20), *copy, *words(rng, 40)])]
    got = {r.doc_id: r.n_words for r in P.repeated_spans(frame(spark, texts)).where("not keeps").groupBy("doc_id").agg(F.sum("n_words").alias("n_words")).collect()}
    found = [got.get(d, 0) >= 0.9 * n for d, n, _ in want]
    assert sum(e for _, _, e in want) > 150 and np.mean(found) >= 0.95


def test_texts_that_share_an_id(spark):
    """Each text of an id loses its own spans."""
    rng = np.random.default_rng(6)
    one, two = words(rng, 60), words(rng, 70)
    rows = [(1, one), (2, two), (3, [*words(rng, 30), *one]), (3, [*two, *words(rng, 30)]), (3, None), (4, words(rng, 40))]
    docs = spark.createDataFrame([(k, w and " ".join(w), "x") for k, w in rows], "doc_id long, text string, spans string")
    kept = sorted((r.doc_id, len((r.text or "").split())) for r in P.drop_repeats(docs).collect())
    assert kept == [(1, 60), (2, 70), (3, 0), (3, 30), (3, 30), (4, 40)]
    assert {(r.doc_id, r.first_doc) for r in P.repeated_spans(docs).where("not keeps").collect()} == {(3, 1), (3, 2)}


def test_components_of_removals(spark):
    rng = np.random.default_rng(8)
    one, two, three = words(rng, 40), words(rng, 40), words(rng, 40)
    texts = [" ".join(t) for t in (one, one + two, two, three, words(rng, 40), three)]
    got = {r.doc_id: r.component_id for r in P.passage_components(P.repeated_spans(frame(spark, texts))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 5: 3}


@given(st.text(alphabet="ab \n", max_size=40), st.lists(st.tuples(st.integers(0, 8), st.integers(1, 4)), max_size=3))
def test_cut_spans(text, spans):
    gone = {k for at, n in spans for k in range(at, at + n)}
    assert P.cut_spans(text, spans).split() == [w for k, w in enumerate(text.split()) if k not in gone] or any(a + 1 in gone and a not in gone for a in range(10))


def edited(rng, passage, changes):
    """A copy with ``changes`` words replaced, left out or put in, a third of its length apart."""
    out = list(passage)
    for k in range(changes, 0, -1):
        at, kind = len(passage) * k // (changes + 1) + int(rng.integers(-3, 4)), int(rng.integers(3))
        out[at : at + (kind != 2)] = [] if kind == 1 else ["edited"]
    return out


def test_whole_passages_and_edited_copies(spark):
    """Equal and edited passages of 50 to 100 words are found from their first word to their last."""
    rng, texts, want = np.random.default_rng(3), [], []
    for n, changes in [(21, 0), (35, 0), (55, 0), (100, 0), (50, 1), (60, 1), (70, 1), (100, 2)] * 8:
        passage = words(rng, n)
        for copy in (passage, edited(rng, passage, changes)):
            head = words(rng, int(rng.integers(0, 60)))
            want.append((len(texts), len(head), len(copy), len(texts) % 2 == 0))
            texts.append(" ".join(head + copy + words(rng, int(rng.integers(0, 60)))))
    got = {}
    for r in P.repeated_spans(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.at, r.n_words, r.keeps))
    for doc, at, n, keeps in want:
        (span,) = got[doc]
        # A word or two of the context can be equal by chance.
        assert abs(span[0] - at) <= 2 and abs(span[0] + span[1] - at - n) <= 2 and span[2] == keeps


def test_no_far_copies_and_long_matches(spark):
    """Every fifth word differs: nothing; a match far beyond what is read first is followed to its end."""
    rng = np.random.default_rng(4)
    passage, long = words(rng, 60), words(rng, 3000)
    other = [w if k % 5 else "z" for k, w in enumerate(passage)]
    changed = [w if k % 2000 else "z" for k, w in enumerate(long)]
    texts = [" ".join(passage), " ".join(other), " ".join(long), " ".join(changed), "w " * 3000, "w " * 2000]
    got = {(r.doc_id, r.keeps): (r.at, r.n_words) for r in P.repeated_spans(frame(spark, texts)).collect()}
    assert got == {(2, True): (1, 2999), (3, False): (1, 2999), (4, True): (0, 3000), (5, False): (0, 2000)} or got == {(2, True): (1, 2999), (3, False): (1, 2999), (4, True): (0, 2000), (5, False): (0, 2000)}
