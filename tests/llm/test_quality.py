import zlib

import numpy as np
import pytest

from vellumark.llm import quality


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert auc(*map(np.array, zip(*held, strict=True))) > 0.95


def test_held_out_labels_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", labels.quality * 0)
    flipped = labels.join(labels.where(~quality.held_out(labels.doc_id)).select("doc_id"), "doc_id").unionByName(other.where(quality.held_out(other.doc_id)))
    a, b = (sorted(tuple(r) for r in quality.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_edges(spark):
    good = [(k, f"plain words of text number {k} that go on and on", "x") for k in range(1, 60)]
    docs = spark.createDataFrame([*good, (100, None, "x"), (101, "", "x"), (None, "no id", "x"), (1, good[0][1], "x"), (102, "long " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)] + [(1, None, None), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("false"), labels).collect() == []
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


@pytest.mark.parametrize("text", [None, "", "a", "ab", "é", "\n\n", "A!" * 10])
def test_terms(text):
    assert terms_ok(quality.terms(text))


def terms_ok(counts):
    return counts.shape == (2 * quality.BINS + 5 * quality.STEPS,) and counts.min() >= 0 and counts[2 * quality.BINS :].sum() == 5


def test_slices_make_no_difference(monkeypatch):
    text = "Some Words, 123 and é!! more\n" * 50
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "SLICE", 17)
    assert (quality.terms(text) == whole).all()


def test_vote_is_the_plain_one():
    """Cosines one by one, the nearest by sorting; ties at the last place all vote, whatever the block."""
    rng = np.random.default_rng(3)
    known = [" ".join(rng.choice(["alpha", "beta!", "Gamma", "12", "delta,"], int(rng.integers(1, 60)))) for _ in range(40)]
    known += known[:20]
    labels = rng.integers(0, 2, len(known)).astype("f8")
    model = quality.fit(np.stack([quality.terms(t) for t in known]), labels, latent=12)
    texts = [*known[:15], None, "", "new words here", "12 12 Gamma!"]
    counts = np.stack([quality.terms(t) for t in texts])
    got = quality.vote(model, counts, 5)
    for c, score in zip(counts, got, strict=True):
        v = quality._weigh(c[None].copy(), model["idf"])[0].astype("f8") @ model["basis"].astype("f8")
        v /= max(np.sqrt(sum(x * x for x in v)), 1e-9)
        cosines = [round(float(sum(a * float(b) for a, b in zip(v, w, strict=True))), quality.DIGITS) for w in model["vectors"]]
        last = sorted(cosines, reverse=True)[4]
        votes = [(max(x, 1e-3) ** 8, y) for x, y in zip(cosines, labels, strict=True) if x >= last]
        assert abs(score - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-6
    assert (np.concatenate([quality.vote(model, counts[k : k + 1], 5) for k in range(len(counts))]) == got).all()
