import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from vellumark.llm import simhash


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash.simhash_digest(docs).collect()}
    want = {r.doc_id: brute.fingerprint(r.text) for r in docs.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    groups = brute.components(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    assert {k: r.component_id for k, r in got.items()} == groups


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (None, "one two", "x"), (6, "É à b c d", "x"), (6, "É à b c d", "x"), (7, "w " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_digest(docs).collect()}
    assert len(simhash.simhash_digest(docs).collect()) == len(rows)
    zero = "0" * 16
    assert got[1, zero] == got[2, zero] == got[3, zero] == 1
    assert {c for (k, _), c in got.items() if k in (4, 5, None)} == {4}
    assert simhash.simhash_digest(docs.where("false")).collect() == []


def test_hot_key_is_dealt_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = {base[i % 3] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for i in range(400)}
    fps = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(sorted(fps))]
    monkeypatch.setattr(simhash, "GROUP", 50)
    df = spark.createDataFrame(fps, "fp long, rep long")
    from vellumark.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, 4)).collect()}
    of = {k: f & (2**64 - 1) for f, k in fps}
    want = brute.components(of, lambda a, b: (of[a] ^ of[b]).bit_count() <= 4)
    assert {k: found.get(k, k) for k in of} == want


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_pigeonhole_covers_all_close_pairs(blocks):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(blocks, 4)]
    rng = np.random.default_rng(blocks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_keep_one(spark):
    rows = [(3, "a b c d e f", "p"), (1, "a b c d e f", "q"), (1, "a b c d e f", "q"), (9, "something else entirely here now", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted((r.doc_id, r.fp) for r in simhash.keep_one(docs).collect()) == [(1, "q"), (9, "r")]


def test_near_copies(spark):
    """Texts that share at least 0.8 of their five-word shingles go, others stay."""
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    texts = []
    for _ in range(40):
        base = words(300)
        copy = list(base)
        copy[int(rng.integers(20, 280))] = "changed"
        copy[int(rng.integers(20, 280))] = "other"
        texts += [" ".join(base), " ".join(copy), " ".join(words(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert all(got[k] == k for k in got if k % 3 != 1) and sum(got[k] == k - 1 for k in got if k % 3 == 1) >= 38
    assert simhash.near_components(docs.where("false")).collect() == []


def test_near_components_against_brute_force_jaccard(spark):
    """Pairs planted on both sides of a Jaccard coefficient of 0.8: exactly those at 0.8 and above are linked."""
    rng, texts = np.random.default_rng(9), []
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    for k in range(240):
        base = [word() for _ in range(204)]
        copy = list(base)
        # Each changed word far from others takes five of 200 shingles: 4 leave 0.82, 5 to 7 leave 0.78 to 0.70.
        for at in rng.choice(20, 4 + (k % 2) * (1 + k // 2 % 3), replace=False):
            copy[5 + 10 * at] = word()
        texts += [" ".join(base), " ".join(copy)]
    sets = [set(zip(*[t.split()[d:] for d in range(5)], strict=False)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    want = {k: k - 1 if k % 2 and len(sets[k] & sets[k - 1]) >= 0.8 * len(sets[k] | sets[k - 1]) else k for k in range(len(texts))}
    assert got == want and sum(want[k] != k for k in want) == 120
