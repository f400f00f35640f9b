from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from vellumark.llm import packing, tokenfiles, tokens
from vellumark.llm.queries import tokenizer_path
from vellumark.llm.tokens import encoder

ODD = [None, "", " ", "a", "a  b", "a \n b", "x\n \ny", " lead", "trail ", "tab\t x", "  b  \n", "né à l'été  12 3", "<|endoftext|> a <|endoftext|>", "nb\xa0 sp 　 z", "\x1c a \x1d b", "don't we'll 'tis", "z" * 3000, "!!??  ...\n\n\n end"]


def plain(text):
    tok = encoder(tokenizer_path()).tok
    return tok.encode(text or "", add_special_tokens=False).ids


def ours(text):
    return np.frombuffer(encoder(tokenizer_path()).encode(text or ""), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ours(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab. \n\t'é1\xa0\x1c !")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert ours(text) == plain(text)


#: White space of two and three bytes, letters and signs of two, marks of three, single and repeated line breaks, contractions, brackets.
PIECES_OF_TEXT = ["a", "Bc", "é", "É", "×", "÷", "ж", "Σ", "中", "“", "”", "'s", "'", ".", ", ", "(", "9", "٣", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x85", "\u180e", "\u2003", "\u2028", "\u3000", "\u0301", "😀", "<|endoftext|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES_OF_TEXT), max_size=12).map("".join) | st.none(), max_size=8), st.integers(8, 40))
def test_columns_of_texts(texts, at_once):
    """Many texts at once, sliced columns, and texts longer than what is cut at once."""
    enc, got = encoder(tokenizer_path()), []
    enc.known, enc.ids = enc.known[:0], enc.ids[:0]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "AT_ONCE", at_once)
        m.setattr(tokens, "REMEMBER", 20)
        for k, ids, at in enc.column(pa.array(["x y", *texts, "z"]).slice(1, len(texts)), np.array([7], "<u4").tobytes()):
            assert k == len(got)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert len(enc.known) <= 20
    assert got == [plain(t) + [7] for t in texts]


def test_what_a_worker_holds_and_encodes():
    """Remembered parts are Arrow buffers of a bounded size, the latest first; words of a column are encoded once, whatever punctuation follows."""
    enc = tokens.Encoder(tokenizer_path())
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in ("an", "el", "ir", "om", "us") * 4 for c in "npqrstvwxz" for d in ("ab", "ec", "id", "of", "ug")]
    text = " ".join(f"{w}{t}" for w in words for t in ("", ".", ",", ");"))
    seen = []
    part = enc._part
    enc._part = lambda p: seen.append(p) or part(p)
    for _, ids, _ in enc.column(pa.array([text, text])):
        assert ids.tolist() == plain(text) * 2
    assert len(seen) == len(set(seen)) <= len(set(words)) + 10
    assert enc.known.nbytes + enc.ids.nbytes < 40 * len(enc.known)


def test_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert ours(r.text) == plain(r.text)


def odd_docs(spark):
    rows = [(k, t, "s") for k, t in enumerate(ODD)] + [(None, "no id", "s"), (3, "same id", "s"), (3, "same id", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_token_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tokenfiles.token_file_digest(docs, tokenizer_path(), path=str(tmp_path / "a")).collect())
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = plain(d.text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), brute.crc_ids(ids))
        start += len(ids)


def test_token_files_edges(spark, tmp_path):
    got = tokenfiles.token_file_digest(odd_docs(spark), tokenizer_path(), path=str(tmp_path / "a")).collect()
    assert sorted(r.ids_crc32 for r in got) == sorted(brute.crc_ids(plain(t) + [0]) for t in [*ODD, "no id", "same id", "same id"])
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    empty = tokenfiles.token_file_digest(odd_docs(spark).where("false"), tokenizer_path(), path=str(tmp_path / "b"))
    assert empty.collect() == []


def test_selective_read(spark, sf, tmp_path):
    tokenfiles.write_token_ids(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path), tokenizer_path())
    plan = tokenfiles.read_token_ids(spark, str(tmp_path)).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_file_format_and_skipped_pages(spark, tmp_path):
    """Ids are dictionary-encoded, row groups and pages bounded, pages indexed; a read of a few documents skips the other pages, one of the metadata all ids."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choice(words, 400)), "x") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tokenfiles.write_token_ids(docs, str(tmp_path), tokenizer_path())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = sorted((tmp_path / "tokens").glob("part-*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(c).path for c in range(meta.num_columns)]
        ids = names.index(next(n for n in names if n.startswith("ids")))
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(ids)
            assert column.has_dictionary_page and {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(column.encodings) and column.total_uncompressed_size <= 1.5 * tokenfiles.ROW_GROUP
            assert column.has_offset_index and meta.row_group(g).column(names.index("doc_id")).has_column_index
            # Ids take about nine bits each, not thirty-two.
            assert column.total_uncompressed_size < 2.5 * column.num_values
    tokens = spark.read.parquet(f"{tmp_path}/tokens")

    def scanned(df):
        """Rows that come out of the scan of the token files, before any filter, and the result's."""
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value(), len(rows)

    out, wanted = scanned(tokens.where("doc_id between 3000 and 3009").select("doc_id", "ids"))
    # Whole pages of at most 2,000 rows and of the ids' size: most of the others are skipped.
    assert wanted == 10 and out <= 2000
    assert scanned(tokens.select("doc_id", "n_tokens")) == (6000, 6000)


def test_long_texts(spark, tmp_path):
    long = "many words of one long text, é! " * 60_000
    docs = spark.createDataFrame([(2, long, "x"), (1, "short", "x")], "doc_id long, text string, ids string")
    ids = plain(long)
    a, b = sorted(tokenfiles.token_file_digest(docs, tokenizer_path(), path=str(tmp_path / "a")).collect())
    assert (a.doc_id, a.start, b.doc_id, b.start, b.n_tokens, b.ids_crc32) == (1, 0, 2, a.n_tokens, len(ids) + 1, brute.crc_ids([*ids, 0]))
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    whole(rows)
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 2)
    assert [(s, n) for _, s, n in pieces] == packing.cut(len(ids) + 1, 1024) and [p for p, _, _ in pieces] == list(range(len(pieces)))


def whole(rows, capacity=1024):
    """Sequences are gapless, within capacity, and hold each piece once."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(spans[-1]) <= capacity
    return at


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    want = {(d.doc_id, p): (a, n, brute.crc_ids(ids[a : a + n])) for d in docs.collect() for ids in [plain(d.text) + [2]] for p, (a, n) in enumerate(packing.cut(len(ids), 1024))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = whole(rows)
    assert len(at) <= -(-sum(r.length for r in rows) // 1024) * 1.005 + 1


def test_packing_edges(spark):
    rows = packing.pack_documents(odd_docs(spark), tokenizer_path()).collect()
    whole(rows)
    assert len([r for r in rows if r.piece == 0]) == len(ODD) + 3
    assert packing.pack_documents(odd_docs(spark).where("false"), tokenizer_path()).collect() == []


def test_packing_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 3000).tolist() + [600] * 500
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES).repartition(16)
    rows = packing.pack_pieces(pieces).collect()
    at = whole(rows)
    assert sorted(r.length for r in rows) == sorted(sizes)
    assert len(at) <= len(packing.best_fit(sizes, 1024)) * 1.005 + 1


@pytest.mark.parametrize("layout", ["sorted", "hashed", "reverse"])
def test_packing_near_the_bound_in_any_layout(spark, layout):
    rng = np.random.default_rng(9)
    sizes = [int(n) for n in np.minimum(1024, rng.lognormal(5.3, 1.0, 12_000) + 1)]
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    df = df.repartition(16, "doc_id") if layout == "hashed" else df.repartitionByRange(16, "length" if layout == "sorted" else -df["length"])
    at = whole(packing.pack_pieces(df).collect())
    assert len(at) <= 1.005 * sum(sizes) / 1024 + 1


def test_tree_goes_on_until_partitions_have_met(spark):
    """Pieces that fit only pieces of other partitions find them, however many partitions there are."""
    rows = [(k, 0, 0, 700 if k % 2 else 324, 0) for k in range(64)]
    pieces = spark.createDataFrame(sorted(rows, key=lambda r: r[3]), packing.PIECES).coalesce(1).repartitionByRange(16, "length")
    out = packing.pack_pieces(pieces).collect()
    assert len(whole(out)) == 32 and all(sum(n for _, n in spans) == 1024 for spans in whole(out).values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert sum(1 for b in bins if 2 * sum(sizes[i] for i in b) <= 50) <= 1


@given(st.integers(0, 5000), st.integers(1, 1024))
def test_cut(n, capacity):
    pieces = packing.cut(n, capacity)
    assert sum(x for _, x in pieces) == n and all(x == capacity for _, x in pieces[1:])
