import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumark.llm import rules

SPACE = "[\x20\x09-\x0d]+"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by plain counting."""
    words = [w for w in re.split(SPACE, text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    bad = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), bad


def judged(spark, texts):
    docs = spark.createDataFrame([(k, t, k % 2 == 0, 1) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean, c int")
    return [r for r in rules.judge(docs).orderBy("doc_id").collect()]


def check(spark, texts):
    for r, text in zip(judged(spark, texts), texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert r.kept == (not r.base_failed and not r.failed)


def test_documents_agree_with_duckdb_and_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = rules.judge(docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select {', '.join(out.columns)} from ({rules.SQL}) order by doc_id").fetchall()
    rows = out.orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


def test_good_documents_stay(spark, sf):
    """All that the labels call good stay, unless the base rule fails them; nearly all that they call bad go."""
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rows = rules.judge(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc \n\t\x0b#é|", max_size=120), max_size=12))
def test_any_text(spark, texts):
    check(spark, [*texts, "x"])


def test_edges(spark):
    w = " ".join(f"w{k}" for k in range(30))
    eight = "a b c d e f g h"
    texts = [None, "", " \n\t", "one", eight, f"{eight} {eight}", f"{eight} x {eight}", "a " * 400, f"{w}\n{w}", f"{w}\nline\nline\nline", "wörter " * 7, "  x  y", "#*$%&|<> " * 30, w + "...\n" + w, f"{eight} i {w} {eight} i"]
    check(spark, texts)


def test_very_long_text_with_repeats(spark):
    plain = " ".join(f"word{k}" for k in range(200_000))
    twice = f"{plain} {plain}"
    long, whole = judged(spark, [plain, twice])
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (200_000, 0, False)
    assert (whole.n_words, whole.n_repeat_words, whole.base_failed) == (400_000, 400_000, True)


def test_rules_are_parameters_and_rows_return_whole(spark):
    text = "The house of the man is on the hill and it was a good house for the people that are there and with us."
    rows = [(1, text, "a", True), (1, text, "a", True), (2, "# * #" * 30, "b", False), (3, None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed string, kept boolean")
    assert sorted(map(tuple, rules.keep_clean(docs).collect())) == rows[:2] and rules.keep_clean(docs).columns == docs.columns
    strict = rules.judge(docs, rules=[("long_words", "word_chars / n_words", 9.0, None)]).where("doc_id = 1").first()
    assert strict.failed == "long_words" and not strict.kept
    assert rules.judge(docs.limit(0)).count() == 0 and rules.keep_clean(docs.limit(0)).count() == 0


def test_one_projection_without_python(spark, sf):
    plan = rules.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
