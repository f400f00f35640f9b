"""Commits over several tables: crashes, races, resumed runs."""

import pytest
from pyspark.sql import functions as F

from tests.test_store import PAGES, STORE, page
from vellumark.sources.commits import Change, Lost, Tables, merge_run, pending, settle_progress


def rows(df):
    return sorted(map(tuple, df.collect()))


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def test_versions_appends_and_vacuum(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    assert t.snapshot().version == 0 and "a" not in t.snapshot()
    t.commit(lambda at, new: (new.replace("a", numbers(spark, 1)), new.replace("b", numbers(spark, 9))))
    first = t.snapshot()
    t.commit(lambda at, new: new.append("a", numbers(spark, 2).withColumn("extra", F.lit(1))))
    assert rows(t.read("a")) == [(1,), (2,)] and rows(t.read("b")) == [(9,)] and rows(first.read("a")) == [(1,)]
    assert t.commit(lambda at, new: None) == 2
    t.commit(lambda at, new: new.replace("a", at.read("a").where("n > 1")))
    assert t.versions() == [1, 2, 3] and rows(t.snapshot(2).read("a")) == [(1,), (2,)]
    assert len(t.vacuum(keep=1)) == 2 and t.versions() == [3] and rows(t.read("a")) == [(2,)]


def test_a_crash_between_any_two_writes_leaves_the_old_state(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    t.commit(lambda at, new: (new.replace("a", numbers(spark, 1)), new.replace("b", numbers(spark, 1))))

    def change(stop):
        def run(at, new):
            for k, name in enumerate(("a", "b")):
                if k == stop:
                    raise RuntimeError("killed")
                new.replace(name, numbers(spark, 2))
            if stop == 2:
                raise RuntimeError("killed")

        return run

    for stop in (0, 1, 2):
        with pytest.raises(RuntimeError):
            t.commit(change(stop))
        assert rows(t.read("a")) == rows(t.read("b")) == [(1,)]
    t.commit(change(3))
    assert rows(t.read("a")) == rows(t.read("b")) == [(2,)]


def test_of_two_writers_one_runs_again(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    t.commit(lambda at, new: new.replace("a", numbers(spark, 0)))
    seen = []

    def slow(at, new):
        seen.append(at.version)
        new.append("a", numbers(spark, 10 + len(seen)))
        if len(seen) == 1:
            t.commit(lambda at, new: new.append("a", numbers(spark, 5)))

    assert t.commit(slow) == 3 and seen == [1, 2]
    assert rows(t.read("a")) == [(0,), (5,), (12,)]
    with pytest.raises(Lost):
        t._claim(3, {})
    with pytest.raises(Lost):
        t.commit(lambda at, new: (t.commit(lambda a, n: n.append("a", numbers(spark, 7))), new.append("a", numbers(spark, 8))), retries=2)


def test_a_killed_run_resumes_to_the_same_store(spark, tmp_path, monkeypatch):
    chunks = {"c1": [page("a", "# A2\n", None, "r2"), page("b", "# B\n", None, "r2")], "c2": [page("c", "# C2\n", None, "r2")], "c3": [page("a", "# A3\n", None, "r2")]}

    def store(name):
        t = Tables(spark, str(tmp_path / name))
        t.commit(lambda at, new: new.replace("articles", spark.createDataFrame([], STORE)))
        merge_run(t, "r1", spark.createDataFrame([page("a", "# A\n"), page("c", "# C\n")], PAGES), "2024-01-01")
        return t

    def fetch(t, name):
        return merge_run(t, "r2", spark.createDataFrame(chunks[name], PAGES), "2024-01-02", name)

    whole, broken = store("whole"), store("broken")
    for name in chunks:
        fetch(whole, name)
    append = Change.append
    for at, name in enumerate(chunks):
        # Killed before the last write of the chunk, then run again, with the chunks before it.
        def dies(self, table, df):
            if table == "progress":
                raise RuntimeError("killed")
            append(self, table, df)

        monkeypatch.setattr(Change, "append", dies)
        with pytest.raises(RuntimeError):
            fetch(broken, name)
        monkeypatch.setattr(Change, "append", append)
        for again in list(chunks)[: at + 1]:
            fetch(broken, again)
    for table, columns in (("articles", ["source_url", "content_markdown"]), ("versions", ["article_id", "content_markdown", "extraction_run_id"]), ("progress", ["run_id", "chunk", "url"]), ("counters", ["run_id", "n_new", "n_updated"])):
        assert rows(whole.read(table).select(*columns)) == rows(broken.read(table).select(*columns))
    wanted = spark.createDataFrame([("s", "a"), ("s", "z")], "source_id string, url string")
    assert rows(pending(broken, "r2", wanted)) == [("s", "z")] and pending(broken, "r9", wanted).count() == 2
    settle_progress(broken, spark.createDataFrame([("r2", "paused")], "id string, status string"))
    assert broken.read("progress").count() == 4
    settle_progress(broken, spark.createDataFrame([("r2", "completed")], "id string, status string"))
    assert broken.read("progress").count() == 0 and pending(broken, "r2", wanted).count() == 2
