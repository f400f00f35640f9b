"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Test items are cut into segments of at most ``SEGMENT`` words; each is a document of the index. A term's score in a segment is its BM25 part
divided by the segment's score for itself, so a full copy scores 1 and one threshold fits all. Segments are ordered in blocks of ``BLOCK``; the index
keeps each term's best score of all and in each block. Every passage of every training text (windows of twice ``SEGMENT`` words, half overlapping, so that
each run of a segment's length lies in one) is a query, and all segments at or over the threshold are retrieved. As in WAND, a passage's terms are put in the
order of their best scores; the term at which the sum of those so far reaches the threshold is the pivot, and a segment without a term from the pivot on can't reach it.
The sum of all terms' block maxima bounds a block's scores, and of the blocks with a term from the pivot on only those whose bound reaches the threshold are scored. Many
passages go through each step together, in parts of at most ``PARTS`` entries, with arrays instead of a cursor a passage: entries of all of a passage's terms are expanded before pivots and bounds leave blocks
out, so that what is saved is scoring, not the look at a block's bound.

A find counts if the item's question and its answer (its last sentence, or its last third) both overlap with the passages that found it.

Document frequencies, their number and mean length are those of all items. The index is built on the driver and broadcast a slice of about ``SLICE`` words of whole items
at a time; each slice is one pass over the texts, done before the next is broadcast. Null and empty texts or items match nothing; texts are read whole. One row
for each text and item: shared ids and repeated rows are merged (best score, earliest passage); passages and items that tie are all retrieved. Empty tables give no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import give_back, id_and_text, packed, table, turn_to_other_work
from vellumark.llm.tokens import texts

#: Words of a segment, segments of a block, words of the items that one broadcast holds.
SEGMENT, BLOCK, SLICE = 64, 8, 2_000_000
#: BM25's constants, the least score, and the least overlap of question (five-word shingles) and answer (word pairs).
K1, B, LEAST, QUESTION, ANSWER = 1.2, 0.75, 0.6, 0.8, 0.5
#: Words looked at together, and entries of the index.
AT_ONCE, PARTS = 200_000, 2_000_000

_WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word long"


def normal(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words up to the last sentence and of it; without a second sentence all words, and the last third."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if (w := normal(s))]
    words = [w for s in sentences for w in s]
    if len(sentences) > 1:
        return words[: -len(sentences[-1])], sentences[-1]
    return words, words[-max(1, math.ceil(len(words) / 3)) :] if words else []


def grams(words: list[str], n: int) -> set[tuple]:
    n = max(1, min(n, len(words)))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def overlap(part: list[str], n: int, words: list[str]) -> float:
    """How much of ``part``'s n-word shingles occurs in ``words``."""
    if not part:
        return 0.0
    own = grams(part, n)
    size = len(next(iter(own)))
    return len(own & grams(words, size)) / len(own) if len(words) >= size else 0.0


def segments(text: str | None) -> list[list[str]]:
    words = normal(text)
    size = math.ceil(len(words) / max(1, math.ceil(len(words) / SEGMENT)))
    return [words[a : a + size] for a in range(0, len(words), size or 1)]


class Index:
    """``df``: segments of all items that hold each word; ``n`` and ``mean``: their number and mean length (those of ``items`` if not given)."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int] | None = None, n: int = 0, mean: float = 0.0) -> None:
        self.items = items
        cut = [(k, s) for k, (_, text) in enumerate(items) for s in segments(text)]
        counts = [Counter(s) for _, s in cut]
        if df is None:
            df, n, mean = Counter(t for c in counts for t in c), len(cut), sum(len(s) for _, s in cut) / max(1, len(cut))
        self.item_of = np.array([k for k, _ in cut], "i8")
        self.n, self.blocks = len(cut), max(1, math.ceil(len(cut) / BLOCK))
        self.ids = {t: k for k, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for s, (c, (_, words)) in enumerate(zip(counts, cut, strict=True)):
            part = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for t, f in c.items()}
            whole = sum(part.values())
            for t, p in part.items():
                postings[self.ids[t]].append((s, p / whole))
        first = self.first = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype("i8")
        self.segment = np.array([s for p in postings for s, _ in p], "i8")
        self.part = np.array([x for p in postings for _, x in p], "f8")
        self.best = np.maximum.reduceat(self.part, first[:-1]) if len(self.part) else np.zeros(0)
        # Each term's blocks, their best scores, and where their postings begin.
        term = np.repeat(np.arange(len(postings)), np.diff(first))
        self.key, begin = np.unique(term * self.blocks + self.segment // BLOCK, return_index=True)
        self.block_max = np.maximum.reduceat(self.part, begin) if len(self.part) else np.zeros(0)
        self.begin = np.append(begin, len(self.part))
        self.block_first = np.searchsorted(self.key, np.arange(len(postings) + 1) * self.blocks)

    @staticmethod
    def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of each range: whose they are, and which."""
        n = hi - lo
        own = np.repeat(np.arange(len(lo)), n)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]

    @staticmethod
    def _parts(sizes: np.ndarray) -> list[slice]:
        """Neighbours together up to ``PARTS`` entries."""
        group = np.cumsum(sizes) // PARTS
        bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def search(self, windows: np.ndarray, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, score) of all scores of at least ``least``; windows and terms: distinct pairs, ordered by window."""
        hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        least -= 1e-9
        if len(windows):
            # Windows whose terms can't reach the threshold wherever they stand are done.
            first = np.flatnonzero(np.diff(windows, prepend=windows[0] - 1))
            count = np.diff(np.append(first, len(windows)))
            keep = np.repeat(np.add.reduceat(self.best[terms], first) >= least, count)
            windows, terms = windows[keep], terms[keep]
        if len(windows):
            order = np.lexsort((self.best[terms], windows))
            windows, terms = windows[order], terms[order]
            first = np.flatnonzero(np.diff(windows, prepend=windows[0] - 1))
            count = np.diff(np.append(first, len(windows)))
            sums = np.cumsum(self.best[terms])
            sums -= np.repeat(sums[first] - self.best[terms[first]], count)
            # From the pivot on: one of these terms must be in a segment that reaches the threshold.
            pivot = sums >= least
            lo, hi = self.block_first[terms], self.block_first[terms + 1]
            for part in self._parts(np.maximum(np.add.reduceat(hi - lo, first), self.blocks)):
                some = slice(first[part][0], (first[part] + count[part])[-1])
                hits.append(self._score(windows[first[part]], np.repeat(np.arange(len(first[part])), count[part]), lo[some], hi[some], pivot[some], least))
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))

    def _score(self, names: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, pivot: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """Scores of at least ``least`` of some windows, whose terms have the block entries from ``lo`` to ``hi``: by pivots and block maxima first, then by segment."""
        own, entry = self._expand(lo, hi)
        pair, n = at[own] * self.blocks + self.key[entry] % self.blocks, len(names) * self.blocks
        live = np.bincount(pair, self.block_max[entry], n) >= least
        met = np.zeros(n, bool)
        met[pair[pivot[own]]] = True
        live &= met
        keep = live[pair]
        pair, entry = pair[keep], entry[keep]
        own, where = self._expand(self.begin[entry], self.begin[entry + 1])
        found, inverse = np.unique(pair[own] * BLOCK + self.segment[where] % BLOCK, return_inverse=True)
        score = np.bincount(inverse, self.part[where], len(found))
        found, score = found[score >= least], score[score >= least]
        window, rest = np.divmod(found, self.blocks * BLOCK)
        return names[window], rest, score

    def find(self, text: str | None, least: float = LEAST) -> list[tuple]:
        """(item_id, score, question_overlap, answer_overlap, start_word) of each verified item."""
        return [f[1:] for f in self.find_all([text], least)]

    def find_all(self, some: list[str | None], least: float = LEAST) -> list[tuple]:
        """(which text, item_id, score, question_overlap, answer_overlap, start_word) of each verified item of the texts; their passages are searched together."""
        out: list[tuple] = []
        held: list[tuple[int, list[str]]] = []
        n = 0
        for r, text in enumerate(some):
            words = normal(text)
            if words and self.n:
                held.append((r, words))
                n += len(words)
            if n >= AT_ONCE or (held and r + 1 == len(some)):
                out += self._find(held, least)
                held, n = [], 0
        return out

    def _find(self, held: list[tuple[int, list[str]]], least: float) -> list[tuple]:
        get = self.ids.get
        # A number for each passage: those of a text follow each other, with one to spare.
        first = np.concatenate([[0], np.cumsum([len(w) // SEGMENT + 2 for _, w in held])])
        hits: list[tuple[np.ndarray, ...]] = []
        for (_, words), base in zip(held, first, strict=False):
            ids = np.fromiter(map(get, words, repeat(-1)), "i8", len(words))
            at = np.flatnonzero(ids >= 0)
            # A word lies in the passage that starts at its SEGMENT, and in the one before.
            window, terms = base + at // SEGMENT, ids[at]
            hits.append((window, np.maximum(window - 1, base), terms))
        own, before, terms = (np.concatenate(x) for x in zip(*hits, strict=True))
        # Words that repeat count each time here, so no passage that could reach the threshold is lost.
        best = self.best[terms]
        bound = np.bincount(own, best, first[-1]) + np.bincount(before, best * (before != own), first[-1])
        keep = bound >= least - 1e-9
        pairs = np.concatenate([own[keep[own]] * len(self.ids) + terms[keep[own]], before[keep[before]] * len(self.ids) + terms[keep[before]]])
        if not len(pairs):
            return []
        pairs = np.unique(pairs)
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for window, segment, score in zip(*self.search(pairs // len(self.ids), pairs % len(self.ids), least), strict=True):
            k = int(np.searchsorted(first, window, side="right")) - 1
            found.setdefault((k, int(self.item_of[segment])), []).append((int(window - first[k]), float(score)))
        out = []
        for (k, item), where in found.items():
            row, words = held[k]
            question, answer = question_and_answer(self.items[item][1])
            near, until = [], 0
            for w in sorted({w for w, _ in where}):
                near += words[max(w * SEGMENT, until) : (w + 2) * SEGMENT]
                until = (w + 2) * SEGMENT
            q, a = overlap(question, 5, near), overlap(answer, 2, near)
            if q >= QUESTION and a >= ANSWER:
                out.append((row, self.items[item][0], max(s for _, s in where), q, a, min(w for w, _ in where) * SEGMENT))
        return sorted(out)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(int(i), s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in segments(t)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.string()))], ["slice", "words"])


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, start_word``: which texts hold which items."""
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item is not null and item_id is not null").distinct()
    # Sizes first: a slice holds about SLICE words (six bytes each) of whole items, whatever the table's size.
    slices = max(1, math.ceil((rows.agg(F.sum(F.octet_length("item"))).first()[0] or 0) / (6 * SLICE)))
    rows = table(rows.withColumn("slice", F.pmod(F.xxhash64("item_id", "item"), F.lit(slices))), "items")
    cut = table(rows.select("slice", "item").mapInArrow(_segments, "slice long, words array<string>"), "segments")
    n, mean = cut.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    held = cut.select("slice", F.explode(F.array_distinct("words")).alias("word"))
    often = table(held.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    narrow, found = id_and_text(docs, id_col, text_col), None
    for s in range(slices):
        part = sorted((r["item_id"], r["item"]) for r in rows.where(F.col("slice") == s).collect())
        df = {r["word"]: r["df"] for r in often.join(held.where(F.col("slice") == s).select("word").distinct(), "word").collect()}
        shared = spark.sparkContext.broadcast(Index(part, df, n, mean or 1.0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            turn_to_other_work()
            index = shared.value
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                out = [(doc_ids[k + j], *f) for k, some in texts(batch, 1, 200) for j, *f in index.find_all(some, least)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word"])
            give_back()

        one = narrow.mapInArrow(run, FOUND)
        if slices > 1:
            one = table(one, "leaks")
            shared.destroy()
        found = one if found is None else found.unionAll(one)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"), F.min("start_word").alias("start_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id has no leak, with their columns; rows without an id stay, and so do null and empty texts. Rows that share an id go together."""
    leaked = table(find_leaks(docs, items, id_col=id_col, text_col=text_col).where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "leaked")
    return packed(docs, id_col).join(leaked, "id", "left_anti").select("row.*")
