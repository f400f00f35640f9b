"""Repeated passages across documents: MinHash of every window of words, then word-by-word alignment and exact Jaccard.

Passages can start anywhere in a line, so every window of ``LEAST_WORDS`` words is a paragraph; its band is one MinHash value, the least hash of its
shingles of ``SEED`` words. Neighbouring windows mostly have the same one, so a few places of a text are written, and an equal run of ``LEAST_WORDS``
words always shares one of them (a seed). Near copies of 50 words and more with a Jaccard coefficient of 0.8 always hold such a run: n five-word
shingles at 0.8 allow n / 45 changed words. Each seed is compared with an earlier occurrence: inside a batch of texts with the batch's first (smallest
document, then place), and the batches' first documents with the first of all. So a passage that very many texts share is met by as
many documents as there are batches, and its occurrences form a tree whose root stays. A match is extended word by word to both sides, gaps of up to
``GAP`` words are bridged, and bridged spans need an exact Jaccard coefficient of ``LEAST_JACCARD`` of their aligned shingles, else they fall apart at
gaps. Spans of ``LEAST_WORDS`` words then count. ``passage_components`` clusters documents by the removals that connect them.

Limits: a seed is compared with one earlier occurrence only, so a passage whose seeds all stand in earlier texts that share nothing more is lost, and which occurrence that is follows the
batches, so other layouts of the table can give slightly other spans (README has figures).

No pairs of occurrences are emitted, only each one with an earlier one. Words are runs of bytes other than ASCII white space, compared with A-Z in lower case.
Null and empty texts hold nothing; texts are read whole; a passage repeated within one document only is left alone. Rows that share id and text are
one document; other texts of an id are documents of their own, later than all ids. Rows without an id take no part. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.components import connected_components
from vellumark.llm.runs import sorted_runs
from vellumark.llm.scratch import drop, give_back, id_and_text, packed, table, turn_to_other_work

#: Words of a shingle; least Jaccard coefficient, and words of a span.
SHINGLE, LEAST_JACCARD, LEAST_WORDS = 5, 0.8, 20
#: Words of a seed, words that a gap may have on either side, equal words that must follow a gap, words read beyond the outermost seeds at first.
SEED, GAP, AFTER, MARGIN = 12, 4, 5, 400
#: Bytes of text that are hashed together, and words that seeds are chosen of together.
BYTES, AT_ONCE = 1 << 20, 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64; kept up to the usual length."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = [np.concatenate([np.ones(1, "u8"), np.full(max(n, BYTES + 4096) - 1, m, "u8")]).cumprod(dtype="u8") for m in (_POWER, _INVERSE)]
        if n > 2 * BYTES:
            return made
        _POWERS[:] = made
    return _POWERS


def word_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts without nulls: its bytes, A-Z in lower case; of each word the text, the first byte, and the end."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], "i8" if wide else "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    starts, ends = ~space, ~space
    starts[1:] &= space[:-1] | edge[1:-1]
    ends[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    low = data + ((data - np.uint8(65)) < 26) * np.uint8(32)
    return low, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of the rows of a text column that make two megabytes together; a longer text is one by itself."""
    offsets = np.frombuffer(column.buffers()[1], "i8" if pa.types.is_large_string(column.type) else "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    group = (offsets[1:] - offsets[0]) // (2 * BYTES)
    for lo in np.flatnonzero(np.diff(group, prepend=-1)).tolist():
        yield lo, int(np.searchsorted(group, group[lo], side="right"))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: polynomials of their bytes from running sums, mixed."""
    out, at = np.empty(len(starts), "u8"), 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + BYTES, side="right")))
        part = low[first : ends[to - 1]]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, "u8")
        np.cumsum((part.astype("u8") + np.uint64(1)) * power[: len(part)], out=total[1:])
        a = starts[at:to] - first
        out[at:to] = (total[ends[at:to] - first] - total[a]) * inverse[a]
        at = to
    return _mix(_mix(out))


def seeds(h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds among words with hashes ``h``, and their keys; ``left``: words from each to the end of its text."""
    wide, at, keys = LEAST_WORDS - SEED + 1, [np.zeros(0, "i8")], [np.zeros(0, "u8")]
    for k in range(0, len(h) - LEAST_WORDS + 1, AT_ONCE):
        part = h[k : k + AT_ONCE + LEAST_WORDS - 1]
        power, inverse = _powers(len(part))
        total = np.concatenate([np.zeros(1, "u8"), np.cumsum(part * power[: len(part)], dtype="u8")])
        gram = _mix(_mix((total[SEED:] - total[:-SEED]) * inverse[: len(part) - SEED + 1]))
        n = len(gram) - wide + 1
        least = gram[:n].copy()
        for d in range(1, wide):
            np.minimum(least, gram[d : d + n], out=least)
        # Of equal ones in a window the first.
        chosen, open_ = np.zeros(len(gram), bool), left[k : k + n] >= LEAST_WORDS
        for d in range(wide):
            hit = open_ & (gram[d : d + n] == least)
            chosen[d : d + n] |= hit
            open_ &= ~hit
        found = np.flatnonzero(chosen)
        at.append(found + k)
        keys.append(gram[found])
    at, keys = np.concatenate(at), np.concatenate(keys)
    at, once = np.unique(at, return_index=True)
    return at, keys[once]


#: What is written of the texts: seeds (key, doc, at), hits inside a batch (doc, at, first, to), and hashes of all words of a document.
FOUND = "kind int, key long, doc long, at int, first long, to int, words binary"


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "key": pa.int64(), "doc": pa.int64(), "at": pa.int32(), "first": pa.int64(), "to": pa.int32(), "words": pa.binary()}
    columns["kind"] = np.full(n, kind, "i4")
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to_other_work()
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for lo, hi in portions(batch.column(1)):
            low, text, starts, ends = word_bounds(batch.column(1).slice(lo, hi - lo))
            h = word_hashes(low, starts, ends)
            del low, starts, ends
            begin = np.searchsorted(text, np.arange(hi - lo + 1))
            place = np.arange(len(h)) - begin[text]
            at, key = seeds(h, begin[text + 1] - begin[text] - place)
            doc, at = docs[lo + text[at]], place[at].astype("i4")
            for k in range(hi - lo):
                if begin[k + 1] - begin[k] >= LEAST_WORDS:
                    yield _rows(2, 1, doc=docs[lo + k : lo + k + 1], words=[(h[begin[k] : begin[k + 1]] >> np.uint64(32)).astype("<u4").tobytes()])
            if len(key):
                order = np.lexsort((at, doc, key))
                new = np.append(True, key[order][1:] != key[order][:-1])
                first = np.empty(len(key), "i8")
                first[order] = order[new][np.cumsum(new) - 1]
                # Of each key of the batch the first document goes on with all its places, in the order of the texts.
                own = np.flatnonzero(doc == doc[first])
                yield _rows(0, len(own), key=key[own].view("i8"), doc=doc[own], at=at[own])
                hit = np.flatnonzero(doc > doc[first])
                yield _rows(1, len(hit), doc=doc[hit], at=at[hit], first=doc[first[hit]], to=at[first[hit]])
    give_back()


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, at) in that order to hits (doc, at, first, to); of a key only its first row is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, at = (c.to_numpy() for c in batch.columns)
        if held is not None:
            key, doc, at = (np.append(np.array([x], c.dtype), c) for x, c in zip(held, (key, doc, at), strict=True))
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        hit = doc > doc[first]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[hit], at[hit], doc[first][hit], at[first][hit])], ["doc", "at", "first", "to"])
        held = (key[-1], doc[first[-1]], at[first[-1]])


def equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two arrays begin with alike."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = a[done : done + step][: n - done] != b[done : done + step][: n - done]
        if differ.any():
            return done + int(differ.argmax())
        done, step = min(n, done + step), step * 4
    return n


_GAPS = sorted(((x, y) for x in range(GAP + 1) for y in range(GAP + 1) if x or y), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))


def follow(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs (place in a, place in b, words) from the start of both on, over gaps of up to GAP words on either side."""
    runs, i, j, reach = [], 0, 0, GAP + AFTER
    while True:
        n = equal_run(a[i:], b[j:])
        runs.append((i, j, n))
        i, j = i + n, j + n
        # As bytes, short stretches compare fast.
        width = 4 * AFTER
        mine, other = a[i : i + reach].tobytes(), b[j : j + reach].tobytes()
        for x, y in _GAPS:
            part = mine[4 * x : 4 * x + width]
            if len(part) == width and part == other[4 * y : 4 * y + width]:
                i, j = i + x, j + y
                break
        else:
            return runs


def bridged(runs: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """Ordered equal runs to spans (place and words in a, place and words in b) whose aligned shingles have a Jaccard coefficient of ``least``."""
    if len(runs) == 1:
        ((at, to, n),) = runs
        return [(at, n, to, n)]
    out, todo = [], [runs]
    while todo:
        part = todo.pop()
        if not part:
            continue
        at, to, n = (np.array(x) for x in zip(*part, strict=True))
        same = np.concatenate([[0], np.cumsum(np.maximum(n - SHINGLE + 1, 0))])
        best = (-1, 0, 0)
        for k in range(len(part)):
            shared = same[k + 1 :] - same[k]
            mine, other = at[k:] + n[k:] - at[k], to[k:] + n[k:] - to[k]
            fine = shared >= least * (np.maximum(mine - SHINGLE + 1, 1) + np.maximum(other - SHINGLE + 1, 1) - shared) - 1e-9
            fine[0] = True  # equal words
            e = int(np.flatnonzero(fine)[-1])
            best = max(best, (int(mine[e]), -k, k + e))
            if e == len(part) - 1 - k:
                break  # later starts end no later
        k, e = -best[1], best[2]
        out.append((int(at[k]), int(at[e] + n[e] - at[k]), int(to[k]), int(to[e] + n[e] - to[k])))
        todo += [part[:k], part[e + 1 :]]
    return out


def aligned(a: np.ndarray, b: np.ndarray, at: list[tuple[int, int]], least_words: int = LEAST_WORDS) -> tuple[list[tuple[int, int, int, int]], tuple[int, int, int, int]]:
    """Spans around the seeds ``at`` (places in a and b), and the first and last words reached in a and b.

    Seeds inside a span that is long enough are done: their words are known to repeat, whatever other place they point to.
    """
    spans, reached, covered = [], [len(a), 0, len(b), 0], np.zeros(len(a), bool)
    seen: dict[int, list[tuple[int, int]]] = {}
    for i, j in sorted(set(at)):
        if covered[i] and covered[i + SEED - 1] and covered[i : i + SEED].all() or any(x <= i and i + SEED <= y for x, y in seen.get(j - i, ())) or not (a[i : i + SEED] == b[j : j + SEED]).all():
            continue
        right = [(i + x, j + y, n) for x, y, n in follow(a[i:], b[j:])]
        left = [(i - x - n, j - y - n, n) for x, y, n in follow(a[:i][::-1], b[:j][::-1])]
        x, y, n = left[0]
        right[0] = (x, y, n + right[0][2])
        runs = sorted(left[1:]) + right
        for x, y, n in runs:
            seen.setdefault(y - x, []).append((x, x + n))
        reached = [min(reached[0], runs[0][0]), max(reached[1], runs[-1][0] + runs[-1][2]), min(reached[2], runs[0][1]), max(reached[3], runs[-1][1] + runs[-1][2])]
        for s in bridged(runs, LEAST_JACCARD):
            spans.append(s)
            if s[1] >= least_words:
                covered[s[0] : s[0] + s[1]] = True
    return list(dict.fromkeys(spans)), tuple(reached)


SPANS = "doc long, at int, n int, first long, keeps boolean"


def _align(least_words: int):
    """Rows (pair, seeds, and of both sides the document, place of the slice, its words, and those of the whole text) to spans (doc, at, n, first, keeps); where a match reaches the end of a slice but not of its text, the pair with n = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 100):
                for r in batch.slice(k, 100).to_pylist():
                    mine, other = r["mine"], r["other"]
                    a, b, x, y = np.frombuffer(mine["words"], "<u4"), np.frombuffer(other["words"], "<u4"), mine["start"], other["start"]
                    at = [(s["at"] - x, s["to"] - y) for s in r["seeds"]]
                    at = [(i, j) for i, j in at if 0 <= i <= len(a) - SEED and 0 <= j <= len(b) - SEED]
                    spans, (a0, a1, b0, b1) = aligned(a, b, at, least_words)
                    room = GAP + AFTER
                    if spans and ((a0 < room and x) or (b0 < room and y) or (a1 > len(a) - room and x + len(a) < mine["all"]) or (b1 > len(b) - room and y + len(b) < other["all"])):
                        out.append((r["pair"], 0, -1, 0, False))
                        continue
                    for i, n, j, m in spans:
                        if n >= least_words:
                            out.append((mine["doc"], x + i, n, other["doc"], False))
                            out.append((other["doc"], y + j, m, other["doc"], True))
            if out:
                cols = zip(*sorted(set(out)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["doc", "at", "n", "first", "keeps"])
        give_back()

    return run


def _joined(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Spans (from, to, first document) with those that overlap as one."""
    out: list[list[int]] = []
    for a, b, f in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], b), min(out[-1][2], f)
        else:
            out.append([a, b, f])
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, at, n, first, keeps) ordered by document to spans that don't overlap; what goes doesn't stay."""
    for cols, bounds in sorted_runs(batches, 1):
        out = []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(cols[0]))[: len(bounds)], strict=True):
            if lo == hi:
                continue
            doc = int(cols[0][lo])
            rows = [(int(a), int(a + n), int(f), bool(k)) for a, n, f, k in zip(*(c[lo:hi] for c in cols[1:]), strict=True)]
            goes = _joined([r[:3] for r in rows if not r[3]])
            out += [(doc, a, b - a, f, False) for a, b, f in goes]
            k = 0
            for a, b, f in _joined([r[:3] for r in rows if r[3]]):
                while k < len(goes) and goes[k][1] <= a:
                    k += 1
                for x, y, _ in goes[k:]:
                    if x >= b:
                        break
                    if x > a:
                        out.append((doc, a, x - a, f, True))
                    a = max(a, y)
                if a < b:
                    out.append((doc, a, b - a, f, True))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["doc", "at", "n_words", "first", "keeps"])


def matched_pairs(found: DataFrame) -> DataFrame:
    """``pair, doc, first, seeds``: the seeds (at, to) that a document shares with an earlier one, of rows of ``FOUND``."""
    keyed = found.where("kind = 0").select("key", "doc", "at")
    far = keyed.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_firsts, "doc long, at int, first long, to int")
    hits = far.unionAll(found.where("kind = 1").select("doc", "at", "first", "to"))
    pairs = hits.groupBy("doc", "first").agg(F.collect_list(F.struct("at", "to")).alias("seeds"))
    return table(pairs.select(F.monotonically_increasing_id().alias("pair"), "doc", "first", "seeds"), "pairs")


#: Rows of a few numbers each, up to which a counted table is broadcast (some tens of megabytes); beyond, it is joined.
FEW = 500_000


def _slices(pairs: DataFrame, words: DataFrame, margin: int) -> DataFrame:
    """Pairs with the words of both sides from ``margin`` before the first seed to as many after the last; both joins read one exchange of the words."""

    def side(df: DataFrame, doc: str, at: str, name: str) -> DataFrame:
        lo = F.greatest(F.lit(0), F.array_min(f"seeds.{at}") - margin)
        cut = df.withColumns({"start": lo, "end": F.array_max(f"seeds.{at}") + SEED + margin}).join(words.withColumnRenamed("doc", "of"), F.col(doc) == F.col("of"))
        slice_ = F.struct(F.col(doc).alias("doc"), "start", F.expr("substring(words, start * 4 + 1, (end - start) * 4)").alias("words"), (F.octet_length("words") / 4).cast("int").alias("all"))
        return cut.select(*df.columns, slice_.alias(name))

    return side(side(pairs, "doc", "at", "mine"), "first", "to", "other").select("pair", "seeds", "mine", "other")


def _spans(rows: DataFrame, least_words: int, repeated: bool) -> DataFrame:
    """``doc, at, n_words, first, keeps`` of rows (doc, text) with an id each; ``repeated``: some rows are there more than once."""
    found = table(rows.mapInArrow(_found, FOUND), "found")
    pairs, margin, parts = matched_pairs(found), MARGIN, []
    words = found.where("kind = 2").select("doc", "words")
    words = words.dropDuplicates(["doc"]) if repeated else words

    def of(pairs: DataFrame) -> tuple[DataFrame, bool]:
        """The documents of the pairs, marked to be broadcast if they are few."""
        needed = table(pairs.select("doc").unionAll(pairs.select("first")).distinct(), "needed")
        few = needed.count() <= FEW
        return F.broadcast(needed) if few else needed, few

    needed, few = of(pairs)
    if few:
        words = words.join(needed, "doc", "left_semi")
    while True:
        spans = table(_slices(pairs, words, margin).mapInArrow(_align(least_words), SPANS), "spans")
        parts.append(spans.where("n > 0"))
        more = spans.where("n < 0").select(F.col("doc").alias("pair")).distinct()
        if not more.take(1):
            break
        # Where a match goes on beyond the slices, longer ones in the next round, which reads the words of those documents only.
        pairs, margin = table(pairs.join(more, "pair"), "pairs"), margin * 16
        words = table(words.join(of(pairs)[0], "doc", "left_semi"), "words")
    drop(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every.distinct().repartition("doc").sortWithinPartitions("doc").mapInArrow(_merge, "doc long, at int, n_words int, first long, keeps boolean")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """Rows (doc, text); where an id has several texts, a table (doc, doc_id, h) of all but the one with the least hash, numbered beyond the ids; whether rows share an id."""
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    several = rows.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = table(several.where("n > 1").select("doc_id", "low", "high"), "shared-ids")
    odd = shared.where("low < high").select("doc_id", "low")
    if not odd.take(1):
        return rows.select(F.col("doc_id").alias("doc"), "text"), None, bool(shared.take(1))
    top = rows.agg(F.max("doc_id")).first()[0]
    others = rows.select("doc_id", F.xxhash64("text").alias("h")).join(odd, "doc_id").where("h > low").select("doc_id", "h").distinct()
    others = table(others.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("doc"), "doc_id", "h"), "shared-ids")
    named = rows.withColumn("h", F.xxhash64("text")).join(others, ["doc_id", "h"], "left")
    return named.select(F.coalesce("doc", "doc_id").alias("doc"), "text"), others, True


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, at, n_words, first_doc, keeps``: the repeated spans of every document; ``keeps`` marks those that stay.

    Spans of a document don't overlap; ``first_doc`` is the smallest of the earlier documents that the words of one were compared with.
    """
    rows, others, repeated = _documents(docs, id_col, text_col)
    spans = _spans(rows, least_words, repeated)
    if others is not None:
        mine, first = (others.select(F.col("doc").alias(c), F.col("doc_id").alias(f"{c}_id")) for c in ("doc", "first"))
        spans = spans.join(mine, "doc", "left").join(first, "first", "left").select(F.coalesce("doc_id", "doc").alias("doc"), "at", "n_words", F.coalesce("first_id", "first").alias("first"), "keeps")
    return spans.select(F.col("doc").alias("doc_id"), "at", "n_words", F.col("first").alias("first_doc"), "keeps")


def passage_components(spans: DataFrame) -> DataFrame:
    """Rows of ``repeated_spans`` with ``component_id``: the smallest document that removals connect theirs to."""
    spans = table(spans, "spans")
    linked = connected_components(spans.where("not keeps").select(F.col("doc_id").alias("a"), F.col("first_doc").alias("b")))
    return spans.join(linked, F.col("doc_id") == F.col("node"), "left").select(*spans.columns, F.coalesce("component", "doc_id").alias("component_id"))


_SPACED = re.compile(r"[^\x09-\x0d\x20]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the (first word, number of words) spans; lines and other spacing stay."""
    if not spans:
        return text
    gone, out, until = sorted(spans), [], 0
    ends = [m.span() for m in _SPACED.finditer(text)]
    for at, n in gone:
        if at >= len(ends):
            break
        start, end = ends[at][0], ends[min(at + n, len(ends)) - 1][1]
        if start < until:
            start = until
        out.append(text[until:start])
        until = end
        while until < len(text) and text[until] == " ":
            until += 1
    out.append(text[until:])
    return "".join(out)


def drop_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (columns of ``documents``) with repeated passages cut but for their first occurrence.

    Texts left without a word stay as empty rows; null texts, and rows without an id, stay as they are. Each text of a shared id loses its own spans. ``n_chars`` follows
    the text where it is cut. An empty table gives no rows; other columns, whatever their names, are carried along.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    rows, others, repeated = _documents(docs, "doc_id", "text")
    spans = _spans(rows, least_words, repeated).where("not keeps")
    lists = table(spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "n_words"))).alias("spans")), "spans")
    keyed = packed(docs, "doc_id").withColumnRenamed("id", "doc")
    if others is not None:
        found = others.select(F.col("doc").alias("other"), F.col("doc_id").alias("doc"), "h")
        keyed = keyed.withColumn("h", F.xxhash64("row.text")).join(found, ["doc", "h"], "left").select(F.coalesce("other", "doc").alias("doc"), "row")
    # Lists are short; a few documents with spans are sent to all texts instead of shuffling those.
    few = lists.count() <= FEW and (lists.agg(F.sum(F.size("spans"))).first()[0] or 0) <= 4 * FEW
    joined = keyed.join(F.broadcast(lists) if few else lists, "doc", "left").select(F.col("row.*"), F.col("spans").alias("spans of the text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        for batch in batches:
            spans = batch.column(len(names))
            cut = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            cols = list(batch.columns[: len(names)])
            if len(cut):
                new = {}
                for k in cut.tolist():
                    if (t := cols[at][k].as_py()) is not None:
                        new[k] = cut_spans(t, [(s["at"], s["n_words"]) for s in spans[k].as_py()])
                chosen = np.zeros(batch.num_rows, bool)
                chosen[list(new)] = True
                cols[at] = pc.replace_with_mask(cols[at], pa.array(chosen), pa.array(list(new.values()), cols[at].type))
                if "n_chars" in names:
                    n = names.index("n_chars")
                    cols[n] = pc.replace_with_mask(cols[n], pa.array(chosen), pa.array([len(t) for t in new.values()], cols[n].type))
            yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return joined.mapInArrow(run, schema)


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the sets with a Jaccard coefficient of at least ``least``."""
    sizes = np.array([len(s) for s in sets])
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    first = np.searchsorted(inverse[order], np.arange(len(ids) + 1))
    starts = np.cumsum(sizes) - sizes
    links, open_, alive = [], [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed] = False
        open_ = [seed]
        while open_:
            a = open_.pop()
            shared = np.zeros(len(sets), "i8")
            for t in inverse[starts[a] : starts[a] + sizes[a]]:
                shared[owner[order[first[t] : first[t + 1]]]] += 1
            near = np.flatnonzero(alive & (shared >= least * (sizes + sizes[a] - shared) - 1e-9) & (shared > 0))
            alive[near] = False
            links += [(a, int(b)) for b in near]
            open_ += near.tolist()
    return links
