"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Pieces are dealt evenly, so that each partition has the sizes of all. Every partition packs its own pieces best-fit decreasing and emits bins that are full but for
``SLACK``. Underfull bins go up the tree opened: their pieces are the items of a round over fewer partitions (as closed items they would keep partners apart: three pieces of 324
tokens in a bin of 1024 each leave a 700 alone). Rounds go on until one partition is left or, where there are too many pieces for that, a round fills hardly any bin. A bin's members are at
most ``capacity`` many, and a partition of a later round holds at most ``ROUND_ROWS`` pieces, so no
task grows with the corpus.

Which of equal sizes share a bin is any way round. Texts of any length are encoded whole, in slices.
A document of more than ``capacity`` tokens is cut into full pieces; its first piece takes the
remainder. Null texts count as empty (their end id is still packed); repeated rows and shared ids are
packed once for each row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import give_back, id_and_text, table
from vellumark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"
BINS = f"sequence_id long, fill int, done boolean, members array<{_MEMBER}>"
#: Pieces that one best-fit call takes; pieces of a later round in one partition; partitions merged into one.
AT_ONCE, ROUND_ROWS, FAN_IN = 100_000, 200_000, 8
#: Part of a bin that may stay empty when it leaves early.
SLACK = 0.005


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]] if n else []


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items (positions in ``sizes``) of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens left
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[k]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        if room > size:
            by_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, rows = batch.column(0).to_pylist(), []
            for k, flat, at in enc.column(batch.column(1), end):
                for doc_id, a, b in zip(doc_ids[k : k + len(at) - 1], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    rows += [(doc_id, p, s, n, zlib.crc32(flat[a + s : a + s + n])) for p, (s, n) in enumerate(cut(b - a, capacity))]
            yield _columns(rows, [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            give_back()

    return run


def _columns(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def _bins(level: int, bins: list[tuple[int, list[tuple]]], first: int, task: int, full: int) -> pa.RecordBatch:
    flat = _columns([m for _, members in bins for m in members], _FIELDS)
    members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(m) for _, m in bins])]).astype("i4")), pa.StructArray.from_arrays(flat.columns, [n for n, _ in _FIELDS]))
    ids = (level << 56) + (task << 36) + first + np.arange(len(bins), dtype="i8")
    fill = np.array([f for f, _ in bins], "i4")
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fill), pa.array(fill >= full), members], ["sequence_id", "fill", "done", "members"])


def _pack(level: int, capacity: int):
    """Best-fit over a partition, ``AT_ONCE`` pieces at a time; those of underfull bins stay to meet the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, full, n = TaskContext.get().partitionId(), math.ceil(capacity * (1 - SLACK)), 0
        held: list[tuple] = []

        def fit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            bins = [[held[i] for i in b] for b in best_fit([p[3] for p in held], capacity)]
            filled = [(sum(p[3] for p in b), b) for b in bins]
            out = filled if last else [b for b in filled if b[0] >= full]
            held = [] if last else [p for fill, b in filled if fill < full for p in b]
            for k in range(0, len(out), 5000):
                yield _bins(level, out[k : k + 5000], n, task, full)
                n += len(out[k : k + 5000])

        fresh = 0
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            fresh += batch.num_rows
            if fresh >= AT_ONCE:
                yield from fit(False)
                fresh = 0
                if len(held) >= AT_ONCE:  # they don't fit each other, whatever comes
                    yield from fit(True)
        yield from fit(True)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Rows of ``PIECES`` to the same rows with ``sequence_id`` and ``offset``."""
    names = [n for n, _ in _FIELDS]
    parts, level, rounds = pieces.rdd.getNumPartitions(), 0, []
    bins = table(pieces.select(names).repartition(parts).mapInArrow(_pack(0, capacity), BINS), "bins")
    left = _open_pieces(bins)
    while left and not (level and parts == 1):
        rounds.append(bins.where("done"))
        before, level = (left, parts), level + 1
        parts = max(math.ceil(left / ROUND_ROWS), 1 if parts <= FAN_IN else math.ceil(parts / FAN_IN))
        opened = bins.where("not done").select(F.inline("members"))
        bins = table(opened.repartition(parts).mapInArrow(_pack(level, capacity), BINS), "bins")
        left = _open_pieces(bins)
        # Once partitions are as few as their size allows, rounds go on while they fill bins.
        if before[1] == parts and left > 0.99 * before[0]:
            break
    rounds.append(bins)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionAll(r)
    at = F.expr("transform(members, (m, i) -> aggregate(slice(members, 1, i), 0L, (s, x) -> s + x.length))")
    return out.select("sequence_id", F.inline(F.arrays_zip("members", at.alias("offset")))).select(F.col("members.*"), "sequence_id", F.col("offset"))


def _open_pieces(bins: DataFrame) -> int:
    return bins.where("not done").agg(F.sum(F.size("members"))).first()[0] or 0


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)
    return pack_pieces(table(pieces, "pieces"), capacity)
