"""Embedding near-duplicates over HNSW graphs of shards that overlap.

Equal vectors become one first, with their count. Pivots are a sample of the distinct ones, none near another; each vector belongs to the cell of the pivot that is
nearest, and to each other cell whose pivot is less nearer by a margin or less. Two vectors are compared in the least cell that they share. The margin is fitted on an
audit: ``AUDITED`` sampled vectors are compared with all, and the margin is the least at which ``COVER`` of their links share a cell, counted by link and by vector,
a quarter as much again; if under ``FEW`` of them have a link, they are joined by made-up links just at the threshold. Every row is indexed. Each cell is a shard: a task
builds its graph and searches it for each of its vectors, starting at the vector's own node. A cell of over ``SHARD`` vectors is cut into several graphs, and a
task takes two of them, searches each one's vectors in the other's graph, and unites what was found from both ends. A query whose beam comes back full of
links is repeated with twice the beam. Each search audits itself: some queries that found links and some that found none are compared with all of the shard, and
while the graph has found less than ``RECALL`` of the links that they stand for, the beam doubles for all; beams end at the whole shard. Finds near
or over the threshold are verified by cosine in double precision.

A vector with ``WIDE`` or more links in a shard needs each of them counted; it is compared with that shard's vectors in blocks, and no pairs of it are held. So a
task holds a shard and at most ``WIDE`` finds for each of its vectors.

No pairs are emitted: a task gives each vector's link count and a spanning forest of what it linked; counts are summed and forests joined
by connected components. Vectors that are null, empty, zero or hold a null or non-finite number link with nothing but keep their row.
Vectors of different lengths don't link. Shared ids: their vectors count as different vectors of one id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumark.llm.components import connected_components
from vellumark.llm.hnsw import Graph
from vellumark.llm.scratch import table

#: Vectors of a shard, and numbers in it or in the pivots (fewer long vectors fit); vectors of a shard for each that a pivot is meant to have; the most pivots, and tasks.
SHARD, NUMBERS, ROOM, PIVOTS, TASKS = 16_384, 1 << 23, 8, 8192, 2000
#: Vectors compared with all to fit the margin, the part of their links that must share a cell, how many need to have links, and the margin's steps.
AUDITED, COVER, FEW, STEP = 512, 0.995, 8, 0.002
#: First beam of a query from another shard and of one from the shard itself, the least part of the audited links that must be found, and queries audited of either kind.
BEAM, OWN_BEAM, RECALL, AUDIT = 48, 24, 0.99, 256
#: Widest beam; a vector that fills it with links is compared with the shard in blocks.
WIDE = 384
#: Queries searched together, so that their marks of what they have seen stay small; cosines of a block.
ROWS, COSINES = 1024, 1 << 22
#: How far under the threshold nodes still lead on, for a vector that starts at its own.
SLACK = 0.1


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, "f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scan(q: np.ndarray, x: np.ndarray, least: float, alone: np.ndarray | None) -> np.ndarray:
    """Of some queries all (query, vector) keys with a cosine of at least ``least``; ``alone``: each query's own vector, left out."""
    keys, step = [np.zeros(0, "i8")], max(1, COSINES // len(x))
    for k in range(0, len(q), step):
        near = q[k : k + step] @ x.T >= least
        if alone is not None:
            near[np.arange(len(near)), alone[k : k + step]] = False
        i, j = np.nonzero(near)
        keys.append((i + k) * len(x) + j)
    return np.concatenate(keys)


def _recall(q: np.ndarray, x: np.ndarray, found: np.ndarray, todo: np.ndarray, least: float, own: bool) -> float:
    """Estimated part of the links of the queries ``todo`` that ``found`` (ordered keys) holds: from an audit of some with finds and some without."""
    n = len(x)
    has = np.zeros(len(q), bool)
    has[found // n] = True
    hits = links = 0.0
    for part in (todo[has[todo]], todo[~has[todo]]):
        if len(part):
            some = part[np.argsort((part.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:AUDIT]]
            key = _scan(q[some], x, least, some if own else None)
            true = some[key // n] * n + key % n
            weight = len(part) / len(some)
            hits += weight * np.isin(true, found).sum()
            links += weight * len(true)
    return hits / links if links else 1.0


def linked(graph: Graph, q: np.ndarray, least: float, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ordered keys (query * n + vector) that the graph finds for all but the wide queries, and those; ``own``: the queries are the graph's vectors in order."""
    x, n = graph.x, len(graph.x)
    beam = OWN_BEAM if own else BEAM
    todo, found, wide, floor = np.arange(len(q)), np.zeros(0, "i8"), np.zeros(len(q), bool), least - SLACK
    while True:
        rows, full, keys = max(16, ROWS * BEAM // beam), [todo[:0]], [found]
        for k in range(0, len(todo), rows):
            part = todo[k : k + rows]
            ids, sims = graph.around(part, beam, floor) if own else graph.search(q[part], beam)
            hit = sims >= least
            if own:
                hit &= ids != part[:, None]
            i, c = np.nonzero(hit)
            keys.append(part[i] * n + ids[i, c])
            if beam < n:
                full.append(part[sims[:, -1] >= least])
        found, full, searched = np.unique(np.concatenate(keys)), np.concatenate(full), beam
        beam *= 2
        if len(full) and beam <= WIDE:
            todo = full
            continue
        wide[full] = True
        if own:
            found = np.unique(np.concatenate([found, found % n * n + found // n]))  # a link is found from either end
        found, todo = found[~wide[found // n]], np.flatnonzero(~wide)
        if _recall(q, x, found, todo, least, own) >= RECALL:
            break
        if searched >= n:
            # All that can be reached has been seen; what can't is compared.
            wide[todo] = True
            found = found[:0]
            break
        floor -= 3 * SLACK
    return found, np.flatnonzero(wide)


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest position reachable, where ``label`` has it so far, with links a-b added; over whole arrays."""
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _sooner(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs of vectors, given by their cells (rows padded with -1), share a cell before this one."""
    hit = np.zeros(len(a), bool)
    for v in a.T if len(a) else ():
        hit |= (v >= 0) & (v < cell) & (b == v[:, None]).any(axis=1)
    return hit


def _sooner_all(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray | None:
    """The same for each vector of a and each of b; None: no pair does."""
    some = np.unique(a[(a >= 0) & (a < cell)])
    if not len(some):
        return None

    def marks(cells: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(cells), len(some) + 1), "f4"), np.searchsorted(some, cells)
        out[np.arange(len(cells))[:, None], np.where(some[np.minimum(at, len(some) - 1)] == cells, at, len(some))] = 1
        return out[:, :-1]

    return marks(a) @ marks(b).T > 0


def compare(x: np.ndarray, y: np.ndarray | None, counts: np.ndarray, threshold: float, graphs: list[Graph], cells: np.ndarray | None = None, cell: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of x and, after them, of y: links between the two (within x if y is None), and the smallest position that they lead to.

    ``counts``: how many rows each vector stands for; ``cells``: each one's cells, where pairs that share one before ``cell`` are left to that.
    """
    own, first = y is None, len(x)
    y = x if own else y
    n = first if own else first + len(y)
    shift = 0 if own else first
    links, label, least = np.zeros(n, "i8"), np.arange(n), np.float32(threshold - 1e-5)
    found, wide_x = linked(graphs[-1], graphs[0].x, least, own)
    a, b = np.divmod(found, len(y))
    wide_y = wide_x
    if not own:
        back, wide_y = linked(graphs[0], graphs[1].x, least)
        j, i = np.divmod(back, first)
        a, b = np.concatenate([a, i]), np.concatenate([b, j])
    spread_x, spread_y = np.zeros(first, bool), np.zeros(len(y), bool)
    spread_x[wide_x], spread_y[wide_y] = True, True
    # Pairs of vectors that aren't wide, from both ends, once.
    keep = ~spread_x[a] & ~spread_y[b]
    a, b = a[keep], b[keep]
    key = np.unique(np.minimum(a, b) * len(y) + np.maximum(a, b) if own else a * len(y) + b)
    a, b = np.divmod(key, len(y))
    if cells is not None:
        other = [_sooner(cells[a[k : k + 65536]], cells[b[k : k + 65536] + shift], cell) for k in range(0, len(a), 65536)]
        keep = ~np.concatenate([*other, np.zeros(0, bool)])
        a, b = a[keep], b[keep]
    sure = [np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) >= threshold for k in range(0, len(a), 65536)]
    if sure:
        sure = np.concatenate(sure)
        a, b = a[sure], b[sure] + shift
        links += np.bincount(a, counts[b], n).astype("i8") + np.bincount(b, counts[a], n).astype("i8")
        label = _forest(a, b, label)

    def block(rows: np.ndarray, mine: np.ndarray, other: np.ndarray, at: int, to: int, counted: np.ndarray) -> None:
        """Wide vectors' links to all of the other side; of that, those marked as ``counted`` see to their own."""
        nonlocal label
        for k in range(0, len(rows), step := max(1, COSINES // len(other))):
            part = rows[k : k + step]
            near = mine[part] @ other.T >= threshold
            if own:
                near[np.arange(len(part)), part] = False
            if cells is not None and (sooner := _sooner_all(cells[at + part], cells[to : to + len(other)], cell)) is not None:
                near &= ~sooner
            links[at + part] += near @ counts[to : to + len(other)]
            links[to : to + len(other)] += np.where(counted, 0, counts[at + part] @ near).astype("i8")
            i, j = np.nonzero(near)
            label = _forest(at + part[i], to + j, label)

    block(wide_x, x, y, 0, shift, spread_y)
    if not own:
        block(wide_y, y, x, shift, 0, spread_x)
    return links, label


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets of a list column without nulls."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _vectors(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each length: the length, their rows, and the unit vectors."""
    values, at = _flat(batch.column(name))
    sizes = np.diff(at)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, _unit(values[at[rows][:, None] + np.arange(dim)])


def _behind(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How much less near than the nearest each pivot is."""
    near = x.astype("f4") @ pivots.T
    return near.max(axis=1, keepdims=True) - near


def _needed(x: np.ndarray, y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For pairs of vectors the least margin, in steps, at which they share a cell."""
    step = max(1, COSINES // len(pivots))
    got = [np.maximum(_behind(x[k : k + step], pivots), _behind(y[k : k + step], pivots)).min(axis=1) for k in range(0, len(x), step)]
    return np.ceil(np.concatenate([*got, np.zeros(0, "f4")]) / STEP).astype("i8")


def _audit(pivots, sample, threshold: float):
    """Links of the sampled vectors by the margin that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            for dim, rows, x in _vectors(batch, "embedding"):
                if dim not in sample.value:
                    continue
                ids, some = sample.value[dim]
                near = (x.astype("f4") @ some.astype("f4").T >= threshold) & (reps[rows][:, None] != ids)
                i, j = np.nonzero(near)
                key, n = np.unique(j * (1 << 20) + _needed(x[i], some[j], pivots.value[dim]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), dim, "i4")), pa.array(key >> 20), pa.array(key & ((1 << 20) - 1)), pa.array(n)], ["dim", "a", "need", "n"])

    return run


def _margin(found: list, sample: np.ndarray, pivots: np.ndarray, threshold: float) -> float:
    """From rows (a, need, n) of the audit."""
    a, need, n = np.array([(r["a"], r["need"], r["n"]) for r in found], "i8").reshape(-1, 3).T
    by = np.bincount(a, n, len(sample))
    weights = [n, n / by[a]]
    if (by > 0).sum() < FEW:
        side = np.random.default_rng(len(sample)).standard_normal(sample.shape)
        side = _unit(side - (side * sample).sum(axis=1, keepdims=True) * sample + 1e-300)
        made = _needed(sample, threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * side, pivots)
        need, weights = np.concatenate([need, made]), [np.concatenate([w, np.ones(len(made))]) for w in weights]
    most = 0
    for w in weights:
        sums = np.cumsum(np.bincount(need, w))
        most = max(most, int(np.searchsorted(sums, COVER * sums[-1])))
    return 1.25 * STEP * most


def _cells(pivots, margins: dict[int, float], dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells, ordered: each vector's own cell and those that it reaches over the margin."""
    if dim not in margins:
        return np.arange(len(x)), np.zeros(len(x), "i8")
    p = pivots.value[dim]
    got, step = [], max(1, COSINES // len(p))
    for k in range(0, len(x), step):
        i, c = np.nonzero(_behind(x[k : k + step], p) <= margins[dim])
        got.append((i + k, c))
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _count(pivots, margins):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _vectors(batch, "embedding"):
                cell, n = np.unique(_cells(pivots, margins, dim, x)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, "i4")), pa.array(cell.astype("i4")), pa.array(n)], ["dim", "cell", "n"])

    return run


PLACED = "dim int, cell int, i int, j int, chunks int, chunk int, rep long, n long"


def _place(pivots, margins, chunks):
    """A row for each vector and task: cells of several chunks have a task for each two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, counts, column = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), batch.column("embedding")
            for dim, rows, x in _vectors(batch, "embedding"):
                row, cell = _cells(pivots, margins, dim, x)
                first = np.searchsorted(row, np.arange(len(x) + 1))
                many = np.array([chunks.value.get((dim, c), 1) for c in range(int(cell.max()) + 1)])[cell]
                chunk = (reps[rows[row]].astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("i8") % many
                one = many == 1
                parts = [(np.flatnonzero(one), chunk[one], chunk[one])]
                for k in np.flatnonzero(~one):
                    others = np.delete(np.arange(many[k]), chunk[k])
                    parts.append((np.full(len(others), k), np.minimum(others, chunk[k]), np.maximum(others, chunk[k])))
                at, i, j = (np.concatenate([p[c] for p in parts]) for c in range(3))
                for k in range(0, len(at), 10_000):
                    some = at[k : k + 10_000]
                    r = row[some]
                    size = first[r + 1] - first[r]
                    ends = np.cumsum(size)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(cell[np.arange(ends[-1]) + np.repeat(first[r] - ends + size, size)].astype("i4")))
                    whole = [np.full(len(some), dim, "i4"), cell[some].astype("i4"), i[k : k + 10_000].astype("i4"), j[k : k + 10_000].astype("i4"), many[some].astype("i4"), chunk[some].astype("i4"), reps[rows[r]], counts[rows[r]]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, whole), lists, column.take(pa.array(rows[r]))], ["dim", "cell", "i", "j", "chunks", "chunk", "rep", "n", "cells", "embedding"])

    return run


def _shard(threshold: float):
    """Links within one cell, or within and between two chunks of it, each once over all tasks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep").combine_chunks()
        column = {c: group.column(c).chunk(0) for c in group.column_names}
        dim, cell, i, j, chunks = (column[c][0].as_py() for c in ("dim", "cell", "i", "j", "chunks"))
        chunk, reps, counts = (column[c].to_numpy() for c in ("chunk", "rep", "n"))
        values, at = _flat(column["embedding"])
        x = _unit(values[at[0] : at[-1]].reshape(-1, dim))
        values, at = _flat(column["cells"])
        cells = np.full((len(x), int(np.diff(at).max())), -1, "i8")
        owner = np.repeat(np.arange(len(x)), np.diff(at))
        cells[owner, np.arange(len(owner)) - (at[:-1] - at[0])[owner]] = values[at[0] : at[-1]]
        sides = [np.flatnonzero(chunk == c) for c in sorted({i, j})]
        sides = [s for s in sides if len(s)]
        graphs = [Graph(x[s].astype("f4"), reps[s]) for s in sides]
        todo = [(s, None, g, s) for s, g, c in zip(sides, graphs, chunk[[s[0] for s in sides]], strict=True) if chunks == 1 or j == c + 1 or (c == chunks - 1 and i == c - 1)]
        if len(sides) == 2:
            todo.append((*sides, None, np.concatenate(sides)))
        a, b, n = [], [], []
        for s, other, graph, rows in todo:
            links, label = compare(x[s], None if other is None else x[other], counts[rows], threshold, graphs if graph is None else [graph], cells[rows], cell)
            some, star = links > 0, label != np.arange(len(label))
            a += [reps[rows[some]], reps[rows[star]]]
            b += [np.full(some.sum(), -1), reps[rows[label[star]]]]
            n += [links[some], np.zeros(star.sum(), "i8")]
        return pa.table([np.concatenate(c).astype("i8") if c else np.zeros(0, "i8") for c in (a, b, n)], ["a", "b", "n"])

    return run


def _sampled(reps: DataFrame, sizes: dict[int, int], most: dict[int, int], seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length about ``most`` distinct vectors by a hash: ids and unit vectors."""
    part = F.element_at(F.create_map(*[F.lit(v) for d in most for v in (d, 1.2 * most[d] / sizes[d])]), F.col("dim"))
    place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 40))
    rows = reps.where(F.col("dim").isin(list(most)) & (place < part * (1 << 40))).select("dim", "rep", "embedding", place.alias("place")).collect()
    rows.sort(key=lambda r: (r["place"], r["rep"]))
    out = {}
    for d, n in most.items():
        some = [r for r in rows if r["dim"] == d][:n]
        if some:
            out[d] = np.array([r["rep"] for r in some]), _unit(np.array([r["embedding"] for r in some], "f8"))
    return out


def _apart(x: np.ndarray, threshold: float) -> np.ndarray:
    """Vectors none of which is linked to one before it."""
    x, kept = x.astype("f4"), []
    for k in range(len(x)):
        if not kept or (x[kept] @ x[k]).max() < threshold:
            kept.append(k)
    return x[kept]


def near_embeddings(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    context = vectors.sparkSession.sparkContext
    kind = vectors.schema[vec_col].dataType
    number = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{number}>").alias("embedding"))
    # Null, NaN and infinite parts don't compare as finite.
    fine = F.coalesce(F.expr("size(embedding) > 0 and forall(embedding, v -> coalesce(cast(v as double) between -1.7976931348623157E308D and 1.7976931348623157E308D, false)) and exists(embedding, v -> v != 0)"), F.lit(False))
    # Two hashes and the length stand for a vector, so that vectors are shuffled once; a zero has one sign.
    signless = F.transform("embedding", lambda v: v + F.lit(0).cast(number))
    rows = rows.withColumn("fine", fine).withColumn("embedding", signless).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(7), "embedding"))
    reps = rows.where("fine").groupBy("h", "g", F.size("embedding").alias("dim")).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    reps = table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each vector length
    most = {d: max(256, min(SHARD, NUMBERS // d)) if SHARD >= 256 else SHARD for d in sizes}
    wanted = {d: min(PIVOTS, max(2, NUMBERS // d), math.ceil(ROOM * n / most[d])) for d, n in sizes.items() if ROOM * n > most[d]}
    pivots, margins = {}, {}
    if wanted:
        pivots = {d: p for d, (_, x) in _sampled(reps, sizes, wanted, 1).items() if len(p := _apart(x, threshold)) > 1}
    spread = context.broadcast(pivots)
    if pivots:
        sample = _sampled(reps, sizes, {d: AUDITED for d in pivots}, 2)
        found = reps.select("rep", "embedding").mapInArrow(_audit(spread, context.broadcast(sample), threshold), "dim int, a long, need long, n long")
        found = found.groupBy("dim", "a", "need").agg(F.sum("n").alias("n")).collect()  # at most a row for each sampled vector and step
        margins = {d: _margin([r for r in found if r["dim"] == d], sample[d][1], p, threshold) if d in sample else 2.0 for d, p in pivots.items()}
    cells = reps.select("embedding").mapInArrow(_count(spread, margins), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()  # a row for each cell
    chunks = {(r["dim"], r["cell"]): math.ceil(2 * r["n"] / most[r["dim"]]) for r in cells if r["n"] > most[r["dim"]]}
    tasks = len(cells) + sum(c * (c - 1) // 2 - 1 for c in chunks.values())
    placed = reps.select("rep", "n", "embedding").mapInArrow(_place(spread, margins, context.broadcast(chunks)), f"{PLACED}, cells array<int>, embedding array<{number}>")
    found = placed.repartition(max(1, min(TASKS, tasks)), "dim", "cell", "i", "j").groupBy("dim", "cell", "i", "j").applyInArrow(_shard(threshold), "a long, b long, n long")
    found = table(found, "found")
    links = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    joined = connected_components(found.where("b >= 0").select("a", "b"))
    named = reps.select("rep", "h", "g", "dim", "low", "n").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = table(named.select("h", "g", "dim", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "named")
    lows = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "c").select("h", "g", "dim", "n_links", "component_id")
    good = rows.where("fine").select("vec_id", "h", "g", F.size("embedding").alias("dim")).join(named, ["h", "g", "dim"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
