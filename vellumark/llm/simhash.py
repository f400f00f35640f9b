"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits come from XXH64 (seed 42) of word shingles. Equal fingerprints become one row first. Two that
differ in at most ``distance`` bits agree on at least ``blocks - distance`` of ``blocks`` blocks, so every choice of that many
blocks is a join key; within a key the bits are compared. No pairs are emitted: each group yields the links of a spanning forest, at
most one for each member, found by searching outwards from a member through those not yet reached. A key met by more than
``GROUP`` fingerprints is dealt out in chunks, one task for each pair of chunks, so no task holds more than two chunks.

Null texts count as empty: fingerprint zero, linked like any other. Texts of any length are read whole, shingles in slices. Ids may
repeat: a component's id is its smallest non-null one (null if there is none). An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.components import connected_components
from vellumark.llm.paragraphs import portions, similar, word_bounds, word_hashes
from vellumark.llm.runs import sorted_runs
from vellumark.llm.scratch import give_back, id_and_text, packed, table, turn_to_other_work
from vellumark.llm.tokens import texts

#: Shingles hashed at once; fingerprints of one key that one chunk takes.
SLICE, GROUP = 200_000, 2048
#: Chance partners that cost less to compare than more blocks' keys to deal out.
CHANCE = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a whole text, as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    h, joined = xxhash.xxh64_intdigest, memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [int(ends[-1])]
    ones = np.zeros(64, "i8")
    for k in range(0, n, SLICE):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(first[k : k + SLICE], last[k : k + SLICE], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for _, some in texts(batch) for t in some], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])
        give_back()

    return run


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - distance`` blocks."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks that leave ``CHANCE`` chance partners a fingerprint at most; the result is the same for any."""
    for blocks in range(distance + 1, 13):
        if math.comb(blocks, distance) * n / 2.0 ** (64 * (blocks - distance) / blocks) <= CHANCE:
            break
    return blocks


def bits(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of 64-bit words."""
    return np.bitwise_count(x).sum(axis=1, dtype="i4")


def spanning_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from, to) of a spanning forest of the fingerprints (rows of words) within ``distance`` bits."""
    alive, a, b = np.arange(len(fp)), [], []
    while len(alive) > 1:
        front, alive = [alive[0]], alive[1:]
        while front and len(alive):
            at = front.pop()
            near = bits(fp[alive] ^ fp[at]) <= distance
            hit = alive[near]
            if len(hit):
                a.append(hit)
                b.append(np.full(len(hit), at))
                alive = alive[~near]
                front.extend(hit)
    none = np.zeros(0, "i8")
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _links(distance: int, keys: int):
    """Rows (key columns, words of the fingerprint, rep) ordered by key to links (a, b) between reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in sorted_runs(batches, keys):
            fp, rep = np.stack(cols[keys:-1], axis=1).view("u8"), cols[-1]
            sizes = np.diff(np.append(bounds, len(fp)) if bounds[-1] != len(fp) else bounds)
            a, b = [], []
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = sizes[group] <= 6
            for d in range(1, 6):  # small groups, all at once
                near = small[:-d] & (group[:-d] == group[d:]) & (bits(fp[:-d] ^ fp[d:]) <= distance) if len(fp) > d else np.zeros(0, bool)
                at = np.flatnonzero(near)
                a.append(rep[at])
                b.append(rep[at + d])
            for k in np.flatnonzero(sizes > 6):
                s = slice(bounds[k], bounds[k] + sizes[k])
                i, j = spanning_links(fp[s], distance)
                a.append(rep[s][i])
                b.append(rep[s][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Rows (fp, rep), each fp once, to links (a, b) between reps that connect all within ``distance`` bits."""
    blocks = blocks or blocks_for(fps.count(), distance)
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, distance)])
    keyed = fps.select("fp", "rep", F.posexplode(masks).alias("choice", "mask")).select("choice", F.expr("fp & mask").alias("part"), "fp", "rep")
    dealt = deal(keyed, ["choice", "part"], ["fp"])
    return dealt.mapInArrow(_links(distance, 5), "a long, b long")


def deal(keyed: DataFrame, key: list[str], words: list[str], more: DataFrame | None = None) -> DataFrame:
    """Rows (key, words, rep) whose key is met more than once, sorted by key and pair of chunks; a key's chunks have about ``GROUP`` rows.

    ``more``: a table (rep, words) to join the words from once keys met a single time are gone.
    """
    several = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*key, F.ceil(F.col("n") / GROUP).cast("int").alias("chunks"))
    keyed = keyed.join(several, key)
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.expr("transform(sequence(0, chunks - 1), o -> struct(least(o, mine) as i, greatest(o, mine) as j))")
    if more is not None:
        keyed = keyed.join(more, "rep")
    dealt = keyed.withColumn("mine", mine).select(*key, F.explode(pairs).alias("p"), *words, "rep").select(F.xxhash64(*key, "p.i", "p.j").alias("key"), *key, F.col("p.i").alias("i"), F.col("p.j").alias("j"), *words, "rep")
    return dealt.repartition("key").sortWithinPartitions("key", *key, "i", "j")


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64-bit), ``component_id`` of every row."""
    prints = table(id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    fps = table(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", "low", F.monotonically_increasing_id().alias("rep")), "fps")
    found = connected_components(fingerprint_links(fps.select("fp", "rep"), distance))
    named = fps.join(found, F.col("rep") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "rep").alias("c"))
    lows = named.groupBy("c").agg(F.min("low").alias("component_id"))
    return prints.join(named.join(lows, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(column: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """Of each text (none is null) the hashes of its shingles, repeats included: of ``shingle`` words, or of all if there are fewer; one of its own if there is none."""
    low, text, starts, ends = word_bounds(column)
    h = word_hashes(low, starts, ends)
    begin = np.searchsorted(text, np.arange(len(column) + 1))
    size = np.diff(begin)
    left = begin[text + 1] - np.arange(len(h))
    roll = np.zeros(len(h), "u8")
    for d in range(shingle):
        shifted = np.zeros(len(h), "u8")
        shifted[: max(0, len(h) - d)] = h[d:]
        roll = (roll ^ (roll >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.where(left > d, shifted, np.uint64(0)) + np.uint64(d)
    roll = (roll ^ (roll >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    roll ^= roll >> np.uint64(32)
    return [roll[a : a + max(1, n - shingle + 1)] if n else np.zeros(1, "u8") for a, n in zip(begin[:-1].tolist(), size.tolist(), strict=True)]


def wide_fingerprint(every: np.ndarray) -> np.ndarray:
    """SimHash of ``WORDS`` 64-bit words from a text's shingle hashes; each takes another mix of them."""
    ones = np.zeros((WORDS, 64), "i8")
    for k in range(0, len(every), SLICE):
        hashes = every[k : k + SLICE]
        for w in range(WORDS):
            mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            ones[w] += np.unpackbits(mixed.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return np.packbits(ones * 2 > len(every), axis=1, bitorder="little").view("<u8").ravel()


#: Of the wide fingerprint: words of 64 bits, bits of a block, blocks, and the share of bits that near copies may differ in.
#: Blocks alone link about 0.8 of the pairs at a Jaccard coefficient of 0.8 (reviewer's simulation); MinHash bands find the others.
WORDS, BLOCK_BITS, BLOCKS, SHARE = 4, 24, 116, 0.19


def block_positions() -> np.ndarray:
    """(BLOCKS, BLOCK_BITS) positions in the fingerprint, drawn with a fixed seed."""
    rng = np.random.default_rng(11)
    return np.stack([rng.choice(64 * WORDS, BLOCK_BITS, replace=False) for _ in range(BLOCKS)])


_WIDE = [f"f{w}" for w in range(WORDS)]


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, words) to a row (key, rep) for each block."""
    at = block_positions()
    weight = np.uint64(1) << np.arange(BLOCK_BITS, dtype="u8")
    for batch in batches:
        fps = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view("u1").reshape(batch.num_rows, 8 * WORDS)
        on = np.unpackbits(fps, axis=1, bitorder="little")
        keys = np.stack([(on[:, p].astype("u8") * weight).sum(axis=1) for p in at], axis=1) + (np.arange(BLOCKS, dtype="u8") << np.uint64(BLOCK_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype("i8").ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BLOCKS))], ["block", "rep"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, rep) ordered by block those whose block has several."""
    for (block, rep), _ in sorted_runs(batches, 1):
        same = block[1:] == block[:-1]
        keep = np.zeros(len(block), bool)
        keep[1:] |= same
        keep[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(rep[keep])], ["block", "rep"])


#: MinHash bands beside the blocks, and values in each: 1 - (1 - 0.8^5)^24 = 0.9999 of pairs at 0.8 meet. Least Jaccard coefficient of near copies.
BANDS, ROWS, LEAST_JACCARD = 24, 5, 0.8
_SEEDS = np.random.default_rng(12).integers(1, 2**63, BANDS * ROWS, dtype="u8") | np.uint64(1)


def set_bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the MinHash bands of a set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for k in range(0, len(hashes), 4096):
        x = (hashes[k : k + 4096, None] ^ (hashes[k : k + 4096, None] >> np.uint64(29))) * _SEEDS
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    key = np.arange(BANDS, dtype="u8")
    for r in least.reshape(BANDS, ROWS).T:
        key = (key * np.uint64(31) + r) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view("i8")


def _sets(shingle: int, bands: bool):
    """Rows (doc_id, text, h) to (doc_id, h, c, fingerprint, bands), or rows (doc_id, text) to (c, shingles); ``c``: hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        turn_to_other_work()
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                hashes = shingle_hashes(batch.column(1).slice(lo, hi - lo), shingle)
                sets = [np.unique(x) for x in hashes]
                c = pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], "u8").view("i8"))
                if bands:
                    fps = np.array([wide_fingerprint(x) for x in hashes], "u8").reshape(-1, WORDS).view("i8")
                    words = [pa.array(np.ascontiguousarray(fps[:, w])) for w in range(WORDS)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), c, *words, pa.array([set_bands(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "h", "c", *_WIDE, "bands"])
                else:
                    yield pa.RecordBatch.from_arrays([c, pa.array([x.tobytes() for x in sets], pa.binary())], ["c", "shingles"])
        give_back()

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (four key columns, shingles, rep) ordered by key to links between sets with a Jaccard coefficient of ``LEAST_JACCARD``."""
    for cols, bounds in sorted_runs(batches, 4):
        a, b = [], []
        for lo, hi in zip(bounds[:-1], np.append(bounds[1:-1], len(cols[0])), strict=True):
            rep = cols[5][lo:hi]
            for x, y in similar([np.frombuffer(s, "u8") for s in cols[4][lo:hi]], LEAST_JACCARD):
                a.append(int(rep[x]))
                b.append(int(rep[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, g, component_id``: a row for each row with an id; ``h``: hash of its text, ``g``: a number of its group."""
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    schema = "doc_id long, h long, c long, " + ", ".join(f"{w} long" for w in _WIDE) + ", bands array<long>"
    prints = table(rows.mapInArrow(_sets(shingle, True), schema), "prints")
    once = prints.groupBy("c").agg(F.min("doc_id").alias("low"), F.min(F.struct(*_WIDE, "bands")).alias("p"))
    fps = table(once.select(F.monotonically_increasing_id().alias("rep"), "c", "low", "p.*"), "fps")
    keyed = fps.select("rep", *_WIDE).mapInArrow(_wide_keys, "block long, rep long")
    # One shuffle of narrow rows; the few whose block is met again are written, then get their fingerprints.
    met = table(keyed.repartition("block").sortWithinPartitions("block").mapInArrow(_met, "block long, rep long"), "met")
    links = deal(met, ["block"], _WIDE, fps.select("rep", *_WIDE)).mapInArrow(_links(int(SHARE * 64 * WORDS), 4), "a long, b long")
    banded = fps.select("rep", F.explode("bands").alias("band"))
    low = banded.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("band", "a")
    candidates = connected_components(links.unionAll(banded.join(low, "band").select("a", F.col("rep").alias("b"))))
    members = candidates.unionAll(candidates.select(F.col("component").alias("node"), "component").distinct())
    members = table(fps.select("rep", "c", "low").join(members, F.col("rep") == F.col("node")).select("component", "rep", "c", "low"), "members")
    # Only candidates' texts are read again for their sets.
    read = rows.join(members.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = read.mapInArrow(_sets(shingle, False), "c long, shingles binary").dropDuplicates(["c"]).join(members.select("c", "rep"), "c").select("rep", "shingles")
    dealt = deal(members.select("component", "rep"), ["component"], ["shingles"], table(sets, "sets"))
    found = connected_components(dealt.mapInArrow(_verified, "a long, b long"))
    named = fps.join(found, F.col("rep") == F.col("node"), "left").select("c", "low", F.coalesce("component", "rep").alias("g"))
    lows = named.groupBy("g").agg(F.min("low").alias("component_id"))
    return prints.select("doc_id", "h", "c").join(named.join(lows, "g").select("c", "g", "component_id"), "c").select("doc_id", "h", "g", "component_id")


def near_components(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of rows with an id: texts linked where their shingles have an exact Jaccard coefficient of ``LEAST_JACCARD``.

    Candidates share a block and ``1 - SHARE`` of the bits of their fingerprints, or a MinHash band; all texts that candidates connect are compared. Null texts
    count as empty; texts without a word are alike. An empty table gives no rows; extra columns are not read.
    """
    return _near(docs, shingle, id_col, text_col).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The row with the smallest id of each group of near copies; its columns stay, whatever their names.

    Different texts of one id are documents of their own: each group keeps one (of several of the smallest id the one with the least hash). Of rows that repeat id
    and text one stays; rows without an id stay. Null texts are empty ones, and empty ones copies of each other. An empty table gives no rows.
    """
    found = table(_near(docs, shingle, id_col, text_col), "near")
    stays = F.col("doc_id") == F.col("component_id")
    per = found.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("s"))
    # Most ids have one row, which stays; the others are the smaller side to join.
    odd = table(per.where("n > 1 or s = 0"), "odd")
    whole = packed(docs, id_col)
    rest = whole.join(odd, "id", "left_anti").select("row")
    if odd.where("n > 1 and s > 0").take(1):
        # Rows of an id that several share are told apart by their texts.
        chosen = found.where(stays).join(odd.where("n > 1").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id", "g").agg(F.min("h").alias("h"))
        shared = whole.withColumn("h", F.xxhash64(F.col("row")[text_col])).join(chosen.select(F.col("doc_id").alias("id"), "h"), ["id", "h"], "left_semi")
        rest = rest.unionAll(shared.dropDuplicates(["id", "h"]).select("row"))
    return rest.select("row.*")
