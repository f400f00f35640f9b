"""Prefix trie of conversations: turn arrays range-sorted over all of them, longest common prefixes of neighbours, one stack sweep a partition.

A turn is 16 bytes (MD5 of role and text) and its number of words; a conversation's path is its turns' bytes in order, so that byte order puts prefixes first. In sorted order a node's
members are neighbours. A sweep opens nodes where a path leaves the one before and closes them where the next one does; a node adds its members, leaves and savings to the one above as it
closes. What stands on the stack at a partition's first and last row may go on elsewhere: those frames, two for each level and partition at most, are small rows. They are
summed by a hash of their prefix and stitched in one stream in order of first sight, which is the trie's own order. Nodes closed inside a partition take the id of an open parent from
the stitched frames by a join that adaptive execution broadcasts or splits.

Paths are sorted with the conversation's id behind them, so equal conversations, however many, are spread over partitions. One row holds one conversation's path, 20 bytes a turn: that is the largest
thing a task has to hold.

Order is by turn, nulls first; rows of one turn by role's and text's hash; repeated rows are repeated turns. Null roles and texts are empty. Rows without a conversation id are left out. Texts of any length are hashed
whole. Extra columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import table

#: Bytes of a turn in a path.
KEY = 16
#: Characters of a list of ids in one row.
IDS = 1 << 16


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``conv_id, turn, role, text``: ``turns`` are ``(key, words)`` in order, the key in hexadecimal."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), words.alias("words")).alias("x"))
    turns = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuild(arrays: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c starts with the first h turns of c - c % group in place of its own, h = crc32(c) % heads."""
    base = F.col("conv_id") - F.col("conv_id") % group
    first = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rows = arrays.withColumn("base", base).join(first, "base", "left")
    own = F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(arrays.schema["turns"].dataType)), own).alias("turns"))


class _Node:
    """An open node: sums over what is closed below it."""

    __slots__ = ("depth", "words", "ids", "n", "low", "children", "leaves", "saved", "below", "left")

    def __init__(self, depth: int, words: int, left: bool) -> None:
        self.depth, self.words, self.left = depth, words, left
        self.ids: list[int] = []
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.below: list[list] = []

    def add(self, n: int, low: int | None, leaves: int, saved: int) -> None:
        self.n += n
        self.leaves += leaves
        self.saved += saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def _ids_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[: KEY * high] == b[: KEY * high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: KEY * mid] == b[: KEY * mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Kinds: "n" a closed node (its parent is known or a frame), "f" a part of a frame, "e" ids of conversations that end in a frame.
_SWEPT = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("side", pa.int32()), ("seq", pa.int32()), ("ref", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "words")]
    + [("ends", pa.string())]
)
_SWEPT_SQL = "kind string, part int, side int, seq int, ref binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"


class _Sweep:
    def __init__(self) -> None:
        self.part = TaskContext.get().partitionId()
        self.out: list[tuple] = []
        self.stack: list[_Node] = []
        self.path = b""
        self.refs: dict[int, bytes] = {}

    def emit(self, kind: str, *, side: int = 0, seq: int = 0, ref: bytes | None = None, row: list | tuple = (None,) * 7, words: int | None = None, ends: str | None = None) -> None:
        """``row``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens."""
        self.out.append((kind, self.part, side, seq, ref, *row, words, ends))

    def ref(self, depth: int) -> bytes:
        return hashlib.md5(self.path[: KEY * depth]).digest()

    def leave(self, node: _Node, side: int) -> None:
        """A frame goes out in parts: its sums, its ids, and the closed nodes that wait for its id."""
        ref = self.ref(node.depth)
        low = min([x for x in (node.low, node.ids[0] if node.ids else None) if x is not None], default=None)
        self.emit("f", side=side, ref=ref, row=(low, node.depth, None, node.n + len(node.ids), node.children, node.leaves, node.saved), words=node.words)
        text, seq = [], 0
        for k, conv in enumerate(node.ids):
            text.append(str(conv))
            if len(text) >= IDS // 10 or k == len(node.ids) - 1:
                self.emit("e", seq=seq, ref=ref, ends=",".join(text))
                text, seq = [], seq + 1
        for row in node.below:
            self.emit("n", ref=ref, row=row[:7], ends=row[7])

    def close(self) -> None:
        node = self.stack.pop()
        if node.left:
            self.leave(node, 0)
            return
        n = node.n + len(node.ids)
        low = min([x for x in (node.low, node.ids[0] if node.ids else None) if x is not None])
        leaves = node.leaves or 1
        saved = node.saved + (n - 1) * node.words
        for row in node.below:
            row[2] = low
            self.emit("n", row=row[:7], ends=row[7])
        above = self.stack[-1]
        above.children += 1
        above.add(n, low, leaves, saved)
        above.below.append([low, node.depth, None, n, node.children, leaves, saved, _ids_hash(node.ids)])

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        first = not self.stack
        keep = 0 if first else _shared(self.path, path)
        while len(self.stack) > keep + 1:
            self.close()
        self.path = path
        if first:
            self.stack.append(_Node(0, 0, True))
        for depth in range(keep + 1, len(path) // KEY + 1):
            self.stack.append(_Node(depth, words[depth - 1], first))
        self.stack[-1].ids.append(conv)

    def end(self) -> None:
        for node in self.stack:
            self.leave(node, 0 if node.left else 1)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = _Sweep()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*s.out, strict=True), _SWEPT, strict=True)], schema=_SWEPT)
        s.out = []
        return batch

    for batch in batches:
        for conv, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s.add(conv, path, words)
            if len(s.out) > 20_000:
                yield out()
    s.end()
    if s.out:
        yield out()


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames in the trie's order to whole nodes; a frame adds to the one above as it closes."""
    stack: list[tuple[_Node, bytes]] = []
    done: list[tuple] = []
    schema = pa.schema([("ref", pa.binary())] + [(c.split()[0], pa.int64()) for c in _NODES.split(", ")])

    def close() -> None:
        node, ref = stack.pop()
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
        for row in node.below:
            done.append((row[0], row[1], row[2], node.low, *row[3:]))
        if stack:
            above = stack[-1][0]
            above.children += 1
            above.add(node.n, node.low, leaves, saved)
            above.below.append([ref, node.low, node.depth, node.n, node.children, leaves, saved])
        else:
            done.append((ref, node.low, node.depth, None, node.n, node.children, leaves, saved if node.depth else node.saved))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        done.clear()
        return batch

    for batch in batches:
        for x in batch.to_pylist():
            while stack and stack[-1][0].depth >= x["depth"]:
                close()
            node = _Node(x["depth"], x["words"], False)
            node.children = x["n_children"]
            node.add(x["n_convs"], x["conv_id"], x["n_leaves"], x["saved_tokens"])
            stack.append((node, x["ref"]))
        if len(done) > 20_000:
            yield out()
    while stack:
        close()
    if done:
        yield out()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each frame with ids, from their rows in order."""
    current, sha, done = None, None, []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.binary()), pa.array([h for _, h in done])], ["ref", "hash"])
        done.clear()
        return batch

    for batch in batches:
        for ref, _, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ref != current:
                if sha:
                    done.append((current, sha.hexdigest()))
                current, sha = ref, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if len(done) > 10_000:
            yield out()
    if sha:
        done.append((current, sha.hexdigest()))
    if done:
        yield out()


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conv_id, turns`` (``turn_arrays``); a node's own turn is the ``depth``-th of its ``conv_id``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = arrays.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    order = ["path", "conv_id"]
    swept = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT_SQL), "swept")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    frames = swept.where("kind = 'f'").groupBy("ref", "depth", "words").agg(F.min(F.struct("part", "side")).alias("at"), F.min("conv_id").alias("conv_id"), *sums)
    frames = frames.coalesce(1).sortWithinPartitions("at", "depth").select("ref", "depth", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    stitched = table(frames.mapInArrow(_stitch, f"ref binary, {_NODES}"), "frames")
    ids = swept.where("kind = 'e'").select("ref", "part", "seq", "ends").repartition("ref").sortWithinPartitions("ref", "part", "seq")
    hashes = ids.mapInArrow(_end_hashes, "ref binary, hash string")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = swept.where("kind = 'n'").select("ref", *names, F.col("ends").alias("ends_sha256"))
    inside = nodes.where("ref is null").select(*names, "ends_sha256")
    below = nodes.where("ref is not null").drop("parent_conv_id").join(stitched.select("ref", F.col("conv_id").alias("parent_conv_id")), "ref").select(*names, "ends_sha256")
    whole = stitched.join(hashes, "ref", "left").select(*names, F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return inside.unionByName(below).unionByName(whole)


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"

#: The same nodes by prefixes: each conversation's prefixes are rows, nodes their groups, subtrees joins of nodes with the prefixes of one member.
SQL = f"""
with own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select distinct conv_id, conv_id - conv_id % 20 as base, {_CRC} % 4 as h from own),
turns as (select i.conv_id, o.k, o.role, o.text from ids i join own o on o.conv_id = i.base and o.k <= i.h
          union all select i.conv_id, o.k + 1000000, o.role, o.text from ids i join own o on o.conv_id = i.conv_id and o.k > i.h),
t as (select conv_id, row_number() over (partition by conv_id order by k) as depth, md5(concat(length(role), ':', role, text)) as key,
      len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words from turns),
p as (select conv_id, depth, words, md5(string_agg(key, '') over (partition by conv_id order by depth)) as node, max(depth) over (partition by conv_id) as last from t
      union all select i.conv_id, 0, 0, 'root', coalesce(m.last, 0) from ids i left join (select conv_id, max(depth) as last from t group by 1) m using (conv_id)),
n as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = last), '') as ends from p group by node, depth),
up as (select n.node, p.node as parent from n join p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
c as (select parent as node, count(*) as n_children from up group by 1),
below as (select p.node, sum((n.n_convs - 1) * n.words) as saved, sum(case when c.n_children is null then 1 else 0 end) as leaves
          from n left join c on c.node = n.node join p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.node)
select n.conv_id, n.depth, pn.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from n left join up on up.node = n.node left join n pn on pn.node = up.parent left join c on c.node = n.node join below on below.node = n.node
"""
