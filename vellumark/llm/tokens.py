"""Exact token ids by the tokenizers library, with work shared between equal words.

A byte-level tokenizer first splits a text by a fixed pattern, and no token crosses such a split. Arrow batches of
texts are cut, in their UTF-8 buffers, where that pattern always splits: before a space that follows a visible
character, between a letter or digit and punctuation, around a single line break between visible characters. Elsewhere
they stay whole, as fewer cuts are as exact. Arrow finds the different parts of a batch, only those are looked
up among the parts that a worker has met or encoded, and their ids are taken back into the order of the texts.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which Python's and the library's idea of white space differ.
_ODD = re.compile("[\x1c-\x1f\x85᠎]")
#: The split pattern of byte-level tokenizers (a fixed value of the vocabulary files).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts that a worker remembers, and the bytes of the longest.
REMEMBER, LONGEST = 300_000, 48
#: Bytes of text that are cut at once.
AT_ONCE = 4 << 20
#: The array type of unsigned 32-bit numbers.
U32 = "I"

#: Kinds of bytes: of letters and digits, ASCII punctuation, the space, line feed, others; of characters beyond ASCII, and
#: first ones of two-byte characters that are all letters (U+00C0 to U+027F but for two signs, U+0400 to U+047F).
_LETTER, _MARK, _SPACE, _BREAK, _OTHER, _FAR, _LEAD = range(7)
_ASCII = [_LETTER if chr(b).isalnum() else _SPACE if b == 32 else _BREAK if b == 10 else _MARK if 32 < b < 127 else _OTHER for b in range(128)]
_KIND = bytes(_ASCII + [_LEAD if b in (*range(0xC3, 0xCA), 0xD0, 0xD1) else _FAR for b in range(128, 256)])
#: By the kinds of two neighbours, eight times the first and the second: 1 cuts between them, 2 does if the first is no white space.
_BETWEEN = bytes({8 * _LETTER + _SPACE: 1, 8 * _MARK + _SPACE: 1, 8 * _LETTER + _MARK: 1, 8 * _FAR + _SPACE: 2}.get(k, 0) for k in range(256))
#: The last three bytes of white space beyond ASCII (of two-byte ones the last two), U+180E with them.
_WHITE_3 = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_WHITE_2 = np.array([0xC285, 0xC2A0])


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def cuts(data: np.ndarray) -> np.ndarray:
    """For each byte whether a part starts there; neighbours count across texts, whose starts are cuts anyway."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    # bytes.translate looks up a byte for a byte, where numpy would widen each to a number of eight.
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND)), "u1")
    lead = np.flatnonzero(kind[:-1] == _LEAD)
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    between = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_BETWEEN), "u1")
    cut[1:] = between == 1
    at = np.flatnonzero(between == 2) + 1
    if len(at):
        last = [data[np.maximum(at - k, 0)].astype("i4") for k in (1, 2, 3)]
        two = (last[1] << 8) | last[0]
        cut[at[~np.isin(two, _WHITE_2) & ~np.isin((last[2] << 16) | two, _WHITE_3)]] = True
    at = np.flatnonzero(kind[1:-1] == _BREAK) + 1
    at = at[(kind[at - 1] <= _MARK) & (kind[at + 1] <= _MARK)]
    cut[at] = cut[at + 1] = True
    return cut


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, pre = self.tok.model, self.tok.pre_tokenizer
        # Others than plain byte-level tokenizers encode whole texts.
        self.parts = self.tok.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and isinstance(self.model, BPE) and not self.model.dropout
        self.find = regex.compile(_PATTERN).findall
        self.names = dict(enumerate(_byte_names()))
        self.space = self.names[32]
        #: Parts that were met, the latest first, and their ids.
        self.known, self.ids = pa.array([], pa.utf8()), pa.array([], pa.binary())

    def _word(self, word: str) -> list[int]:
        """Ids of one word of the split pattern, white space in front included."""
        if word.isascii() and word.isprintable():
            named = word.replace(" ", self.space)
        else:
            named = word.encode().decode("latin1").translate(self.names)
        return [t.id for t in self.model.tokenize(named)]

    def _part(self, part: str) -> list[int]:
        if (part[1:] if part[0] == " " else part).isalpha():
            return self._word(part)
        if _ODD.search(part):
            return self.tok.encode(part, add_special_tokens=False).ids
        return [i for word in self.find(part) for i in self._word(word)]

    def _new(self, parts: pa.Array) -> pa.Array:
        flat, sizes = array(U32), []
        for part in parts.to_pylist():
            ids = self._part(part)
            flat.extend(ids)
            sizes.append(len(ids))
        ends = np.concatenate([[0], 4 * np.cumsum(sizes, dtype="i8")]).astype("i4")
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])

    def _lookup(self, parts: pa.Array) -> pa.Array:
        """Ids of different parts, which are then the first of those remembered."""
        at = pc.index_in(parts, value_set=self.known)
        new = at.is_null()
        ids = pa.concat_arrays([self.ids, self._new(parts.filter(new))])
        at, new = at.fill_null(0).to_numpy(), new.to_numpy(zero_copy_only=False)
        others = np.ones(len(self.known), bool)
        others[at[~new]] = False
        at = np.where(new, len(others) + np.cumsum(new) - 1, at)
        short = np.flatnonzero(pc.binary_length(parts).to_numpy() <= LONGEST)[:REMEMBER]
        others = np.flatnonzero(others)[: REMEMBER - len(short)]
        self.known = pa.concat_arrays([parts.take(pa.array(short)), self.known.take(pa.array(others))])
        self.ids, ids = ids.take(pa.array(np.concatenate([at[short], others]))), ids.take(pa.array(at))
        return ids

    def _cut(self, data: np.ndarray, bounds: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that lie in ``data`` between ``bounds``: their ids, ``end`` after each, and where each text's start, with the end."""
        cut = np.append(cuts(data), False)
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1]).astype("i4")
        parts = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        # The part after the last is the end of a text.
        ids = pa.concat_arrays([self._lookup(parts.dictionary), pa.array([end], pa.binary())])
        ends = np.searchsorted(starts, bounds[1:])
        taken = ids.take(pa.array(np.insert(parts.indices.to_numpy(), ends, len(ids) - 1)))
        at = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1)[np.concatenate([[0], ends + np.arange(1, len(bounds))])] // 4
        return np.frombuffer(taken.buffers()[2] or b"", "<u4", at[-1]), at.astype("i8")

    def _long(self, data: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``_cut`` of one text of any length, in slices that end where a part does."""
        got, at = [], 0
        while at < len(data):
            size = AT_ONCE
            while at + size < len(data) and not (found := np.flatnonzero(cuts(data[at : at + size]))).size:
                size *= 2
            upto = at + int(found[-1]) if at + size < len(data) else len(data)
            got.append(self._cut(data[at:upto], np.array([0, upto - at]), end if upto == len(data) else b"")[0])
            at = upto
        ids = np.concatenate(got)
        return ids, np.array([0, len(ids)])

    def column(self, column: pa.Array, end: bytes = b"") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids of an Arrow column of texts (null: empty), ``end`` after each, some texts at a time: the first one's position, ids, where each text's start, with the end."""
        column = column.cast(pa.utf8()).fill_null("")
        if not self.parts:
            for k, text in enumerate(column.to_pylist()):
                ids = np.frombuffer(array(U32, self.tok.encode(text, add_special_tokens=False).ids).tobytes() + end, "<u4")
                yield k, ids, np.array([0, len(ids)])
            return
        if not len(column):
            return
        bounds = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
        data, k = np.frombuffer(column.buffers()[2] or b"", "u1"), 0
        while k < len(column):
            upto = max(k + 1, int(np.searchsorted(bounds, bounds[k] + AT_ONCE, "right")) - 1)
            texts, own = data[bounds[k] : bounds[upto]], bounds[k : upto + 1] - bounds[k]
            yield (k, *(self._long(texts, end) if len(texts) > AT_ONCE else self._cut(texts, own, end)))
            k = upto

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, ids, _ in self.column(pa.array([text])))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def texts(batch, column: int = 1, at_once: int = 1000) -> Iterator[tuple[int, list]]:
    """The texts of an Arrow batch, some at a time: position of the first, and the texts."""
    for k in range(0, batch.num_rows, at_once):
        yield k, batch.column(column).slice(k, at_once).to_pylist()
