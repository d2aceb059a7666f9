"""The words of string columns as arrays: where they are, their hashes, and texts of those that are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker splits at once; a longer text is split alone.
SLICE_BYTES = 4_000_000
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 512

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The bytes of a little-endian 64-bit load that belong to a word with so many bytes left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; it is one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a string column's rows.

    begin and end are bounds in data, the rows' UTF-8 bytes one after another; row k has the words first[k] to
    first[k + 1] - 1. Null rows have none.
    """

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        _, offsets, data = column.buffers()
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        self.at = at - at[0]
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)  # where a row begins
        edge[self.at] = True
        apart = ~inside
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= apart[:-1] | edge[1:-1]
        end[:-1] &= apart[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, self.at)

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes: different for different words of one length up to eight bytes, and for others but by chance."""
        length = self.end - self.begin
        h = length.astype(np.uint64) * _P
        view = np.ndarray((len(self.data),), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        active, k = np.flatnonzero(length <= LONG_WORD) if len(length) and length.max() > LONG_WORD else np.arange(len(h)), 0
        while len(active):
            left = length[active] - k
            h[active] = mix(h[active] ^ (view[self.begin[active] + k] & _MASK[np.minimum(left, 8)]))
            active, k = active[left > 8], k + 8
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            import xxhash

            h[i] = xxhash.xxh3_64_intdigest(self.data[self.begin[i] : self.end[i]].tobytes())
        return h

    def starts(self, k: int) -> np.ndarray:
        """The words at which k consecutive words of one row begin."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= k)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each row's kept words, joined by one blank."""
        k = np.flatnonzero(keep)
        bounds = np.searchsorted(k, self.first)
        begin, stop = self.begin[k], self.end[k].copy()
        blank = np.ones(len(k), bool)
        blank[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False  # the last one kept of a row has no blank behind it
        data = self.data.copy()
        data[stop[blank]] = 0x20  # white space, as another word of the row comes later
        stop[blank] += 1
        step = np.zeros(len(data) + 1, np.int8)
        step[begin] = 1
        step[stop] -= 1
        kept = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(stop - begin)])[bounds].astype(np.int32)
        return pa.StringArray.from_buffers(len(self.first) - 1, pa.py_buffer(offsets), pa.py_buffer(kept))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values (mixed), whatever row they are of; values h[i : i + k] give the i-th."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    whole, have, power, span = None, 0, _P, 1  # whole covers `have` values; h covers `span`
    while True:
        if k & span:
            whole = h if whole is None else whole[: len(h) - have] * _U(pow(int(_P), span, 1 << 64)) + h[have:] if have else h
            have += span
        if have == k:
            return mix(whole[: len(whole)])
        h = h[:-span] * _U(pow(int(_P), span, 1 << 64)) + h[span:]
        span *= 2


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[slice]:
    """Slices of a string column's rows with at most so many bytes each, or of one row."""
    sizes = texts.fill_null("") if texts.null_count else texts
    import pyarrow.compute as pc

    size = np.concatenate([[0], np.cumsum(pc.binary_length(sizes).to_numpy(zero_copy_only=False))]) if len(texts) else np.zeros(1)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, size[begin] + most, "right")) - 1)
        yield slice(begin, end)
        begin = end
