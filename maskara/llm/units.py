"""Cutting texts into units that a byte-level BPE encodes one by one, as it would in their place.

A unit starts at a space that a character other than white space follows. The split pattern of byte-level BPE
always starts a new match there: of a run of white space before a word, all but the last character match alone.
So the ids of a text are the ids of its units in order, and a unit is encoded once however often it occurs.

Texts are cut, hashed and told apart as arrays of bytes, a slice at a time; no string is made for a unit.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that no unit starts before: ASCII white space, and the first bytes of the other white space characters, which are looked at again.
_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Units up to so many bytes are hashed as arrays, longer ones one by one.
MOST_HASHED = 4096
#: Elements put together at a time.
TAKEN = 200_000
_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, (2, MOST_HASHED + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the characters of those three bytes, of which a is in _LEADS, are white space (U+180E counts as such)."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    ogham = (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return two | ogham | general | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def _opens(data: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """Whether another character than white space follows each space; data has three bytes more than the texts."""
    follow = data[spaces + 1]
    opens = ~_ASCII_WHITE[follow]
    wide = np.flatnonzero(opens & _LEADS[follow])
    opens[wide] = ~_white(follow[wide], data[spaces[wide] + 2], data[spaces[wide] + 3])
    return opens


class Cut:
    """Bytes, and where units start and end in them; ``offsets``: the units before each text, and in all."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        self.data, self.starts, self.ends, self.offsets = data, starts, ends, offsets

    def __len__(self) -> int:
        return len(self.starts)

    @classmethod
    def of(cls, texts: pa.Array) -> Cut:
        """The units of texts; null: none, as of an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, at, values = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        size = int(offsets[-1] - offsets[0])
        data = np.zeros(size + 3, dtype=np.uint8)  # padded, so that a look ahead stays inside
        if size:
            data[:size] = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        spaces = np.flatnonzero(data[:size] == 0x20)
        last = np.zeros(size + 1, dtype=bool)
        last[offsets] = True  # where texts begin or end
        opens = _opens(data, spaces) & ~last[spaces + 1]
        first = np.zeros(size + 1, dtype=bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        first[spaces[opens]] = True
        starts = np.flatnonzero(first[:size])
        return cls(data, starts, np.append(starts[1:], size) if len(starts) else starts, np.searchsorted(starts, offsets))

    @classmethod
    def runs(cls, texts: pa.Array) -> Cut:
        """The runs of other bytes than spaces in each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, at, values = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets] = True
        inside = np.append(data != 0x20, False)
        before = np.append(False, inside[:-1])
        starts = np.flatnonzero(inside & (~before | edge))
        return cls(data, starts, np.flatnonzero(before & (~inside | edge)), np.searchsorted(starts, offsets))

    @classmethod
    def end_to_end(cls, data: bytes, lengths: np.ndarray) -> Cut:
        """Units that stand end to end."""
        ends = np.cumsum(lengths, dtype=np.int64)
        return cls(np.frombuffer(data + bytes(3), dtype=np.uint8), ends - lengths, ends, np.array([0, len(ends)]))

    def hashes(self) -> np.ndarray:
        """[unit, 2] 128 bits: twice a sum of random numbers of letters times such of places."""
        n = self.ends - self.starts
        out = np.zeros((len(n), 2), dtype=np.uint64)
        if not len(n):
            return out
        long = np.flatnonzero(n > MOST_HASHED)
        begin, size = int(self.starts[0]), int(self.ends[-1])
        upto = np.append(self.starts[1:], size)
        place = np.arange(begin, size, dtype=np.int64)
        place -= np.repeat(self.starts, upto - self.starts)
        gaps = len(n) > 0 and bool((upto != self.ends).any())
        if len(long) or gaps:
            np.minimum(place, MOST_HASHED, out=place)
        data = self.data[begin:size]
        for k in range(2):
            product = _LETTER[k][data] * _PLACE[k][place]
            if gaps:  # what stands between units counts for nothing
                product[data == 0x20] = 0
            out[:, k] = np.add.reduceat(product, self.starts - begin)
            out[:, k] ^= out[:, k] >> np.uint64(29)
        for i in long.tolist():
            digest = xxhash.xxh3_128_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
            out[i] = digest & (2**64 - 1), digest >> 64
        return out

    def joint(self, at: np.ndarray) -> np.ndarray:
        """Whether those units are a space and more without another one, and would start a unit after any other."""
        spaces = np.append(0, np.cumsum(self.data == 0x20))
        s, e = self.starts[at], self.ends[at]
        return (self.data[s] == 0x20) & (spaces[e] - spaces[s] == 1) & (e - s > 1) & _opens(self.data, s)

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        """Those units' bytes, end to end."""
        s = self.starts[at]
        return _taken(self.data, s, self.ends[at] - s)

    def strings(self, at: np.ndarray) -> list[str]:
        return [self.data[s:e].tobytes().decode() for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def gathered(codes: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of data (lengths long, end to end) that codes name, end to end; and how long each is."""
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    return _taken(data, starts[codes], each), each


def _taken(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces of data, n long from starts on, end to end; about ``TAKEN`` elements at a time, as their places take eight bytes each."""
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=data.dtype)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(out), TAKEN), side="left"), len(ends)))
    for a, b in zip(np.append(0, cuts), cuts):
        if b > a:
            first = int(ends[a] - n[a])
            at = np.arange(first, int(ends[b - 1]), dtype=np.int64)
            at += np.repeat(starts[a:b] - (ends[a:b] - n[a:b]), n[a:b])
            out[first : first + len(at)] = data[at]
    return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct row of 128-bit hashes, the place of every row among them)."""
    _, first, which = np.unique(h[:, 0], return_index=True, return_inverse=True)
    if (h[first, 1][which] != h[:, 1]).any():  # equal in the first half alone
        _, first, which = np.unique(h, axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


class Places:
    """A table from 128-bit hashes to numbers: two dozen bytes an entry, looked up many at a time. It grows as needed."""

    def __init__(self, most: int):
        size = 1 << max(4, (2 * most - 1).bit_length())
        self.most, self.mask, self.n = most, np.uint64(size - 1), 0
        self.keys, self.values = np.zeros((size, 2), dtype=np.uint64), np.full(size, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        open_, at = np.arange(len(h)), h[:, 0] & self.mask
        while len(open_):
            v = self.values[at]
            keys = self.keys[at]
            same = (v >= 0) & (keys[:, 0] == h[open_, 0]) & (keys[:, 1] == h[open_, 1])
            out[open_[same]] = v[same]
            on = (v >= 0) & ~same
            open_, at = open_[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new, distinct hashes on, in order."""
        if 4 * (self.n + len(h)) > 3 * len(self.values):
            known = self.values >= 0
            old = self.keys[known][np.argsort(self.values[known])]
            self.__init__(2 * (self.n + len(h)))
            self.add(old)
        number, at = np.arange(self.n, self.n + len(h), dtype=np.int32), h[:, 0] & self.mask
        self.n += len(h)
        left = np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.values[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.keys[at[took]], self.values[at[took]] = h[left[took]], number[left[took]]
            on = np.ones(len(left), dtype=bool)
            on[took] = False
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all hashes, the indices of those that are new, one of each, in the order of their numbers)."""
        got = self.find(h)
        new = np.flatnonzero(got < 0)
        if not len(new):
            return got, new
        first, which = distinct(h[new])
        got[new] = self.n + which
        self.add(h[new[first]])
        return got, new[first]

    def clear(self) -> None:
        self.n = 0
        self.values.fill(-1)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """The batch in slices of rows of about ``most`` bytes of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most, prepend=0)) if len(sizes) else []
    at = 0
    for end in [*ends, batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Returns freed memory to the system: a worker that Spark reuses would keep what its largest task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps from one task to the next: (owner, key) and the object, one at most.
_KEPT: dict = {}


def kept(owner: str, key, make):
    """The object that this worker made for the key, made anew if it has none; others are let go."""
    if (owner, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def tidy(f, keeps: bool = True):
    """f, a generator over batches, that gives its memory back when it ends. What other operators' tasks kept goes before it starts; all that is kept, if f
    ``keeps`` nothing: a worker would hold it through the later stages of its operator."""
    owner = f.__module__.rpartition(".")[2]

    @functools.wraps(f)
    def whole(batches, *more):
        if any(o != owner or not keeps for o, _ in _KEPT):
            _KEPT.clear()
            gc.collect()
            give_back()
        yield from f(batches, *more)
        gc.collect()
        give_back()

    return whole
