"""Texts and their words as arrays over the bytes of an Arrow batch, without a Python string for each.

A word is known by three numbers: its first eight bytes, its next eight, and its length; from 17 bytes on the
third is a 64-bit digest of the whole word instead, with the top bit set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHORT = 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] |= 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_U = np.uint64


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets of each; a null text is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows cut to ranges of at most so many bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number; ``data`` needs eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data.data if data.flags.c_contiguous else np.ascontiguousarray(data).data, 0, (1,))


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; no word goes over the end of a text."""
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[begins] = inside[begins]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Four rows of numbers: the three that tell words apart, and a hash of them."""
    padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
    at, size = loads(padded), ends - starts
    out = np.empty((4, len(starts)), np.uint64)
    out[0] = at[starts] & _MASKS[np.minimum(size, 8)]
    out[1] = at[starts + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]
    out[2] = size
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw, digest = memoryview(padded), xxhash.xxh3_64_intdigest
        out[2, long] = np.fromiter((digest(raw[a:b]) | 1 << 63 for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    out[3] = mixed(out[0] * _U(0x9E3779B97F4A7C15) ^ mixed(out[1] * _U(0xC2B2AE3D27D4EB4F) ^ out[2]))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and each word's number among them; told apart by all three numbers."""
    order = np.argsort(keys[3], kind="stable")
    mine = keys[:, order]
    new = np.append(True, mine[3, 1:] != mine[3, :-1])[: len(order)]
    same = np.flatnonzero(~new)
    if (mine[:3, same] != mine[:3, same - 1]).any():  # two words of one hash
        order = np.lexsort(keys)
        mine = keys[:, order]
        new = np.append(True, (mine[:, 1:] != mine[:, :-1]).any(axis=0))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all slices one after another, and the offsets of each."""
    upto = np.cumsum(ends - starts)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - (ends - starts)), ends - starts)
    return data[at], np.append(0, upto)


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    flat, offsets = slices(data, starts, ends)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class Lookup:
    """Finds keys (rows of numbers, the last one a hash) by a table of slots, and by search where a slot has another key.

    ``order`` has the keys' places as given; what is found counts in that order.
    """

    def __init__(self, keys: np.ndarray, weight: np.ndarray | None = None):
        self.order = np.argsort(keys[-1], kind="stable")
        self.keys = np.ascontiguousarray(keys[:, self.order])
        bits = max(4, 2 * keys.shape[1]).bit_length()
        self.shift = _U(64 - bits)
        self.index = np.zeros(1 << bits, np.int32)
        heavy = np.arange(len(self.order)) if weight is None else np.argsort(weight[self.order], kind="stable")
        self.index[(self.keys[-1][heavy] >> self.shift).astype(np.int64)] = heavy  # the heaviest of a slot comes last and stays

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``order`` each key is; -1 if it isn't there."""
        n = self.keys.shape[1]
        if not n:
            return np.full(keys.shape[1], -1, np.int64)
        at = self.index[(keys[-1] >> self.shift).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero(~self._equal(at, keys))
        at[other] = np.minimum(np.searchsorted(self.keys[-1], keys[-1][other]), n - 1)
        while len(other):  # more than one step only where hashes are equal
            left = keys[:, other]
            miss = ~self._equal(at[other], left)
            after = np.minimum(at[other] + 1, n - 1)
            again = miss & (after > at[other]) & (self.keys[-1][after] == left[-1])
            at[other[miss & ~again]] = -1
            other = other[again]
            at[other] += 1
        return at

    def _equal(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        same = self.keys[-1][at] == keys[-1]
        for mine, want in zip(self.keys[:-1], keys[:-1], strict=True):
            same &= mine[at] == want
        return same


class Seen:
    """A growing table of keys, made of parts, each at least twice as large as the next."""

    def __init__(self) -> None:
        self.keys, self.tables = np.zeros((4, 0), np.uint64), []

    def __len__(self) -> int:
        return self.keys.shape[1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, counted as they came, or -1."""
        place, left = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1])
        for _, first, table in self.tables:
            at = table.find(keys if len(left) == keys.shape[1] else keys[:, left])
            hit = at >= 0
            place[left[hit]] = first + table.order[at[hit]]
            left = left[~hit]
        return place

    def learn(self, keys: np.ndarray) -> None:
        """Adds keys, which are distinct and not there yet."""
        first = len(self)
        self.keys = np.concatenate([self.keys, keys], axis=1)
        while self.tables and self.tables[-1][0] < 2 * (len(self) - first):
            first = self.tables.pop()[1]
        self.tables.append((len(self) - first, first, Lookup(self.keys[:, first:])))
