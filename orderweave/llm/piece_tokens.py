"""SentencePiece encoding and decoding by suffix-array matching.

A block of texts is cut into units that no piece of the vocabulary crosses: between two bytes that are neighbours in
no piece. The block's distinct units that were not met before are concatenated and indexed by a suffix array,
truncated to the longest piece (the first characters packed to a number, then prefix doubling); every piece is
binary-searched for its range of suffixes; ranges are unrolled to edges, sorted by where they end, and relaxed in step over all units, which
are cut once more wherever no edge crosses. For a unigram model relaxing keeps the best sum of scores. For a BPE
model an edge holds if its piece may follow the last piece of the text before it, that is if merging the two pieces'
text gives just those two; every position has one such edge, so the path is that of the merges. Characters without
a piece become one piece a byte.

Units are told apart by numbers (``word_blocks``), and every text's pieces are decoded and held against the text's
bytes: a text that they don't give back is encoded again by itself. The model file is read on the driver, parsed, and
sent to the tasks, which see no local file. Units already encoded are kept in a worker's table of at most
``MOST_UNITS``; a full table is emptied, which changes no result.

Defined results: a null text is empty and has no piece; decoding gives the text back but for the mark U+2581,
which the format itself turns into a space; repeated rows are encoded each; an empty table gives an empty result;
other columns are ignored by ``encode_documents``. Models with a character map or with user-defined pieces are
refused.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orderweave.llm.common import table, tidy
from orderweave.llm.word_blocks import Seen, distinct, parts, slices, text_bytes, word_keys

MODEL_FILE = os.environ.get("ORDERWEAVE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
PART = 1 << 22  # bytes of text encoded at once, or one text
CHARS_AT_ONCE, MOST_UNITS, MOST_IDS = 500_000, 600_000, 1 << 22
# Numbers of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        shift = out = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Vocabulary and flags of a model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.model, self.prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        #: By two bytes: whether they are neighbours in some piece (a mark as a space) or in a character.
        self.joins = np.zeros(1 << 16, bool)
        self.joins.reshape(256, 256)[:, 0x80:0xC0] = True
        for p in self.ids:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8).astype(np.int64)
            self.joins[raw[:-1] << 8 | raw[1:]] = True
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``normalise`` for the bytes of many texts; a mark is one byte, a space."""
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        if self.squeeze:
            space = data == 32
            after = np.append(True, space[:-1])[: len(data)]
            after[begins] = True
            data, offsets = _without(data, offsets, np.flatnonzero(space & after))
            last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
            data, offsets = _without(data, offsets, last[data[last] == 32])
        mark = _marks(data)
        if len(mark):
            data = data.copy()
            data[mark] = 32
            data, offsets = _without(data, offsets, np.concatenate([mark + 1, mark + 2]))
        if self.prefix:
            full = offsets[1:] > offsets[:-1]
            offsets = offsets + np.append(0, np.cumsum(full))
            out, text = np.full(offsets[-1], 32, np.uint8), np.ones(offsets[-1], bool)
            text[offsets[:-1][full]] = False
            out[text] = data
            data = out
        return data, offsets

    def unit_bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of ``normalised`` texts begin and end."""
        pair = data.astype(np.uint16)
        pair[1:] |= pair[:-1] << np.uint16(8)
        first = ~self.joins[pair]
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        begins = np.flatnonzero(first)
        return begins, np.append(begins[1:], len(data))[: len(begins)]

    def merge_tree(self, piece: str) -> tuple | None:
        """How a piece's characters merge, best-scored neighbours first and leftmost among equals: nested (id, left, right); None if not to one."""
        nodes = [(self.ids.get(c, -1), None, None) for c in piece]
        texts = list(piece)
        while len(nodes) > 1:
            found = [(-self.scores[self.ids[x]], k) for k in range(len(texts) - 1) if (x := texts[k] + texts[k + 1]) in self.ids]
            if not found:
                return None
            k = min(found)[1]
            texts[k : k + 2] = [texts[k] + texts[k + 1]]
            nodes[k : k + 2] = [(self.ids[texts[k]], nodes[k], nodes[k + 1])]
        return nodes[0] if nodes[0][0] >= 0 else None

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def _marks(data: np.ndarray) -> np.ndarray:
    a, b, c = MARK.encode()
    return np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)


def _without(data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(places):
        return data, offsets
    stay = np.ones(len(data), bool)
    stay[places] = False
    return data[stay], offsets - np.searchsorted(np.sort(places), offsets)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Starts of all suffixes in the order of their first ``depth`` numbers at least; the sorted packed heads, bits a number, numbers a head.

    As many numbers as fit are packed to one to begin with, then prefix doubling goes on. Numbers are small and not negative.
    """
    n, bits = len(text), max(1, int(text.max(initial=0)).bit_length())
    width = min(depth, 63 // bits)
    padded, head = np.append(text, np.zeros(width, np.int64)), np.zeros(n, np.int64)
    for k in range(width):
        head = head << bits | padded[k : k + n]
    order, size = np.argsort(head), width
    heads = sorted_ = head[order]
    while size < depth and n:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        sorted_, size = key[order], size * 2
    return order, heads, bits, width


def piece_ranges(text: np.ndarray, order: np.ndarray, heads: np.ndarray, bits: int, width: int, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (a row, padded with 0) the range of ``order`` whose suffixes begin with it."""
    n, packed = len(order), np.zeros(len(pieces), np.int64)
    for k in range(width):
        packed = packed << bits | (pieces[:, k] if k < pieces.shape[1] else 0)
    rest = bits * np.maximum(width - lengths, 0)
    lo, hi = np.searchsorted(heads, packed), np.searchsorted(heads, packed + (np.int64(1) << rest))
    padded = np.append(text, np.zeros(pieces.shape[1] + 1, np.int64))
    for at in range(width, pieces.shape[1]):  # longer ones, number by number
        live = np.flatnonzero((lengths > at) & (lo < hi))
        if not len(live):
            break
        want = pieces[live, at]
        bounds = []
        for least in (want, want + 1):  # first suffix whose number at this depth is not below
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                below = padded[order[np.minimum(mid, n - 1)] + at] < least
                a = np.where(open_ & below, mid + 1, a)
                b = np.where(open_ & ~below, mid, b)
            bounds.append(a)
        lo[live], hi[live] = bounds
    return lo, np.maximum(lo, hi)


class Neighbours:
    """Says of pairs of pieces whether merging their joined text gives just those two.

    While both sides merge on their own, what touches at the border goes up the right edge of the left piece's tree
    and the left edge of the right piece's. The border holds if at no time the two touching nodes' merge is due
    before both of the merges that take either of them away.
    """

    def __init__(self, model: PieceModel):
        n, width = len(model.pieces), model.longest + 1
        rank = -np.array(model.scores)
        self.whole = np.zeros(n, bool)
        # Nodes on the edge facing the border, first character first, and the rank at which each is merged away.
        self.node = [np.zeros((n, width), np.int64) for _ in range(2)]
        self.until = [np.full((n, width), np.inf) for _ in range(2)]
        joined = {}
        for piece, i in model.ids.items():
            for k in range(1, len(piece)):
                if piece[:k] in model.ids and piece[k:] in model.ids:
                    joined[model.ids[piece[:k]] << 32 | model.ids[piece[k:]]] = rank[i]
            tree = model.merge_tree(piece)
            if tree is None:
                continue
            self.whole[i] = True
            for side, child in ((0, 2), (1, 1)):
                path, at = [], tree
                while at is not None:
                    path.append(at[0])
                    at = at[child]
                path.reverse()
                self.node[side][i, : len(path)] = path
                self.node[side][i, len(path) :] = i
                self.until[side][i, : len(path) - 1] = rank[path[1:]]
        self.keys = np.array(sorted(joined), np.int64)
        self.ranks = np.array([joined[k] for k in self.keys.tolist()])

    def hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = self.whole[left] & self.whole[right]
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        live = np.flatnonzero(ok)
        while len(live):
            a, b = left[live], right[live]
            away_a, away_b = self.until[0][a, i[live]], self.until[1][b, j[live]]
            key = self.node[0][a, i[live]] << 32 | self.node[1][b, j[live]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            due = np.where(self.keys[at] == key, self.ranks[at], np.inf)
            ok[live] &= ~((due < away_a) & (due <= away_b))
            go = ok[live] & (np.minimum(away_a, away_b) < np.inf)
            first = away_a <= away_b
            i[live] += first
            j[live] += ~first
            live = live[go]
        return ok


class Encoder:
    """Encodes blocks of texts; keeps what it knows of units."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.neighbours = Neighbours(model) if model.model == BPE else None
        use = [(p, i) for p, i in model.ids.items() if self.neighbours is None or self.neighbours.whole[i]]
        #: Numbers of the characters that pieces have; all others are 1, and 0 is what is between units.
        self.numbers = np.ones(0x110000, np.int32)
        letters = sorted({ord(c) for p, _ in use for c in p})
        self.numbers[letters] = np.arange(2, len(letters) + 2)
        self.rows = np.zeros((len(use), model.longest), np.int64)
        self.row_ids = np.array([i for _, i in use])
        for r, (p, _) in enumerate(use):
            self.rows[r, : len(p)] = self.numbers[list(map(ord, p))]
        self.lengths = np.array([len(p) for p, _ in use])
        self.scores = np.array(model.scores)
        raw = [r.replace(MARK.encode(), b" ") for r in model.raw]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self.pair_keys = np.full(1 << 20, -1, np.int64)
        self.pair_values = np.zeros(1 << 20, bool)
        self._empty()

    def _empty(self) -> None:
        self.seen = Seen()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, at, *_ = self.encode_block(*text_bytes(pa.array(texts, pa.string())))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of texts: the ids and each text's offsets in them, what they decode to, and whether that is the text."""
        norm, bounds = self.model.normalised(data, offsets)
        begin, end = self.model.unit_bounds(norm, bounds)
        at = self._places(word_keys(norm, begin, end), norm, begin, end)
        ids, upto = slices(self.flat, self.starts[at], self.starts[at + 1])
        ids_at = upto[np.searchsorted(begin, bounds)]
        back, back_at = self.decode(ids, ids_at)
        if len(back) != len(norm) or (back != norm).any():
            lost = [i for i in range(len(bounds) - 1) if back[back_at[i] : back_at[i + 1]].tobytes() != norm[bounds[i] : bounds[i + 1]].tobytes()]
            alone = {i: self._alone(norm[bounds[i] : bounds[i + 1]]) for i in lost}
            every = [alone.get(i, ids[ids_at[i] : ids_at[i + 1]]) for i in range(len(bounds) - 1)]
            ids, ids_at = np.concatenate(every), np.cumsum([0, *map(len, every)])
            back, back_at = self.decode(ids, ids_at)
        if self.model.prefix:
            begins = back_at[:-1][back_at[1:] > back_at[:-1]]
            back, back_at = _without(back, back_at, begins[back[begins] == 32])
        plain, plain_at = data, offsets
        if len(mark := _marks(data)):
            plain = data.copy()
            plain[mark] = 32
            plain, plain_at = _without(plain, offsets, np.concatenate([mark + 1, mark + 2]))
        same = np.diff(back_at) == np.diff(plain_at)
        if not same.all() or (back != plain).any():
            same = np.array([back[a:b].tobytes() == plain[c:d].tobytes() for a, b, c, d in zip(back_at[:-1], back_at[1:], plain_at[:-1], plain_at[1:], strict=True)], bool)
        return ids, ids_at, back, back_at, same

    def decode(self, ids: np.ndarray, ids_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many texts' ids one after another, a mark as a space, and each text's offsets in them."""
        back, upto = slices(self.raw, self.raw_at[ids], self.raw_at[ids + 1])
        return back, upto[ids_at]

    def _places(self, keys: np.ndarray, norm: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the table of each unit; encodes those that aren't in it."""
        place = self.seen.find(keys)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        first, number = distinct(keys[:, new])
        if len(self.seen) + len(first) > MOST_UNITS or len(self.flat) > MOST_IDS:
            self._empty()
            new = np.arange(keys.shape[1])
            first, number = distinct(keys)
        place[new] = len(self.seen) + number
        first = new[first]
        text, bounds = slices(norm, begin[first], end[first])
        flat, starts = [self.flat], [self.starts]
        for lo, hi in parts(bounds, CHARS_AT_ONCE):
            ids, each = self._units(text[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            flat.append(ids)
            starts.append(starts[-1][-1] + np.cumsum(each))
        self.flat, self.starts = np.concatenate(flat), np.concatenate(starts)
        self.seen.learn(keys[:, first])
        return place

    def _alone(self, norm: np.ndarray) -> np.ndarray:
        begin, end = self.model.unit_bounds(norm, np.array([0, len(norm)]))
        return self._units(norm, np.append(begin, len(norm)))[0] if len(begin) else np.zeros(0, np.int32)

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all occurrences of pieces; a character without a piece has one of id -1."""
        used = np.flatnonzero(np.bincount(text, minlength=2))
        small = np.zeros(int(self.numbers.max()) + 1, np.int64)
        small[used] = np.arange(len(used)) if used[0] == 0 else np.arange(1, len(used) + 1)
        there = np.zeros(len(small), bool)
        there[used] = there[0] = True
        live = np.flatnonzero(there[self.rows].all(axis=1))
        dense, rows, lengths = small[text], small[self.rows[live]], self.lengths[live]
        order, *heads = suffix_order(dense, self.model.longest)
        lo, hi = piece_ranges(dense, order, *heads, rows, lengths)
        count = hi - lo
        upto = np.cumsum(count)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(lo - (upto - count), count)
        start, row = order[at], np.repeat(live, count)
        end, piece = start + self.lengths[row], self.row_ids[row]
        bare = np.ones(len(text), bool)
        bare[start[end == start + 1]] = False
        bare = np.flatnonzero(bare & (text > 0))
        return np.concatenate([start, bare]), np.concatenate([end, bare + 1]), np.concatenate([piece, np.full(len(bare), -1)])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right piece may follow the left one; ids below 0 (nothing, or no piece) go with anything."""
        key = left * (1 << 32) + right
        free = (left < 0) | (right < 0)
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        missing = np.flatnonzero(~free & (self.pair_keys[slot] != key))
        value = self.pair_values[slot]
        if len(missing):
            keys, where = np.unique(key[missing], return_inverse=True)
            said = self.neighbours.hold(keys >> 32, keys & 0xFFFFFFFF)
            value[missing] = said[where]
            self.pair_keys[slot[missing]], self.pair_values[slot[missing]] = key[missing], said[where]
        return free | value

    def _units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units (their bytes, a mark as a space) one after another, and how many each has."""
        code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code[code == 32] = ord(MARK)
        sizes = np.add.reduceat((raw & 0xC0) != 0x80, bounds[:-1], dtype=np.int64)
        whole = np.cumsum(np.append(0, sizes[:-1] + 1))
        text, codes, inside = np.zeros(len(code) + len(sizes), np.int64), np.zeros(len(code) + len(sizes), np.int64), np.ones(len(code) + len(sizes), bool)
        inside[whole + sizes] = False
        text[inside], codes[inside] = self.numbers[code], code
        start, end, piece = self._edges(text)
        # A unit falls apart wherever no edge crosses: nothing is merged over such a place.
        wide = end > start + 1
        crossing = np.cumsum(np.bincount(start[wide] + 1, minlength=len(text) + 1) - np.bincount(end[wide], minlength=len(text) + 1))
        real = text > 0
        begin = np.flatnonzero(real & ((crossing[:-1] == 0) | ~np.append(False, real[:-1])))
        stop = np.append(begin[1:], len(text))
        stop = np.minimum(stop, (whole + sizes)[np.searchsorted(whole, begin, "right") - 1])
        step = end - np.repeat(begin, np.diff(np.append(begin, len(text))))[start - begin[0]]
        order = np.argsort(step.astype(np.uint16) if int(step.max(initial=0)) < 1 << 16 else step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last, back = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1)
        best = np.full(len(text) + 1, -np.inf)
        cuts = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
        first = np.zeros(len(text) + 1, bool)
        first[begin] = True
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.model.model == BPE:
                ok = self._pairs(np.where(first[s], -1, last[s]), p)
            else:
                total = np.where(first[s], 0.0, best[s]) + np.where(p >= 0, self.scores[p], self.scores.min() - 10)
                o = np.lexsort((total, e))
                top = o[np.append(e[o][1:] != e[o][:-1], True)]
                best[e[top]] = total[top]
                ok = np.zeros(len(s), bool)
                ok[top] = True
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        ids, each = self._walk(codes, begin, stop - begin, last, back)
        return ids, np.bincount(np.searchsorted(whole, begin, "right") - 1, each, len(sizes)).astype(np.int64)

    def _walk(self, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, owner, ends, ids = begin + sizes, np.arange(len(begin)), [], []
        owners = []
        while len(owner):
            ends.append(at)
            ids.append(last[at])
            owners.append(owner)
            at = back[at]
            go = at > begin[owner]
            at, owner = at[go], owner[go]
        ends, ids, owners = np.concatenate(ends), np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(ends, kind="stable")
        ends, ids, owners = ends[order], ids[order], owners[order]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            more = [self._bytes(int(text[e - 1])) for e in ends[bare]]
            width = np.ones(len(ids), np.int64)
            width[bare] = [len(m) for m in more]
            where = np.cumsum(width) - width
            out = np.repeat(ids, width)
            for w, m in zip(where[bare], more, strict=True):
                out[w : w + len(m)] = m
            return out.astype(np.int32), np.bincount(owners, width, len(begin)).astype(np.int64)
        return ids.astype(np.int32), np.bincount(owners, minlength=len(begin)).astype(np.int64)

    def _bytes(self, code: int) -> list[int]:
        m = self.model
        return [m.byte_ids[b] for b in chr(code).encode("utf-8", "surrogatepass")] if m.byte_ids else [m.unknown]


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(PieceModel(data))


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: the ids of the pieces, and the text that they decode to."""
    return _encoded(docs, model_file, id_col, text_col, digests=False)


def _encoded(docs: DataFrame, model_file: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_file))
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for lo, hi in parts(bounds, PART):
                ids, ids_at, back, back_at, same = encoder.encode_block(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                key, lists = batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ids_at.astype(np.int32)), pa.array(ids))
                if not digests:
                    decoded = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(back_at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(back))])
                    yield pa.RecordBatch.from_arrays([key, lists, decoded], names=["doc_id", "ids", "decoded"])
                    continue
                sha = [_sha(ids.astype("<i4", copy=False), ids_at), _sha(back, back_at)]
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(ids_at).astype(np.int64)), lists, *sha, pa.array(same)], names=["doc_id", "n_pieces", "ids", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = "n_pieces long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean" if digests else "ids array<int>, decoded string"
    return chosen.mapInArrow(tidy(run), f"doc_id {kind}, {schema}")


def _sha(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = memoryview(np.ascontiguousarray(values))
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def encode_digests(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """(doc_id, n_pieces, ids, ids_sha256 of little-endian 32-bit ids, decoded_sha256, round_trip)."""
    return _encoded(docs, model_file, "doc_id", "text", digests=True)


def op6_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    return encode_digests(table(spark, sf_dir, "documents"))
