"""Legacy binary workbooks: the OLE2 container and the BIFF8 records of the first sheet, as cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Record numbers, and the marks of sectors that end a chain or are free.
SST, CONTINUE, BOUNDSHEET, XF, PALETTE, BOF, EOF = 0xFC, 0x3C, 0x85, 0xE0, 0x92, 0x809, 0x0A
LABELSST, NUMBER, RK, MULRK, LABEL, FORMULA, STRING = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x207
LAST = 0xFFFFFFFA
FIRST_COLORS = ["000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF"]


def workbook_stream(data: bytes) -> bytes:
    """The workbook's own stream out of the container."""
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_fat = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b)
    tables = [n for n in numbers(data[76:512]) if n < LAST]
    more = struct.unpack_from("<I", data, 68)[0]
    while more < LAST:
        *found, more = numbers(sector(more))
        tables += [n for n in found if n < LAST]
    fat = [n for t in tables for n in numbers(sector(t))]

    def chain(start: int, links: list[int], read) -> bytes:
        out, seen = [], set()
        while start < LAST and start not in seen:
            seen.add(start)
            out.append(read(start))
            start = links[start]
        return b"".join(out)

    entries = chain(directory, fat, sector)
    root, found = None, None
    for at in range(0, len(entries), 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
        start, n = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = (start, n)
        elif kind == 2 and name in ("Workbook", "Book") and found is None:
            found = (start, n)
    if found is None:
        raise ValueError("no workbook in the container")
    start, n = found
    if n >= cutoff:
        return chain(start, fat, sector)[:n]
    mini = chain(root[0], fat, sector)
    links = list(numbers(chain(mini_fat, fat, sector)))
    return chain(start, links, lambda k: mini[k * small : (k + 1) * small])[:n]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Parts:
    """Bytes of a record and its continuations; text that goes on in the next part repeats its width flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if self.at >= len(self.parts[self.k]) and n > 0:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        chars, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while chars > 0:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            here = min(chars, (len(self.parts[self.k]) - self.at) >> wide)
            out.append(self.take(here << wide).decode("utf-16-le" if wide else "latin-1"))
            chars -= here
        self.take(4 * runs + extra)
        return "".join(out)


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def _rk(v: int) -> str:
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & ~3))[0]
    return _number(x / 100 if v & 1 else x)


def stream_cells(stream: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, text, fill) of the first sheet; integral numbers are written without decimals."""
    strings, fills, colors, sheet, parts = [], [], {k + 8: c for k, c in enumerate(FIRST_COLORS)}, None, None
    for kind, body in records(stream):
        if parts is not None and kind != CONTINUE:
            count, reader = struct.unpack_from("<I", parts[0], 4)[0], _Parts([parts[0][8:], *parts[1:]])
            strings, parts = [reader.text() for _ in range(count)], None
        if kind == SST:
            parts = [body]
        elif kind == CONTINUE and parts is not None:
            parts.append(body)
        elif kind == BOUNDSHEET and sheet is None:
            sheet = struct.unpack_from("<I", body)[0]
        elif kind == XF:
            pattern, color = struct.unpack_from("<I", body, 14)[0] >> 26, struct.unpack_from("<H", body, 18)[0] & 127
            fills.append(color if pattern else None)
        elif kind == PALETTE:
            colors |= {8 + k: body[2 + 4 * k : 5 + 4 * k].hex().upper() for k in range(struct.unpack_from("<H", body)[0])}
        elif kind == EOF:
            break
    fill = lambda xf: "FF" + colors[fills[xf]] if xf < len(fills) and fills[xf] in colors else ""
    waiting = None
    for kind, body in records(stream, sheet or 0):
        if kind == EOF:
            return
        if kind == STRING and waiting:
            row, col, xf = waiting
            yield row + 1, col + 1, _Parts([body]).text(), fill(xf)
            waiting = None
        if kind not in (LABELSST, NUMBER, RK, MULRK, LABEL, FORMULA):
            continue
        row, col, xf = struct.unpack_from("<HHH", body)
        if kind == MULRK:
            for k in range((len(body) - 6) // 6):
                xf, v = struct.unpack_from("<HI", body, 4 + 6 * k)
                yield row + 1, col + k + 1, _rk(v), fill(xf)
            continue
        if kind == FORMULA and body[12:14] == b"\xff\xff":
            waiting = (row, col, xf) if body[6] == 0 else None
            continue
        if kind == LABELSST:
            text = strings[struct.unpack_from("<I", body, 6)[0]]
        elif kind == RK:
            text = _rk(struct.unpack_from("<I", body, 6)[0])
        elif kind == LABEL:
            text = _Parts([body[6:]]).text()
        else:
            text = _number(struct.unpack_from("<d", body, 6)[0])
        if text.strip():
            yield row + 1, col + 1, text.strip(), fill(xf)


def biff_cells(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    return stream_cells(workbook_stream(data))
