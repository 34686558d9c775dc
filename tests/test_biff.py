"""Binary workbooks made here, in both kinds of container storage."""

import struct

import pytest

from orderweave.sources import biff, sheet


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def text(t, wide=True):
    return struct.pack("<HB", len(t), int(wide)) + t.encode("utf-16-le" if wide else "latin-1")


def stream(pad=0):
    first, second = text("Комод"), text("plain", wide=False)
    long = "д" * 10
    cut = text(long)[:9]  # three characters, the rest goes on in the next record
    sst = record(biff.SST, struct.pack("<II", 3, 3) + first + second + cut) + record(biff.CONTINUE, b"\x01" + long[3:].encode("utf-16-le"))
    xfs = record(biff.XF, bytes(20)) + record(biff.XF, bytes(14) + struct.pack("<IH", 1 << 26, 10) + b"")
    palette = record(biff.PALETTE, struct.pack("<H", 3) + bytes.fromhex("00000000" "FFFFFF00" "E0FFE000"))
    cell = lambda kind, r, c, xf, body: record(kind, struct.pack("<HHH", r, c, xf) + body)
    rows = cell(biff.LABELSST, 0, 0, 1, struct.pack("<I", 0)) + cell(biff.LABELSST, 0, 1, 0, struct.pack("<I", 1)) + cell(biff.LABELSST, 0, 2, 0, struct.pack("<I", 2))
    rows += cell(biff.NUMBER, 1, 0, 0, struct.pack("<d", 12.0)) + cell(biff.NUMBER, 1, 1, 0, struct.pack("<d", 1.5)) + cell(biff.RK, 1, 2, 0, struct.pack("<I", 7 << 2 | 2)) + cell(biff.RK, 1, 3, 0, struct.pack("<I", 150 << 2 | 3))
    rows += record(biff.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, 5 << 2 | 2) + struct.pack("<HI", 0, 6 << 2 | 2) + struct.pack("<H", 1))
    rows += cell(biff.FORMULA, 3, 0, 0, b"\0" * 6 + b"\xff\xff" + bytes(8)) + record(biff.STRING, text("sum"))
    head = record(biff.BOF, bytes(16))
    globals_ = lambda at: head + xfs + palette + record(biff.BOUNDSHEET, struct.pack("<I", at) + bytes(4)) + sst + record(biff.EOF, b"")
    at = len(globals_(0))
    return globals_(at) + head + rows + record(biff.EOF, b"") + bytes(pad)


def container(data, mini):
    size, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    body = [b""]  # sector 0 is the allocation table
    fat = {0: 0xFFFFFFFD}

    def put(raw):
        start = len(body)
        parts = [raw[i : i + size].ljust(size, b"\0") for i in range(0, len(raw), size)]
        for k, p in enumerate(parts):
            fat[len(body)] = len(body) + 1 if k < len(parts) - 1 else end
            body.append(p)
        return start

    mini_fat = end
    if mini:
        n = -(-len(data) // 64)
        root = put(data.ljust(n * 64, b"\0"))
        mini_fat = put(struct.pack(f"<{n}I", *range(1, n), end).ljust(size, b"\xff"))
        own, total = 0, n * 64
    else:
        root, total, own = end, 0, put(data)
    name = lambda s: s.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(s) + 2)
    entry = lambda s, kind, start, n: (name(s) + bytes([kind]) + bytes(49) + struct.pack("<II", start, n) + bytes(4)).ljust(128, b"\0")
    directory = put(entry("Root Entry", 5, root, total) + entry("Workbook", 2, own, len(data)))
    body[0] = struct.pack("<128I", *(fat.get(i, free) for i in range(128)))
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 48, directory)
    struct.pack_into("<IIIII", head, 56, 4096, mini_fat, int(mini), end, 0)
    struct.pack_into("<109I", head, 76, 0, *[free] * 108)
    return bytes(head) + b"".join(body)


@pytest.mark.parametrize("mini", [True, False])
def test_cells(mini):
    data = container(stream(0 if mini else 6000), mini)
    assert sheet.kind_of(data) == "xls"
    assert list(sheet.cells(data, "a.xls")) == [
        (1, 1, "Комод", "FFE0FFE0"), (1, 2, "plain", ""), (1, 3, "д" * 10, ""), (2, 1, "12", ""), (2, 2, "1.5", ""), (2, 3, "7", ""), (2, 4, "1.5", ""), (3, 1, "5", ""), (3, 2, "6", ""), (4, 1, "sum", ""),
    ]


def test_no_workbook():
    data = bytearray(container(stream(), True))
    at = bytes(data).index("Workbook".encode("utf-16-le"))
    data[at : at + 2] = b"X\0"
    with pytest.raises(ValueError):
        list(biff.biff_cells(bytes(data)))
