"""MessagePack, as much of it as record shards use."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def items(b: memoryview) -> Iterator:
    """The items of a list, one at a time."""
    b = b.cast("B")
    tag = b[0]
    forms = {0xDC: ">H", 0xDD: ">I"}
    if tag not in forms and not 0x90 <= tag < 0xA0:
        raise ValueError("not a list of records")
    n, at = (tag & 15, 1) if tag not in forms else (struct.unpack_from(forms[tag], b, 1)[0], 1 + struct.calcsize(forms[tag]))
    for _ in range(n):
        x, at = _value(b, at)
        yield x


def unpack(raw: bytes):
    """One MessagePack value."""
    return _value(memoryview(raw), 0)[0]


def _value(b: memoryview, at: int):
    tag = b[at]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag < 0x90:
        return _pairs(b, at, tag & 15)
    if tag < 0xA0:
        return _items(b, at, tag & 15)
    if tag < 0xC0:
        return str(b[at : at + (tag & 31)], "utf-8"), at + (tag & 31)
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if tag in numbers:
        size = struct.calcsize(numbers[tag])
        return struct.unpack_from(numbers[tag], b, at)[0], at + size
    sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    if tag not in sizes:
        raise ValueError(f"MessagePack type {tag:#x} isn't supported")
    n = struct.unpack_from(sizes[tag], b, at)[0]
    at += struct.calcsize(sizes[tag])
    if tag in (0xC4, 0xC5, 0xC6):
        return bytes(b[at : at + n]), at + n
    if tag in (0xD9, 0xDA, 0xDB):
        return str(b[at : at + n], "utf-8"), at + n
    return _items(b, at, n) if tag < 0xDE else _pairs(b, at, n)


def _items(b: memoryview, at: int, n: int):
    out = []
    for _ in range(n):
        x, at = _value(b, at)
        out.append(x)
    return out, at


def _pairs(b: memoryview, at: int, n: int):
    flat, at = _items(b, at, 2 * n)
    return dict(zip(flat[::2], flat[1::2], strict=True)), at


def sized(n: int, short: int, limit: int, tags: str) -> bytes:
    """The head of a string, list or map of n parts: short + n up to limit, else a tag for 8 (strings only), 16 or 32 bits."""
    if n <= limit:
        return bytes([short | n])
    for tag, (top, form) in zip(bytes.fromhex(tags), [(0xFF, ">B"), (0xFFFF, ">H"), (0xFFFFFFFF, ">I")][-len(tags) // 2 :], strict=True):
        if n <= top:
            return bytes([tag]) + struct.pack(form, n)
    raise ValueError(f"{n} parts are too many")


def pack(x) -> bytes:
    """One value as MessagePack: None, booleans, numbers, strings, bytes, lists, numpy arrays (f32, u32 or u8) and dicts."""
    if isinstance(x, np.ndarray):
        tag, form = {"f": (0xCA, ">f4"), "u": (0xCE, ">u4") if x.dtype.itemsize > 1 else (0xCC, "u1"), "i": (0xCE, ">u4")}[x.dtype.kind]
        rows = np.empty(len(x), dtype=[("t", "u1"), ("v", form)])
        rows["t"], rows["v"] = tag, x
        return sized(len(x), 0x90, 15, "dcdd") + rows.tobytes()
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if 0 <= x < 0x80:
            return bytes([x])
        return struct.pack(">BQ", 0xCF, x) if x >= 0 else struct.pack(">Bq", 0xD3, x)
    if isinstance(x, float):
        return struct.pack(">Bd", 0xCB, x)
    if isinstance(x, str):
        raw = x.encode()
        return sized(len(raw), 0xA0, 31, "d9dadb") + raw
    if isinstance(x, bytes):
        return sized(len(x), 0, -1, "c4c5c6") + x
    if isinstance(x, dict):
        return sized(len(x), 0x80, 15, "dedf") + b"".join(pack(k) + pack(v) for k, v in x.items())
    return sized(len(x), 0x90, 15, "dcdd") + b"".join(map(pack, x))
