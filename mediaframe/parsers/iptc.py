"""Photoshop resources and IIM datasets."""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

from . import Malformed, need


class Resource(NamedTuple):
    number: int
    name: bytes
    data: bytes


class Dataset(NamedTuple):
    record: int
    dataset: int
    data: bytes
    whole: bytes


def resources(data: bytes, strict: bool = False) -> list[Resource]:
    """8BIM resources; lenient reading stops at the first misfit."""
    out, at = [], 0
    try:
        while at < len(data):
            if need(data, at, 4) != b"8BIM":
                raise Malformed("no 8BIM")
            number = struct.unpack(">H", need(data, at + 4, 2))[0]
            n = need(data, at + 6, 1)[0]
            name = need(data, at + 7, n)
            at += 7 + n + (n + 1) % 2
            size = struct.unpack(">I", need(data, at, 4))[0]
            out.append(Resource(number, name, need(data, at + 4, size)))
            at += 4 + size + size % 2
    except Malformed:
        if strict:
            raise
    return out


def write_resources(parts: list[Resource]) -> bytes:
    out = []
    for r in parts:
        name = bytes([len(r.name)]) + r.name
        out.append(b"8BIM" + struct.pack(">H", r.number) + name + b"\0" * (len(name) % 2) + struct.pack(">I", len(r.data)) + r.data + b"\0" * (len(r.data) % 2))
    return b"".join(out)


def datasets(data: bytes, strict: bool = True) -> list[Dataset]:
    """IIM datasets; a length with its top bit set gives the size of the length that follows."""
    out, at = [], 0
    try:
        while at < len(data):
            head = need(data, at, 5)
            if head[0] != 0x1C:
                raise Malformed("no dataset mark")
            size, start = struct.unpack(">H", head[3:])[0], at + 5
            if size & 0x8000:
                n = size & 0x7FFF
                if n > 8:
                    raise Malformed("length too long")
                size, start = int.from_bytes(need(data, start, n), "big"), start + n
            body = need(data, start, size)
            out.append(Dataset(head[1], head[2], body, data[at : start + size]))
            at = start + size
    except Malformed:
        if strict:
            raise
    return out


IIM, DIGEST = 0x0404, 0x0425


def filtered(data: bytes, keeps_resource, keeps_dataset) -> bytes:
    """Resources that stay, with the datasets that stay; the digest follows the data only if it matched before, and goes with it."""
    own = resources(data)
    iim = next((r for r in own if r.number == IIM), None)
    matched = iim is not None and any(r.number == DIGEST and r.data == hashlib.md5(iim.data).digest() for r in own)
    new = None
    if iim is not None and keeps_resource(IIM):
        try:
            new = b"".join(d.whole for d in datasets(iim.data) if keeps_dataset(d.record, d.dataset))
        except Malformed:
            new = None
    out = []
    for r in own:
        if r.number == IIM:
            if new:
                out.append(r._replace(data=new))
        elif r.number == DIGEST:
            if new and keeps_resource(DIGEST):
                out.append(r._replace(data=hashlib.md5(new).digest()) if matched else r)
        elif keeps_resource(r.number):
            out.append(r)
    return write_resources(out)
