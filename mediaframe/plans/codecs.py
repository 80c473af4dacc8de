"""Codec slots: functions bytes → bytes or None (nothing better). Native tools are used where they are installed; none is bundled."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scalars import INFLATE_LIMIT, inflate_exact
from ..operators.tables import prepare
from ..parsers import png

TOOL_SECONDS = 3600


class QualityChooser(Protocol):
    """An extension that chooses the one lossy step of a file."""

    formats: frozenset[str]
    other_formats_lossless: bool

    def choose(self, data: bytes, encode: Callable[[bytes, int], bytes | None]) -> bytes | None: ...

    def verify(self, original: bytes, result: bytes) -> bool: ...


def redeflate_png(data: bytes) -> bytes | None:
    """The same PNG with its image data in one IDAT, deflated at the best level by each strategy; None if that is not smaller."""
    parts = png.chunks(data, strict=True)
    body = b"".join(c.data for c in parts if c.kind == "IDAT")
    pixels = inflate_exact(body, INFLATE_LIMIT)
    if pixels is None:
        return None
    packed = []
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE):
        c = zlib.compressobj(9, zlib.DEFLATED, 15, 9, strategy)
        packed.append(c.compress(pixels) + c.flush())
    out, placed = [], False
    for c in parts:
        if c.kind != "IDAT":
            out.append((c.kind, c.data))
        elif not placed:
            out.append(("IDAT", min(packed, key=len)))
            placed = True
    result = png.write(out)
    return result if len(result) < len(data) else None


def tool(name: str, arguments: Callable[[str, str], list[str]], suffix: str, seconds: int = TOOL_SECONDS) -> Callable[[bytes], bytes | None]:
    """A native program as a codec. Raises FileNotFoundError where it is not installed; a run over the time limit is killed."""

    def run(data: bytes) -> bytes | None:
        path = shutil.which(name)
        if path is None:
            raise FileNotFoundError(name)
        with tempfile.TemporaryDirectory() as d:
            source, target = Path(d, f"in{suffix}"), Path(d, f"out{suffix}")
            source.write_bytes(data)
            done = subprocess.run([path, *arguments(str(source), str(target))], capture_output=True, timeout=seconds, check=False)
            return target.read_bytes() if done.returncode == 0 and target.exists() else None

    return run


#: Slots by candidate name. Missing ones are reported as `unavailable`.
SLOTS: dict[str, Callable[[bytes], bytes | None]] = {
    "redeflate": redeflate_png,
    **{f"oxipng-{k}": tool("oxipng", lambda a, b, k=k: ["-o", k, "--out", b, a], ".png") for k in ("2", "4", "6", "max")},
    "cwebp": tool("cwebp", lambda a, b: ["-lossless", "-z", "9", "-exact", a, "-o", b], ".webp"),
}


def run_codec(df: DataFrame, name: str, keys: list[str], column: str = "content", slots: dict | None = None) -> DataFrame:
    """(keys…, name, status, size, result): status is smaller, nothing, failed or unavailable. One narrow map; results stay beside their keys."""
    prepare(df.sparkSession)
    codec = (slots or SLOTS).get(name)

    def run(batches):
        for b in batches:
            status, results = [], []
            for v in b.column(len(keys)):
                out = None
                try:
                    if codec is None:
                        status.append("unavailable")
                    else:
                        out = codec(v.as_py()) if v.as_py() is not None else None
                        status.append("smaller" if out is not None else "nothing")
                except FileNotFoundError:
                    status.append("unavailable")
                except (ValueError, subprocess.TimeoutExpired):
                    status.append("failed")
                results.append(out)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(keys))), pa.array([name] * b.num_rows), pa.array(status), pa.array([None if r is None else len(r) for r in results], pa.int64()), pa.array(results, pa.binary())],
                [*keys, "name", "status", "size", "result"],
            )

    own = df.select(*keys, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", name string, status string, size long, result binary"
    return own.mapInArrow(run, schema)
