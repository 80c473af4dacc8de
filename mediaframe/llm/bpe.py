"""Operator 1: byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .tokens import ByteBPE, grouped, loaded


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns id_col, ids array<int>, offsets array<struct<start,end>> (code points), one row per row of df.

    Null text counts as empty: no ids. Other columns of df, whatever their names, are left out.
    """
    prepare(df.sparkSession)
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBPE, path, pattern)
        for b in batches:
            ids, spans = [], []
            for texts in grouped(t.as_py() for t in b.column(1)):
                for text, own in zip(texts, bpe.encode_many(texts)):
                    ids.append(own.astype("i4"))
                    spans.append([{"start": s, "end": e} for s, e in zip(*map(np.ndarray.tolist, bpe.offsets(own, text)))])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(spans, kinds)], [id_col, "ids", "offsets"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<struct<start:int,end:int>>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns id_col, bytes binary, text string (malformed UTF-8, as of cut ids, becomes U+FFFD). Null ids count as none."""
    prepare(df.sparkSession)
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBPE, path, pattern)
        for b in batches:
            raw = [bpe.decode(x.as_py() or []) for x in b.column(1)]
            text = [x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], [id_col, "bytes", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text in one pass; digests instead of the ids and bytes themselves.

    Columns id_col, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256, n_bytes, offsets_crc32 (of all
    starts and then all ends of the tokens in code points, as little-endian 32-bit numbers).
    One narrow map: no shuffle, a text at a time, nothing kept but the bounded caches. A null text counts as
    empty, a null id stays null, repeated rows give repeated results, other columns are left out.
    """
    prepare(df.sparkSession)
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBPE, path, pattern)
        names = {i: str(i) for i in bpe.bytes_of}
        for b in batches:
            n, ids_sha, text_sha, size, spans = [], [], [], [], []
            for texts in grouped(t.as_py() for t in b.column(1)):
                for text, own in zip(texts, bpe.encode_many(texts)):
                    ids = own.tolist()
                    starts, ends = bpe.offsets(own, text)
                    spans.append(zlib.crc32(ends.astype("<i4"), zlib.crc32(starts.astype("<i4"))))
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    size.append(len(back))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(size, pa.int64()), pa.array(spans, pa.int64())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "offsets_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, offsets_crc32 long")
