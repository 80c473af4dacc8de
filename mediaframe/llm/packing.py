"""Operator 6: harmonic packing of tokenised documents into sequences of a fixed size."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .tokens import WordBPE, grouped, loaded

CAPACITY = 4096
#: A sequence with less room than this is full: the rest is padding, under one per cent of a sequence.
LEAST_ROOM = 32


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths that a document of total tokens comes in: whole if it fits a sequence, else full sequences and the rest."""
    return [capacity] * (total // capacity) + [total % capacity] * (total % capacity > 0)


class Harmonic:
    """Bins of one worker. A document of n tokens is in class capacity // n; a bin of class j takes j documents of it.

    A bin that has its count is at least j / (j + 1) full. What room it has left is for later documents: one that fits
    goes there whole, and one that fits no single room, but all of them together, is cut over them, the largest first. So only
    such documents are cut. Rooms together are smaller than a document, so bins with room are few, and what stands in them
    and in open bins at the end is poured one after the other into sequences, cut where one is full; the last of
    these is cut into powers of two, so that it needs no padding.
    """

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        #: (room, number, pieces) of bins with their count, by room
        self.rooms: list[tuple[int, int, list[tuple]]] = []
        self.space = self.made = 0

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (document, start, length, ids, doc_tokens). Rows (…, sequence_id, offset) of the bins that are full now."""
        n = piece[2]
        k = bisect_left(self.rooms, (n,))
        if k < len(self.rooms):
            return self._fill(k, piece)
        if self.space >= n:
            doc, start, _, ids, of = piece
            out, done = [], 0
            while done < n:
                take = min(self.rooms[-1][0], n - done)
                out += self._fill(len(self.rooms) - 1, (doc, start + done, take, ids[done : done + take], of))
                done += take
            return out
        j = self.capacity // n
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        return self._counted(self.open.pop(j)) if len(bin_) == j else []

    def _fill(self, k: int, piece: tuple) -> list[tuple]:
        room, _, pieces = self.rooms.pop(k)
        self.space -= room
        pieces.append(piece)
        return self._counted(pieces)

    def _counted(self, pieces: list[tuple]) -> list[tuple]:
        room = self.capacity - sum(p[2] for p in pieces)
        if room < LEAST_ROOM:
            return self._close(pieces)
        self.made += 1
        insort(self.rooms, (room, self.made, pieces))
        self.space += room
        return []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at, seq = [], 0, self.next_id
        self.next_id += 1
        for p in pieces:
            out.append((*p, seq, at))
            at += p[2]
        return out

    def finish(self) -> Iterator[tuple]:
        left = [p for _, _, own in self.rooms for p in own] + [p for j in sorted(self.open) for p in self.open[j]]
        self.open, self.rooms, self.space = {}, [], 0
        rest, size, now = sum(p[2] for p in left), self.capacity, []
        while rest and size > rest:
            size //= 2
        room = size
        for doc, start, length, ids, of in left:
            done = 0
            while done < length:
                take = min(room, length - done)
                now.append((doc, start + done, take, ids[done : done + take], of))
                done, room, rest = done + take, room - take, rest - take
                if not room:
                    yield from self._close(now)
                    now = []
                    while rest and size > rest:
                        size //= 2
                    room = size


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids array<int>, if asked for).

    Each worker packs its own partition in one pass: no shuffle, and a bin holds a fixed count of documents, so the
    open bins of all classes are bounded. A document of any length is packed; one that is longer than a sequence fills
    sequences of its own first. Other columns of df, whatever their names, are left out; an empty table gives no rows. sequence_id has the partition in its upper bits. A null text is an empty
    document, which still has the end id; a null id stays null; repeated rows are packed each.
    """
    prepare(df.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = loaded(WordBPE, path)
        bins = Harmonic(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([end_id], "<u4")

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(cols[0], kind_pa), *(pa.array(cols[k], pa.int64()) for k in (1, 2))]
            arrays += [pa.array([zlib.crc32(x) for x in cols[3]], pa.int64()), *(pa.array(cols[k], pa.int64()) for k in (4, 5, 6))]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[3]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        kind_pa, rows = None, []
        for b in batches:
            kind_pa = b.schema.field(0).type
            docs = iter(b.column(0).to_pylist())
            for texts in grouped(t.as_py() for t in b.column(1)):
                for doc, own in zip(islice(docs, len(texts)), bpe.encode_many(texts), strict=True):
                    ids, start = np.concatenate([own, end]), 0
                    for n in cuts(len(ids), capacity):
                        rows += bins.add((doc, start, n, ids[start : start + n], len(ids)))
                        start += n
                if len(rows) > 5000:
                    yield out(rows)
                    rows = []
        if kind_pa is not None:
            rows += bins.finish()
            yield out(rows)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return df.select(id_col, text_col).mapInArrow(run, schema)
