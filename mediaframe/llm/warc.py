"""Operator 4: WARC records in ZIP packages that are read without extraction.

A package is a ZIP file with ZIP64 records whose members are stored, not compressed: `archive/data.warc.gz`, one gzip
member per WARC record, and `indexes/index.cdxj`, one line per record with its place in the archive member. The
reader takes the end of the file, parses the central directory, and from then on reads ranges only.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fs, new_path, prepare, written

#: Payloads under this many bytes are never deduplicated.
LEAST_BYTES = 100
#: A package is closed when its archive has this many bytes.
PACKAGE_BYTES = 64 << 20
#: Groups of equal payloads up to which they are broadcast; more are joined by a shuffle with salted keys.
BROADCAST_GROUPS = 50_000
SALTS = 32

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

# Fixed values of the ZIP format: signatures and layouts (application note 6.3).
LOCAL, CENTRAL, END64, LOCATOR64, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
_LOCAL, _CENTRAL, _END64, _LOCATOR64, _END = "<4s5H3I2H", "<4s6H3I5H2I", "<4sQ2H2I4Q", "<4sIQI", "<4s4H2IH"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members one after the other into a stream, ZIP64 throughout, so that no size need be known ahead."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        # bit 3: sizes and checksum follow the data; bit 11: the name is UTF-8
        self._put(struct.pack(_LOCAL, LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        self.start = self.at

    def write(self, data: bytes) -> int:
        """Adds to the member; the place of data within it."""
        m, place = self.members[-1], self.at - self.start
        m[2] = zlib.crc32(data, m[2])
        m[3] += len(data)
        self._put(data)
        return place

    def end(self) -> None:
        m = self.members[-1]
        self._put(b"PK\x07\x08" + struct.pack("<I2Q", m[2], m[3], m[3]))

    def close(self) -> None:
        begun = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self._put(struct.pack(_CENTRAL, CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, n = self.at - begun, len(self.members)
        end64 = self.at
        self._put(struct.pack(_END64, END64, 44, 45, 45, 0, 0, n, n, size, begun))
        self._put(struct.pack(_LOCATOR64, LOCATOR64, 0, end64, 1))
        self._put(struct.pack(_END, END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


class ZipReader:
    """Members of a ZIP file by name, from read_at(offset, length) and the file's size alone."""

    def __init__(self, read_at, size: int) -> None:
        self.read_at = read_at
        tail_at = max(0, size - 22 - FULL16 - 20)
        tail = read_at(tail_at, size - tail_at)
        k = tail.rfind(END)
        while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] > len(tail)):
            k = tail.rfind(END, 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        *_, n, length, at, _ = struct.unpack_from(_END, tail, k)
        if FULL16 == n or FULL32 in (length, at):
            if k < 20 or tail[k - 20 : k - 16] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = read_at(struct.unpack_from(_LOCATOR64, tail, k - 20)[2], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            *_, n, length, at = struct.unpack(_END64, record)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        data, p = read_at(at, length), 0
        for _ in range(n):
            if data[p : p + 4] != CENTRAL:
                raise ValueError("bad central directory")
            _, _, _, flags, method, _, _, crc, packed, plain, name, extra, comment, _, _, _, offset = struct.unpack_from(_CENTRAL, data, p)
            raw, fields = data[p + 46 : p + 46 + name], data[p + 46 + name : p + 46 + name + extra]
            wide = iter(struct.unpack(f"<{len(x) // 8}Q", x[: len(x) // 8 * 8]) if (x := self._extra(fields)) else ())
            plain, packed, offset = (next(wide) if v == FULL32 else v for v in (plain, packed, offset))
            self.members[raw.decode("utf-8" if flags & 0x800 else "cp437")] = (method, offset, packed, crc)
            p += 46 + name + extra + comment

    @staticmethod
    def _extra(fields: bytes) -> bytes:
        p = 0
        while p + 4 <= len(fields):
            kind, size = struct.unpack_from("<2H", fields, p)
            if kind == 1:
                return fields[p + 4 : p + 4 + size]
            p += 4 + size
        return b""

    def locate(self, name: str) -> tuple[int, int]:
        """Offset in the file and length of a stored member's data."""
        method, offset, size, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        head = self.read_at(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        name_len, extra_len = struct.unpack_from("<2H", head, 26)
        return offset + 30 + name_len + extra_len, size


def record(kind: str, page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A WARC/1.1 record, uncompressed: a response with its payload, or a revisit with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {clean}')}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with __payload (null as empty), __digest and __first: the id of the response that a row revisits, or null.

    Of equal payloads of LEAST_BYTES and more, rows with the smallest id are responses, also if several rows have
    it; a row with a null id revisits if any equal row has an id. Only groups of two and more ids are gathered, as
    digests and ids; payloads are not shuffled unless there are more than BROADCAST_GROUPS such groups.
    """
    p = pages.withColumn("__payload", F.coalesce(payload_col, F.lit(""))).withColumn("__digest", F.sha2(F.col("__payload"), 256))
    large = p.where(F.octet_length("__payload") >= LEAST_BYTES)
    groups = large.groupBy("__digest").agg(F.min(id_col).alias("__least"), F.max(id_col).alias("__most"), F.count("*").alias("n"), F.count(id_col).alias("ids"))
    groups, _ = written(groups.where("__least < __most OR (ids > 0 AND ids < n)").select("__digest", "__least"), "equal-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        joined = p.join(F.broadcast(groups), "__digest", "left")
    else:
        salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = p.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["__digest", "__salt"], "left").drop("__salt")
    small = F.octet_length("__payload") < LEAST_BYTES
    return joined.withColumn("__first", F.when(~small & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__least"))), F.col("__least"))).drop("__least")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes packages into folder and returns their manifest (path, size, records), itself a table in the folder.

    Each task writes files of its own name, with the attempt in it; the manifest has those of the attempts that
    Spark committed, so a lost executor leaves at most files that nobody reads.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = arrow_fs(folder)
        task = TaskContext.get()
        fs.create_dir(f"{base}/packages", recursive=True)
        state = {"zip": None, "n": 0}

        def opened() -> ZipWriter:
            state["path"] = f"packages/{task.partitionId():06d}-{task.taskAttemptId()}-{state['n']:04d}.wacz"
            state["n"] += 1
            state["out"] = fs.open_output_stream(f"{base}/{state['path']}")
            state["zip"], state["lines"] = ZipWriter(state["out"]), []
            state["zip"].begin(ARCHIVE)
            return state["zip"]

        def closed() -> pa.RecordBatch:
            z = state["zip"]
            z.end()
            z.begin(INDEX)
            z.write("".join(state["lines"]).encode())
            z.end()
            z.close()
            state["out"].close()
            state["zip"] = None
            return pa.RecordBatch.from_arrays([pa.array([state["path"]]), pa.array([z.at], pa.int64()), pa.array([len(state["lines"])], pa.int64())], ["path", "size", "records"])

        for b in batches:
            for page, url, payload, digest, first in zip(*(b.column(k) for k in range(5))):
                page, url, raw, first = page.as_py(), url.as_py() or "", payload.as_py().encode(), first.as_py()
                kind = "response" if first is None else "revisit"
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = deflate.compress(record(kind, page, url, raw, digest.as_py(), first)) + deflate.flush()
                z = state["zip"] or opened()
                at = z.write(packed)
                state["lines"].append(json.dumps({"page": page, "url": url, "offset": at, "length": len(packed), "digest": f"sha256:{digest.as_py()}", "type": kind}) + "\n")
                if at + len(packed) >= PACKAGE_BYTES:
                    yield closed()
        if state["zip"]:
            yield closed()

    marked = mark_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    made = marked.select(id_col, url_col, "__payload", "__digest", "__first").mapInArrow(run, "path string, size long, records long")
    made.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, size long, records long").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of all records of the packages in folder's manifest.

    Of each package the directory and the index are read, then each record by its range. The length and digest of a
    response are taken from its payload, which must agree with its head; a revisit has those of its head, and no payload.
    """
    prepare(spark)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs(folder)
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{path}") as f:

                    def read_at(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    z = ZipReader(read_at, size)
                    start, _ = z.locate(ARCHIVE)
                    index = read_at(*z.locate(INDEX)).decode().splitlines()
                    rows, held = [], 0
                    for line in map(json.loads, index):
                        fields, block = parse_record(zlib.decompress(read_at(start + line["offset"], line["length"]), 31))
                        kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: payload of {line['url']} differs from its record")
                        page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], kind, n, digest, int(to) if to else None, payload)[: len(names)])
                        held += n
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    manifest = spark.read.schema("path string, size long, records long").parquet(f"{folder}/manifest")
    dealt = manifest.select("path", "size").repartition(max(1, manifest.count()))  # a package a task; without a key, so evenly
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return dealt.mapInArrow(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) into packages in the shared folder and reads them back, without payloads."""
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder, with_payload=False)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS least FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
