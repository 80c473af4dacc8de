"""Operator 7: size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. Runs of shards of one size tier are merged into a shard of the next, until
files reach the target size. A version of the table is a manifest: a list of shards. It is committed by creating its
file, which only one writer can do; a reader takes the last version, or an older one that is kept, and sees that and
nothing else.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_fs, drop_path, new_path, prepare, written

#: Bytes that a finished shard has at least, of which a small shard has 1 / FAN ** k in tier k.
TARGET_BYTES = 64 << 20
#: Shards of a tier that are merged into one.
FAN = 4
#: Bytes of text after which an arrival's task begins a new shard.
ARRIVAL_BYTES = 4 << 20
#: Rows that are copied at a time.
BATCH_ROWS = 2000
#: Shards of a tier that are planned together.
GROUP_SHARDS = 2000
#: Bytes of shards that a reading task takes.
READ_BYTES = 32 << 20
#: Files of a list at most.
LIST_FILES = 16
#: Versions that a vacuum keeps, and the age under which it never deletes a shard, as its commit may still come.
KEEP_VERSIONS, GRACE_SECONDS = 3, 24 * 3600


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardTable:
    """A table of shards in a folder that driver and executors share.

    Below the folder: `shards/` has the shards, `lists/` the shards of each version as Parquet rows (name, rows, bytes),
    and `manifests/v<number>.json` names the list of a version. Lists are made, joined and read by tasks; the driver
    holds no row per shard. A commit renames a draft onto the manifest's name, which fails where that exists: atomic
    on file systems whose rename is (HDFS, local), not on plain object stores, which need a lock of their own.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        """The committed versions that are still there, the last one last."""
        p, fs = _hadoop(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n.endswith(".json") and n.startswith("v"))

    def version(self) -> int:
        """The last committed version; 0 of an empty table."""
        return max(self.versions(), default=0)

    def _list(self, version: int) -> str:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/v{version:08d}.json", wholetext=True).first()[0])["list"]

    def manifest(self, version: int | None = None) -> DataFrame:
        """(name, rows, bytes): the shards of a version, the last one if None."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _SHARD)
        return self.spark.read.schema(_SHARD).parquet(f"{self.folder}/lists/{self._list(version)}")

    def _listed(self, shards: DataFrame) -> str:
        """Writes a list of shards; its name."""
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.folder}/lists/{name}")
        return name

    def commit(self, based_on: int, shards: DataFrame) -> int:
        """Version based_on + 1. The manifest is written under another name and renamed, which fails if the version is there."""
        made = based_on + 1
        p, fs = _hadoop(self.spark, f"{self.folder}/manifests/v{made:08d}.json")
        if fs.exists(p):
            raise Conflict(f"version {made} exists")
        name = self._listed(shards.coalesce(LIST_FILES))
        draft, _ = _hadoop(self.spark, f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps({"version": made, "list": name}).encode())
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            drop_path(self.spark, f"{self.folder}/lists/{name}")
            raise Conflict(f"version {made} exists")
        return made

    def append(self, rows: DataFrame, arrival_bytes: int = ARRIVAL_BYTES) -> int:
        """Rows as new small shards, one or more per task, and a version that has them too. No row is shuffled."""
        prepare(self.spark)
        begun = time.time()
        return self._commit_new(rows.mapInArrow(_writer(self.folder, rows, arrival_bytes), _SHARD), None, begun)

    def _commit_new(self, made: DataFrame, replaced: DataFrame | None, begun: float) -> int:
        """Runs the tasks of `made`, whose rows are shards, once, and commits them in place of those replaced; again from the newest version on conflict.

        Work that took longer than half of GRACE_SECONDS is not committed, so that no vacuum can have deleted its shards.
        """
        fresh = f"{self.folder}/lists/{self._listed(made)}"
        found = self.spark.read.schema(_SHARD).parquet(fresh)
        gone = replaced.select("name") if replaced is not None else self.spark.createDataFrame([], "name string")
        want = gone.count()
        try:
            while True:
                base = self.version()
                old = self.manifest(base)
                if want and old.join(gone, "name", "left_semi").count() < want:
                    raise Conflict("a shard to be replaced is gone")
                if time.time() - begun > GRACE_SECONDS / 2:
                    raise Conflict("too slow: a vacuum may have deleted the new shards")
                try:
                    return self.commit(base, (old.join(gone, "name", "left_anti") if want else old).unionByName(found))
                except Conflict:
                    continue
        finally:
            drop_path(self.spark, fresh)

    def plan(self, target: int = TARGET_BYTES, fan: int = FAN) -> DataFrame:
        """(run, name, bytes): runs of the last version that are due, `fan` or more shards of one tier under the target, merged up to the target.

        The shards of a tier are dealt into groups of about GROUP_SHARDS by a hash of their names, and each group is planned by itself.
        """
        import pandas as pd

        small = self.manifest().where(f"bytes < {target}").withColumn("tier", tier_column(F.col("bytes"), target, fan))
        counts = small.groupBy("tier").agg(F.ceil(F.count("*") / GROUP_SHARDS).alias("groups"))
        dealt = small.join(F.broadcast(counts), "tier").withColumn("grp", F.pmod(F.xxhash64("name"), F.col("groups")))  # a row per tier

        def runs(own: pd.DataFrame) -> pd.DataFrame:
            own, now, size, out = own.sort_values(["bytes", "name"]), [], 0, []
            for name, n in zip(own["name"], own["bytes"]):
                now.append((name, n))
                size += n
                if len(now) >= fan and size >= target or len(now) == fan * fan:
                    out.append(now)
                    now, size = [], 0
            if len(now) >= fan:
                out.append(now)
            return pd.DataFrame([(run[0][0], name, n) for run in out for name, n in run], columns=["run", "name", "bytes"])

        return dealt.groupBy("tier", "grp").applyInPandas(runs, "run string, name string, bytes long")

    def compact(self, target: int = TARGET_BYTES, fan: int = FAN, own: bool = False) -> int:
        """Merges until no run is due; a task merges one run, row group by row group, and each step is a version. The number of steps.

        own: nobody else writes or reads this table, so what a step has merged is deleted at once.
        """
        prepare(self.spark)
        steps = 0
        while True:
            begun = time.time()
            runs, path = written(self.plan(target, fan), "runs")
            due = runs.groupBy("run").agg(F.sort_array(F.collect_list("name")).alias("names"))  # at most fan * fan names
            tasks = due.count()
            if tasks:
                self._commit_new(due.repartition(tasks).mapInArrow(_merger(self.folder), _SHARD), runs, begun)
                steps += 1
                if own:
                    self.vacuum(keep=1, grace=0)
            drop_path(self.spark, path)
            if not tasks:
                return steps

    def vacuum(self, keep: int = KEEP_VERSIONS, grace: float = GRACE_SECONDS) -> int:
        """Drops all but the last `keep` versions, and deletes the shards that none of these names and that are older than `grace` seconds. The number of shards deleted.

        A younger shard may belong to a commit that another writer has yet to make. With a grace of 0 nobody else may write or read.
        """
        alive, dropped = self.versions()[-keep:], self.versions()[:-keep]
        lists = {self._list(v) for v in alive}
        for v in dropped:
            drop_path(self.spark, f"{self.folder}/manifests/v{v:08d}.json")
        p, fs = _hadoop(self.spark, f"{self.folder}/shards")
        if not alive or not fs.exists(p):
            return 0
        mark, _ = _hadoop(self.spark, f"{self.folder}/manifests/now-{uuid.uuid4().hex}")  # the clock of the file system, not of this machine
        fs.create(mark, False).close()
        bound = fs.getFileStatus(mark).getModificationTime() - grace * 1000
        fs.delete(mark, False)
        lp, _ = _hadoop(self.spark, f"{self.folder}/lists")
        for s in fs.listStatus(lp):
            if s.getPath().getName() not in lists and (not grace or s.getModificationTime() < bound):
                fs.delete(s.getPath(), True)
        named = self.spark.read.schema(_SHARD).parquet(*[f"{self.folder}/lists/{x}" for x in lists]).select("name").distinct()
        folder = self.folder
        buckets = self.spark.createDataFrame([(f"{k:02x}",) for k in range(256)], "bucket string")

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs as pfs

            store, base = arrow_fs(folder)
            for b in batches:
                for bucket in b.column(0).to_pylist():
                    infos = store.get_file_info(pfs.FileSelector(f"{base}/shards/{bucket}", allow_not_found=True))
                    old = [f"{bucket}/{i.base_name}" for i in infos if not grace or (i.mtime and i.mtime.timestamp() * 1000 < bound)]
                    yield pa.RecordBatch.from_arrays([pa.array(old, pa.string())], ["name"])

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = arrow_fs(folder)
            for b in batches:
                for name in b.column(0).to_pylist():
                    if store.get_file_info(f"{base}/shards/{name}").type.name == "File":
                        store.delete_file(f"{base}/shards/{name}")
                yield b

        dead = buckets.repartition(LIST_FILES).mapInArrow(listed, "name string").join(named, "name", "left_anti")
        return dead.mapInArrow(delete, "name string").count()

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of a version, with the column shard. Tasks take shards from the list by themselves, about READ_BYTES each; the driver never sees their names."""
        prepare(self.spark)
        schema = self.spark.createDataFrame([], schema).schema
        shards = self.manifest(version)
        total = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        names, folder = [f.name for f in schema.fields], self.folder
        out = StructType([*schema.fields, StructField("shard", StringType())])
        kinds = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = arrow_fs(folder)
            for b in batches:
                for name in b.column(0).to_pylist():
                    with pq.ParquetFile(f"{base}/shards/{name}", filesystem=store) as f:
                        for part in f.iter_batches(BATCH_ROWS, columns=names):
                            cols = [part.column(n).cast(kinds.field(n).type) for n in names]
                            yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * part.num_rows, pa.string())], [*names, "shard"])

        return shards.select("name").repartition(max(1, -(-total // READ_BYTES))).mapInArrow(run, out)


_SHARD = "name string, rows long, bytes long"


def tier(size: int, target: int = TARGET_BYTES, fan: int = FAN) -> int:
    """0 just under the target, and one more for each factor of fan below it."""
    k, bound = 0, target / fan
    while size < bound:
        k, bound = k + 1, bound / fan
    return k


def tier_column(size, target: int, fan: int):
    out, k, bound = F.lit(0), 0, target / fan
    while bound >= 1:
        k += 1
        out = F.when(size < bound, k).otherwise(out)
        bound /= fan
    return out


def _shard_row(name: str, rows: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["name", "rows", "bytes"])


class _Shard:
    """A shard that is being written. Its name is new for each attempt; only a manifest makes it part of the table."""

    def __init__(self, folder: str, schema: pa.Schema) -> None:
        self.fs, base = arrow_fs(folder)
        own = uuid.uuid4().hex
        # 256 folders, so that a listing of one stays short
        self.fs.create_dir(f"{base}/shards/{own[:2]}", recursive=True)
        self.name = f"{own[:2]}/{own}.parquet"
        self.path, self.rows = f"{base}/shards/{self.name}", 0
        self.writer = pq.ParquetWriter(self.path, schema, filesystem=self.fs, compression="zstd")

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)
        self.rows += batch.num_rows

    def close(self) -> pa.RecordBatch:
        self.writer.close()
        return _shard_row(self.name, self.rows, self.fs.get_file_info(self.path).size)


def _writer(folder: str, rows: DataFrame, arrival_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = None, 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                shard = shard or _Shard(folder, part.schema)
                shard.add(part)
                size += part.nbytes
                if size >= arrival_bytes:
                    yield shard.close()
                    shard, size = None, 0
        if shard:
            yield shard.close()

    return run


def _merger(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs(folder)
        for b in batches:
            for names in b.column(b.schema.get_field_index("names")).to_pylist():
                shard = None
                for name in names:
                    with pq.ParquetFile(f"{base}/shards/{name}", filesystem=fs) as f:
                        for part in f.iter_batches(BATCH_ROWS):
                            shard = shard or _Shard(folder, part.schema)
                            shard.add(part)
                if shard:
                    yield shard.close()

    return run


def shard(docs: DataFrame, target: int = TARGET_BYTES, fan: int = FAN, arrival_bytes: int = ARRIVAL_BYTES) -> DataFrame:
    """Appends docs, compacts, and reads the last version back: all rows and columns of docs, and their shard.

    Rows come back as they are, nulls, repeats and very long texts too; an empty table gives an empty version. A column
    of docs named shard is replaced by the name of the file.
    """
    docs = docs.drop("shard")
    table = ShardTable(docs.sparkSession, new_path(docs.sparkSession, "shards"))
    table.append(docs, arrival_bytes)
    table.compact(target, fan, own=True)  # the folder is new: nobody else knows it
    return table.read(docs.schema)


ORACLE = """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents
"""
