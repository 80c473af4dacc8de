"""Operator 5: n-gram Jaccard self-join by size-aware signatures, and the classes that its links make.

Two sets that link (intersection at least 4/5 of the union) share their k smallest common elements within the first
n // 5 + k elements of each, in any order that both follow. The order is: rarest first, by counts of hashed elements
over all documents in a table that grows with the input up to a bound. That gives two kinds of keys:

* light sets (few elements): each 2-element subset of the first n // 5 + 2 elements,
* heavy sets: each of the first n // 5 + 1 elements, whose inverted lists are scanned; light sets that are large
  enough to link with a heavy one are in these lists too.

The boundary is where the keys and the expected list entries cost least, from the sizes of all sets.

Lists of few sets give all their pairs. The members of a longer list are first tested with a few leaders of it, which
joins most of a group of copies. Those of its members that are in different classes then meet in blocks, where inverted
lists of whole sets are scanned: what comes out are links between classes, as many as connect them, never the pairs of a
group. So no link between classes is lost, and what is known to be one class is not compared again. All tests are
exact, on whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, prepare, written
from .shingles import mix, shingle_sets

#: Pieces that the table of hashed element counts travels in; bits of the least and the largest table, which as levels of one byte is 8 MB.
PIECES = 16
LEAST_BITS, MOST_BITS = 14, 23
#: Bytes of text for each counter, below the largest table.
BYTES_PER_COUNTER = 32
#: Elements that a task counts at a time.
COUNTED = 1 << 22
#: Levels are logarithms of counts in steps of a LEVELS-th of a power of two.
LEVELS = 8
#: Rows of a key that may stand in one task, or a 2**-20 of all elements if that is more; keys of elements with higher counts are dealt over salts.
HOT_LIST, SALTS = 200, 64
#: Keys up to which what belongs to hot ones is broadcast; more are joined by a shuffle with salts.
BROADCAST_KEYS = 100_000
#: Candidate boundaries between light and heavy sets, in elements.
BOUNDARIES = (0, 6, 8, 12, 16, 24, 32, 48, 64, 96)
#: Lists up to this length give all pairs at once.
SHORT_LIST = 10
#: Leaders that all members of a longer list are tested with at first.
LEADERS = 3
#: Edges that a task of the components takes at least: small graphs are not spread over all partitions.
EDGES_PER_TASK = 20_000
#: Documents up to which the ids of candidates are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Elements of the sets of a block; two blocks meet in one task.
BLOCK_ELEMENTS = 150_000


def _buckets() -> list[int]:
    """Least sizes of buckets: a set links with none that is more than a quarter larger, so with none beyond the next bucket."""
    out = [1]
    while out[-1] < 2**30:
        out.append(out[-1] * 5 // 4 + 1)
    return out


BUCKETS = _buckets()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bits_for(size: int) -> int:
    """Bits of the table for `size` bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_COUNTER).bit_length()))


def _at(elements: np.ndarray, bits: int) -> np.ndarray:
    return (elements >> np.uint64(64 - bits)).astype(np.int64)


def _count(counts: np.ndarray, sets: list[np.ndarray], bits: int) -> None:
    at, n = np.unique(_at(np.concatenate(sets), bits), return_counts=True)
    counts[at] = np.minimum(counts[at].astype(np.int64) + n, 2**31 - 1)


def describe(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Rows of kind 0: id, size n and fingerprint (f1, f2) of each document's set. Rows of kind 1: a partition's element counts, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << bits, np.int32)
        part = TaskContext.get().partitionId()
        for b in batches:
            n, f1, f2, waiting, size = [], [], [], [], 0
            with np.errstate(over="ignore"):
                for s in shingle_sets(b.column(1)):
                    n.append(len(s))
                    f1.append(int(mix(s).sum(dtype=np.uint64)))
                    f2.append(int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)))
                    waiting.append(s)
                    size += len(s)
                    if size > COUNTED:
                        _count(counts, waiting, bits)
                        waiting, size = [], 0
            if waiting:
                _count(counts, waiting, bits)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k, pa.int32()), b.column(0).cast(pa.int64()), pa.array(n, pa.int32()), _signed(np.array(f1, np.uint64)), _signed(np.array(f2, np.uint64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                _DESCRIBED,
            )
        if counts.any():
            own = [zlib.compress(x.astype("<i4").tobytes(), 1) for x in np.split(counts, PIECES)]
            blank = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * PIECES, pa.int32()), pa.array([part] * PIECES, pa.int64()), pa.nulls(PIECES, pa.int32()), blank, blank, pa.array(range(PIECES), pa.int32()), pa.array(own, pa.binary())],
                _DESCRIBED,
            )

    return docs.select(id_col, text_col).mapInArrow(run, "kind int, id long, n int, f1 long, f2 long, piece int, counts binary")


_DESCRIBED = ["kind", "id", "n", "f1", "f2", "piece", "counts"]


def _merge(groups: DataFrame, last: bool) -> DataFrame:
    """Adds up the counts of each (piece, id), or of each piece as the last step, which gives levels, their sum and the sum of squares."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(0, np.int64)
        for x in pdf["counts"]:
            own = np.frombuffer(zlib.decompress(x), "<i4")
            total = own.astype(np.int64) if not len(total) else total + own
        if last:
            return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [zlib.compress(levels(total).tobytes(), 1)], "total": [float(total.sum())], "squares": [float((total.astype(float) ** 2).sum())]})
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "id": [pdf["id"].iloc[0]], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)]})

    return groups.groupBy("piece").applyInPandas(add, "piece int, counts binary, total double, squares double") if last else groups.groupBy("piece", "id").applyInPandas(add, "piece int, id long, counts binary")


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: 0 of none, and 1 and more by their logarithms, rounded down."""
    return np.minimum(255, 1 + np.floor(LEVELS * np.log2(np.maximum(counts, 1)) + 1e-9)).astype(np.uint8) * (counts > 0)


class Counts:
    """What the table tells: the level of each hashed element's count, their sum and sum of squares over the counters, and the level from which keys are hot."""

    def __init__(self, table: np.ndarray, total: float, squares: float) -> None:
        self.table, self.total, self.squares, self.bits = table, total, squares, int(len(table)).bit_length() - 1
        self.hot = int(levels(np.array([max(HOT_LIST, int(total) >> 20)]))[0])

    def of(self, elements: np.ndarray) -> np.ndarray:
        return self.table[_at(elements, self.bits)]


def element_counts(described: DataFrame, bits: int) -> Counts:
    """The table over all documents: partitions are added up in two steps, so that no task holds many of them."""
    rows = described.where("kind = 1").select("piece", F.pmod(F.hash("id"), F.lit(64)).cast("long").alias("id"), "counts")
    out, step, total, squares = np.zeros(1 << bits, np.uint8), (1 << bits) // PIECES, 0.0, 0.0
    for r in _merge(_merge(rows, False), True).collect():  # PIECES rows of bounded size
        out[r.piece * step : (r.piece + 1) * step] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
        total, squares = total + r.total, squares + r.squares
    return Counts(out, total, squares)


def boundary(sizes: dict[int, int], counts: Counts) -> int:
    """The number of elements up to which sets are light. sizes: number of sets by their size, where that is at most the largest boundary."""
    total = max(1.0, counts.total)
    # entries that an element finds in its list: how much heavier than even the counters are, seen from an element
    entries = max(0.0, counts.squares / total / max(1.0, total / len(counts.table)) - 1)

    def cost(x: int) -> float:
        light = sum(m * ((n // 5 + 2) * (n // 5 + 1) / 2 + (n * 5 >= 4 * (x + 1)) * (n // 5 + 1)) for n, m in sizes.items() if 4 <= n <= x)
        return light + sum(m * (n // 5 + 1) * (1 + entries) for n, m in sizes.items() if n > x)

    return min(BOUNDARIES, key=cost)


def keys_of(s: np.ndarray, counts: Counts, light: int) -> np.ndarray:
    """Keys of a set, of which two that link share at least one; the lowest bit of a key tells whether it may be hot. Sets under 4 elements link with none but their equals."""
    n = len(s)
    if n < 4:
        return s[:0]
    own = counts.of(s)
    order = np.argsort(own, kind="stable")[: n // 5 + 2]
    rare, hot = s[order], (own[order] >= counts.hot).astype(np.uint64)
    out = []
    if n <= light:
        i, j = np.triu_indices(len(rare), 1)
        out.append(mix(rare[i] ^ mix(rare[j] + np.uint64(0x632BE59BD9B4E019))) & ~np.uint64(1) | hot[i] & hot[j])
    if n > light or 5 * n >= 4 * (light + 1):
        out.append((rare & ~np.uint64(1) | hot)[: n // 5 + 1])
    return np.concatenate(out)


def _with_sets(docs: DataFrame, id_col: str, text_col: str, name: str, make) -> DataFrame:
    """(doc, n, name array<long>): make(set) for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, lists = [], [], []
            with np.errstate(over="ignore"):
                for doc, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1))):
                    found = make(s)
                    if doc is not None and len(found):
                        ids.append(doc)
                        n.append(len(s))
                        lists.append(found.view(np.int64))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc", "n", name])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc long, n int, {name} array<bigint>")


def _beside(rows: DataFrame, few: DataFrame, key: str, broadcast: int) -> DataFrame:
    """rows with the columns of few, a written table with one row per key: broadcast up to a bound, else joined by key and salt, so that a hot key's rows are dealt over SALTS tasks."""
    if few.count() <= broadcast:
        return rows.join(F.broadcast(few), key)
    many = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(many, [key, "__salt"]).drop("__salt")


def _of_key(rows: DataFrame, values: dict[str, Column], paths: list[str]) -> DataFrame:
    """rows (a written table with key and hot) with aggregates over all rows of their key: by a window where a key's rows are few, by partial sums and a join back where it is hot."""
    by = Window.partitionBy("key")
    cold = rows.where("NOT hot").withColumns({k: v.over(by) for k, v in values.items()})
    hot = rows.where("hot")
    sums, path = written(hot.groupBy("key").agg(*[v.alias(k) for k, v in values.items()]), "hot-keys")
    paths.append(path)
    return cold.unionByName(_beside(hot, sums, "key", BROADCAST_KEYS))


def components(edges: DataFrame, what: str = "components") -> tuple[DataFrame, list[str]]:
    """(v, c): the smallest vertex of the component of each vertex of edges (a, b), by alternating large and small stars.

    A vertex's smallest neighbour comes from an aggregate with partial sums and is joined back, so the centre of a large
    star is in no task with all its edges: broadcast while there are few vertices, else by a join whose skewed
    partitions Spark splits. Nothing is collected but two sums that tell whether a step changed anything.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = written(e, what)
    paths, before, count = [path], None, e.count()
    tasks = 1 + count // EDGES_PER_TASK

    def with_least(x: DataFrame) -> DataFrame:
        # two vertices an edge at most, and no step adds vertices
        m = x.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return x.join(F.broadcast(m) if 2 * count <= BROADCAST_IDS else m, "a")

    while True:
        both = with_least(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # (b, m) of the larger neighbours; an edge to the smallest neighbour comes back with the small stars
        keep = both.where("m < a").select("a", F.col("m").alias("b"))
        large, path = written(large.unionByName(keep).distinct().coalesce(tasks), what)
        paths.append(path)
        small = with_least(large)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        e, path = written(small.coalesce(tasks), what)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for old in paths:
            drop_path(e.sparkSession, old)
        paths = [path]
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("c")), paths
        before = now


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links, itself included).

    Rows with the same id are one document, whose sets all count. A null id has a null component and links with
    nothing; null, empty and blank texts have no shingles and link with nothing; an empty table gives an empty result.
    Other columns are left out.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    bits = bits_for(docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0])
    described, _ = written(describe(docs, id_col, text_col, bits), "sets")
    sets = described.where("kind = 0").select("id", "n", "f1", "f2")
    counts = element_counts(described, bits)
    sizes = {r.n: r["count"] for r in sets.where(f"n <= {BOUNDARIES[-1] + 1}").groupBy("n").count().collect()}  # as many rows as sizes
    table, light = spark.sparkContext.broadcast(counts), boundary(sizes, counts)

    # Equal sets are one: all but the smallest id are left out of the join. Only groups of two and more are held.
    equal = sets.where("id IS NOT NULL AND n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep <> most").drop("most")
    equal, equal_path = written(equal, "equal")
    few = F.broadcast(equal) if equal.count() <= BROADCAST_IDS else equal
    reps = sets.where("id IS NOT NULL").join(few, ["f1", "f2", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "n")
    reps, reps_path = written(reps, "reps")

    # of equal sets only the representative has keys: what is left out is broadcast up to a bound, and then not even encoded
    copies, copies_path = written(reps.groupBy("id").agg(F.max(F.col("id") == F.col("rep")).alias("own")).where("NOT own").select(F.col("id").alias("doc")), "copies")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    make = lambda s: keys_of(s, table.value, light)
    if copies.count() <= BROADCAST_IDS:
        keyed = _with_sets(texts.join(F.broadcast(copies), "doc", "left_anti"), "doc", "text", "keys", make)
    else:
        keyed = _with_sets(texts, "doc", "text", "keys", make).join(copies, "doc", "left_anti")
    keyed = keyed.select("doc", "n", F.explode("keys").alias("key")).withColumn("hot", F.col("key").bitwiseAND(F.lit(1)) == 1)
    keyed = keyed.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int"))
    # one shuffle of the keys: those that are not hot are whole in a task, and those that occur once go
    lists = keyed.withColumn("len", F.count("*").over(Window.partitionBy("key", "salt"))).where("hot OR len > 1").drop("salt")
    lists, lists_path = written(lists, "lists")

    pairs, groups = _candidates(lists, light)
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(groups.select("doc")).distinct()
    members, members_path = written(members, "members")
    wanted = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    whole, whole_path = written(_with_sets(texts.join(wanted, "doc", "left_semi"), "doc", "text", "s", lambda s: s), "whole")

    classes = _link(pairs, groups, whole)
    old = [equal_path, copies_path, lists_path, members_path, whole_path]
    # Sets that share an id are one document: their classes come together.
    result = _finish(sets, reps, classes)
    for p in old:
        drop_path(spark, p)
    return result.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").cast(docs.schema[id_col].dataType).alias("component_id"))


def _finish(sets: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of sets with the component: of the set's representative, and of ids that stand for several sets."""
    spark = sets.sparkSession
    one = reps.join(classes, reps.rep == classes.v, "left").select("id", F.coalesce("c", "rep").alias("c"), "n")
    several = one.groupBy("id").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    if not several.where("least <> most").isEmpty():
        links = one.select(F.col("id").alias("a"), F.col("c").alias("b")).where("a <> b").distinct()
        merged, _ = components(links, "same-ids")
        several = several.join(merged, several.id == merged.v, "left").select("id", F.coalesce("c", "least").alias("least"))
    several, _ = written(several.select("id", F.least("id", "least").alias("component")), "ids")
    return sets.join(several, "id", "left").select("id", "n", "component")


def _candidates(lists: DataFrame, light: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that may link, of short lists all and of longer ones those with their leaders; and groups (g, doc, n) of the longer ones.

    Sets with p of their n elements as keys have at most c + max(n - p, n2 - p2) elements in common, where c is the number of
    keys they share: those counted in short lists and at most as many as both have in longer ones. Pairs that cannot reach
    the intersection they need are left out.
    """
    near = "5 * least(n, n2) >= 4 * greatest(n, n2)"
    paths: list[str] = []
    hot, hot_path = written(lists.where("hot").groupBy("key").agg(F.count("*").alias("len")).where("len > 1"), "hot-lists")
    lists = lists.where("NOT hot").unionByName(_beside(lists.where("hot").drop("len"), hot, "key", BROADCAST_KEYS))
    lists = lists.withColumn("more", F.count_if(F.col("len") > SHORT_LIST).over(Window.partitionBy("doc")).cast("int"))
    lists, lists_path = written(lists, "counted")
    long = lists.where(f"len > {SHORT_LIST}")
    # A leader is the member with the smallest hash, whatever the list: lists of the same members share it.
    best = {f"l{k}": F.min(F.struct(F.xxhash64("doc", F.lit(k)).alias("h"), F.col("doc").alias("d2"), F.col("n").alias("n2"), F.col("more").alias("m2"))) for k in range(LEADERS)}
    led = _of_key(long, best, paths).select("doc", "n", "more", F.col("l0.d2").alias("g"), F.explode(F.array_distinct(F.array(*best))).alias("l"))
    led, led_path = written(led.distinct(), "led")
    star = led.select("doc", "n", "more", "l.d2", "l.n2", "l.m2", F.lit(0).alias("c"))
    short = lists.where(f"len <= {SHORT_LIST}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc", "n", "more"))).alias("m"))
    two = short.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.doc AS doc, x.n AS n, x.more AS more, y.doc AS d2, y.n AS n2, y.more AS m2, 1 AS c))))")).alias("p")).select("p.*")
    both = two.unionByName(star).where(f"doc <> d2 AND {near}")
    swap = F.col("doc") > F.col("d2")
    ordered = both.select(
        F.least("doc", "d2").alias("b"), F.greatest("doc", "d2").alias("a"), F.when(swap, F.col("n2")).otherwise(F.col("n")).alias("nb"), F.when(swap, F.col("n")).otherwise(F.col("n2")).alias("na"),
        F.least("more", "m2").alias("m"), "c",
    )
    found = ordered.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("m").alias("m"))
    reach = "9 * (c + m + greatest(na - (na div 5 + 1), nb - (nb div 5 + 1))) >= 4 * (na + nb)"
    pairs, _ = written(found.where(f"least(na, nb) <= {light} OR {reach}").select("a", "b").distinct(), "pairs")
    groups, _ = written(led.select("g", "doc", "n").distinct(), "groups")
    for p in (lists_path, led_path, hot_path, *paths):
        drop_path(lists.sparkSession, p)
    return pairs, groups


def _link(pairs: DataFrame, groups: DataFrame, whole: DataFrame) -> DataFrame:
    """(v, c) of all documents in a class of two or more."""
    left = pairs.join(whole.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(whole.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).where("100 * i >= 80 * (size(sa) + size(sb) - i)").select("a", "b")
    links, _ = written(both, "links")
    classes, _ = components(links)
    # What shares a longer list, and is not yet in one class, meets in the group of the list's first leader.
    groups = groups.join(classes, F.col("doc") == F.col("v"), "left").select("g", "doc", "n", F.coalesce("c", "doc").alias("c"))
    groups, _ = written(groups, "open-groups")
    rest, _ = written(_scan(groups, whole), "rest")
    if not rest.isEmpty():
        classes, _ = components(links.unionByName(rest))
    return classes


def _scan(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b): links between classes within each group, enough to connect what is connected.

    Members are dealt into buckets by the size of their sets, such that sets that link are in the same or neighbouring
    ones, and the members of a bucket by a hash into blocks of about BLOCK_ELEMENTS elements. Each two blocks of a group whose
    buckets are the same or neighbours meet in one task. There the inverted lists of one block's elements are scanned for
    each set of the other, which counts whole intersections.
    """
    classes = groups.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    classes, classes_path = written(classes, "open")
    rows = _beside(groups, classes, "g", BROADCAST_KEYS).withColumn("s", F.expr(f"size(filter(array({', '.join(map(str, BUCKETS))}), b -> b <= n))"))
    rows, rows_path = written(rows, "members-of-open")
    blocks = rows.groupBy("g", "s").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    blocks, _ = written(blocks.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("s", "blocks"))).alias("blocks")), "blocks")  # a bucket an entry, of BUCKETS at most
    rows = _beside(rows, blocks, "g", BROADCAST_KEYS).withColumn("k", F.expr("CAST(pmod(xxhash64(doc), blocks[s]) AS INT)"))
    # each block that a member's own one meets, as (i, j) in order
    other = "flatten(transform(filter(array(s - 1, s, s + 1), x -> blocks[x] IS NOT NULL), x -> transform(sequence(0, blocks[x] - 1), y -> struct(x AS s, y AS k))))"
    put = rows.withColumn("own", F.expr("struct(s, k)")).withColumn("o", F.explode(F.expr(other)))
    put = put.select("g", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "own", "doc", "c")
    number = lambda x: F.expr(f"{x}.s * 16777216L + {x}.k")
    put = put.select("g", number("p").alias("i"), number("q").alias("j"), number("own").alias("blk"), "doc", "c").join(whole.select("doc", "s"), "doc")

    def meet(key, t):
        docs, c, blk = (t[x].to_numpy() for x in ("doc", "c", "blk"))
        sets = t["s"].combine_chunks()
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        sizes = np.diff(ends)
        left = np.flatnonzero(blk == key[1].as_py())
        right = np.flatnonzero(blk == key[2].as_py())
        tokens = np.concatenate([values[ends[k] : ends[k + 1]] for k in right]) if len(right) else values[:0]
        owner = np.repeat(np.arange(len(right)), sizes[right])
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        known, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out: list[tuple[int, int]] = []
        for a in left if len(known) else ():
            if (c[right] == c[a]).all():
                continue
            own = values[ends[a] : ends[a + 1]]
            place = np.searchsorted(known, own)
            place = place[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == own)]
            if not len(place):
                continue
            n = count[place]
            spots = np.repeat(first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[spots], minlength=len(right))
            linked = (100 * common >= 80 * (sizes[a] + sizes[right] - common)) & (c[right] != c[a])
            for b in right[linked]:
                x, y = find(int(c[a])), find(int(c[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(docs[a]), int(docs[b])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return put.groupBy("g", "i", "j").applyInArrow(meet, "a long, b long")
