"""What several operators share: row identity, staged tables, words and window hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

# The white space that ends a word, as a class of Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The setting that drops a job's shuffle files when the job ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A task works on about so many bytes of text at a time; a longer text is one step.
CHUNK_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """The shuffle files of a job go when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder. The shuffle files of the job that made it
    go when it ends, so a chain of stages never holds more than one stage's files."""
    with dropping_shuffles(df.sparkSession):
        return materialize(df, label)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """`df`, known to have `rows` rows at most, with its last step in no more tasks than `each` rows a task
    make: a small table is not written as hundreds of files."""
    return df.coalesce(max(1, -(-rows // each)))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def identified(docs: DataFrame, key: str, row: str = "_row", *keep: str) -> DataFrame:
    """The columns `key` and `keep` with a unique, non-null BIGINT `row`.

    The key itself where it is unique whole numbers without null (one small job looks
    at the keys alone). Otherwise the rows are written with numbers of their own, so
    that rows which repeat a key, or have none, stay apart.
    """
    docs = docs.select(key, *keep)
    if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        worst = docs.groupBy(key).count().agg(
            F.max(F.when(F.col(key).isNull(), 2).otherwise(F.col("count"))).alias("n")
        )
        if (worst.first()["n"] or 0) <= 1:
            return docs.withColumn(row, F.col(key).cast("bigint"))
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, share: int = 10_000) -> DataFrame:
    """`rows` joined with the rows of `table`, which has each key once. `weight` counts the rows
    that a key meets.

    The keys that meet more than 1 / share of all are fewer than `share`, so they are broadcast;
    behind the shuffle no other key brings more than that part of the rows to a task. Both tables
    are read twice: they should be written ones.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    heavy = F.col(weight) * share > F.lit(total)
    hot, rest = table.where(heavy), table.where(~heavy)
    spread = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(spread)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) of every node on an edge (a, b); `root` is the smallest node it reaches.

    Alternates two steps over the edge table until all that is left are stars: every larger
    neighbour of a node moves to the node's smallest neighbour, then every smaller
    one does. A hot node is summed before its rows move, and its join can be split.
    """
    now = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label,
    )
    while True:
        n = now.count()
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(
            now.select(F.col("b").alias("v"), F.lit(0).alias("up")))
        # In a star, the larger end of an edge is on no other edge; the smaller one is the root.
        if not n or not ends.groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where(
                "ups > 1 or (ups = 1 and low = 0)").count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).distinct()
        large = staged(few(large.where(F.col("a") != F.col("b")), 2 * n), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e")
        ).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        now = staged(few(small.where(F.col("a") != F.col("b")).distinct(), 4 * n), label)


# Inside tasks.


def held(owner: str, key, make: Callable):
    """An object that a worker process makes once and keeps for its later tasks, until a task of another
    owner runs there. It is kept with the interpreter, since a function that travels with a job
    finds new module variables in each task."""
    import sys

    kept = sys.__dict__.setdefault("_held_by_tasks", {})
    if kept.get("owner") != owner:
        kept.clear()
        kept["owner"] = owner
    if (key,) not in kept:
        kept[(key,)] = make()
    return kept[(key,)]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the memory that Arrow keeps for later goes back."""
    yield from batches
    pa.default_memory_pool().release_unused()


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // size
        cuts = np.flatnonzero(np.diff(group)) + 1
        if not len(cuts):
            yield batch
            continue
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            # A copy: some text functions go wrong on a slice, which shares its bytes.
            yield batch.take(pa.array(np.arange(start, stop)))


def _each(texts: pa.Array, lower: bool) -> list[bytes]:
    """The bytes of each text; A-Z in lower case if asked for."""
    texts = texts.cast(pa.large_binary())
    ends, data = np.frombuffer(texts.buffers()[1] or b"", np.int64), texts.buffers()[2]
    ends = ends[texts.offset:texts.offset + len(texts) + 1].tolist()
    data = data.to_pybytes() if data else b""
    data = data.lower() if lower else data  # A-Z only, as these are bytes
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Words:
    """The words of a column of texts: a code per word, the row each is in, and the
    words by code, as bytes. `first` is the place of each row's first word. With `lower`, words
    that differ in case have codes of their own but one hash."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        self.distinct = _each(coded.dictionary, lower)
        if b"" in self.distinct:
            full = codes != self.distinct.index(b"")
            codes, rows = codes[full], rows[full]
        self.codes, self.rows = codes, rows
        self.sizes = np.bincount(rows, minlength=len(texts))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.places = np.arange(len(codes)) - self.first[rows]

    def hashes(self) -> np.ndarray:
        """64 bits per word, the same in every task."""
        return self.table()[self.codes]

    def table(self) -> np.ndarray:
        """The hashes by code."""
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads near ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


class Windows:
    """Hashes of runs of numbers, each in a few steps whatever its length."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        power = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        if n:
            power[0] = back[0] = 1
        power, self.back = np.cumprod(power), np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power)])

    def at(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))
