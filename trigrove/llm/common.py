"""What the operators share: written intermediates, Arrow mapping, byte-level words and hashes."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.sources.code import ship

#: Text bytes that a Python worker holds in numpy arrays at once (longer texts are taken alone).
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch sent to a Python worker, about (a longer row is sent alone), where the session sets none.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """Sends the modules to the executors and bounds the batches that Python workers get by bytes, as rows may be long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in one process only, a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trigrove-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so a lost executor costs no rework."""
    spark = df.sparkSession
    prepared(spark)
    path = fresh_path(spark, name)
    # the shuffles behind it are used no more, so their files go at once and not when the driver collects its garbage
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Removes the files of written() tables that are needed no longer."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: joined by sorting both sides, never broadcast, at every size."""
    return df.hint("merge")


@contextmanager
def prefiltered(spark: SparkSession):
    """What is executed inside has its sorted joins' large sides filtered before they are shuffled, where the other side has a filter.

    Spark builds the Bloom filter (8 MB at most) of the other side's keys, if that has at most 512 MB, and leaves it out
    else. It drops only rows that the join would drop, so results are the same with and without it.
    """
    wanted = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "512m", "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
        "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 26), "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
}


def released(f: Callable) -> Callable:
    """f, a function for mapInArrow, that gives freed memory back to the system when its task ends.

    Workers stay for the next task, and several of an idle executor would else hold what their largest batch took.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def arrow_schema(schema: str) -> pa.Schema:
    """Of a DDL string of the kinds above; needs no session, so tasks can call it."""
    return pa.schema([pa.field(name, KINDS[kind]) for name, kind in (x.split() for x in schema.split(","))])


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Applies f to record batches cut to about ``chunk`` bytes; f gives columns (dict), several or None."""

    def run(batches):
        target = arrow_schema(schema)
        for batch in batches:
            for part in cut(batch, chunk):
                got = f(part)
                if got is None:
                    continue
                for columns in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays([as_arrow(columns[x.name], x.type) for x in target], schema=target)

    prepared(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each of about ``most`` bytes of its string columns, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.full(batch.num_rows, 32, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.diff(offsets_of(column))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def offsets_of(column: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a string or binary column."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32) if column.buffers()[1] is not None and len(column) else np.zeros(1, np.int64)
    return at[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array and the n + 1 offsets into it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    at = offsets_of(column)
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def sample_of(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``columns``.

    Tasks first leave out rows whose hash is too large for the sample, so that they send on few more than it holds.
    """
    n = df.count()
    drawn = F.pmod(F.xxhash64(*columns), F.lit(1 << 20))
    if n > most:
        share = min(1.0, (most + 6 * most**0.5 + 10) / n)
        df = df.where(drawn <= int(share * (1 << 20)) + 1)
    return df.orderBy(drawn, *columns).limit(most)


#: Multiplier of the polynomial hashes modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of BASE (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "power"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), UNBASE if inverse else BASE, np.uint64)
        step[0] = 1
        _POWERS[key] = have = np.cumprod(step, dtype=np.uint64)
        if have.nbytes > 1 << 26:
            _POWERS.pop(key)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of the polynomial of values, from which any range's hash follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), equal for equal contents wherever they lie."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start] + (end - start).astype(np.uint64))


#: Bytes of a range, at most, that are hashed eight at a time; longer ones are hashed by BLAKE2.
SHORT = 64


def range_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, short: int = SHORT) -> np.ndarray:
    """64-bit names of the contents data[start:end], equal for equal contents wherever they lie.

    Eight bytes at a time go through a scramble that isn't linear, so that there are no families of contents that
    collide, as there are for polynomials modulo 2**64. Contents of up to eight bytes collide with none of their length.
    """
    size = end - start
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > short)
    active = np.flatnonzero((size > 0) & (size <= short)) if len(long) else np.arange(len(size))
    k = 0
    while len(active):
        left = np.minimum(size[active] - k, 8)
        lane = lanes[start[active] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - left).astype(np.uint64)))
        out[active] = mix(out[active] ^ lane) * np.uint64(BASE)
        k += 8
        active = active[size[active] > k]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that are no white space), and the n + 1 word counts by text."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    if len(first):
        begins[first] = inside[first]
        last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
        ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Odd factors of a shingle's words: a multilinear hash of the words' names.
FACTORS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` lower-cased words.

    A text of fewer words gives the whole sequence as its only shingle; one without words gives none.
    """
    starts, ends, counts = words(data, offsets)
    hashed = range_names(LOWER[data], starts, ends)
    out = []
    rolled = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
    for k, factor in enumerate(FACTORS[:width]):
        rolled += hashed[k : k + len(rolled)] * factor
    rolled = mix(rolled)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            x = np.full(1, 0x5851F42D4C957F2D + (b - a), np.uint64)
            for k in range(a, b):
                x = mix(x ^ hashed[k])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Edges that a task contracts at once.
EDGES = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: edges (a, b) put together within each task, so that each u has one v there, the least it reaches."""

    def run(batches):
        target = arrow_schema("u long, v long")
        held, size = [], 0

        def out():
            nonlocal held, size
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j = ends[: len(a)], ends[len(a) :]
            label = np.arange(len(ids))
            while True:
                least = np.minimum(label[i], label[j])
                new = label.copy()
                for x in (i, j, label[i], label[j]):
                    np.minimum.at(new, x, least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], schema=target)

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
                size += batch.num_rows
                if size >= EDGES:
                    yield out()
        if held:
            yield out()

    prepared(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(released(run), "u long, v long")


def components(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each id that isn't the smallest itself.

    Tasks first contract what they hold. Then, round by round, the smaller neighbours of each id are linked to the least
    of them, and links to an id go on to that id's least neighbour, until nothing moves. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    edges, before = contracted(links), None
    while True:
        least = edges.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("vs"))
        least = written(least.select("u", F.element_at("vs", 1).alias("m"), F.slice("vs", F.lit(2), F.size("vs")).alias("rest")), f"{name}-least")
        rows = least.select("u", F.col("m").alias("v"), F.lit(False).alias("moved")).unionByName(least.select(F.explode("rest").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")))
        onward = least.select(F.col("u").alias("v"), F.col("m").alias("p"))  # a join of two plain exchanges: Spark splits a hub's rows
        now = rows.join(growing(onward), "v", "left").select("u", F.coalesce("p", "v").alias("v"), (F.col("moved") | F.col("p").isNotNull()).alias("moved"))
        now = written(now, f"{name}-edges")
        delete(least, *([before] if before is not None else []))
        if not now.where("moved").limit(1).count():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = before = now
