"""Posting tables: built from documents' bytes, and their set algebra.

A posting table holds runs: (gram, ds, ids), the ascending file ids of a gram in a dataset, in folders by index type and
bucket. Large tables have several runs of a gram, each for a range of file ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions.grams import gram_column, grams_of
from trigrove.sources.code import ship

#: Buckets of an index type at most, a power of two. Grams are dealt to them by hash, as some leading bytes are far more frequent.
BUCKETS = 64
#: Postings of a bucket up to which a table gets no more buckets, and of one file at most, about.
BUCKET_POSTINGS, SLICE_POSTINGS = 500_000, 4 << 20
#: Postings that a scanning task gathers before it passes them on.
HELD = 2 << 20
TABLE = "gram int, ds int, ids array<int>, itype string, gram_bucket int"
_RAW = "pid int, ds int, k int, path string, itype string, bucket int, seq int, block binary, n long"


def bucket_of(gram):
    """The gram's bucket of BUCKETS, of one number or an array."""
    return (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 26


def folders_of(gram: int) -> list[int]:
    """The gram's ``gram_bucket`` in tables of 1, 2, 4 ... BUCKETS buckets: the number of buckets plus the bucket's leading bits."""
    return [(1 << b) + (bucket_of(gram) >> (6 - b)) for b in range(BUCKETS.bit_length())]


def packed(keys: np.ndarray) -> bytes:
    """A block of sorted (gram << 32 | k): distinct grams, how often each occurs, and all k, in 16 bits where they fit."""
    grams, counts = np.unique((keys >> 32).astype(np.int32), return_counts=True)
    k = (keys & 0xFFFFFFFF).astype(np.int64)
    least = int(k.min())
    wide = int(k.max()) - least > 0xFFFF
    head = np.array([len(grams), len(keys), least, wide], np.int32)
    return b"".join(x.tobytes() for x in (head, grams, counts.astype(np.int32), (k - least).astype(np.uint32 if wide else np.uint16)))


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(gram, k) of a block."""
    m, n, least, wide = np.frombuffer(block, np.int32, 4).tolist()
    grams, counts = np.frombuffer(block, np.int32, m, 16), np.frombuffer(block, np.int32, m, 16 + 4 * m)
    k = np.frombuffer(block, np.uint32 if wide else np.uint16, n, 16 + 8 * m)
    return np.repeat(grams, counts), k.astype(np.int64) + least


def scanned(found: DataFrame, types: list[str], realign: bool = False) -> DataFrame:
    """Of files (ds, path, content), in one pass: a row for each file, numbered within its dataset and task, and blocks of postings.

    Contents don't leave the task that reads them. A file's grams are distinct.
    """
    ship(found.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        pid, seq, held = TaskContext.get().partitionId(), 0, 0
        target = pa.schema([("pid", pa.int32()), ("ds", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("itype", pa.string()), ("bucket", pa.int32()), ("seq", pa.int32()), ("block", pa.binary()), ("n", pa.int64())])
        following: dict[int, int] = {}
        parts: dict[tuple[int, str], list[tuple[int, np.ndarray]]] = {}

        def flush():
            nonlocal seq, held
            rows = []
            for (ds, kind), grams in parts.items():
                keys = np.concatenate([g for _, g in grams]).astype(np.int64)
                keys = bucket_of(keys) << 56 | keys << 32 | np.repeat([k for k, _ in grams], [len(g) for _, g in grams])
                keys.sort()
                edges = np.searchsorted(keys, np.arange(BUCKETS, dtype=np.int64) << 56).tolist() + [len(keys)]
                for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if e > s:
                        rows.append((ds, kind, b, seq, packed(keys[s:e] & ((1 << 56) - 1)), e - s))
            seq, held = seq + 1, 0
            parts.clear()
            for a in range(0, len(rows), 256):
                ds, kinds, buckets, seqs, blocks, n = zip(*rows[a : a + 256], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid] * len(ds), pa.int32()), pa.array(ds, pa.int32()), pa.nulls(len(ds), pa.int32()), pa.nulls(len(ds), pa.string()), pa.array(kinds), pa.array(buckets, pa.int32()), pa.array(seqs, pa.int32()), pa.array(blocks, pa.binary()), pa.array(n, pa.int64())],
                    schema=target,
                )

        for batch in batches:
            size, numbers = batch.num_rows, []
            for ds, content in zip(batch.column("ds").to_pylist(), batch.column("content"), strict=True):
                k = following.get(ds, 0)
                following[ds] = k + 1
                numbers.append(k)
                data = content.as_buffer().to_pybytes()
                for kind in types:
                    grams = grams_of(data, kind, realign)
                    if len(grams):
                        parts.setdefault((ds, kind), []).append((k, grams))
                        held += len(grams)
                if held > HELD:
                    yield from flush()
            nulls = [pa.nulls(size, t) for t in (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([pid] * size, pa.int32()), batch.column("ds").cast(pa.int32()), pa.array(numbers, pa.int32()), batch.column("path"), *nulls], schema=target)
        if parts:
            yield from flush()

    return found.select("ds", "path", "content").mapInArrow(run, _RAW)


#: Rows of task bases up to which they are summed up on the driver.
FEW = 50_000


def bases(raw: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(ds, pid, base): a scanning task's first file id in a dataset; and the files of each dataset.

    Ids follow the order of tasks and of rows in them.
    """
    counts = raw.where(F.col("path").isNotNull()).groupBy("ds", "pid").agg(F.count("*").alias("files"))
    rows = counts.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        total: dict[int, int] = {}
        placed = []
        for ds, pid, n in sorted(map(tuple, rows)):
            placed.append((ds, pid, total.get(ds, 0)))
            total[ds] = total.get(ds, 0) + n
        return F.broadcast(raw.sparkSession.createDataFrame(placed, "ds int, pid int, base long")), total
    earlier = Window.partitionBy("ds").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    total = {r["ds"]: r["files"] for r in counts.groupBy("ds").agg(F.sum("files").alias("files")).collect()}  # a row for each dataset
    return counts.select("ds", "pid", F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("base")), total


def laid_out(total: dict[str, int]) -> tuple[dict[str, int], dict[str, int], Callable[[dict], Column]]:
    """For postings by type: bits of buckets, slices of a bucket, and what reads a dict by the column ``itype``."""
    bits = {t: min(6, max(0, (-(-n // BUCKET_POSTINGS) - 1).bit_length())) for t, n in total.items()}
    slices = {t: -(-n // (SLICE_POSTINGS << bits[t])) for t, n in total.items()}
    return bits, slices, lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("itype")]


def _bucket(gram: Column) -> Column:
    """bucket_of in the JVM."""
    return F.shiftright((gram.cast("long") * 0x9E3779B1).bitwiseAND(0xFFFFFFFF), 26)


def gathered(raw: DataFrame, base: DataFrame, least_tasks: int) -> DataFrame | None:
    """The posting table of scanned files: blocks of one bucket meet in a task, which sorts them by gram.

    A task holds about SLICE_POSTINGS of a bucket: larger buckets are cut into ranges of file ids, so a frequent gram is too.
    """
    blocks = raw.where(F.col("block").isNotNull())
    told = blocks.groupBy("itype").agg(F.sum("n").alias("n"), F.max("pid").alias("last")).collect()  # a row for each type
    if not told:
        return None
    total, tasks = {r["itype"]: r["n"] for r in told}, 1 + max(r["last"] for r in told)
    bits, slices, of = laid_out(total)
    folder = (of({t: 1 << b for t, b in bits.items()}) + F.floor(F.col("bucket") / of({t: 1 << (6 - b) for t, b in bits.items()}))).cast("int")
    part = F.floor(F.col("pid").cast("long") * of(slices) / tasks).cast("int")
    dealt = blocks.join(base, ["ds", "pid"]).select("itype", folder.alias("gram_bucket"), part.alias("slice"), "ds", "base", "seq", "block")
    groups = sum(slices[t] << bits[t] for t in total)
    wanted = max(least_tasks, -(-sum(total.values()) // SLICE_POSTINGS))
    keys = ["itype", "gram_bucket", "slice"]
    return dealt.repartition(max(1, min(groups, wanted)), *keys).sortWithinPartitions(*keys, "ds", "base", "seq").mapInArrow(_gather, TABLE)


def _gather(batches):
    target = pa.schema([("gram", pa.int32()), ("ds", pa.int32()), ("ids", pa.list_(pa.int32())), ("itype", pa.string()), ("gram_bucket", pa.int32())])
    group, held = None, []

    def close():
        size = [len(h[2]) for h in held]
        gram = np.concatenate([h[2] for h in held])
        order = np.argsort(gram, kind="stable")  # blocks are in the order of datasets and ids
        gram, ids = gram[order], np.concatenate([h[3] + h[1] for h in held])[order].astype(np.int32)
        ds = np.repeat(np.array([h[0] for h in held], np.int32), size)[order]
        begin = np.append(True, (gram[1:] != gram[:-1]) | (ds[1:] != ds[:-1])).nonzero()[0]
        ends = np.append(begin[1:], len(gram))
        held.clear()
        a = 0
        while a < len(begin):
            b = max(a + 1, int(np.searchsorted(ends, begin[a] + 500_000, "right")))
            b = min(b, a + 50_000)
            offsets = pa.array(np.append(begin[a:b], ends[b - 1]) - begin[a], pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.array(ids[begin[a] : ends[b - 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(gram[begin[a:b]]), pa.array(ds[begin[a:b]]), runs, pa.array([group[0]] * (b - a)), pa.array([group[1]] * (b - a), pa.int32())], schema=target)
            a = b

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("itype", "gram_bucket", "slice", "ds", "base"))
        for *name, ds, base, block in zip(*columns, batch.column("block"), strict=True):
            if name != group:
                if held:
                    yield from close()
                group = name
            held.append((ds, base, *unpacked(block.as_buffer().to_pybytes())))
    if held:
        yield from close()


def write(table: DataFrame, path: str) -> None:
    """Parquet by index type and bucket, sorted by gram, so that a look-up reads few row groups of few files."""
    table.sortWithinPartitions("itype", "gram_bucket", "gram", "ds").write.option("parquet.block.size", 16 << 20).partitionBy("itype", "gram_bucket").parquet(path)


def build_native(files: DataFrame, types: list[str]) -> DataFrame:
    """(itype, gram, dataset_id, file_id) of files (dataset_id, file_id, content) by JVM functions only; slower, a second opinion for tests."""
    parts = [files.select(F.lit(t).alias("itype"), F.explode(gram_column(F.col("content"), t)).alias("gram"), "dataset_id", "file_id") for t in types]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def runs(postings: DataFrame) -> DataFrame:
    """(itype, gram, dataset_id, run): each gram's sorted file ids."""
    return postings.groupBy("itype", "gram", "dataset_id").agg(F.sort_array(F.collect_set("file_id")).alias("run"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("itype", "gram").agg(F.count("*").alias("files"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in both of two runs (dataset_id, file_id)."""
    return a.join(b, ["dataset_id", "file_id"], "left_semi").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def threshold(many: list[DataFrame], least: int) -> DataFrame:
    """Ids in at least ``least`` of the runs; a run given twice counts twice."""
    everything = many[0].distinct()
    for m in many[1:]:
        everything = everything.unionByName(m.distinct())
    return everything.groupBy("dataset_id", "file_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def joined(table: DataFrame, base: Column, files: int, least_tasks: int) -> DataFrame | None:
    """Runs of merged datasets as those of one: ids moved by ``base``, the files of the datasets before theirs.

    A gram's runs are put together, in slices of ids where a bucket is larger than a task should hold.
    """
    total = {r["itype"]: r["n"] for r in table.groupBy("itype").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row for each type
    if not total:
        return None
    bits, slices, of = laid_out(total)
    folder = (of({t: 1 << b for t, b in bits.items()}) + F.floor(_bucket(F.col("gram")) / of({t: 1 << (6 - b) for t, b in bits.items()}))).cast("int")
    part = F.floor(F.col("first") * of(slices) / files).cast("int")
    rows = table.withColumn("base", base).withColumn("first", F.element_at("ids", 1).cast("long") + F.col("base"))
    rows = rows.select("itype", folder.alias("gram_bucket"), part.alias("slice"), "gram", "first", F.transform("ids", lambda i: (i + F.col("base")).cast("int")).alias("ids"))
    groups = sum(slices[t] << bits[t] for t in total)
    keys = ["itype", "gram_bucket", "slice"]
    dealt = rows.repartition(max(1, min(groups, max(least_tasks, -(-sum(total.values()) // SLICE_POSTINGS)))), *keys)
    together = dealt.groupBy(*keys, "gram").agg(F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("runs"))
    return together.select("gram", F.lit(0).alias("ds"), F.flatten(F.col("runs.ids")).alias("ids"), "itype", "gram_bucket")
