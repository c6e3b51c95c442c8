"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import arrow_schema, read, released, written
from trigrove.llm.mixing import WORD

CAPACITY = 2048
#: Pieces that one shard packs, about. A shard is packed by one task and knows nothing of others.
SHARD_ROWS = 20_000
#: Documents of one source that share a sequence at most; a source's bitmap has as many bits.
PER_SOURCE = 8


class Bins:
    """Open bins by residual capacity, each with its sources' and duplicate clusters' bitmaps.

    Residuals are whole numbers, so a bitmap of the residuals that occur gives the successor of any size. Bins of
    one residual are grouped by their source bitmap; a group whose sources conflict is passed over at once.
    """

    def __init__(self, capacity: int, per_source: int = PER_SOURCE) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.present = 0
        self.by_residual: dict[int, dict[int, list[list]]] = {}
        self.source_bits: dict[object, int] = {}
        self.cluster_bits: dict[object, int] = {}
        self.count = 0

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, offset) of a piece: the tightest bin that holds it without a conflict, else a new one."""
        at = self.source_bits.setdefault(source, len(self.source_bits) * self.per_source)
        full = 1 << (at + self.per_source - 1)  # a source's last bit is set when it may come no more
        twin = 0 if cluster is None else 1 << self.cluster_bits.setdefault(cluster, len(self.cluster_bits))
        over = self.present >> size
        residual = size
        while over:
            step = (over & -over).bit_length() - 1
            residual += step
            groups = self.by_residual[residual]
            for sources, bins in groups.items():
                if sources & full:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not bins[k][1] & twin:
                        chosen = bins.pop(k)
                        if not bins:
                            del groups[sources]
                            if not groups:
                                del self.by_residual[residual]
                                self.present &= ~(1 << residual)
                        return self._fill(chosen, residual, sources, size, at, twin)
            over >>= step + 1
            residual += 1
        self.count += 1
        return self._fill([self.count - 1, 0], self.capacity, 0, size, at, twin)

    def _fill(self, chosen: list, residual: int, sources: int, size: int, at: int, twin: int) -> tuple[int, int]:
        mine = sources >> at & (1 << self.per_source) - 1
        sources |= (mine + 1) << at  # the lowest bit that is not set follows those that are
        chosen[1] |= twin
        left = residual - size
        if left:
            self.by_residual.setdefault(left, {}).setdefault(sources, []).append(chosen)
            self.present |= 1 << left
        return chosen[0], self.capacity - residual


def pack(pieces: Iterable[tuple[int, object, object]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), taken in the order given (best fit decreasing: largest first)."""
    bins = Bins(capacity, per_source)
    for size, source, cluster in pieces:
        yield bins.place(size, source, cluster)


SCHEMA = "doc_id long, piece int, piece_start long, n_words long, bin string, bin_offset long, source string, cluster long"


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: where it starts, its words, its bin and its offset there.

    Bins hold ``capacity`` words. A document of more words is cut: each full piece has a bin of its own, the rest is
    packed as any other. No bin holds two documents of equal text (a duplicate cluster: 64 bits of the text's hash,
    or the column ``cluster`` where there is one), nor more than ``per_source`` of one source; null sources count
    as one source. A text without words, or null, gives one piece of 0 words in no bin (null). Repeated rows are
    packed each for itself. Documents are dealt to shards by hash, so neither a hot source nor a group of copies
    fills one of them; every shard packs its pieces largest first.
    """
    cluster = F.col("cluster") if "cluster" in docs.columns else F.xxhash64("text")
    sized = docs.select("doc_id", "source", cluster.cast("long").alias("cluster"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"), F.xxhash64("doc_id", "source", "text").alias("draw"))
    sized = written(sized, "packing-sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    fulls = F.floor(F.col("n") / capacity).cast("int")
    # rows that repeat are told apart by a number, so that reruns give the same names
    whole = sized.where(fulls >= 1).groupBy("doc_id", "source", "cluster", "n", "draw").agg(F.count("*").alias("rows"))
    whole = whole.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "source", "cluster", F.explode(F.sequence(F.lit(0), fulls - 1)).alias("piece"), "draw", "row")
    whole = whole.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("piece_start"), F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.concat(F.lit("w"), F.hex("draw")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), "source", "cluster",
    )
    empty = sized.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_offset"), "source", "cluster")
    rest = sized.withColumn("rest", F.col("n") % capacity).where("rest > 0")
    rest = rest.select(F.pmod(F.xxhash64("draw"), F.lit(shards)).alias("shard"), "doc_id", fulls.alias("piece"), "rest", "source", "cluster", "draw")

    def run(batches):
        target = arrow_schema(SCHEMA)
        shard, bins = None, None
        for batch in batches:
            columns = batch.to_pydict()
            names, offsets = [], []
            for s, size, source, twin in zip(columns["shard"], columns["rest"], columns["source"], columns["cluster"], strict=True):
                if s != shard:
                    shard, bins = s, Bins(capacity, per_source)
                b, at = bins.place(size, source, twin)
                names.append(f"s{s}-{b}")
                offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), pa.array([p * capacity for p in columns["piece"]], pa.int64()), batch.column("rest"), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), batch.column("source"), batch.column("cluster")],
                schema=target,
            )

    ordered = rest.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("rest"), "draw", "doc_id")
    return ordered.mapInArrow(released(run), SCHEMA).unionByName(whole).unionByName(empty)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies: the columns of ``packed``."""
    return packed(docs)
