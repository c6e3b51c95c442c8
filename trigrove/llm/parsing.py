"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import CHUNK_BYTES, arrow_schema, cut, mix, partitions, prefix_hash, range_hash, read, released, written

#: Levels of the hierarchy, the levels whose phrase names are kept (phrases of about 9 and 27 bytes), slots, bits a slot.
LEVELS, KEPT, SLOTS, BITS = 3, (2, 3), 64, 12
EMPTY = "zzz"
#: Documents of one bucket of the order by doc_id, at least.
BUCKET_ROWS = 500
TRAILING = np.array([8] + [(k & -k).bit_length() - 1 for k in range(1, 256)], np.uint8)


def tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels, neighbours different, from symbols whose neighbours differ; a label depends on 3 symbols to its left.

    Each toss gives twice the position of the lowest bit that differs from the left neighbour's, plus that bit. The
    first symbol of a text has a neighbour that differs in bit 0.
    """
    symbols = symbols.astype(np.uint64, copy=False)
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = symbols[first] ^ np.uint64(1)
    low = symbols ^ left
    low &= np.uint64(0) - low
    at = np.bitwise_count(low - np.uint64(1))
    label = (2 * at + ((symbols >> at.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(2):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ np.uint8(1)
        at = TRAILING[label ^ left]
        label = 2 * at + ((label >> at) & 1)
    return label


def level(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's symbols (phrase names) and offsets. Texts are parsed each for itself; none is empty.

    Runs of a symbol become one symbol; then phrases begin where labels have a local minimum, and at the text's start.
    """
    begins = np.empty(len(symbols), bool)
    begins[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    begins[offsets[:-1]] = True
    at = np.flatnonzero(begins)
    runs = np.diff(at, append=len(symbols))
    plain = symbols[at]
    offsets = np.searchsorted(at, offsets)
    first = offsets[:-1]
    label = tossed(plain, first)
    low = np.empty(len(plain), bool)
    low[0], low[1:] = True, label[1:] < label[:-1]
    low[:-1] &= label[:-1] <= label[1:]
    last = offsets[1:-1] - 1  # of a text, followed by another text: only its left neighbour counts
    inner = last[last > 0]
    low[inner] = label[inner] < label[inner - 1]
    low[first] = True
    starts = np.flatnonzero(low)
    whole = plain.astype(np.uint64)
    long = runs > 1
    whole[long] = mix(whole[long] + (runs[long].astype(np.uint64) << np.uint64(40)))
    names = range_hash(prefix_hash(whole), starts, np.append(starts[1:], len(plain)))
    return names, np.searchsorted(starts, offsets)


def fingerprints(texts: list[bytes]) -> list[str]:
    """A fingerprint of each text: for each slot the least phrase name that falls there, in hexadecimal digits."""
    full = [k for k, t in enumerate(texts) if t]
    out = [EMPTY * SLOTS] * len(texts)
    if not full:
        return out
    symbols = np.frombuffer(b"".join(texts[k] for k in full), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in full])])
    least = np.full(len(full) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for n in range(1, LEVELS + 1):
        symbols, offsets = level(symbols, offsets)
        if n in KEPT:
            drawn = mix(symbols + np.uint64(n))
            of = np.repeat(np.arange(len(full)), np.diff(offsets))
            np.minimum.at(least, of * SLOTS + (drawn % np.uint64(SLOTS)).astype(np.int64), drawn // np.uint64(SLOTS))
    free = least == np.iinfo(np.uint64).max
    short = mix(least) & np.uint64((1 << BITS) - 1)
    digits = np.array([f"{k:03x}" for k in range(1 << BITS)] + [EMPTY])[np.where(free, 1 << BITS, short.astype(np.int64))].reshape(-1, SLOTS)
    for k, row in zip(full, digits.tolist(), strict=True):
        out[k] = "".join(row)
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those that either fingerprint fills, less what chance gives; 1 for equal ones."""
    if a == b:
        return 1.0
    x = [a[k : k + 3] for k in range(0, len(a), 3)]
    y = [b[k : k + 3] for k in range(0, len(b), 3)]
    used = [(p, q) for p, q in zip(x, y, strict=True) if p != EMPTY or q != EMPTY]
    same = sum(p == q for p, q in used) / len(used)
    return max(0.0, (same - 2**-BITS) / (1 - 2**-BITS))


def edited(text: str, following: str) -> str:
    """The text with its last third (code points, rounded down) replaced by the first as many of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The fingerprint of every whole text and of its edited text, with their likeness to each other and to the next text's.

    The next document is that of the next smaller doc_id, after the smallest the largest; a sole document follows
    itself. Null texts count as empty; null ids come last; rows of one id follow each other by a hash of their text.
    Documents are dealt into ranges of the id; the first of each range is also sent to the range that it follows, so
    each text moves once. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("text"))
    ids = written(rows.select("key", "draw"), "parsing-ids")
    n = ids.count()
    buckets = int(max(1, min(n // bucket_rows, 4 * partitions(spark))))
    cuts = ids.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)] or [0.5], F.lit(100 * buckets + 1000))).first()[0] or []
    cuts = np.unique(np.array(cuts if buckets > 1 else [], np.int64))

    def bucket_of(keys: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, keys.to_numpy(), "left").astype(np.int32)

    def tops(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column("key"))), b.column("key"), b.column("draw")], schema=arrow_schema("bucket int, key long, draw long"))

    first = {r["bucket"]: (r["m"]["key"], r["m"]["draw"]) for r in ids.mapInArrow(tops, "bucket int, key long, draw long").groupBy("bucket").agg(F.max(F.struct("key", "draw")).alias("m")).collect()}
    used = sorted(first)  # at most a row for each range
    before = {b: used[(k + 1) % len(used)] for k, b in enumerate(used)}

    def deal(batches):
        target = arrow_schema("bucket int, ghost int, key long, draw long, doc_id long, text string")
        for batch in batches:
            for b in cut(batch, 4 * CHUNK_BYTES):
                at = bucket_of(b.column("key"))
                keys, draws = b.column("key").to_numpy(), b.column("draw").to_numpy()
                twin = [k for k in range(len(at)) if first[int(at[k])] == (int(keys[k]), int(draws[k]))]
                rows = [b.column(c) for c in ("key", "draw", "doc_id", "text")]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int32)), *rows], schema=target)
                if twin:
                    to = pa.array([before[int(at[k])] for k in twin], pa.int32())
                    yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(twin), np.int32)), *(r.take(pa.array(twin)) for r in rows)], schema=target)

    def run(batches):
        target = arrow_schema(SCHEMA)
        pending: list[tuple[int, int, int | None, str]] = []
        held = 0

        def done(last: bool):
            """Results of all pending rows but those whose next row isn't there yet."""
            nonlocal pending, held
            work = []
            for k, (bucket, ghost, doc_id, text) in enumerate(pending):
                if not ghost and k + 1 < len(pending):
                    if pending[k + 1][0] != bucket:
                        raise ValueError("a range of documents lacks its follower")
                    work.append((doc_id, text, pending[k + 1][3]))
            pending = [] if last else pending[-1:]
            held = sum(len(p[3]) for p in pending)
            if not work:
                return None
            changed = [edited(t, f).encode() for _, t, f in work]
            own = fingerprints([t.encode() for _, t, _ in work] + [work[-1][2].encode()])
            # rows follow each other within a range, so most followers' fingerprints are there already
            near = [own[k + 1] if k + 1 == len(work) or work[k + 1][1] == work[k][2] else fingerprints([work[k][2].encode()])[0] for k in range(len(work))]
            after = fingerprints(changed)
            columns = [
                [w[0] for w in work], [len(w[1]) for w in work], [hashlib.sha256(c).hexdigest() for c in changed], own[:-1], after,
                [likeness(a, b) for a, b in zip(own, after, strict=False)], [likeness(a, b) for a, b in zip(own, near, strict=False)],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for row in zip(batch.column("bucket").to_pylist(), batch.column("ghost").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if row[1] and pending and pending[-1][1]:
                    continue  # equal rows sent the follower more than once
                pending.append(row)
                held += len(row[3])
                if held > CHUNK_BYTES // 2 and (got := done(False)) is not None:
                    yield got
        if (got := done(True)) is not None:
            yield got

    dealt = rows.mapInArrow(deal, "bucket int, ghost int, key long, draw long, doc_id long, text string").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "ghost", F.desc("key"), F.desc("draw")).drop("key", "draw").mapInArrow(released(run), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(read(spark, sf_dir, "documents"))
