"""Removal of repeated passages by hash-compared suffix sorting of anchored windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import BASE, CHUNK_BYTES, arrow_schema, cut, delete, growing, mix, powers, prefix_hash, range_hash, range_names, read, released, text_bytes, written

#: Bytes of a repeated passage, at least, and of the grams whose least hash anchors a window of that length.
LENGTH, GRAM = 100, 32
#: Bits of a position in a segment of text, and windows of a segment at most.
PLACE, SEGMENT = 22, 1 << 19
#: Contexts that one sort holds of an anchor at most; the windows of more are grouped by their content.
CONTEXTS = 1024


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, gram hash, context digest in two halves) of the windows that begin at the ``valid`` positions of data.

    A window's anchor is the leftmost of its grams with the least hash. Consecutive windows of one anchor are one
    row: they begin at first..last, and their context is data[first : last + LENGTH]. The halves of its digest are
    hashes of different kinds, a polynomial and a scramble of eight bytes at a time, with the anchor's place mixed in.
    """
    prefix = prefix_hash(data)
    n = len(data) - GRAM + 1
    raw = (prefix[GRAM:] - prefix[:n]) * powers(n, inverse=True)
    key = raw * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    key *= np.uint64(BASE)
    key >>= np.uint64(PLACE)
    key <<= np.uint64(PLACE)
    key |= np.arange(n, dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width : n - width + 1])
    at = (least[valid] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.empty(len(at), bool)
    new[:1] = True
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, at = valid[begin], valid[np.append(begin[1:], len(valid)) - 1], at[begin]
    grams = mix(raw[at])
    place = (at - first).astype(np.uint64) * np.uint64(BASE)
    context = mix(range_hash(prefix, first, last + LENGTH) + place) ^ grams
    check = mix(range_names(data, first, last + LENGTH, 2 * LENGTH) + place)
    return at, first, last, grams, context, check


def segments(data: np.ndarray, offsets: np.ndarray):
    """(data, positions of windows, number of the text of each, position where the piece begins) of pieces up to SEGMENT."""
    if len(data) <= SEGMENT + LENGTH:
        sizes = np.diff(offsets)
        windows = np.maximum(sizes - LENGTH + 1, 0)
        if windows.sum():
            text = np.repeat(np.arange(len(sizes)), windows)
            place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            yield data, place + offsets[:-1][text], text, 0
        return
    for k in range(len(offsets) - 1):  # a long text alone, in pieces that overlap by a window
        for a in range(int(offsets[k]), int(offsets[k + 1]) - LENGTH + 1, SEGMENT):
            piece = data[a : min(a + SEGMENT + LENGTH - 1, offsets[k + 1])]
            yield piece, np.arange(len(piece) - LENGTH + 1), np.full(len(piece) - LENGTH + 1, k), a


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, c, d, rid, at): each text's anchored contexts; ``at`` packs first start, number of windows less 1, and a flag.

    c and d are the halves of the context's digest. The flag marks a context that the same text has before.
    """

    def run(batches):
        target = arrow_schema("h long, c long, d long, rid long, at long")
        for batch in batches:
            for part in cut(batch, CHUNK_BYTES // 2):
                data, offsets = text_bytes(part.column("text"))
                ids = part.column("rid").to_numpy(zero_copy_only=False)
                got = []
                for piece, valid, text, begins in segments(data, offsets):
                    _, first, last, grams, context, check = anchors(piece, valid)
                    of = text[np.searchsorted(valid, first)]
                    got.append((grams, context, check, of, begins + first - offsets[of], last - first))
                if not got:
                    continue
                grams, context, check, of, first, more = (np.concatenate(x) for x in zip(*got))
                order = np.lexsort((first, check, context, of))
                again = np.zeros(len(order), np.int64)
                again[order[1:]] = (context[order[1:]] == context[order[:-1]]) & (check[order[1:]] == check[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
                halves = [pa.array(x.view(np.int64)) for x in (grams, context, check)]
                yield pa.RecordBatch.from_arrays([*halves, pa.array(ids[of]), pa.array(first << 9 | more << 1 | again)], schema=target)

    return docs.select("rid", "text").mapInArrow(released(run), "h long, c long, d long, rid long, at long")


class SuffixSorter:
    """Sorts suffixes of ``data``, compared over LENGTH bytes at most, by mergesort with hashed comparisons.

    Equal leading parts are found by binary search on prefix hashes, so a comparison takes the logarithm of LENGTH
    steps. All merges of one round run at once: a suffix's place is its own plus the number of its sibling run's
    suffixes before it, which a second binary search finds.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.prefix = prefix_hash(data)
        self.inverse = powers(len(data) + 1, inverse=True)

    def hashed(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and at b, LENGTH at most."""
        out = np.full(len(a), LENGTH)
        open_ = np.flatnonzero(self.hashed(a, LENGTH) != self.hashed(b, LENGTH))
        a, b = a[open_], b[open_]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH - 1)
        for _ in range(LENGTH.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashed(a, mid) == self.hashed(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        out[open_] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b; of equal ones, where ``ties``."""
        n = self.common(a, b)
        return np.where(n == LENGTH, ties, self.data[a + n] < self.data[b + n])

    def sort(self, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, class): the order of the suffixes by group and content, and a number that equal ones of a group share.

        A first pass compares eight bytes as one number; suffixes that tie there are merged.
        """
        lead = np.zeros(len(starts), np.uint64)
        for k in range(8):
            lead = lead << np.uint64(8) | self.data[starts + k]
        order = np.lexsort((lead, group))
        tie = np.ones(len(order), bool)
        tie[1:] = (lead[order[1:]] != lead[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
        begin = np.flatnonzero(tie)
        size = np.diff(begin, append=len(order))
        of = np.repeat(np.arange(len(begin)), size)
        step = 0
        while len(size) and (1 << step) < size.max():
            run = 1 << step
            here = np.flatnonzero(size[of] > run)  # places in classes that still have runs to merge
            base, end = begin[of[here]], begin[of[here]] + size[of[here]]
            rank = here - base
            right = (rank >> step) & 1
            sibling = base + (((rank >> step) ^ 1) << step)
            low, high = np.zeros(len(here), np.int64), np.clip(end - sibling, 0, run)
            mine = starts[order[here]]
            while len(todo := np.flatnonzero(low < high)):
                mid = (low[todo] + high[todo]) >> 1
                less = self.before(starts[order[sibling[todo] + mid]], mine[todo], right[todo].astype(bool))
                low[todo] = np.where(less, mid + 1, low[todo])
                high[todo] = np.where(less, high[todo], mid)
            place = base + ((rank >> (step + 1)) << (step + 1)) + (rank & (run - 1)) + low
            moved = order[here]
            order = order.copy()
            order[place] = moved
            step += 1
        differs = np.ones(len(order), bool)
        inner = np.flatnonzero(~tie)
        a, b = starts[order[inner - 1]], starts[order[inner]]
        equal = self.hashed(a, LENGTH) == self.hashed(b, LENGTH)
        span = np.arange(LENGTH)
        for k in range(0, len(inner), 1 << 15):  # equal hashes are verified byte by byte
            part = np.flatnonzero(equal[k : k + (1 << 15)]) + k
            equal[part] = (self.data[a[part][:, None] + span] == self.data[b[part][:, None] + span]).all(1)
        differs[inner[equal]] = False
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(differs)
        return order, number


def repeated(contexts: list[bytes], keys: np.ndarray, rid: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(rid, start, end) covered in texts by windows of these contexts that occur earlier in a context of the same key."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    _, number = SuffixSorter(data).sort(begin[of] + inside, keys[of])
    place = first[of] + inside
    order = np.lexsort((place, rid[of], number))
    head = np.ones(len(order), bool)
    head[1:] = number[order[1:]] != number[order[:-1]]
    later = np.ones(len(order), bool)
    later[order[head]] = False
    # one context's windows that follow each other make one interval
    hit = np.flatnonzero(later)
    if not len(hit):
        return []
    cut_at = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
    start, stop = hit[cut_at], hit[np.append(cut_at[1:], len(hit)) - 1]
    return list(zip(rid[of[start]].tolist(), place[start].tolist(), (place[stop] + LENGTH).tolist(), strict=True))


def compared(contexts: DataFrame) -> DataFrame:
    """(rid, s, e): the repeats among the contexts (h, rid, first, context) of each key h."""

    def run(batches):
        target = arrow_schema("rid long, s long, e long")
        key, rows, ready, held = None, [], [], 0

        def out(last: bool):
            nonlocal ready, held
            if last and len(rows) > 1:
                ready += rows
            if not ready:
                return None
            keys = np.unique(np.array([r[0] for r in ready], np.int64), return_inverse=True)[1]
            found = repeated([r[3] for r in ready], keys, np.array([r[1] for r in ready], np.int64), np.array([r[2] for r in ready], np.int64))
            ready, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], schema=target)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "first", "context")), strict=True):
                if row[0] != key:
                    if len(rows) > 1:
                        ready += rows
                        held += sum(len(r[3]) for r in rows)
                    if held > CHUNK_BYTES // 2 and (got := out(False)) is not None:
                        yield got
                    key, rows = row[0], []
                rows.append(row)
        if (got := out(True)) is not None:
            yield got

    return contexts.repartition("h").sortWithinPartitions("h", "rid", "first").mapInArrow(released(run), "rid long, s long, e long")


def covers(docs: DataFrame) -> DataFrame:
    """(rid, s, e): intervals of bytes whose union is what 100-byte strings cover that also start earlier.

    Any such string has an anchor, whose gram its earlier copy shares; so only grams that occur twice matter. Where all
    contexts of a gram have one 128-bit digest, the first text's is kept and the others are covered whole. Else contexts
    of one digest are put together, and one of each is compared with the gram's others, window by window, by sorting
    suffixes. Windows of a gram with over CONTEXTS different contexts are grouped by their bytes instead.
    """
    begins, more, again = F.shiftright("at", 9), F.shiftright(F.col("at").bitwiseAND(0x1FE), 1), F.col("at").bitwiseAND(1)
    ends = [F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("d").alias("d1"), F.max("d").alias("d2")]
    shared = occurrences(docs).groupBy("h").agg(F.min("rid").alias("first_rid"), *ends, F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("h", "first_rid", F.expr("c1 <> c2 OR d1 <> d2").alias("several")), "suffixes-shared")
    found = written(occurrences(docs).join(growing(shared), "h"), "suffixes-found")
    whole = [begins.alias("s"), (begins + more + LENGTH).alias("e")]
    plain = found.where((again == 1) | (~F.col("several") & (F.col("rid") != F.col("first_rid")))).select("rid", *whole)
    several = found.where(F.col("several") & (again == 0)).select("h", "c", "d", "rid", "at")
    kinds = written(several.groupBy("h", "c", "d").agg(F.min(F.struct("rid", "at")).alias("m"), F.count("*").alias("n")).select("h", "c", "d", "m.rid", "m.at", "n"), "suffixes-kinds")
    copies = several.join(growing(kinds.where("n > 1").select("h", "c", "d", F.col("rid").alias("own"))), ["h", "c", "d"]).where("rid <> own").select("rid", *whole)
    sizes = written(kinds.groupBy("h").agg(F.count("*").alias("m")).where(f"m > {CONTEXTS}").select("h", F.lit(True).alias("hot")), "suffixes-hot")
    wanted = kinds.join(sizes, "h", "left").select("rid", F.struct("h", begins.alias("first"), more.alias("more"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("w"))  # no more than the text has room for
    fetched = docs.select("rid", "text").join(growing(wanted), "rid").select("rid", "text", F.col("w.h").alias("hs"), F.col("w.first").alias("firsts"), F.col("w.more").alias("mores"), F.col("w.hot").alias("hots"))

    def fetch(batches):
        target = arrow_schema("h long, rid long, first long, context binary")
        for batch in batches:
            for part in cut(batch, 2 * CHUNK_BYTES):
                for rid, text, hs, firsts, mores, hots in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "hs", "firsts", "mores", "hots")), strict=True):
                    data, rows = text.encode(), []
                    for h, first, more, hot in zip(hs, firsts, mores, hots, strict=True):
                        if hot:  # its windows one by one, without the key
                            rows.extend((None, rid, k, data[k : k + LENGTH]) for k in range(first, first + more + 1))
                        else:
                            rows.append((h, rid, first, data[first : first + more + LENGTH]))
                        if len(rows) > 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), target)], schema=target)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), target)], schema=target)

    contexts = fetched.mapInArrow(released(fetch), "h long, rid long, first long, context binary")
    hot = sizes.limit(1).count() > 0
    if hot:
        contexts = written(contexts, "suffixes-contexts")
    apart = compared(contexts.where("h IS NOT NULL"))
    if hot:
        windows = contexts.where("h IS NULL").select("context", "rid", "first")
        earliest = windows.groupBy("context").agg(F.min(F.struct("rid", "first")).alias("m"), F.count("*").alias("n")).where("n > 1")
        earliest = written(earliest.select("context", F.col("m.rid").alias("rid0"), F.col("m.first").alias("first0")), "suffixes-earliest")
        later = windows.join(growing(earliest), "context").where("rid <> rid0 OR first <> first0")
        apart = apart.unionByName(later.select("rid", F.col("first").alias("s"), (F.col("first") + LENGTH).alias("e")))
    out = written(plain.unionByName(copies).unionByName(apart), "suffixes-covers")
    delete(shared, found, kinds, sizes)
    if hot:
        delete(contexts, earliest)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``rid``: the doc_id, or where ids are null or repeat, numbers in the order of id (null last) and text hash."""
    check = docs.agg(F.count("*"), F.count("doc_id")).first()
    if check[0] == check[1] and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.withColumn("rid", F.col("doc_id").cast("long"))
    ordered = docs.withColumn("_draw", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_last(), "_draw").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "_draw")
    return written(ordered.drop("_draw").withColumn("rid", F.monotonically_increasing_id()), "suffixes-rows")


def merged(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def spans(docs: DataFrame) -> DataFrame:
    """docs with ``rid`` and ``cuts``: sorted, disjoint byte intervals [s, e) that repeat something earlier; null for none.

    Texts are UTF-8 bytes; null counts as empty, and texts of fewer than LENGTH bytes have no cuts. Equal texts of
    rows that share an id are ordered arbitrarily. An empty table gives no rows.
    """
    own = numbered(docs)
    texts = own.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    by_text = covers(texts).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    return own.join(growing(by_text), "rid", "left")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = spans(docs.select("doc_id", "text")).select("doc_id", "text", F.col("cuts.s").alias("ss"), F.col("cuts.e").alias("es"))

    def run(batches):
        target = arrow_schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        for batch in batches:
            out = []
            for doc_id, text, ss, es in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ss", "es")), strict=True):
                data = (text or "").encode()
                gone = merged(list(zip(ss or [], es or [], strict=True)))
                out.append((doc_id, len(data), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept_bytes(data, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), target)], schema=target) if out else pa.RecordBatch.from_pylist([], schema=target)

    return rows.mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_bytes(data: bytes, gone: list[list[int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def query(spark, sf_dir: str) -> DataFrame:
    return digested(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages, n_chars counted anew; documents of which nothing is left go.

    A cut inside a character takes the whole character. Documents that were empty before stay.
    """
    rows = spans(docs)
    columns = docs.columns
    pack = rows.select(*[F.col(f"`{c}`") for c in columns], F.col("cuts.s").alias("_ss"), F.col("cuts.e").alias("_es"))

    def trim(text, ss, es):
        import pandas as pd

        out = []
        for t, a, b in zip(text, ss, es, strict=True):
            if t is None or a is None:
                out.append(t)
            else:
                out.append(kept_bytes(t.encode(), merged(list(zip(a, b, strict=True)))).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    trimmed = F.pandas_udf(trim, "string")
    changed = pack.where("_ss IS NOT NULL").withColumn("text", trimmed("text", "_ss", "_es")).where(F.trim("text") != "")
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return changed.unionByName(pack.where("_ss IS NULL")).select(*[F.col(f"`{c}`") for c in columns])


#: The operator's rows in DuckDB SQL: windows as hexadecimal text, cut from pieces so that none is far into its string.
SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (
  SELECT doc_id, c * 256 AS base, substr(x, c * 512 + 1, 512 + 198) AS piece
  FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2 + 255) // 256)) AS c FROM t)),
windows AS (
  SELECT doc_id, base + k AS k, substr(piece, 2 * k + 1, 200) AS w
  FROM (SELECT doc_id, base, piece, unnest(range(0, least(256, length(piece) // 2 - 99))) AS k FROM pieces)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS place FROM windows) WHERE place > 1),
begun AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM later),
spans AS (
  SELECT doc_id, min(k) AS s, max(k) + 100 AS e
  FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM begun) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(s) FROM spans GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS left_
  FROM gaps JOIN t USING (doc_id) GROUP BY t.doc_id),
totals AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS n FROM spans GROUP BY doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(left_, x))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""
