"""Embedding near-duplicates: coarse inverted lists, product-quantised residuals, table-lookup distances, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import arrow_schema, components, delete, growing, mix, read, released, sample_of, written

THRESHOLD = 0.95
#: Vectors that centroids and codebooks are fitted on at most (the smallest hashes; a documented bound).
FIT_ROWS = 20_000
#: Vectors for each coarse list, about.
LIST_ROWS = 128
#: Subspaces of the residual codes and codewords of each.
SUBSPACES, CODEWORDS = 16, 64
#: Rows that one block of lists holds, about, and blocks that there are at least where lists suffice. A hot list has
#: many blocks; each block is compared in a task's memory.
BLOCK_ROWS, BLOCKS = 2048, 48


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds; empty clusters get random rows."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def along(c: np.ndarray) -> np.ndarray:
    """An order of the rows of c in which near rows are near: halves along the direction of most variance."""
    if len(c) < 3:
        return np.arange(len(c))
    x = c - c.mean(0)
    v = x[(x * x).sum(1).argmax()]
    for _ in range(4):
        v = (x @ v) @ x
        v = v / max(float(np.sqrt(v @ v)), 1e-30)
    order = (x @ v).argsort(kind="stable")
    low, high = np.split(order, [len(c) // 2])
    return np.concatenate([low[along(c[low])], high[along(c[high])]])


@dataclass
class Index:
    """Coarse centroids and a codebook for each subspace of the residuals."""

    coarse: np.ndarray
    books: np.ndarray  # subspace, codeword, dimension

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        residual = x - self.coarse[at]
        width = self.books.shape[2]
        return np.stack([nearest(residual[:, m * width : (m + 1) * width], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def back(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each query with every codeword: subspace, codeword, query. They serve for all lists."""
        return np.einsum("mkd,qmd->mkq", self.books, x.reshape(len(x), len(self.books), -1), optimize=True)

    def reachable(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether each list can hold a vector within ``reach`` of each query, and the query's squared distance to it.

        A list's vectors lie within its radius of its centroid, and on that side of the plane halfway to the
        query's own centroid. Margins are far above the errors of single precision.
        """
        c, mine = self.coarse[lists], self.coarse[own]
        norm = (c * c).sum(1)
        far = np.maximum((x * x).sum(1)[:, None] + norm - 2 * (x @ c.T), 0)
        apart = np.sqrt(np.maximum((mine * mine).sum(1)[:, None] + norm - 2 * (mine @ c.T), 0))
        beyond = far - ((x - mine) ** 2).sum(1)[:, None] <= 2 * reach * apart + 4e-3
        return beyond & (np.sqrt(far) <= reach + radius[lists] + 2e-3), far


def fit(x: np.ndarray, lists: int, seed: int = 7) -> Index:
    """An index of the rows of x, which have unit length. Dimensions must be a multiple of the subspaces."""
    rng = np.random.default_rng(seed)
    coarse = kmeans(x, lists, 8, rng)
    coarse = coarse[along(coarse)]
    at = nearest(x, coarse)
    residual = x - coarse[at]
    parts = SUBSPACES if x.shape[1] % SUBSPACES == 0 else 1
    width = x.shape[1] // parts
    books = np.stack([kmeans(residual[:, m * width : (m + 1) * width], CODEWORDS, 8, rng) for m in range(parts)])
    return Index(coarse, books)


def unit(rows) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of equally long lists."""
    x = np.asarray(rows, np.float64)
    return x, x / np.sqrt((x * x).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> DataFrame:
    """(least, n, embedding) of each distinct usable vector: not null, finite, not zero, grouped with equal copies."""
    usable = vectors.where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    # -0.0 is 0.0
    plain = usable.select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("embedding"))
    return plain.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))


def forest(i: np.ndarray, j: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components as those between i of ``left`` nodes and j of ``right`` nodes after them."""
    label, j = np.arange(left + right), j + left
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(label)))
            return moved, label[moved]
        label = new


ROWS = "block int, role int, list int, rep long, n long, embedding array<double>"


def pairs(reps: DataFrame, index: Index, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of all pairs of equally long representatives with cosine >= threshold: rows (a, b, null) that link the same
    components, and rows (a, null, n) whose sum over a is the number of rows that representative a links with.

    Every list that can hold a linked vector is asked, so no pair is left out. Lists lie in blocks, and of two blocks
    one asks the other.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def settle(batches):
        target = arrow_schema("list int, far double, rep long, n long, embedding array<double>")
        for batch in batches:
            if batch.num_rows:
                u = unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))[1].astype(np.float32)
                own = nearest(u, index.coarse)
                far = np.sqrt(((u - index.coarse[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far, pa.float64()), *(batch.column(k) for k in ("rep", "n", "embedding"))], schema=target)

    rows = written(reps.select("rep", "n", "embedding").mapInArrow(released(settle), "list int, far double, rep long, n long, embedding array<double>"), "vectors-lists")
    radius, size = np.zeros(len(index.coarse), np.float32), np.zeros(len(index.coarse), np.int64)
    for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("size")).collect():  # at most a row for each list
        radius[r["list"]], size[r["list"]] = r["far"], r["size"]
    filled = np.flatnonzero(size)
    room = max(1, min(block_rows, -(-int(size.sum()) // BLOCKS)))
    # lists that follow each other share a block while there is room; a list of more rows than that has several
    first, held = [], room + 1
    for k, n in enumerate(size[filled].tolist()):
        if held + n > room:
            first.append(k)
            held = 0
        held += n
    splits = np.maximum(1, -(-np.add.reduceat(size[filled], first) // room)) if first else np.zeros(0, int)
    group = np.zeros(len(size), int)
    group[filled] = np.searchsorted(first, np.arange(len(filled)), "right") - 1
    base = np.cumsum(splits) - splits
    blocks = np.arange(int(splits.sum()))

    def spread(batches):
        """Each vector as a row of its own block, and as a query of every block that it asks."""
        target = arrow_schema(ROWS)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                own, rep = (part.column(k).to_numpy() for k in ("list", "rep"))
                at = group[own]
                home = base[at] + (mix(rep.astype(np.uint64)) % splits[at].astype(np.uint64)).astype(int)
                ok, _ = index.reachable(unit(x)[1].astype(np.float32), own, filled, radius, reach)
                asked = np.repeat(np.logical_or.reduceat(ok, first, axis=1), splits, axis=1)
                # of two blocks, the lower one asks where their sum is even
                asked &= (home[:, None] < blocks) ^ ((home[:, None] + blocks) % 2 == 1)
                asked[np.arange(len(x)), home] = False
                who, which = np.nonzero(asked)
                who, which = np.concatenate([np.arange(len(x)), who]), np.concatenate([home, which])
                role = np.repeat([0, 1], [len(x), len(who) - len(x)])
                step = max(1, (1 << 23) // (8 * x.shape[1]))
                for a in range(0, len(who), step):
                    w = who[a : a + step]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(w) + 1) * x.shape[1], x.shape[1], dtype=np.int32)), pa.array(x[w].ravel()))
                    ids = [part.column(k).take(pa.array(w)) for k in ("list", "rep", "n")]
                    yield pa.RecordBatch.from_arrays([pa.array(which[a : a + step], pa.int32()), pa.array(role[a : a + step], pa.int32()), *ids, vectors], schema=target)

    def compare(batches):
        target = arrow_schema("a long, b long, n long")
        key, waiting, own = None, [], None

        def counted(ids, counts):
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some].astype(np.int64))], schema=target)

        def finish():
            """The block's rows, sorted by list, with codes and all that doesn't depend on the query."""
            nonlocal own, waiting
            at, ids, n, u = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting = []
            order = at.argsort(kind="stable")
            at, ids, n, u = at[order], ids[order], n[order], u[order]
            low = u.astype(np.float32)
            codes = index.codes(low, at)
            back = index.back(codes)
            known = (back * back).sum(1) + 2 * (back * index.coarse[at]).sum(1)
            # a linked vector is within reach, so its code is within reach and the code's own error
            cut = (reach + np.sqrt(((low - index.coarse[at] - back) ** 2).sum(1))) ** 2 + 2e-3
            lists, starts = np.unique(at, return_index=True)
            own = (at, ids, n, u, codes, known, cut, lists, [*starts.tolist(), len(at)], np.zeros(len(at)))

        def ask(q_at, q_ids, q_n, q, within):
            at, ids, n, u, codes, known, cut, lists, starts, counts = own
            for a in range(0, len(q), 1024):
                x, x_ids, x_n = q[a : a + 1024], q_ids[a : a + 1024], q_n[a : a + 1024]
                low = x.astype(np.float32)
                ok, far = index.reachable(low, q_at[a : a + 1024], lists, radius, reach)
                tables = 2 * index.tables(low)
                found, link_a, link_b = np.zeros(len(x)), [], []
                for k in np.flatnonzero(ok.any(0)).tolist():
                    s, e = starts[k], starts[k + 1]
                    pick = np.flatnonzero(ok[:, k])
                    if 2 * len(pick) > len(x):
                        pick, t = np.arange(len(x)), tables
                    else:
                        t = tables[:, :, pick]
                    for b in range(s, e, 512):
                        end = min(e, b + 512)
                        d = known[b:end, None] + far[pick, k]
                        for m in range(len(t)):
                            d -= t[m].take(codes[b:end, m], axis=0)
                        near = d <= cut[b:end, None]
                        if np.count_nonzero(near) * 16 > near.size:
                            g = u[b:end] @ x[pick].T
                            near = g >= threshold - 1e-9
                            j, i = np.nonzero(near)
                            sure = g[j, i] >= threshold + 1e-9
                        else:
                            j, i = np.nonzero(near)
                            sure = np.zeros(len(j), bool)
                        j, i = j + b, pick[i]
                        for c in range(0, len(j), 65536):
                            y = c + np.flatnonzero(~sure[c : c + 65536])
                            sure[y] = np.einsum("ij,ij->i", x[i[y]], u[j[y]]) >= threshold
                        j, i = j[sure], i[sure]
                        if within:
                            fresh = ids[j] != x_ids[i]
                            j, i = j[fresh], i[fresh]
                        else:
                            counts += np.bincount(j, x_n[i], len(u))
                        found += np.bincount(i, n[j], len(x))
                        if len(j) > 2 * (end - b + len(x)):
                            both = np.concatenate([ids[b:end], x_ids])
                            v, w = forest(j - b, i, end - b, len(x))
                            link_a.append(both[v])
                            link_b.append(both[w])
                        else:
                            link_a.append(x_ids[i])
                            link_b.append(ids[j])
                yield counted(x_ids, found)
                if link_a:
                    v, w = np.concatenate(link_a), np.concatenate(link_b)
                    fresh = v != w
                    v, w = v[fresh], w[fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v, w)), pa.array(np.maximum(v, w)), pa.nulls(len(v), pa.int64())], schema=target)

        def begin():
            finish()
            yield from ask(*own[:4], True)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, role, at, ids, n = (batch.column(k).to_numpy() for k in ("block", "role", "list", "rep", "n"))
            u = unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))[1]
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(role) != 0)) + 1).tolist(), len(ids)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if block[s] != key:
                    if waiting:
                        yield from begin()
                    if own is not None:
                        yield counted(own[1], own[-1])
                    key, own = block[s], None
                if role[s] == 0:
                    waiting.append((at[s:e], ids[s:e], n[s:e], u[s:e]))
                    continue
                if waiting:
                    yield from begin()
                if own is not None:  # a hot list's block may have got no rows
                    yield from ask(at[s:e], ids[s:e], n[s:e], u[s:e], False)
        if waiting:
            yield from begin()
        if own is not None:
            yield counted(own[1], own[-1])

    dealt = rows.select("list", "rep", "n", "embedding").mapInArrow(released(spread), ROWS)
    found = written(dealt.repartition("block").sortWithinPartitions("block", "role").mapInArrow(released(compare), "a long, b long, n long"), "vectors-links")
    delete(rows)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``: lists are left out
    and codes cut by bounds only, so all such pairs are found. Vectors of each length are indexed for themselves and
    link among themselves only. Null or zero vectors and those with null or non-finite components link with nothing.
    Rows with a null vec_id have null links. Repeated rows with the same vec_id and vector count as copies; rows of one
    vec_id with different vectors (of two models, say) have links and components of their own.
    """
    spark = vectors.sparkSession
    own = written(vectors.select("vec_id", "embedding"), "vectors-input")
    # a vec_id may have several vectors, so classes have keys of their own
    reps = written(classes(own).withColumn("rep", F.monotonically_increasing_id()), "vectors-reps")
    lengths = {r[0]: r[1] for r in reps.groupBy(F.size("embedding")).count().collect()}
    found = spark.createDataFrame([], "a long, b long, n long")
    for dims, count in sorted(lengths.items()):
        if count < 2:
            continue  # nothing to link with
        fitting = reps.where(F.size("embedding") == dims)
        sample = sample_of(fitting, fit_rows, "least").select("embedding").toPandas()["embedding"]
        lists = int(max(1, min(4096, -(-count // list_rows))))
        index = fit(unit(np.stack(list(sample)))[1].astype(np.float32), lists)
        found = found.unionByName(pairs(fitting, index, threshold))
    links = found.where("b IS NOT NULL").select("a", "b")
    others = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    if lengths:
        reached = written(components(spark, links, "vectors").withColumnRenamed("id", "rep"), "vectors-reached")
        reached = reached.unionByName(reached.select(F.col("component").alias("rep"), "component").distinct())  # each component's own key
        reached = written(reached.join(growing(reps.select("rep", "least")), "rep"), "vectors-components")
        # written, so that the join has two plain exchanges and Spark splits a large component's rows
        first = written(reached.groupBy(F.col("component").alias("_key")).agg(F.min("least").alias("_least")), "vectors-least")
        reached = reached.join(growing(first), F.col("component") == F.col("_key")).select("rep", F.col("_least").alias("component"))
    else:
        reached = spark.createDataFrame([], "rep long, component long")
    by_class = reps.join(others, "rep", "left").join(reached, "rep", "left")
    by_class = written(by_class.select("embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "vectors-classes")
    # copies of one vector are many: the join's sides are dealt by Spark, which splits a hot vector
    plain = own.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") + 0.0))
    joined = plain.join(growing(by_class), "embedding", "left")
    own_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = joined.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), own_id.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: The operator's rows in DuckDB SQL.
SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
firsts AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, v.vec_id)::BIGINT AS component_id, coalesce(least, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN firsts f ON f.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
