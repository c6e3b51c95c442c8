"""Exact Jaccard join of documents on word shingles, with skipping by index blocks and by answers already known."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import arrow_schema, components, contracted, cut, delete, growing, map_arrow, mix, prefiltered, read, released, shingles, text_bytes, written

#: Link at 100 * intersection >= PERCENT * union of shingles of WIDTH words.
PERCENT, WIDTH = 75, 5
#: A link of two sets is missed by their keys with a probability of at most 2 ** -BITS (as hash collisions are).
BITS = 44
#: Frequent shingles that come last in every set's order: those seen LEAST times or more, HOT of them at most.
HOT, LEAST, WINDOW = 65_536, 32, 16 << 20
#: Hashes of the sample that a set carries along, and how many two linked sets have in common at least (but for a chance under 2 ** -42).
SAMPLE, COMMON = 48, 12
#: Sets that a task compares at once of one key's list; the lists of more are dealt out in blocks.
LIST = 1024
#: Sets that one comparison holds at most of either side, and hashes in them (a larger set is a block of its own).
BLOCK, HASHES = 1024, 1 << 19


def prefix_length(n: int, frequent: int) -> int:
    """Keys of a set of n shingles, of which ``frequent`` are frequent and come last.

    Any two linked sets share one of their first n - ceil(0.75 n) + 1 shingles. When most shingles aren't frequent,
    fewer do: their order is random, and of the first shingles of the union each is unshared with a probability of
    at most a third of n over those that aren't frequent.
    """
    exact = n - -(-PERCENT * n // 100) + 1
    plain = n - frequent
    unshared = n * (100 - PERCENT) / PERCENT
    if plain <= unshared:
        return exact
    return min(exact, math.ceil(BITS / math.log2(plain / unshared)))


def sets_of(column: pa.Array) -> list[np.ndarray]:
    return shingles(*text_bytes(column), WIDTH)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n, sig1, sig2, shingles): each document's set as sorted 64-bit hashes, its size and 128 bits that
    stand for it. ``name`` is a hash of the text as it is."""

    def run(batch: pa.RecordBatch) -> dict:
        s = sets_of(batch.column("text"))
        return {
            "doc_id": batch.column("doc_id"), "name": batch.column("name"), "n": [len(x) for x in s],
            "sig1": np.array([np.bitwise_xor.reduce(mix(x)) if len(x) else 0 for x in s], np.uint64).view(np.int64),
            "sig2": np.array([mix(x + np.uint64(77)).sum(dtype=np.uint64) if len(x) else 0 for x in s], np.uint64).view(np.int64),
            "shingles": pa.array([x.tobytes() for x in s], pa.binary()),
        }

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("name")), run, "doc_id long, name long, n long, sig1 long, sig2 long, shingles binary")


def sets_in(column: pa.Array) -> list[np.ndarray]:
    """The sets of a column of ``hashed``."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def frequent_shingles(sets: DataFrame, most: int = HOT, least: int = LEAST) -> np.ndarray:
    """The most frequent shingles, rarest first, ``most`` at most: only an order, so results don't depend on them.

    Each task counts the distinct sets of WINDOW bytes at a time and passes on what occurs 4 times.
    """

    def count(batches):
        target = arrow_schema("shingle long, n long")
        held, seen, size = [], set(), 0

        def out():
            if not held:
                return None
            found, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], schema=target)

        for batch in batches:
            for part in cut(batch, 1 << 20):
                for s in sets_in(part.column("shingles")):
                    if len(s) and (key := (len(s), int(s[0]), int(s[-1]), int(np.bitwise_xor.reduce(s)))) not in seen:
                        seen.add(key)
                        held.append(s)
                size += part.nbytes
                if size > WINDOW:
                    yield out()
                    held, seen, size = [], set(), 0
        if (got := out()) is not None:
            yield got

    total = sets.select("shingles").mapInArrow(released(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    total = written(total, "jaccard-frequent")
    # the least count of which there are no more than ``most``, from counts by powers of 1.1
    steps = total.groupBy(F.floor(F.log("n") / math.log(1.1)).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    room, cut_off = most, None
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        cut_off = r["step"]
    if cut_off is None:
        return np.zeros(0, np.uint64)
    top = total.where(F.floor(F.log("n") / math.log(1.1)) >= cut_off).toPandas()  # at most HOT rows
    top = top.sort_values(["n", "shingle"])
    delete(total)
    return top["shingle"].to_numpy(np.int64).view(np.uint64)


def keyed(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(rid, n, keys, sample): the keys of each set with at least one shingle, and a sample of its hashes."""
    order = np.argsort(frequent)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most HOT pairs

    def run(batch: pa.RecordBatch) -> dict:
        known, rank = shared.value
        keys, samples = [], []
        for s in sets_in(batch.column("shingles")):
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = known[at] == s
                k = prefix_length(len(s), int(hit.sum()))
                plain = s[~hit]
                first = plain[:k]
                if len(first) < k:
                    hot = s[hit]
                    first = np.concatenate([first, hot[np.argsort(rank[at[hit]], kind="stable")][: k - len(first)]])
            else:
                first = s[: prefix_length(len(s), 0)]
            keys.append(first.view(np.int64))
            samples.append((s[:SAMPLE] >> np.uint64(33)).astype(np.int32))
        return {"rid": batch.column("rid"), "n": batch.column("n"), "keys": pa.array(keys, pa.list_(pa.int64())), "sample": pa.array(samples, pa.list_(pa.int32()))}

    return map_arrow(sets.select("rid", "n", "shingles"), run, "rid long, n long, keys array<long>, sample array<int>")


class Forest:
    """Union-find over 0..n-1; ``join`` tells whether it united two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near_in_list(sizes: np.ndarray, values: np.ndarray, begin: np.ndarray, side: np.ndarray, tree: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the members of a job whose samples and sizes allow a link.

    Member k's sample is values[begin[k]:begin[k + 1]]. Where both sides have members, only members of different sides are
    compared. Members of one tree, or joined by edges, aren't.
    """
    m = len(sizes)
    need = np.minimum(COMMON, (0.4 * sizes).astype(int))
    forest, edges = Forest(m), []
    _, at, of = np.unique(tree, return_index=True, return_inverse=True)
    for k in range(m):
        forest.join(k, int(at[of[k]]))
    two = bool(side.min() != side.max())
    owner = np.repeat(np.arange(m), np.diff(begin))
    order = np.argsort(values, kind="stable")
    listed, owner = values[order], owner[order]
    for k in range(m - 1):
        mine = values[begin[k] : begin[k + 1]]
        a, b = np.searchsorted(listed, mine, "left"), np.searchsorted(listed, mine, "right")
        span = b - a
        places = np.repeat(a - (np.cumsum(span) - span), span) + np.arange(span.sum())
        common = np.bincount(owner[places], minlength=m)
        possible = (common >= np.minimum(need, need[k])) & (100 * np.minimum(sizes, sizes[k]) >= PERCENT * np.maximum(sizes, sizes[k])) & (np.arange(m) > k)
        if two:
            possible &= side != side[k]
        edges.extend((k, j) for j in np.flatnonzero(possible).tolist() if forest.join(k, j))
    return edges


JOB = ["key", "lump1", "lump2", "block1", "block2"]


def dealt(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of hot keys' lists (key, rid, n, sample) as jobs of at most two blocks of about LIST members.

    First every member is compared with the list's least one, and who may link with it is of its tree. A list of one
    tree is settled by that. In the others each large tree is a lump of blocks of its own, whose members need no
    comparison with each other, and the rest is one more lump: so a large group of near copies meets only what isn't of it.
    The trees' edges (a, b) come along.
    """
    roots = written(hot.groupBy("key").agg(F.min(F.struct("rid", "n", "sample")).alias("r")).select("key", F.col("r.rid").alias("root"), F.col("r.n").alias("root_n"), F.col("r.sample").alias("root_sample")), "jaccard-roots")
    need = F.least(F.lit(COMMON), F.floor(F.least("n", "root_n") * 0.4))
    alike = (100 * F.least("n", "root_n") >= PERCENT * F.greatest("n", "root_n")) & (F.size(F.array_intersect("sample", "root_sample")) >= need)
    star = written(contracted(hot.join(growing(roots), "key").where((F.col("rid") != F.col("root")) & alike).select(F.col("rid").alias("a"), F.col("root").alias("b"))), "jaccard-stars")
    star = star.select(F.col("u").alias("a"), F.col("v").alias("b"))
    trees = components(hot.sparkSession, star, "jaccard-trees")
    rows = hot.join(growing(trees), hot["rid"] == trees["id"], "left").select("key", "rid", "n", "sample", F.coalesce("component", "rid").alias("tree"))
    rows = written(rows, "jaccard-hot")
    sizes = rows.groupBy("key", "tree").agg(F.count("*").alias("m")).withColumn("lump", F.when(F.col("m") > LIST // 2, F.col("tree")).otherwise(-1))
    sizes = written(sizes, "jaccard-lumps")
    lumps = sizes.groupBy("key", "lump").agg(F.ceil(F.sum("m") / LIST).cast("int").alias("blocks"))
    # lumps are fewer than a list's members by LIST / 2 at least, so a list of them is small beside what it stands for
    lumps = lumps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lump", "blocks"))).alias("all"))
    meets = lumps.select("key", "all", F.explode("all").alias("one")).select("key", "one", F.explode(F.filter("all", lambda x: (x["lump"] > F.col("one.lump")) | ((x["lump"] == -1) & (F.col("one.lump") == -1)))).alias("two"))
    visits = [F.col("one.lump").alias("lump1"), F.col("two.lump").alias("lump2")]
    first = meets.select("key", F.col("one.lump").alias("lump"), *visits, F.col("one.blocks").alias("own"), F.col("two.blocks").alias("others"), F.lit(0).alias("side"))
    second = meets.where("one.lump < two.lump").select("key", F.col("two.lump").alias("lump"), *visits, F.col("two.blocks").alias("own"), F.col("one.blocks").alias("others"), F.lit(1).alias("side"))
    visits = written(first.unionByName(second), "jaccard-meets")
    placed = written(rows.join(growing(sizes.select("key", "tree", "lump")), ["key", "tree"]), "jaccard-placed")
    out = placed.join(growing(visits), ["key", "lump"]).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("own")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    within = F.col("lump1") == F.col("lump2")
    block1 = F.when(within, F.least("mine", "other")).when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other"))
    block2 = F.when(within, F.greatest("mine", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    side = F.when(within & (F.col("mine") > F.col("other")), 1).otherwise(F.col("side"))
    return out.select("key", "lump1", "lump2", block1.alias("block1"), block2.alias("block2"), side.alias("side"), "rid", "n", "sample", "tree"), star


def candidate_groups(reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(rid, grp): representatives joined by chains of possible links. Those without one are left out."""
    spark = reps.sparkSession
    own = written(keys.join(growing(reps.select("rid")), "rid", "left_semi"), "jaccard-keys")
    entries = own.select("rid", F.explode("keys").alias("key"))
    shared = written(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-shared")
    listed = written(entries.join(growing(shared), "key"), "jaccard-entries")
    rows = listed.join(growing(own.select("rid", "n", "sample")), "rid")
    zero = [F.lit(0).alias(c) for c in ("block1", "block2", "side")]
    jobs = rows.where(F.col("c") <= LIST).select("key", F.lit(-1).cast("long").alias("lump1"), F.lit(-1).cast("long").alias("lump2"), *zero, "rid", "n", "sample", F.col("rid").alias("tree"))
    stars = None
    if shared.where(F.col("c") > LIST).limit(1).count():
        hot = written(rows.where(F.col("c") > LIST).select("key", "rid", "n", "sample"), "jaccard-long")
        more, stars = dealt(hot)
        jobs = jobs.unionByName(more)

    def run(batches):
        target = arrow_schema("a long, b long")
        job, held, out = None, [], []
        seen: set[tuple[int, int]] = set()

        def close():
            ids, sizes, side, tree = (np.concatenate([h[k] for h in held]) for k in range(4))
            if len(ids) > 1:
                values = np.concatenate([h[4] for h in held])
                begin = np.concatenate([[0], np.cumsum(np.concatenate([h[5] for h in held]))])
                for x, y in near_in_list(sizes, values, begin, side, tree):
                    e = (int(ids[x]), int(ids[y])) if ids[x] < ids[y] else (int(ids[y]), int(ids[x]))
                    if e not in seen:
                        seen.add(e)
                        out.append(e)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in JOB]
            ids, sizes, side, tree = (batch.column(c).to_numpy() for c in ("rid", "n", "side", "tree"))
            sample = batch.column("sample")
            lengths, values = np.diff(sample.offsets.to_numpy()), sample.flatten().to_numpy()
            begin = np.cumsum(lengths) - lengths
            new = np.zeros(len(ids), bool)
            for c in at:
                new[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), len(ids)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                name = tuple(int(c[s]) for c in at)
                if name != job:
                    if held:
                        close()
                    job, held = name, []
                    if len(seen) > 200_000:
                        seen.clear()
                held.append((ids[s:e], sizes[s:e], side[s:e], tree[s:e], values[begin[s] : begin[e - 1] + lengths[e - 1]], lengths[s:e]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], schema=target)
                out = []
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], schema=target)

    edges = jobs.repartition(*JOB).sortWithinPartitions(*JOB, "rid").mapInArrow(released(run), "a long, b long")
    if stars is not None:
        edges = edges.unionByName(stars)
    found = components(spark, edges, "jaccard-candidates")
    found = written(found, "jaccard-reached")
    delete(own, shared, listed)
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return found.unionByName(roots).select(F.col("id").alias("rid"), F.col("component").alias("grp"))


class Block:
    """Sets of one comparison with an index from shingle to the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        df = np.bincount(flat, minlength=len(names))
        # rarest first, as the common ones' lists are long
        order = np.argsort(df, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        flat = place[flat]
        by_set = np.lexsort((flat, owner))
        self.tokens, self.begin = flat[by_set], np.concatenate([[0], np.cumsum(self.n)])
        position = np.arange(len(flat)) - np.repeat(self.begin[:-1], self.n)
        by_token = np.lexsort((position, self.tokens))
        self.holders, self.positions = owner[by_set][by_token], position[by_token]
        self.at = np.concatenate([[0], np.cumsum(df[order])])

    def set_of(self, k: int) -> np.ndarray:
        return self.tokens[self.begin[k] : self.begin[k + 1]]

    def _entries(self, tokens: np.ndarray) -> np.ndarray:
        a, span = self.at[tokens], self.at[tokens + 1] - self.at[tokens]
        return np.repeat(a - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())

    def counted(self, k: int) -> np.ndarray:
        """Overlap of set k with every set, from the lists of all its shingles."""
        return np.bincount(self.holders[self._entries(self.set_of(k))], minlength=len(self.n))

    def derived(self, k: int, of: int, answers: np.ndarray) -> np.ndarray:
        """The same from the answers of a similar set: only the lists of shingles that one of the two lacks are read."""
        mine, other = self.set_of(k), self.set_of(of)
        more = np.setdiff1d(mine, other, assume_unique=True)
        less = np.setdiff1d(other, mine, assume_unique=True)
        out = answers.copy()
        if len(more):
            out += np.bincount(self.holders[self._entries(more)], minlength=len(self.n))
        if len(less):
            out -= np.bincount(self.holders[self._entries(less)], minlength=len(self.n))
        return out

    def skipped(self, k: int) -> np.ndarray:
        """Overlap of set k with the sets that it may link with (0 for others), by its first shingles' lists.

        Lists are in the order of the shingle's position in each set. Only the leading block of a list, whose
        positions leave enough shingles behind them to reach the threshold, is read; the rest is skipped.
        """
        mine = self.set_of(k)
        n = len(mine)
        found = []
        for i, token in enumerate(mine[: n - -(-PERCENT * n // 100) + 1].tolist()):
            a, b = self.at[token], self.at[token + 1]
            largest = n * 100 // PERCENT
            a_end = a + np.searchsorted(self.positions[a:b], largest - -(-PERCENT * largest // 100) + 1, "right")
            who, where = self.holders[a:a_end], self.positions[a:a_end]
            rest = np.minimum(n - i, self.n[who] - where) + np.minimum(i, where)
            found.append(who[(100 + PERCENT) * rest >= PERCENT * (n + self.n[who])])
        out = np.zeros(len(self.n), np.int64)
        mark = np.zeros(len(self.at), bool)
        mark[mine] = True
        for j in np.unique(np.concatenate(found)).tolist():
            out[j] = mark[self.set_of(j)].sum()
        return out


def linked(sets: list[np.ndarray]):
    """For each set k in order of size: (k, array of the sets j that it links with)."""
    block = Block(sets)
    anchors: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(block.n, kind="stable").tolist():
        n = block.n[k]
        of = max(anchors, key=lambda a: a[1][k], default=None)
        similar = of is not None and block.n[of[0]] + n - 2 * of[1][k] < n / 2
        if similar:
            overlap = block.derived(k, of[0], of[1])
        elif len(sets) > 8:
            overlap = block.counted(k)
            if len(anchors) < 16:
                anchors.append((k, overlap))
        else:
            overlap = block.skipped(k)
        hit = (100 + PERCENT) * overlap >= PERCENT * (n + block.n)
        hit[k] = False
        yield k, np.flatnonzero(hit)


def exact_links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, links) of the groups' members: edges that join what links directly (b not null), and each member's links.

    Members are compared within their group and class of size only: the sizes of linked sets differ by a third at
    most, which two neighbouring classes cover. A class of more than BLOCK members, or HASHES hashes, is cut into
    blocks, and every pair of blocks is compared once, so however large a group is, a task holds two blocks.
    """
    step = math.log(100 / PERCENT)
    members = members.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HASHES)).cast("int")
    counts = written(members.groupBy("grp", "class").agg(blocks.alias("blocks")), "jaccard-classes")
    # written with its neighbours' blocks, so that the join with the members has two plain exchanges: Spark splits a large group's rows
    near = counts
    for name, shift in (("above", -1), ("below", 1)):
        near = near.join(growing(counts.select("grp", (F.col("class") + shift).alias("class"), F.col("blocks").alias(name))), ["grp", "class"], "left")
    near = written(near, "jaccard-neighbours")
    placed = members.join(growing(near), ["grp", "class"]).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    mine, visitor = F.col("mine"), -1 - F.col("mine")

    def visits(others: str, up: int, low, high, side):
        """A job with each of the ``others`` blocks; none where there is no such class."""
        at = (F.col("class") + up).alias("class")
        each = F.transform(F.sequence(F.lit(0), F.col(others) - 1), lambda x: F.struct(at, low(x).alias("low"), high(x).alias("high"), side.alias("side")))
        return F.coalesce(each, F.array())

    inside = visits("blocks", 0, lambda x: F.least(mine, x), lambda x: F.greatest(mine, x), mine)
    visiting = visits("above", 1, lambda x: visitor, lambda x: x, visitor)
    visited = visits("below", 0, lambda x: -1 - x, lambda x: mine, mine)
    placed = written(placed.select("rid", "copies", "grp", F.concat(inside, visiting, visited).alias("jobs")), "jaccard-places")
    # the members' sets move once to their members' rows and then to their jobs; the condition lets Spark filter the others before
    jobs = sets.select("rid", "shingles").join(growing(placed.where("rid >= 0")), "rid").withColumn("job", F.explode("jobs")).select("grp", "job.*", "rid", "copies", "shingles")

    def run(batches):
        target = arrow_schema("a long, b long, links long")
        job, held = None, []
        out: list[tuple[int, int | None, int]] = []

        def close():
            if len(held) < 2:
                return
            low, high = job[2:]
            ids = [h[0] for h in held]
            side, weight = np.array([h[1] for h in held]), np.array([h[2] for h in held])
            forest = Forest(len(ids))
            for k, found in linked([h[3] for h in held]):
                if low != high:
                    found = found[side[found] != side[k]]
                if len(found):
                    out.append((ids[k], None, int(weight[found].sum())))
                    out.extend((min(ids[k], ids[j]), max(ids[k], ids[j]), 0) for j in found.tolist() if forest.join(k, j))

        def batch_out():
            nonlocal out
            got = pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], schema=target)
            out = []
            return got

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("grp", "class", "low", "high")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("rid", "side", "copies")), sets_in(batch.column("shingles")), strict=True)
            for name, row in zip(names, rows, strict=True):
                if name != job:
                    close()
                    job, held = name, []
                held.append((*row[:3], row[3].copy()))  # else the whole batch stays
            if len(out) > 10_000:
                yield batch_out()
        close()
        if out:
            yield batch_out()

    sorted_jobs = jobs.repartition("grp", "class", "low", "high").sortWithinPartitions("grp", "class", "low", "high", "rid")
    with prefiltered(sets.sparkSession):
        links = written(sorted_jobs.mapInArrow(released(run), "a long, b long, links long"), "jaccard-links")
    delete(counts, near, placed)
    return links


def joined(docs: DataFrame, behind: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and name (a hash of the text) of every document.

    n_shingles is the number of distinct shingles of WIDTH lower-cased (A-Z) words; a text of fewer words has one,
    of all of them, and null, empty or blank texts have none and link with nothing. component_id is the smallest
    doc_id reachable by links, a document without links being its own; n_links counts the documents linked directly,
    equal sets included. Documents without an id are kept with null component_id. Repeated rows count each for itself,
    and so do rows of one id with different texts, which may be in different components. Other columns are ignored; an
    empty table gives no rows. The written tables that the result is read from are added to ``behind``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = written(hashed(docs).withColumn("rid", F.monotonically_increasing_id()), "jaccard-sets")
    usable = own.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("n", "sig1", "sig2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes, "jaccard-reps")
    groups = candidate_groups(classes, keyed(usable, frequent_shingles(own)))
    groups = written(groups.join(growing(classes.select("rid", "n", "copies")), "rid"), "jaccard-groups")
    links = exact_links(own, groups)
    reached = components(spark, links.where("b IS NOT NULL").select("a", "b"), "jaccard").select(F.col("id").alias("rid"), "component")
    counted = links.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    told = classes.join(reached, "rid", "left").join(counted, "rid", "left")
    told = written(told.select("n", "sig1", "sig2", "least", F.coalesce("component", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-told")
    delete(classes, groups, links)
    firsts = written(told.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-firsts")
    answers = written(told.join(growing(firsts), "root").select("n", "sig1", "sig2", "component_id", "n_links"), "jaccard-answers")
    delete(told, firsts)
    if behind is not None:
        behind += [own, answers]
    own_rows = own.select("doc_id", "name", "n", "sig1", "sig2")
    out = own_rows.join(growing(answers), ["n", "sig1", "sig2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "name")


def query(spark, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents")).drop("name")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all columns.

    Of repeated rows one stays. Rows without an id stay, and so do those without words: neither links with anything.
    """
    behind: list[DataFrame] = []
    told = written(joined(docs, behind), "jaccard-rows")
    delete(*behind)
    found = told.where("component_id = doc_id").groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    found = written(found, "jaccard-kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id IS NOT NULL").withColumns({"_id": F.col("doc_id").cast("long"), "_name": F.xxhash64("text")})
    ids = growing(found.select(F.col("doc_id").alias("_id"), F.col("name").alias("_name")))
    kept = named.join(ids, ["_id", "_name"], "left_semi")
    if found.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_id", "_name"])
    return kept.select(*columns).unionByName(docs.where("doc_id IS NULL"))


#: The operator's rows in DuckDB SQL.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
classes AS (SELECT min(doc_id) AS rep, list_sort(shingles) AS shingles, count(*) AS copies FROM s GROUP BY list_sort(shingles)),
entries AS (SELECT rep, len(shingles) AS n, unnest(shingles) AS shingle FROM classes),
counted AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM counted WHERE 100 * c >= 75 * (na + nb - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
firsts AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT l.a, sum(c.copies) AS n FROM links l JOIN classes c ON c.rep = l.b GROUP BY l.a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles,
       CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE least(c.rep, coalesce(f.least, c.rep)) END::BIGINT AS component_id,
       CASE WHEN len(s.shingles) = 0 THEN 0 ELSE c.copies - 1 + coalesce(k.n, 0) END::BIGINT AS n_links
FROM s JOIN classes c ON c.shingles = list_sort(s.shingles) LEFT JOIN firsts f ON f.a = c.rep LEFT JOIN counts k ON k.a = c.rep
"""
