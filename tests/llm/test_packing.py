from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import WORDS, awkward, table
from trigrove.llm import packing


def check(rows, texts, capacity, per_source):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
    for i, t in texts.items():
        n = len(WORDS.findall(t or ""))
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["n_words"] for r in mine) == n
        at = 0
        for r in mine:
            assert r["piece_start"] == at
            at += r["n_words"]
    for content in bins.values():
        content.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in content:
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at <= capacity
        assert max(Counter(r["source"] for r in content).values()) <= per_source
        twins = Counter(r["cluster"] for r in content if r["cluster"] is not None)
        assert not twins or max(twins.values()) == 1


def test_awkward_documents(spark):
    rows = packing.packed(table(spark), capacity=64, per_source=2, shard_rows=4).collect()
    check(rows, {r[0]: r[1] for r in awkward()}, 64, 2)


def test_empty_and_repeated(spark):
    assert packing.packed(table(spark, [])).count() == 0
    rows = packing.packed(spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, "s")], "doc_id long, text string, source string")).collect()
    assert len(rows) == 3 and len({r["bin"] for r in rows}) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from("abc"), st.integers(0, 6)), max_size=40))
def test_the_tightest_compatible_bin_is_found(pieces):
    bins: list[dict] = []
    for (size, source, cluster), (number, offset) in zip(pieces, packing.pack(pieces, 12, 2), strict=True):
        fits = [12 - b["n"] for b in bins if b["n"] + size <= 12 and b["sources"][source] < 2 and cluster not in b["clusters"]]
        if number == len(bins):
            assert not fits and offset == 0
            bins.append({"n": 0, "sources": Counter(), "clusters": set()})
        b = bins[number]
        if fits:
            assert 12 - b["n"] == min(fits) and offset == b["n"]
        b["n"] += size
        b["sources"][source] += 1
        b["clusters"].add(cluster)
        assert b["n"] <= 12


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [(k // 3, "w " * (40 + k % 5 * 30), f"s{k % 2}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda df: sorted(map(str, packing.packed(df, capacity=64, per_source=2, shard_rows=20).collect()))
    assert told(docs.repartition(7)) == told(docs.coalesce(1))


def test_shards_fill_nearly_as_one(spark):
    """Bins of sharded packing against those of all pieces packed together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = [len({r["bin"] for r in packing.packed(docs, shard_rows=n).collect() if r["bin"]}) for n in (100, 10**9)]
    words = sum(len(WORDS.findall(r["text"] or "")) for r in docs.collect())
    print("bins in shards of 100, in one, and at least:", counts, -(-words // packing.CAPACITY))
    assert counts[0] <= 1.15 * counts[1]
