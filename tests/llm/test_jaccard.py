import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import BASE, awkward, jaccard, table
from trigrove.llm import common
from trigrove.llm import jaccard as J


def check(spark, rows, df=None):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.joined(df or spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard(rows)


def test_awkward_documents(spark):
    check(spark, [r[:2] for r in awkward()], table(spark))


def test_empty_and_null_ids(spark):
    assert J.joined(table(spark, [])).count() == 0
    got = J.joined(spark.createDataFrame([(None, BASE), (4, BASE)], "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == ["(4, 56, 4, 0)", "(None, 56, None, 0)"]


def test_repeated_rows(spark):
    near = BASE.replace("wordy59", "changed")
    got = J.joined(spark.createDataFrame([(1, BASE), (1, BASE), (2, near), (2, near), (3, "else")], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 56, 1, 3), (1, 56, 1, 3), (2, 56, 1, 3), (2, 56, 1, 3), (3, 1, 3, 0)]


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(5, BASE), (5, "something else here"), (1, BASE.upper()), (7, "something else here"), (7, "something else here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in J.joined(df).collect())
    assert got == [(1, 56, 1, 1), (5, 1, 5, 2), (5, 56, 1, 1), (7, 1, 5, 2), (7, 1, 5, 2)]
    assert sorted(tuple(r) for r in J.stage(spark, df, "").collect()) == [(1, BASE.upper()), (5, "something else here")]
    twice = spark.createDataFrame([(3, BASE), (3, BASE), (None, BASE), (None, BASE)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in J.stage(spark, twice, "").collect()) == ["3", "None", "None"]


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_for_polynomials(spark):
    """Such words have one polynomial modulo 2**64, whatever the base."""
    one = thue_morse(11)
    other = one.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, one), (2, other), (3, f"{one} {BASE}"), (4, f"{other} {BASE}"), (5, one), (6, " ".join([one] * 9)), (7, " ".join([other] * 9))])


def test_names_of_words():
    data = np.frombuffer(b"abcdefgh abcdefgh\x00 a ab " + bytes(range(33, 120)) * 2, np.uint8)
    starts, ends = np.array([0, 9, 9, 19, 21, 24, 24 + 87, 0, 5, 24, 111]), np.array([8, 17, 18, 20, 23, 24 + 87, 24 + 174, 0, 5, 24 + 60, 111 + 60])
    names = common.range_names(data, starts, ends)
    contents = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for x, a in zip(contents, names):
        for y, b in zip(contents, names):
            assert (x == y) == (a == b)


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    """Lists of a common shingle, with a large group of near copies among texts that only share a passage."""
    monkeypatch.setattr(J, "LIST", 8)
    monkeypatch.setattr(J, "LEAST", 10**6)
    rng = random.Random(8)
    passage = [f"common{k}" for k in range(30)]
    rows = []
    for n in range(60):
        words = passage + [f"copy{k}" for k in range(90)]
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    for n in range(60, 140):
        words = passage + [f"u{n % 50}x{k}" for k in range(rng.choice([5, 9, 60]))]
        rows.append((n, " ".join(words)))
    rng.shuffle(rows)
    check(spark, rows)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(J, "HASHES", 200)
    rows = [(n, " ".join(f"w{k}" for k in range(60 + n % 5))) for n in range(30)]
    check(spark, rows)


def test_groups_of_near_copies_and_common_passages(spark):
    rng = random.Random(3)
    rows, n = [], 0
    passage = " ".join(f"common{k}" for k in range(50))
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice([8, 30, 150]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    for _ in range(80):
        rows.append((n, passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(rng.choice([5, 20, 100])))))
        n += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for n in range(60):
        words = base[: rng.randrange(45, 61)]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"e{n}"
        rows.append((n, " ".join(words)))
    check(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=30), min_size=1, max_size=14))
def test_skipping_is_exact(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = {k: set(found.tolist()) for k, found in J.linked(arrays)}
    for a, x in enumerate(sets):
        assert got[a] == {b for b, y in enumerate(sets) if a != b and 100 * len(x & y) >= 75 * len(x | y)}
    block = J.Block(arrays)
    for a, x in enumerate(sets):
        assert block.counted(a).tolist() == [len(x & y) for y in sets]
        assert block.derived(a, 0, block.counted(0)).tolist() == [len(x & y) for y in sets]
        skipped = block.skipped(a)
        for b, y in enumerate(sets):
            assert skipped[b] in (0, len(x & y))
            assert 100 * len(x & y) < 75 * len(x | y) or skipped[b] == len(x & y)


def test_prefixes():
    for n in range(1, 400):
        exact = n - math.ceil(0.75 * n) + 1
        assert J.prefix_length(n, n) == exact and 1 <= J.prefix_length(n, 0) <= exact
    assert J.prefix_length(1000, 0) == 28


def test_stage_keeps_one_of_each_group(spark):
    kept = J.stage(spark, table(spark), "")
    reached = jaccard([r[:2] for r in awkward()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c, _) in reached.items() if c == i)
    assert kept.columns == table(spark).columns


def test_sets_are_filtered_before_their_shuffle(spark):
    """The filter is in the plan, lets all members through and leaves the session's settings as they were."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    large = common.written(spark.range(0, 20_000).selectExpr("id AS rid", "hash(id) AS v"), "test-large")
    small = common.written(spark.range(0, 20_000, 500).selectExpr("id AS rid"), "test-small")
    with common.prefiltered(spark):
        joined = large.join(common.growing(small.where("rid >= 0")), "rid")
        assert "might_contain" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["rid"] for r in joined.collect()) == list(range(0, 20_000, 500))
    assert spark.conf.get(key) == before
