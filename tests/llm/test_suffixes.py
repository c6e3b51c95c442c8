import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, repeats, table
from trigrove.llm import suffixes as S


def check(spark, rows, df=None):
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digested(df or spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = repeats(rows)
    texts = dict(rows)
    assert got == {i: (len((texts[i] or "").encode()), gone, spans, hashlib.sha256(kept).hexdigest()) for i, (kept, gone, spans) in want.items()}


def test_awkward_documents(spark):
    check(spark, [r[:2] for r in awkward()], table(spark))


def edited_rows(n=80):
    rng = random.Random(7)
    letters = "abcdefgh "
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([60, 100, 101, 140, 700]))) for _ in range(12)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(90)) for _ in range(rng.randrange(0, 6)))
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "É" + text[at + 1 :]
        rows.append((k * 2, text))
    rng.shuffle(rows)
    return rows


def test_passages_and_edits(spark):
    check(spark, edited_rows())


def test_hot_anchors_are_keyed_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "CONTEXTS", 3)
    check(spark, edited_rows(60))


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 500)
    check(spark, edited_rows(60))


def test_empty_repeated_rows_and_null_ids(spark):
    assert S.digested(table(spark, [])).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (0, text[:150])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in S.digested(df).collect())
    assert got[0] == ("0", 0) and got[-1] == ("None", 300)
    assert sorted(n for i, n in got if i == "1") == [150, 300]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(0, 10**6), st.lists(st.integers(0, 2), min_size=20, max_size=20))
def test_suffixes_are_sorted(blocks, seed, groups):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(97, 100, rng.integers(1, 60), dtype=np.uint8).tobytes() for _ in range(4)]
    data = b"".join(parts[b] for b in blocks) + b"b" * S.LENGTH
    starts = np.arange(len(data) - S.LENGTH + 1)
    group = np.array([groups[k % 20] for k in range(len(starts))])
    order, number = S.SuffixSorter(np.frombuffer(data, np.uint8)).sort(starts, group)
    keys = [(group[k], data[starts[k] : starts[k] + S.LENGTH]) for k in range(len(starts))]
    assert [keys[k] for k in order] == sorted(keys)
    assert len(set(number.tolist())) == len(set(keys)) and all(number[a] == number[b] for a, b in zip(order, order[1:]) if keys[a] == keys[b])


def test_stage_cuts_texts(spark):
    kept = {r["doc_id"]: r["text"] for r in S.stage(spark, table(spark), "").collect()}
    want = repeats([r[:2] for r in awkward()])
    for i, text, *_ in awkward():
        left = want[i][0].decode("utf-8", "ignore")
        if want[i][1] and not left.strip(" "):
            assert i not in kept
        else:
            assert (kept[i] or "") == left and (text is None) == (kept[i] is None)


def test_polynomials_that_collide_are_told_apart(spark, monkeypatch):
    """With a polynomial that calls everything equal the digests' other half still keeps contexts apart."""
    real = S.range_hash
    monkeypatch.setattr(S, "range_hash", lambda prefix, a, b: real(prefix, a, b) * np.uint64(0))
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab") for _ in range(140)) + "shared passage of some length, " * 5) for k in range(12)]
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    _, first, last, grams, context, check = S.anchors(data, np.arange(len(data) - S.LENGTH + 1))
    names = {}
    for a, b, g, c, d in zip(first.tolist(), last.tolist(), grams.tolist(), context.tolist(), check.tolist()):
        assert names.setdefault((g, c, d), data[a : b + S.LENGTH].tobytes()) == data[a : b + S.LENGTH].tobytes()
    assert len({n[1:] for n in names}) == len(names)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(map(str, con.execute(S.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in S.query(spark, "/root/testdata/sf0.001").collect()) == want
