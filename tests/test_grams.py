import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrove.functions.codec import decode_run, encode_run, export_index, import_index
from trigrove.functions.grams import ALPHABET, gram_column, grams_of
from trigrove.operators import postings


def packed(text: str) -> int:
    out = 0
    for c in text:
        out = out * 64 + ALPHABET.index(c)
    return out


def test_vectors():
    assert grams_of(b"abcd", "gram3").tolist() == [0x616263, 0x626364]
    assert set(grams_of(b"abcde\xaaXghi", "text4").tolist()) == {packed(x) for x in ("abcd", "bcde", "Xghi")}
    assert packed("abcd") == 0x69B71D
    assert set(grams_of(b"a\0b\0c\0d\0e\0", "wide8").tolist()) == {packed("abcd"), packed("bcde")}
    assert not len(grams_of(b"\0a\0b\0c\0d", "wide8"))
    assert grams_of(b"\0a\0b\0c\0d\0", "wide8").tolist() == [packed("abcd")]
    assert not len(grams_of(b"xa\0b\0c\0d\0", "wide8"))
    assert grams_of(b"xa\0b\0c\0d\0", "wide8", realign=True).tolist() == [packed("abcd")]
    assert set(grams_of(b"abcde", "hash4").tolist()) == {0x616263 ^ 0x626364, 0x626364 ^ 0x636465}
    for kind, short in (("gram3", b"ab"), ("text4", b"abc"), ("hash4", b"abc"), ("wide8", b"a\0b\0c\0d")):
        assert not len(grams_of(short, kind)) and not len(grams_of(b"", kind))


def test_columns_equal_arrow(spark):
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab \nXz9\0\0\0\xff\x80!") for _ in range(rng.randrange(0, 60))) for _ in range(120)] + [b"", None]
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(rows)], "id int, content binary")
    for kind in ("gram3", "text4", "hash4", "wide8"):
        got = {r["id"]: r["g"] for r in df.select("id", gram_column(F.col("content"), kind).alias("g")).collect()}
        for k, r in enumerate(rows):
            if r is None:
                assert got[k] is None
            else:
                assert sorted(got[k]) == grams_of(r, kind).tolist(), (kind, r)


def test_native_build_equals_arrow_build(spark, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_POSTINGS", 200)
    rows = [(k % 2, k // 2, f"p{k:02}", bytearray(f"file number {k} of w\0i\0d\0e\0s\0".encode())) for k in range(20)]
    types = ["gram3", "text4", "hash4", "wide8"]
    raw = postings.scanned(spark.createDataFrame([(d, p, c) for d, _, p, c in rows], "ds int, path string, content binary").coalesce(1), types).persist()
    base, count = postings.bases(raw)
    assert count == {0: 10, 1: 10}
    a = postings.gathered(raw, base, 3).collect()
    files = spark.createDataFrame([(str(d), k, c) for d, k, _, c in rows], "dataset_id string, file_id int, content binary")
    b = postings.build_native(files, types).collect()
    assert sorted((r["itype"], r["gram"], str(r["ds"]), i) for r in a for i in r["ids"]) == sorted((r["itype"], r["gram"], r["dataset_id"], r["file_id"]) for r in b)
    assert all(r["ids"] == sorted(r["ids"]) and r["gram_bucket"] in postings.folders_of(r["gram"]) for r in a)


def test_blocks_are_packed():
    for top in (50, 1 << 20):
        keys = np.unique(np.random.default_rng(top).integers(0, 1 << 24, 3000) << 32 | np.random.default_rng(1).integers(0, top, 3000))
        gram, k = postings.unpacked(postings.packed(keys))
        assert (gram.astype(np.int64) << 32 | k == keys).all()


def test_run_codec():
    assert encode_run([1, 2, 5, 8, 265]).hex() == "010002028002"
    assert encode_run([1, 2, 3, 5, 7, 15, 200, 250]).hex() == "010000010107b80131"
    ids = sorted(np.random.default_rng(3).choice(10**7, 1000, replace=False).tolist())
    assert decode_run(encode_run(ids)) == ids
    with pytest.raises(ValueError):
        encode_run([3, 3])


TABLES = {
    "gram3": ([b"aaaaabb   bbccccc", b"\xff\xff\xff", b"aaaaabbccccc"], "ca4a0662863a42b9"),
    "text4": ([b"aaaaabb   bbccccc", b"\xff\xff\xff", b"aaaaabbccccc"], "32078e5136ea7705"),
    "wide8": ([b"aaaaabb   bbccccc", b"a\0c\0b\0d\0efgh", b"a\0b\0c\0d\0efgh", b"\xff\xff\xff", b"aaaaabbccccc"], "c73b55c36445ca6b"),
}


@pytest.mark.parametrize("kind", TABLES)
def test_exported_indexes(kind):
    files, digest = TABLES[kind]
    runs: dict[int, list[int]] = {}
    for k, data in enumerate(files):
        for g in grams_of(data, kind).tolist():
            runs.setdefault(g, []).append(k)
    number = {"gram3": 1, "text4": 2, "wide8": 4}[kind]
    out = export_index(number, runs.items())
    assert hashlib.sha256(out).hexdigest()[:16] == digest
    assert import_index(out) == (number, runs)
