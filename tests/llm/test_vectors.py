import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from trigrove.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, list string"


def brute(rows):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float32).astype(float))
    ids = sorted(ok)
    u = np.stack([ok[i] / np.sqrt((ok[i] ** 2).sum()) for i in ids])
    near = u @ u.T >= 0.95 - 1e-12
    comp = {i: i for i, _ in rows}
    for _ in ids:
        for a, i in enumerate(ids):
            comp[i] = min(comp[j] for b, j in enumerate(ids) if near[a, b])
    return {i: (int(near[ids.index(i)].sum()) - 1 if i in ok else 0, comp[i]) for i, _ in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 64))
    rows = []
    for k in range(400):
        c = centers[rng.integers(30)] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.4])
        rows.append((k, c.astype(np.float32).tolist()))
    rows += [(1000 + k, rows[7][1]) for k in range(20)]
    rows += [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [float("inf")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, []), (2006, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "r", "n", "l") for i, v in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(v[2] == (v[1] == i) for i, v in got.items())


def test_empty_and_tiny(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((str(tuple(r)[:3])) for r in vectors.near_duplicates(df).collect())
    assert got == sorted(["(1, 2, 1)", "(1, 2, 1)", "(2, 2, 1)", "(3, 0, 3)", "(4, 0, 4)", "(None, None, None)"])


def table(spark, folder, ids, rows):
    """A table of vec_id and embedding, written and read: too many rows for createDataFrame."""
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), f"{folder}/vectors.parquet")
    return spark.read.parquet(f"{folder}/vectors.parquet")


def check_all_links(got, x):
    """Every row of x against every other, and the component that the links reach."""
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    want = np.concatenate([(u[a : a + 2000] @ u.T >= 0.95).sum(1) for a in range(0, len(u), 2000)]) - 1
    assert [got[k][0] for k in range(len(u))] == want.tolist()
    return want


def test_group_of_a_third_of_the_rows(spark, tmp_path):
    """Distinct near copies that lie in far more lists than a few: all their links count."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    group = rng.permutation(30_000)[:10_000]
    x[group] = rng.normal(size=64) + np.sqrt(0.045) * rng.normal(size=(10_000, 64))
    df = table(spark, tmp_path, range(len(x)), list(x.astype(np.float32)))
    got = {r["vec_id"]: r[1:] for r in vectors.near_duplicates(df).collect()}
    want = check_all_links(got, x)
    assert 4000 < np.median(want[group]) < 9900
    assert {got[k][1] for k in group if want[k]} == {min(k for k in group if want[k])}


def test_each_length_is_indexed(spark, tmp_path):
    """Vectors of two models in one table, with ids in common: each length has its links and components."""
    rng = np.random.default_rng(6)
    centers = [rng.normal(size=(8, d)) for d in (64, 48)]
    parts = [c[rng.integers(8, size=n)] + 0.15 * rng.normal(size=(n, c.shape[1])) for c, n in zip(centers, (300, 250), strict=True)]
    ids = [[k + 5 for k in range(300)], list(range(250))]
    alone = [[(i, x.astype(np.float32).tolist()) for i, x in zip(k, part, strict=True)] for k, part in zip(ids, parts, strict=True)]
    want = [(i, *v) for part in alone for i, v in brute(part).items()]
    assert sum(w[1] for w in want[300:]) > 1000
    rows = alone[0] + alone[1]
    got = vectors.near_duplicates(table(spark, tmp_path, [i for i, _ in rows], [v for _, v in rows])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)


def test_query_equals_sql(spark):
    """All links of the table: recall 1."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(map(str, con.execute(vectors.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in vectors.query(spark, "/root/testdata/sf0.01").collect()) == want
