from collections import defaultdict
from hashlib import md5

import duckdb

from tests.llm.helpers import WORDS, awkward, table
from trigrove.llm import mixing

SF = "/root/testdata/sf0.001"


def targets(sizes):
    """Water filling by rounds: sources over their cap are fixed and the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want, taken = targets(sizes), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_awkward_documents(spark):
    rows = [(r[0], r[1], r[3]) for r in awkward()]
    for bucket_rows in (2000, 2):
        got = mixing.mixed(table(spark), bucket_rows=bucket_rows).collect()
        assert len(got) == len(rows)
        check(rows, got)
        at = [r["position"] for r in got if r["position"] is not None]
        assert at == sorted(at) or bucket_rows
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(table(spark), bucket_rows=2).collect()))


def test_empty_and_repeated(spark):
    assert mixing.mixed(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "x", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.mixed(rows).count() == 4


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = mixing.query(spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({mixing.SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_stage_repeats_documents(spark):
    docs = table(spark)
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mixing.mixed(docs).collect()}
    out = mixing.stage(spark, docs, "")
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert dict(got) == {i: n for i, n in taken.items() if n} and out.columns == docs.columns


def test_stage_places_each_pass(spark):
    """Every pass lies where its source's schedule has spent what comes before it, the last quarter included."""
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "en", f"src{k % 3}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = {f"src{j}": sum(1 + k % 7 for k in range(90) if k % 3 == j) for j in range(3)}
    goals, want = targets(sizes), []
    for s, slope in (("src0", 0.5), ("src1", 0.0), ("src2", -0.5)):
        start = 0
        for draw, k in sorted((int(md5(str(k).encode()).hexdigest()[:15], 16), k) for k in range(90) if rows[k][3] == s):
            for spent in range(start, round(goals[s]), sizes[s]):
                part = spent / goals[s]
                want.append((((1 - slope) ** 2 + 4 * slope * part) ** 0.5 / (2 * slope) - (1 - slope) / (2 * slope) if slope else part, draw, k))
            start += 1 + k % 7
    assert max(goals[s] / sizes[s] for s in sizes) == 2
    assert [r["doc_id"] for r in mixing.stage(spark, df, "").collect()] == [k for _, _, k in sorted(want)]


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    for slope in (0.5, 0.0, -0.5):
        rows = spark.range(11).select((F.col("id") / 10).alias("p")).select("p", mixing.when_of(F.col("p"), F.lit(slope)).alias("t")).collect()
        assert all(abs((1 - slope) * r["t"] + slope * r["t"] ** 2 - r["p"]) < 1e-12 for r in rows)


def test_no_python_on_the_executors(spark):
    plan = mixing.mixed(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
