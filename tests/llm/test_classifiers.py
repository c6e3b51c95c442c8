import random
import zlib

import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, table
from trigrove.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("module", "label", "accuracy"), [(toxicity, "toxic", 0.95), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, accuracy):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = module.query(spark, SF).collect()
    assert len(rows) == 1000
    cut = 0.5 if label == "toxic" else 0.3
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
    mine = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in mine) >= accuracy * len(mine)


def test_folding():
    assert toxicity.fold("Аn 1d10t, \u200b\u0405TU\u200bPID! 2024 4x4") == " an idiot stupid 2024 axa "
    assert toxicity.fold("") == "  " and toxicity.fold("ｆｏｏ") == " foo "


def test_lexicon_exceptions_and_length():
    lexicon = toxicity.Lexicon({"trash ": 5.0, "lowei": 4.0}, {"trash can"}, bias=-3, slope=1)
    assert lexicon.evidence(toxicity.fold("the trash here")) == (5.0, 1)
    assert lexicon.evidence(toxicity.fold("the trash can here")) == (0, 0)
    assert lexicon.evidence(toxicity.fold("loweische TR4SH")) == (9.0, 2)
    assert lexicon.evidence(toxicity.fold("trashy glowei")) == (0, 0)
    assert lexicon.score("trash") > lexicon.score("trash " + "fine " * 2000) > lexicon.score(None) == lexicon.score("")


def test_exceptions_are_learned():
    rng = random.Random(0)
    fill = lambda: " ".join(rng.choice(["good", "day", "to", "all", "of", "you"]) for _ in range(20))
    texts = [f"{fill()} you trash {fill()}" for _ in range(60)] + [f"{fill()} trash can {fill()}" for _ in range(6)] + [fill() for _ in range(200)]
    lexicon = toxicity.learn(texts, [1] * 60 + [0] * 206)
    assert "trash can" in lexicon.exceptions
    assert lexicon.score(f"{fill()} you trash {fill()}") > 0.5 > lexicon.score(f"{fill()} trash can {fill()}")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_documents(spark, module):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (3, None, None), (None, 1, 1), (6, 0, 0), (999, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = module.scored(docs, module.fit(docs, labels)).collect()
        assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert module.scored(table(spark, []), module.fit(docs, odd)).count() == 0
    assert module.scored(docs, module.fit(table(spark, []), odd)).count() == len(awkward())


def test_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in toxicity.stage(spark, docs, SF).collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in kept for i in clean) > 0.98 * len(clean)
    assert sum(i in kept for i, y in labels.items() if y) < 0.3 * sum(labels.values())  # some labels are wrong, and here are few to learn from


def test_quality_measures_are_per_text():
    texts = [r[1] for r in awkward()]
    terms, shape = quality.measured(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        a, b = quality.measured(pa.array([t], pa.string()))
        assert (a[0] == terms[k]).all() and abs(b[0] - shape[k]).max() < 1e-9


def test_votes_against_plain_loops():
    """Every labelled vector's cosine by itself; the nearest ones' votes summed one by one."""
    import math

    import numpy as np

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    model = quality.learn(texts[:60], [k % 3 > 0 for k in range(60)])
    x = model.latent(*quality.measured(pa.array(texts[60:], pa.string())))
    for mine, got in zip(x, model.vote(x), strict=True):
        cosines = sorted(((float(sum(np.float64(a) * np.float64(b) for a, b in zip(mine, v))), k) for k, v in enumerate(model.vectors)), reverse=True)[: model.neighbours]
        weights = [math.exp(8 * (c - cosines[0][0])) for c, _ in cosines]
        want = (sum(w * model.labels[k] for w, (_, k) in zip(weights, cosines)) + 0.5 * model.prior) / (sum(weights) + 0.5)
        tied = sum(abs(c - cosines[-1][0]) < 1e-6 for c, _ in cosines) > 1
        assert abs(got - want) < (0.05 if tied else 1e-4)


def test_matches_against_plain_search():
    """Evidence by looking at every place of every text for every term."""
    rng = random.Random(6)
    words = ["bad", "badly", "bads", "fine", "worst", "worstly", "good"]
    terms = {"bad ": 1.0, "badl": 2.5, "worst": 4.0, "worstly ": 1.5}
    lexicon = toxicity.Lexicon(terms, {"fine bad", "worst good"})
    for _ in range(200):
        names = [rng.choice(words) for _ in range(rng.randrange(0, 9))]
        total, number = 0.0, 0
        for k, w in enumerate(names):
            fits = [t for t in terms if (w == t.rstrip() if t.endswith(" ") else w.startswith(t))]
            spared = " ".join(names[k - 1 : k + 1]) in lexicon.exceptions if k else False
            spared |= " ".join(names[k : k + 2]) in lexicon.exceptions
            if fits and not spared:
                total += terms[max(fits, key=len)]
                number += 1
        got = lexicon.evidence(toxicity.fold(" ".join(names)))
        assert abs(got[0] - total) < 1e-9 and got[1] == number


def test_training_rows_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (100 * (k % 7 + 1))) for k in range(200)] * 2 + [(999, "y" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(999, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", 1000, 8000)
    assert len({r["doc_id"] for r in rows}) == len(rows) and 5000 < sum(len(r["text"]) for r in rows) <= 8000
    assert all(not held(r["doc_id"]) and r["y"] == r["doc_id"] % 2 for r in rows)


def test_stage_on_awkward_documents(spark, tmp_path):
    spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (awkward() * 2, []):
        docs = table(spark, rows)
        kept = toxicity.stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() <= len(rows)
        assert {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows if not r[1]}
