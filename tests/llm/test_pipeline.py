from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.helpers import BASE, WORDS, awkward, jaccard, repeats
from trigrove.llm import mixing, packing, toxicity
from trigrove.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    lexicon = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {i: r["text"] for i, r in rows.items() if lexicon.score(r["text"]) < 0.5}
    docs = corpus_pipeline.toxic(spark, docs, SF)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == clean

    apart = {i: clean[i] for i, (_, c, _) in jaccard(list(clean.items())).items() if c == i}
    docs = corpus_pipeline.near_copies(spark, docs, SF)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == apart

    cut = {i: kept.decode("utf-8", "ignore") for i, (kept, gone, _) in repeats(list(apart.items())).items() if kept.strip(b" ") or not gone}
    docs = corpus_pipeline.repeats(spark, docs, SF)
    assert docs.columns == columns and {r["doc_id"]: r["text"] or "" for r in docs.collect()} == cut

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mixed(docs).collect()}
    passes = Counter({i: -(-t // n) for i, (t, n) in taken.items() if t})
    docs = corpus_pipeline.mixed(spark, docs, SF)
    assert docs.columns == columns and Counter(r["doc_id"] for r in docs.collect()) == passes

    words = defaultdict(int)
    bins = Counter()
    for r in corpus_pipeline.packed(spark, docs, SF).collect():
        words[r["doc_id"]] += r["n_words"]
        bins[r["bin"]] += r["n_words"]
    assert words == {i: n * len(WORDS.findall(cut[i])) for i, n in passes.items()}
    assert max(bins.values()) <= packing.CAPACITY


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_awkward_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [r[:5] for r in awkward()]
    for name, some in (("all", rows + rows[:3] + [(None, BASE, None, None, None)]), ("none", [])):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for stage, f in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = written(f(spark, docs, str(tmp_path)), f"test-{name}-{stage}")
            if stage == "packing":
                break
            assert docs.columns == columns
            if stage == "jaccard_join":
                ids = [r["doc_id"] for r in docs.collect()]
                reached = jaccard([r[:2] for r in rows])
                assert sorted(i for i in ids if i is not None) == (sorted(i for i, (_, c, _) in reached.items() if c == i) if some else [])
                assert ids.count(None) == bool(some)
        assert (docs.count() > 0) == bool(some)
