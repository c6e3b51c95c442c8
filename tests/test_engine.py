import random
import threading

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from trigrove.operators import compaction
from trigrove.operators.catalog import CONFIG, Catalog, CatalogError, Locked, changed, upgraded
from trigrove.operators.engine import Engine
from trigrove.plans import compiler, registry
from trigrove.plans.parser import parse_query
from trigrove.plans.planner import plan, rewrite
from trigrove.sources.storage import Storage
from trigrove.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, (tmp_path / "db").as_uri())


@pytest.fixture
def put(tmp_path):
    def write(folder, **files):
        at = tmp_path / folder
        at.mkdir(exist_ok=True)
        for name, data in files.items():
            (at / name).write_bytes(data)
        return str(at)

    return write


def names(response):
    return sorted(f.rpartition("/")[2] for f in response["result"]["files"])


def ask(engine, query, modifiers=""):
    """A query's answer, raw and through a cursor."""
    raw = names(engine.execute(f"select {modifiers} {query};"))
    made = engine.execute(f"select {modifiers} into iterator {query};".replace("  ", " "))["result"]
    got = engine.execute(f'iterator "{made["iterator"]}" pop 1000;')
    assert names(got) == raw and got["result"]["total_files"] == made["file_count"] == len(raw)
    return raw


def test_gram_tables(engine, put):
    at = put("a", kot=b"aaaaabb   bbccccc", zzz=b"aaaaabbccccc", yyy=b"\xff\xff\xff", empty=b"")
    assert engine.execute(f'index "{at}" with [gram3];')["type"] == "ok"
    assert ask(engine, '"abbc"') == ["kot", "zzz"]
    assert ask(engine, "{ff ff ff}") == ["yyy"]
    assert ask(engine, "{}") == ask(engine, '""') == ["kot", "yyy", "zzz"]
    (name,) = engine.catalog.manifest["datasets"]
    assert engine.execute(f'reindex "{name}" with [text4];')["type"] == "ok"
    assert ask(engine, '"abbc"') == ["zzz"]
    assert ask(engine, "{ff ff ff}") == ["kot", "yyy", "zzz"]


def test_wildcards_tags_and_datasets(engine, put):
    engine.execute(f'index "{put("a", first=b"first", fiRst=b"fiRst", second=b"second")}" with taints ["t"];')
    engine.execute(f'index "{put("b", other=b"first other", aaaa=b"aaaa", aaab=b"aaab", aaac=b"aaac")}";')
    assert ask(engine, '"first"') == ["first", "other"]
    assert len(ask(engine, '"fi\\x??st"')) == 7
    assert ask(engine, '"first"', 'with taints ["t"]') == ["first"]
    assert ask(engine, '"first"', 'with taints ["t", "u"]') == []
    assert ask(engine, 'min 2 of ("aaa", "aab")') == ["aaab"]
    tagged = next(n for n, d in engine.catalog.manifest["datasets"].items() if d["taints"])
    assert ask(engine, '"first"', f'with datasets ["{tagged}"]') == ["first"]
    assert engine.execute('select with datasets ["no"] "first";')["type"] == "error"
    engine.execute(f'dataset "{tagged}" untaint "t";')
    assert ask(engine, '"first"', 'with taints ["t"]') == []
    engine.execute(f'dataset "{tagged}" drop;')
    assert ask(engine, '"first"') == ["other"]
    assert engine.catalog.orphans() == []


def test_wide(engine, put):
    at = put("a", ascii=b"koty", wide=b"k\0o\0t\0y\0", falsepositive=b"k\0o\0???\0o\0t\0y\0")
    engine.execute(f'index "{at}" with [gram3, text4, wide8];')
    assert ask(engine, '"koty"') == ["ascii"]
    assert ask(engine, 'w"koty"') == ["wide"]
    assert ask(engine, '"koty" | w"koty"') == ["ascii", "wide"]


def test_dedupe_list_files_and_odd_names(engine, put, tmp_path):
    at = put("a", **{"o d'd": b"asdfgh", "$x<>": b"asdfgh", "q[1]*": b"asdfgh"})
    (tmp_path / "list").write_text(f"{at}\n\n")
    engine.execute(f'index from list "{tmp_path / "list"}";')
    engine.execute(f'index "{at}";')
    assert ask(engine, '"asdfgh"') == sorted(["o d'd", "$x<>", "q[1]*"])
    engine.execute(f'index "{at}" nocheck;')
    assert len(ask(engine, '"asdfgh"')) == 6


def test_cursor(engine, put):
    engine.execute(f'index "{put("a", file0=b"test", file1=b"test", file2=b"test")}";')
    name = engine.execute('select into iterator "test";')["result"]["iterator"]
    assert [engine.execute(f'iterator "{name}" pop 1;')["result"]["iterator_position"] for _ in range(3)] == [1, 2, 3]
    last = engine.execute(f'iterator "{name}" pop 1;')
    assert last["type"] == "error" and last["error"]["retry"] is False
    other = engine.execute('select into iterator "test";')["result"]["iterator"]
    assert engine.catalog.collect_cursors(now=4e9) == [other]


def test_merging_keeps_answers_and_obeys_limits(engine, put):
    rng = random.Random(1)
    data = [bytes(rng.choice(b"abcd") for _ in range(40)) for _ in range(6)]
    for k, d in enumerate(data):
        engine.execute(f'index "{put(f"d{k}", **{f"f{k}": d})}" with [gram3, text4]{" with taints [" + chr(34) + "x" + chr(34) + "]" if k > 3 else ""};')
    queries = ['"abc"', '"abca" | "ddd"', 'min 2 of ("aaa", "bcd", "dab")', "{}"]
    before = [ask(engine, q) for q in queries]
    assert engine.execute('config set "merge_max_datasets" 2;')["type"] == "ok"
    assert engine.execute("compact all;")["type"] == "ok"
    assert len(engine.catalog.manifest["datasets"]) == 5
    engine.execute('config set "merge_max_datasets" 10;')
    engine.compact_fully(smart=False)
    assert len(engine.catalog.manifest["datasets"]) == 2  # tags differ
    assert [ask(engine, q) for q in queries] == before
    assert engine.execute("compact smart;")["type"] == "ok"


def test_config_status_ping(engine):
    assert engine.execute('config get "query_max_edge" "no";')["result"]["keys"] == {"query_max_edge": 2}
    assert engine.execute('config set "query_max_edge" 256;')["type"] == "error"
    assert engine.execute('config set "no" 1;')["type"] == "error"
    assert engine.execute("status;")["result"]["tasks"] == []
    assert engine.execute("ping;", "ab")["result"]["connection_id"] == "6162"
    assert engine.execute("nonsense;")["error"]["retry"] is False


def test_locks_and_snapshots(engine, put):
    engine.execute(f'index "{put("a", x=b"test")}";')
    (name,) = engine.catalog.manifest["datasets"]
    with engine.catalog.task("work", {("dataset", name)}):
        assert engine.execute(f'dataset "{name}" taint "t";')["error"] == {"message": "Can't acquire lock, try again later", "retry": True}
        assert len(engine.execute("status;")["result"]["tasks"]) == 1 + 0
        engine.execute(f'dataset "{name}" drop;')  # takes no lock; files stay while a task reads them
        assert engine.storage.exists(f"files/t={name}")
    assert not engine.storage.exists(f"files/t={name}") and not engine.storage.exists(f"postings/t={name}")
    with pytest.raises(Locked), engine.catalog.task("a", {("iterator", "i")}), engine.catalog.task("b", {("iterator", "i")}):
        pass
    with pytest.raises(ValueError), engine.catalog.task("fails") as (task, _):
        task.changes.append(("config", "query_max_edge", 9))
        raise ValueError
    assert engine.catalog.config("query_max_edge") == 2


def test_parallel_pops_take_each_file_once(engine, put):
    engine.execute(f'index "{put("a", **{f"f{k}": b"test" for k in range(8)})}";')
    name = engine.execute('select into iterator "test";')["result"]["iterator"]
    got, guard = [], threading.Lock()

    def work():
        while True:
            r = engine.execute(f'iterator "{name}" pop 1;')
            if r["type"] == "error":
                if r["error"]["retry"]:
                    continue
                return
            with guard:
                got.extend(r["result"]["files"])

    threads = [threading.Thread(target=work) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == len(set(got)) == 8


def test_upgrade_and_reopening(spark, tmp_path):
    old = {"config": {"max_mem_size": 5, "query_max_edge": 3}, "datasets": [], "iterators": None}
    assert upgraded(old) == {"config": {"query_max_edge": 3}, "datasets": {}, "iterators": {}, "version": "1.5.0"}
    storage = Storage(spark, (tmp_path / "c").as_uri())
    Catalog.create(storage)
    with pytest.raises(CatalogError):
        Catalog.create(storage)
    storage.create("files/t=lost/x", "1")
    c = Catalog.open(storage)
    assert c.orphans() == ["files/t=lost"] and c.orphans(remove=True) and c.orphans() == []


def test_manifests_survive_crashes_and_other_writers(spark, tmp_path):
    storage = Storage(spark, (tmp_path / "c").as_uri())
    a = Catalog.create(storage)
    b = Catalog.open(storage)
    for c, key, n in ((a, "query_max_edge", 7), (b, "query_max_ngram", 8), (a, "database_workers", 9)):
        with c.task("set") as (task, _):
            task.changes.append(("config", key, n))
    with a.task("late") as (task, _):
        task.changes.append(("config", "merge_max_datasets", 3))
        with b.task("early") as (other, _):  # commits between a's snapshot and a's commit
            other.changes.append(("config", "merge_max_files", 4))
    want = {"query_max_edge": 7, "query_max_ngram": 8, "database_workers": 9, "merge_max_datasets": 3, "merge_max_files": 4}
    assert Catalog.open(storage).manifest["config"] == want
    storage.create(f"manifest-{a.number + 1}.json", '{"version": "1.5')  # a writer died
    c = Catalog.open(storage)
    assert c.manifest["config"] == want
    with c.task("set") as (task, _):
        task.changes.append(("config", "query_max_edge", 1))
    assert Catalog.open(storage).manifest["config"]["query_max_edge"] == 1
    with pytest.raises(CatalogError, match="meanwhile"):
        changed(c.manifest, [("drop", "gone")], lenient=False)
    for n in Catalog._numbers(storage):
        storage.delete(f"manifest-{n}.json")
    storage.create("files/t=some/x", "1")
    with pytest.raises(CatalogError, match="missing"):
        Catalog.open(storage)


def test_old_cursors_go_after_any_task(engine, put):
    engine.execute(f'index "{put("a", x=b"test")}";')
    name = engine.execute('select into iterator "test";')["result"]["iterator"]
    engine.catalog.manifest["iterators"][name]["last_read"] -= 10**6
    engine.execute("ping;")
    with engine.catalog.task("any"):
        pass
    assert engine.catalog.manifest["iterators"] == {} and not engine.storage.exists(f"iterators/{name}")


def test_many_datasets_in_one_job(spark, engine):
    rows = [(f"s{k % 3}", f"p{k}", bytearray(b"common text " + bytes([97 + k]) * 5)) for k in range(12)] + [("s9", "q", None)]
    found = spark.createDataFrame(rows, "name string, path string, content binary").repartition(3)
    assert engine.index_many(found, ["gram3", "text4"], lambda n: [n, "all"]) == ["s0", "s1", "s2"]
    assert len({d["table"] for d in engine.catalog.manifest["datasets"].values()}) == 1
    assert names(engine.execute('select "common";')) == sorted(f"p{k}" for k in range(12))
    assert names(engine.execute('select with taints ["s1"] "common";')) == ["p1", "p10", "p4", "p7"]
    assert names(engine.execute('select with datasets ["s0"] "ddddd" | "common";')) == ["p0", "p3", "p6", "p9"]
    counters = engine.execute('select with taints ["s1"] "ccccc";')["counters"]
    assert counters["read"]["count"] == counters["uniq_read"]["count"] == 1
    sets = engine.execute("topology;")["result"]["datasets"]
    assert all(d["file_count"] == 4 and sum(i["size"] for i in d["indexes"]) > 0 for d in sets.values())
    engine.execute('dataset "s1" drop;')
    assert names(engine.execute('select "common";')) == sorted(f"p{k}" for k in range(12) if k % 3 != 1)
    engine.execute('dataset "s0" untaint "s0";')
    engine.execute('dataset "s2" untaint "s2";')
    engine.compact_fully(smart=False)
    assert len(engine.catalog.manifest["datasets"]) == 1 and engine.catalog.orphans() == []
    assert names(engine.execute('select "common" & min 1 of ("ddddd", "ggggg");')) == ["p3", "p6"]
    with pytest.raises(CatalogError):
        name = next(iter(engine.catalog.manifest["datasets"]))
        engine.index_many(spark.createDataFrame([(name, "z", bytearray(b"abcd"))], "name string, path string, content binary"))


def test_large_random_files_before_and_after_merging(engine, spark, monkeypatch):
    """Several slices and buckets, and every answer equal to a scan's."""
    import numpy as np

    from trigrove.operators import postings

    monkeypatch.setattr(postings, "BUCKET_POSTINGS", 100_000)
    monkeypatch.setattr(postings, "SLICE_POSTINGS", 50_000)
    monkeypatch.setattr(postings, "HELD", 150_000)
    data = [np.random.default_rng(k).integers(0, 256, 100_000, dtype=np.uint8).tobytes() for k in range(12)]
    for part in (range(5), range(5, 12)):
        rows = [(f"r{k}", bytearray(data[k])) for k in part]
        engine.index(spark.createDataFrame(rows, "path string, content binary").repartition(3), ["gram3", "hash4"])
    wanted = [data[k % 12][1000 * k : 1000 * k + 4] for k in range(12)]
    query = parse_query(" | ".join("{" + w.hex() + "}" for w in wanted))
    alone = [parse_query("{" + w.hex() + "}") for w in wanted[:4]]
    answers = lambda: [sorted(r["path"] for r in engine.select(q).collect()) for q in (query, *alone)]
    before = answers()
    for q, w, got in zip(alone, wanted, before[1:]):
        assert {f"r{k}" for k, d in enumerate(data) if w in d} <= set(got)
    assert len(before[0]) == 12
    ids = engine.files(engine.catalog.manifest["datasets"]).groupBy("dataset_id").agg({"file_id": "max"}).collect()
    assert sorted(r[1] for r in ids) == [4, 6]
    assert engine.compact() is not None and answers() == before
    runs = engine.runs(engine.catalog.manifest["datasets"])
    assert runs.where("itype = 'gram3'").select("gram_bucket").distinct().count() > 8


def test_reindex_reads_only_the_files_of_the_dataset(engine, put):
    at = put("a", one=b"abcdef", two=b"abcxyz")
    engine.execute(f'index "{at}" with [gram3];')
    put("a", three=b"abcdef", **{"od,d{1}": b"abcdef"})
    (name,) = engine.catalog.manifest["datasets"]
    import os

    os.remove(f"{at}/two")
    assert engine.execute(f'reindex "{name}" with [text4];')["type"] == "ok"
    assert ask(engine, '"abcd"') == ["one"]
    engine.execute(f'index "{at}" with [gram3];')
    (new,) = [n for n, d in engine.catalog.manifest["datasets"].items() if d["index_types"] == ["gram3"]]
    assert engine.execute(f'reindex "{new}" with [text4];')["type"] == "ok"
    assert ask(engine, '"abcd"') == ["od,d{1}", "one", "three"]
    assert engine.execute(f'index "{at}" "{at}/one" nocheck;')["type"] == "ok"  # named twice, comes twice
    assert ask(engine, '"abcd"').count("one") == 3


def test_choice():
    sets = lambda *n: {f"d{k}": {"taints": [], "index_types": ["gram3"], "file_count": c, "sizes": {"gram3": c}} for k, c in enumerate(n)}
    assert compaction.choose(sets(10, 11, 50), True, 10, 1000) == ["d0", "d1"]
    assert compaction.choose(sets(10, 50), True, 10, 1000) == []
    assert compaction.choose(sets(10, 50, 60), False, 2, 1000) == ["d0", "d1"]
    assert compaction.choose(sets(10, 50, 60), False, 10, 59) == []
    assert compaction.choose(sets(10, 50, 60), False, 10, 1000, lambda n: n == "d0") == ["d1", "d2"]


def test_candidates_hold_all_matches_and_joins_agree(spark):
    own = registry.files(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in registry.documents(spark, SF).collect()}
    for types in (["gram3"], ["text4"], ["hash4"], ["gram3", "text4", "hash4"]):
        hits = registry.indexes(spark, SF, types)
        for q in ('"ouer"', '"the of" & ("ations" | "License")', 'min 2 of ("erenth", "ouer", "and the")'):
            tree = rewrite(plan(parse_query(q), types))
            a = compiler.candidates(tree, hits, own)
            b = compiler.candidates_by_joins(plan(parse_query(q), types), hits, own)
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        found = {r["doc_id"] for r in compiler.candidates(rewrite(plan(parse_query('"ouer"'), types)), hits, own).join(own, ["dataset_id", "file_id"]).collect()}
        assert {d for d, t in texts.items() if "ouer" in t} <= found


def test_many_grams_use_an_array(spark):
    own, hits = registry.files(spark, SF), registry.index(spark, SF, "gram3")
    words = [a + b + c for a in "aeiou" for b in "nrstl" for c in "aeiot"]
    query = f'min 3 of ({", ".join(chr(34) + w + chr(34) for w in words)}) & "the"'
    tree = rewrite(plan(parse_query(query), ["gram3"]))
    a = compiler.candidates(tree, hits, own)
    b = compiler.candidates_by_joins(tree, hits, own)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_lookups_are_pushed_down(spark):
    tree = rewrite(plan(parse_query('"retition"'), ["gram3"]))
    df = compiler.candidates(tree, registry.index(spark, SF, "gram3"), registry.files(spark, SF))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in text and "gram_bucket" in text and text.count("Exchange hashpartitioning") == 1


def test_stream(spark, engine, put, tmp_path):
    at = put("s", a=b"first file", b=b"second file")
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(at)
    for _ in range(2):
        ingest(stream, engine, (tmp_path / "cp").as_uri()).awaitTermination()
    assert ask(engine, '"file"') == ["a", "b"]
    put("s", c=b"third file")
    ingest(stream, engine, (tmp_path / "cp").as_uri()).awaitTermination()
    assert ask(engine, '"file"') == ["a", "b", "c"]
    assert len(engine.catalog.manifest["datasets"]) == 2


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    got = sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, SF).collect())
    assert got == want


def equals_sql(spark, name, folder):
    """A query's rows over a folder's documents are its SQL's, and there are some."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    got = sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, str(folder)).collect())
    return len(want) > 0 and got == want


@pytest.fixture
def documents(tmp_path):
    """Writes a table of documents of these sources and languages, with longer ids first."""

    def write(rows, text="the of it"):
        ids = range(len(rows) + 5, 5, -1)  # 9 comes after 10 in the order of paths
        table = {"doc_id": list(ids), "text": [text] * len(rows), "source": [s for s, _ in rows], "lang": [l for _, l in rows]}
        pq.write_table(pa.table(table, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("lang", pa.string())])), tmp_path / "documents.parquet")
        return tmp_path

    return write


def test_compact_remap_of_large_contents(spark, monkeypatch):
    monkeypatch.setattr("trigrove.operators.engine.SPREAD", 16384)  # more than this for each core, as 1 GB is
    assert equals_sql(spark, "compact_remap", SF)


def test_cursor_page_of_large_contents(spark, monkeypatch):
    monkeypatch.setattr("trigrove.operators.engine.SPREAD", 16384)
    monkeypatch.setattr(registry, "_BUILT", {})
    assert equals_sql(spark, "cursor_page", SF)


def test_ids_follow_paths_whatever_the_size(spark, engine, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"p{k}", b"the of it") for k in range(300, 0, -1)], "path string, content binary")  # of unknown size
    rows.repartition(5).write.parquet((tmp_path / "rows").as_uri())
    stored = spark.read.parquet((tmp_path / "rows").as_uri())
    for found, bytes_of_range in ((rows, 64 << 20), (stored, 1 << 30), (stored, 4096), (stored, 256)):
        monkeypatch.setattr("trigrove.operators.engine.SPREAD", bytes_of_range)
        name = engine.index(found, ["gram3"], check=False)
        assert [r["path"] for r in engine.files([name]).orderBy("file_id").collect()] == sorted(f"p{k}" for k in range(1, 301))


@pytest.mark.parametrize("n", [20, 21, 60])
def test_cursor_page_ends_with_the_cursor(spark, documents, n):
    assert len(registry.cursor_page(spark, str(documents([("a", "en")] * n))).collect()) == min(25, n - 20)


def test_cursor_page_tells_a_failure(spark, documents, monkeypatch):
    do = Engine._do_iterator

    def second_is_locked(self, c, *rest):
        if c.number == 25:
            raise Locked
        return do(self, c, *rest)

    monkeypatch.setattr(Engine, "_do_iterator", second_is_locked)
    with pytest.raises(KeyError):
        registry.cursor_page(spark, str(documents([("a", "en")] * 30)))


def test_cursor_page_puts_documents_without_source_or_language_last(spark, documents):
    assert equals_sql(spark, "cursor_page", documents([(None, "de"), ("a", None), (None, None), ("t", "en")] * 11))


def test_cursor_page_puts_documents_without_id_last_in_their_dataset(spark, tmp_path):
    ids = [None if k % 4 == 0 else k - 30 for k in range(60)]
    table = {"doc_id": ids, "text": ["the of it"] * 60, "source": [["a", "b", None][k % 3] for k in range(60)], "lang": ["en"] * 60}
    pq.write_table(pa.table(table, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("lang", pa.string())])), tmp_path / "documents.parquet")
    assert equals_sql(spark, "cursor_page", tmp_path)


def test_compact_remap_orders_equal_sizes_by_source(spark, documents):
    assert equals_sql(spark, "compact_remap", documents([(s, "en") for s in ("a", "a-b", None, "", "a/b", "B") for _ in range(3)] + [("a", "x/en"), ("a", None)]))


def test_compact_remap_merges_all_datasets(spark, documents):
    assert equals_sql(spark, "compact_remap", documents([(f"s{k % 1100}", "en") for k in range(1130)]))  # merge_max_datasets is 1024 at most


def test_compact_remap_merges_any_number_of_files(spark, documents, monkeypatch):
    monkeypatch.setitem(CONFIG, "merge_max_files", (7, 1, 4294967295))
    assert equals_sql(spark, "compact_remap", documents([(s, "en") for s in "abc" for _ in range(4)]))


def test_compacting_as_a_whole_leaves_the_limits_to_commands(engine, put):
    for k in range(4):
        engine.execute(f'index "{put(f"d{k}", **{f"f{k}": b"abcdef"})}" with [gram3];')
    engine.execute('config set "merge_max_datasets" 2;')
    engine.execute("compact all;")
    assert sorted(d["file_count"] for d in engine.catalog.manifest["datasets"].values()) == [1, 1, 2]
    assert engine.compact(whole=True) is not None
    assert [d["file_count"] for d in engine.catalog.manifest["datasets"].values()] == [4]
    assert ask(engine, '"abcd"') == ["f0", "f1", "f2", "f3"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
