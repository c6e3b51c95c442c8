"""The engine's registered queries over the driver's tables, and their DuckDB counterparts.

Rows of ``documents`` are the files: the id is the path, the text's UTF-8 bytes the content; a dataset holds one source
and language, and the language is its tag. All queries go through an ``Engine``; a catalog is built once a session for
the index types that queries ask for, and read by all of them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.operators import compaction, postings
from trigrove.operators.engine import Engine
from trigrove.plans import compiler
from trigrove.plans.parser import parse_query
from trigrove.plans.planner import plan, rewrite

_BUILT: dict[tuple, object] = {}


def workspace(spark: SparkSession) -> str:
    """A folder of this session in the one that driver and executors share (in one process only, a local one where none is set)."""
    key = ("workspace", spark.sparkContext.applicationId)
    if key not in _BUILT:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='trigrove-')}"
        _BUILT[key] = f"{shared.rstrip('/')}/index-{uuid.uuid4().hex[:12]}"
    return _BUILT[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def content_of(kind: str):
    """UTF-8 bytes, or for wide grams UTF-16 of the text with '?' for all that isn't plain ASCII."""
    if kind == "wide8":
        return F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "UTF-16LE")
    return F.encode("text", "UTF-8")


def contents(spark: SparkSession, sf_dir: str, kind: str = "gram3") -> DataFrame:
    """(name, path, content) of the documents, ``name`` being the dataset."""
    return documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("name"), F.col("doc_id").cast("string").alias("path"), content_of(kind).alias("content"))


def tag_of(dataset: str) -> list[str]:
    return [dataset.rpartition("/")[2]]


def fresh(spark: SparkSession, sf_dir: str, reader: Callable | None = None) -> Engine:
    """An engine over a new catalog."""
    return Engine(spark, f"{workspace(spark)}/db-{uuid.uuid4().hex[:8]}", reader)


def engine(spark: SparkSession, sf_dir: str, types=("gram3",)) -> Engine:
    """The session's engine over the documents, a dataset for each source and language, with these index types."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(types))
    if key not in _BUILT:
        e = fresh(spark, sf_dir)
        e.index_many(contents(spark, sf_dir, types[0]), types, tag_of)
        _BUILT[key] = e
    return _BUILT[key]


def mixed_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The same with gram3 only for English datasets and text grams too for the others."""
    key = (spark.sparkContext.applicationId, sf_dir, "mixed")
    if key not in _BUILT:
        e, rows = fresh(spark, sf_dir), contents(spark, sf_dir)
        english = F.col("name").endswith("/en")
        e.index_many(rows.where(english), ["gram3"], tag_of)
        e.index_many(rows.where(~english), ["gram3", "text4"], tag_of)
        _BUILT[key] = e
    return _BUILT[key]


def files(spark: SparkSession, sf_dir: str, types=("gram3",)) -> DataFrame:
    """(dataset_id, file_id, doc_id): ids count from 0 within each dataset."""
    e = engine(spark, sf_dir, types)
    return e.files(e.catalog.manifest["datasets"]).select("dataset_id", "file_id", F.col("path").cast("long").alias("doc_id"))


def index(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The postings of one index type."""
    e = engine(spark, sf_dir, (kind,))
    return e.postings(e.catalog.manifest["datasets"])


def indexes(spark: SparkSession, sf_dir: str, types) -> DataFrame:
    e = engine(spark, sf_dir, tuple(types))
    return e.postings(e.catalog.manifest["datasets"])


def found(spark: SparkSession, sf_dir: str, query: str, types=("gram3",), taints=(), datasets=()) -> DataFrame:
    """(ordinal, dataset_id, file_id, path, doc_id) of the candidates of a query."""
    return engine(spark, sf_dir, types).select(parse_query(query), taints, datasets).withColumn("doc_id", F.col("path").cast("long"))


def select(query: str, types=("gram3",), **filters):
    return lambda spark, sf_dir: found(spark, sf_dir, query, types, **filters).select("doc_id")


# SQL by hand: a literal's candidates hold all its pieces


def pieces(literal: str, n: int, text: str = "text") -> str:
    return "(" + " AND ".join(f"contains({text}, '{literal[k : k + n]}')" for k in range(len(literal) - n + 1)) + ")"


def docs_where(condition: str) -> str:
    return f"SELECT doc_id FROM documents WHERE text <> '' AND {condition}"


ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"
WINDOWS3 = "SELECT doc_id, source || '/' || lang AS ds, ('0x' || substr(h, 2 * i + 1, 6))::INTEGER AS gram FROM (SELECT doc_id, source, lang, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)) - 2)) AS i FROM documents WHERE text <> '')"
GRAM3 = f"SELECT DISTINCT doc_id, ds, gram FROM ({WINDOWS3})"
HASH4 = (
    "SELECT DISTINCT doc_id, xor(x // 256, x & 16777215)::INTEGER AS gram FROM (SELECT doc_id, ('0x' || substr(h, 2 * i + 1, 8))::BIGINT AS x FROM "
    "(SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)) - 3)) AS i FROM documents WHERE text <> ''))"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 ' || chr(10) || '"


def text_grams(text: str) -> str:
    code = lambda k: f"(strpos('{ALPHABET}', substr(r, i + {k}, 1)) - 1)"
    return (
        f"SELECT DISTINCT doc_id, (((({code(1)} * 64) + {code(2)}) * 64 + {code(3)}) * 64 + {code(4)})::INTEGER AS gram FROM "
        f"(SELECT doc_id, r, unnest(range(0, length(r) - 3)) AS i FROM (SELECT doc_id, unnest(regexp_extract_all({text}, '[A-Za-z0-9 \\n]{{4,}}')) AS r FROM documents))"
    )


def posting_rows(kind: str):
    return lambda spark, sf_dir: index(spark, sf_dir, kind).join(files(spark, sf_dir, (kind,)), ["dataset_id", "file_id"]).select("doc_id", "gram")


def gram_document_frequency(spark, sf_dir):
    return postings.document_frequency(index(spark, sf_dir, "gram3")).select("gram", "files")


def posting_runs(spark, sf_dir):
    runs = postings.runs(index(spark, sf_dir, "gram3"))
    return runs.select("dataset_id", "gram", F.size("run").cast("long").alias("files"), F.element_at("run", 1).alias("first_id"), F.element_at("run", -1).alias("last_id"), F.aggregate("run", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


FIDS = "SELECT doc_id, source || '/' || lang AS ds, (row_number() OVER (PARTITION BY source || '/' || lang ORDER BY doc_id::VARCHAR) - 1)::INTEGER AS fid FROM documents WHERE text <> ''"


def _hits(spark, sf_dir, literal):
    return found(spark, sf_dir, literal).select("dataset_id", "file_id")


def setop(kind: str):
    def run(spark, sf_dir):
        a, b, c = (_hits(spark, sf_dir, q) for q in ('"retition"', '"ouer"', '"license"'))
        out = {"intersect": lambda: postings.intersect(a, b), "union": lambda: postings.union(a, c), "threshold": lambda: postings.threshold([a, b, c, b], 2)}[kind]()
        return out.join(files(spark, sf_dir), ["dataset_id", "file_id"]).select("doc_id")

    return run


def dedupe_anti_join(spark, sf_dir):
    """What a second indexing of all documents takes in when those in English are catalogued: its new datasets' files."""
    e, rows = fresh(spark, sf_dir), contents(spark, sf_dir)
    e.index_many(rows.where(F.col("name").endswith("/en")), [], tag_of)
    new = e.index(rows.select("path", "content"), [])
    return e.files([new] if new else []).select("path")


def select_mixed_index_types(spark, sf_dir):
    """Datasets with gram3 only and datasets with text grams too: each planned for what it has."""
    return mixed_engine(spark, sf_dir).select(parse_query('"erenth"')).select(F.col("path").cast("long").alias("doc_id"))


def select_multi_table_nocheck(spark, sf_dir):
    """Two tables and one of them again, indexed without a check: repeated paths stay."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("path"), F.encode("text", "UTF-8").alias("content"))
    e = fresh(spark, sf_dir)
    e.index(docs, ["gram3", "text4"])
    for _ in range(2):
        e.index(talks, ["gram3", "text4"], check=False)
    return e.select(parse_query('"ouer"')).select("path")


def unindexed_scan(spark, sf_dir):
    """A query over raw bytes: the plan as a condition of the scan, without any shuffle."""
    tree = rewrite(plan(parse_query('min 2 of ("erenth", "ouer", "ations") & "the of"'), ["gram3", "text4"]))
    return documents(spark, sf_dir).where(compiler.scan_condition(tree, F.encode("text", "UTF-8"))).select("doc_id")


def select_by_joins(spark, sf_dir):
    tree, own = rewrite(plan(parse_query('"ouer" & ("retition" | "erenth")'), ["gram3"])), files(spark, sf_dir)
    return compiler.candidates_by_joins(tree, index(spark, sf_dir, "gram3"), own).join(own, ["dataset_id", "file_id"]).select("doc_id")


def plan_rewrite_equivalence(spark, sf_dir):
    """Files for which the raw and the rewritten plan differ: none; and how many both find."""
    raw = plan(parse_query('min 2 of ("ouer", "erenth", "retition") | ("the of" & ("ouer" & "ab"))'), ["gram3"])
    own, hits = files(spark, sf_dir), index(spark, sf_dir, "gram3")
    a = compiler.candidates(rewrite(raw), hits, own).withColumn("a", F.lit(1))
    b = compiler.candidates_by_joins(raw, hits, own).withColumn("b", F.lit(1))
    both = a.join(b, ["dataset_id", "file_id"], "full")
    return both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("different"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("equal"))


#: The path of documents without an id: it sorts after all numbers.
NO_ID = "~"


def cursor_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose cursors follow SQL's order: documents without a source or language come last, those without an id last in their dataset.

    Where every document has all three, the session's engine is in that order.
    """
    key, rows = (spark.sparkContext.applicationId, sf_dir, "cursors"), documents(spark, sf_dir)
    if key not in _BUILT:
        if rows.where(F.col("source").isNull() | F.col("lang").isNull() | F.col("doc_id").isNull()).isEmpty():
            return engine(spark, sf_dir)
        e, name = fresh(spark, sf_dir), F.coalesce(F.concat(F.lit("s/"), "source", F.lit("/"), "lang"), F.lit("t"))
        e.index_many(rows.select(name.alias("name"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID)).alias("path"), content_of("gram3").alias("content")))
        _BUILT[key] = e
    return _BUILT[key]


def cursor_page(spark, sf_dir):
    """The second page of a cursor: 20 files are popped, then 25 more; a cursor of no more than 20 is gone by then."""
    e = cursor_engine(spark, sf_dir)
    name = e.execute('select into iterator "the of";')["result"]["iterator"]
    first = e.execute(f'iterator "{name}" pop 20;')["result"]
    more = first["iterator_position"] < first["total_files"]
    page = e.execute(f'iterator "{name}" pop 25;')["result"]["files"] if more else []
    return spark.createDataFrame([(20 + k, None if path == NO_ID else int(path)) for k, path in enumerate(page)], "place long, doc_id long")


def topology(spark, sf_dir):
    """Files and tags of each dataset as the command tells them, and its postings."""
    e = engine(spark, sf_dir, ("gram3", "text4"))
    told = [(n, d["file_count"], d["taints"][0]) for n, d in e.execute("topology;")["result"]["datasets"].items()]
    counts = spark.createDataFrame(told, "dataset_id string, file_count long, taint string")
    runs = e.runs(e.catalog.manifest["datasets"]).withColumn("n", F.size("ids"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("itype") == t, F.col("n"))), F.lit(0)).alias(f"{t}_postings")
    sizes = runs.groupBy("dataset_id").agg(of("gram3"), of("text4"))
    return counts.join(sizes, "dataset_id", "left").select("dataset_id", "file_count", F.coalesce("gram3_postings", F.lit(0)).alias("gram3_postings"), F.coalesce("text4_postings", F.lit(0)).alias("text4_postings"), "taint")


def _counts(spark, sf_dir) -> dict[str, dict]:
    """The catalog's datasets with files for bytes, as SQL doesn't know an index's bytes."""
    have = engine(spark, sf_dir).catalog.manifest["datasets"]
    return {n: d | {"sizes": {"gram3": d["file_count"]}} for n, d in sorted(have.items())}


def _english(spark, sf_dir) -> Engine:
    """The English documents, a dataset for each source; ids sort as sources do, and null comes last."""
    e, english = fresh(spark, sf_dir), documents(spark, sf_dir).where(F.col("lang") == "en")
    name = F.coalesce(F.concat(F.lit("s/"), "source"), F.lit("t"))
    e.index_many(english.select(name.alias("name"), F.col("doc_id").cast("string").alias("path"), content_of("gram3").alias("content")), ["gram3"], lambda _: ["en"])
    return e


def compact_remap(spark, sf_dir):
    """Ids after the English datasets are compacted into one, from the smallest to the largest, however many they are."""
    e = _english(spark, sf_dir)
    e.compact(whole=True)
    return e.files(e.catalog.manifest["datasets"]).select(F.col("path").cast("long").alias("doc_id"), "file_id")


def compact_select(spark, sf_dir):
    """Candidates of a query after the same compaction."""
    e = _english(spark, sf_dir)
    e.compact(whole=True)
    return e.select(parse_query('"ouer" & ("retition" | "the of")')).select(F.col("path").cast("long").alias("doc_id"))


def compact_candidates(smart: bool):
    def run(spark, sf_dir):
        chosen = compaction.choose(_counts(spark, sf_dir), smart, 10, 2097152)
        return spark.createDataFrame([(n,) for n in sorted(chosen)], "dataset_id string")

    return run


def reindex_precision(spark, sf_dir):
    """Candidates of a literal before and after a dataset of all documents is indexed anew with text grams too."""
    rows = contents(spark, sf_dir).select("path", "content")
    e, query = fresh(spark, sf_dir, lambda _, paths: rows), parse_query('"andation"')
    name = e.index(rows, ["gram3"])
    before = e.select(query).count()
    e.execute(f'reindex "{name}" with [gram3, text4];')
    return spark.createDataFrame([(before, e.select(query).count())], "before long, after long")


def false_positive_rate(spark, sf_dir):
    hits = found(spark, sf_dir, '"retition"').select("doc_id")
    truth = documents(spark, sf_dir).select("doc_id", F.contains("text", F.lit("retition")).alias("t"))
    return truth.join(hits.withColumn("h", F.lit(1)), "doc_id", "left").agg(F.count_if(F.col("h").isNotNull()).alias("candidates"), F.count_if("t").alias("matches"), F.count_if(F.col("t") & F.col("h").isNull()).alias("missed"))


def _group_choice(smart: bool) -> str:
    """M1 to M3 in SQL: at most 10 datasets of a language, from the smallest on; ``smart`` stops at the first that is twice as large."""
    smart_rule = "prev IS NULL OR prev * 2 > n" if smart else "true"
    return f"""
WITH c AS (SELECT source || '/' || lang AS dataset_id, lang, count(*) AS n FROM documents WHERE text <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, dataset_id) AS k, lag(n) OVER (PARTITION BY lang ORDER BY n, dataset_id) AS prev FROM c),
s AS (SELECT *, bool_and({smart_rule}) OVER (PARTITION BY lang ORDER BY k) AS ok FROM r),
t AS (SELECT * FROM s WHERE ok AND k <= 10),
g AS (SELECT lang, count(*) - sum(n) // count(*) AS v, min(dataset_id) AS first FROM t GROUP BY lang HAVING count(*) > 1),
w AS (SELECT lang FROM g ORDER BY v DESC, (SELECT min(dataset_id) FROM c WHERE c.lang = g.lang) LIMIT 1)
SELECT dataset_id FROM t WHERE lang = (SELECT lang FROM w)"""


_B3 = lambda s: pieces(s, 3)


def _hash_select(literal: str) -> str:
    ids = []
    for k in range(len(literal) - 3):
        a, b, c, d = literal[k : k + 4].encode()
        ids.append(((a ^ b) << 16) | ((b ^ c) << 8) | (c ^ d))
    ids = sorted(set(ids))
    return f"SELECT doc_id FROM ({HASH4}) WHERE gram IN ({', '.join(map(str, ids))}) GROUP BY doc_id HAVING count(*) = {len(ids)}"


#: name -> (query, SQL or None)
TABLE = {
    "gram3_postings": (posting_rows("gram3"), f"SELECT doc_id, gram FROM ({GRAM3})"),
    "text4_postings": (posting_rows("text4"), text_grams("text")),
    "hash4_postings": (posting_rows("hash4"), HASH4),
    "wide8_postings": (posting_rows("wide8"), text_grams(ASCII)),
    "gram_document_frequency": (gram_document_frequency, f"SELECT gram, count(*) AS files FROM ({GRAM3}) GROUP BY gram"),
    "posting_runs": (posting_runs, f"SELECT g.ds AS dataset_id, gram, count(*) AS files, min(fid) AS first_id, max(fid) AS last_id, sum(fid)::BIGINT AS id_sum FROM ({GRAM3}) g JOIN ({FIDS}) f ON g.doc_id = f.doc_id GROUP BY 1, 2"),
    "select_literal_gram3": (select('"retition"'), docs_where(_B3("retition"))),
    "select_literal_text4": (select('"thereation"', ("text4",)), docs_where(pieces("thereation", 4))),
    "select_literal_hash4": (select('"erenth"', ("hash4",)), _hash_select("erenth")),
    "select_literal_all": (select('"ations"', ("gram3", "text4", "hash4")), docs_where(pieces("ations", 4))),
    "select_literal_wide8": (select('w"erenth"', ("wide8",)), docs_where(" AND ".join(f"contains({ASCII}, '{'erenth'[k : k + 4]}')" for k in (0, 1, 2)))),
    "select_wildcard": (select('"thea\\x??nth"'), docs_where("contains(text, 'the') AND contains(text, 'hea') AND contains(text, 'nth')")),
    "select_nibble": (select("{74 68 65 6? 6e 74 68}"), docs_where("contains(text, 'the') AND contains(text, 'nth')")),
    "select_alternatives": (select("{6f 75 65 (72 | 7?) 61 74 69}"), docs_where("contains(text, 'oue') AND contains(text, 'ati')")),
    "select_and": (select('"retition" & "ouer"'), docs_where(f"{_B3('retition')} AND {_B3('ouer')}")),
    "select_or": (select('"license" | "License"'), docs_where(f"({_B3('license')} OR {_B3('License')})")),
    "select_right_assoc": (select('"license" | "ouer" & "License" | "retition"'), docs_where(f"({_B3('license')} OR ({_B3('ouer')} AND ({_B3('License')} OR {_B3('retition')})))")),
    "select_nested": (select('("ouer" & ("erenth" | "License")) | min 2 of ("retition", "the of", "license")'), docs_where(f"(({_B3('ouer')} AND ({_B3('erenth')} OR {_B3('License')})) OR ({_B3('retition')}::INT + {_B3('the of')}::INT + {_B3('license')}::INT) >= 2)")),
    "select_minof": (select('min 2 of ("retition", "ouer", "the of")'), docs_where(f"({_B3('retition')}::INT + {_B3('ouer')}::INT + {_B3('the of')}::INT) >= 2")),
    "select_minof_duplicates": (select('min 2 of ("ouer", "ouer", "retition")'), docs_where(f"({_B3('ouer')}::INT * 2 + {_B3('retition')}::INT) >= 2")),
    "select_minof_zero": (select('min 0 of ("ouer")'), docs_where("true")),
    "select_minof_too_many": (select('min 3 of ("ouer", "retition")'), docs_where("false")),
    "select_minof_all": (select('min 2 of ("ouer", "retition")'), docs_where(f"{_B3('ouer')} AND {_B3('retition')}")),
    "select_everything_short": (select('"ab"'), docs_where("true")),
    "select_with_taints": (select('"ouer"', taints=["fr"]), docs_where(f"lang = 'fr' AND {_B3('ouer')}")),
    "select_with_datasets": (select('"ouer"', datasets=["src1/en", "src2/en"]), docs_where(f"source IN ('src1', 'src2') AND lang = 'en' AND {_B3('ouer')}")),
    "select_everything_by_tag": (select("{}", taints=["fr"]), docs_where("lang = 'fr'")),
    "select_mixed_index_types": (select_mixed_index_types, docs_where(f"((lang = 'en' AND {_B3('erenth')}) OR (lang <> 'en' AND {pieces('erenth', 4)}))")),
    "select_multi_table_nocheck": (select_multi_table_nocheck, f"SELECT 'd' || doc_id AS path FROM documents WHERE {pieces('ouer', 4)} UNION ALL SELECT 'c-' || conv_id || '-' || turn FROM conversations, range(2) WHERE {pieces('ouer', 4)}"),
    "unindexed_scan": (unindexed_scan, docs_where(f"({pieces('erenth', 4)}::INT + {pieces('ouer', 4)}::INT + {pieces('ations', 4)}::INT) >= 2 AND {pieces('the of', 4)}")),
    "select_by_joins": (select_by_joins, docs_where(f"{_B3('ouer')} AND ({_B3('retition')} OR {_B3('erenth')})")),
    "plan_rewrite_equivalence": (plan_rewrite_equivalence, f"SELECT 0::BIGINT AS different, count(*) AS equal FROM documents WHERE ({_B3('ouer')}::INT + {_B3('erenth')}::INT + {_B3('retition')}::INT) >= 2 OR ({_B3('the of')} AND {_B3('ouer')})"),
    "setop_intersect": (setop("intersect"), docs_where(f"{_B3('retition')} INTERSECT {docs_where(_B3('ouer'))}")),
    "setop_union": (setop("union"), docs_where(f"{_B3('retition')} UNION {docs_where(_B3('license'))}")),
    "setop_threshold": (setop("threshold"), docs_where(f"({_B3('retition')}::INT + 2 * {_B3('ouer')}::INT + {_B3('license')}::INT) >= 2")),
    "dedupe_anti_join": (dedupe_anti_join, "SELECT doc_id::VARCHAR AS path FROM documents WHERE text <> '' AND lang <> 'en'"),
    "cursor_page": (cursor_page, f"SELECT place, doc_id FROM (SELECT row_number() OVER (ORDER BY source || '/' || lang, doc_id::VARCHAR) - 1 AS place, doc_id FROM documents WHERE {_B3('the of')}) WHERE place >= 20 AND place < 45"),
    "topology": (topology, f"SELECT dataset_id, file_count, coalesce(g3, 0) AS gram3_postings, coalesce(t4, 0) AS text4_postings, taint FROM (SELECT source || '/' || lang AS dataset_id, lang AS taint, count(*) AS file_count FROM documents WHERE text <> '' GROUP BY ALL) LEFT JOIN (SELECT ds, count(*) AS g3 FROM ({GRAM3}) GROUP BY ds) ON ds = dataset_id LEFT JOIN (SELECT source || '/' || lang AS d2, count(*) AS t4 FROM ({text_grams('text')}) t JOIN documents USING (doc_id) GROUP BY 1) ON d2 = dataset_id"),
    "compact_remap": (compact_remap, "SELECT doc_id, (row_number() OVER (ORDER BY n, source, doc_id::VARCHAR) - 1)::INTEGER AS file_id FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE lang = 'en' AND text <> '')"),
    "compact_select": (compact_select, docs_where(f"lang = 'en' AND {_B3('ouer')} AND ({_B3('retition')} OR {_B3('the of')})")),
    "compact_candidates_all": (compact_candidates(False), _group_choice(False)),
    "compact_candidates_smart": (compact_candidates(True), _group_choice(True)),
    "reindex_precision": (reindex_precision, f"SELECT count(*) FILTER (WHERE {_B3('andation')}) AS before, count(*) FILTER (WHERE {pieces('andation', 4)}) AS after FROM documents WHERE text <> ''"),
    "false_positive_rate": (false_positive_rate, f"SELECT count(*) FILTER (WHERE {_B3('retition')}) AS candidates, count(*) FILTER (WHERE contains(text, 'retition')) AS matches, 0::BIGINT AS missed FROM documents"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
