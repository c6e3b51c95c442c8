"""WARC archives with revisit records: write pages deduplicated by payload digest, read them back and resolve revisits."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import arrow_schema, fresh_path, growing, read, released, written

#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
#: Bytes of payload that one archive file holds, about.
FILE_BYTES = 32 << 20
END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    """A record's URN: the page id (or ``null``) under a name space of this writer."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def headers(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to) of each page: refers_to is null for responses.

    Only digests are shuffled, not payloads. A digest's largest page_id is its response. Pages whose payload is
    null count as empty; rows that repeat a page_id all hold the same payload under the response's rules.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select("page_id", F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    own = written(own, "warc-headers")
    large = own.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    shared = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.drop("n"), "warc-shared")
    found = own.join(shared, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("response") != F.col("page_id"), F.col("response"))
    return found.select("page_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per page to WARC files under ``path``.

    Each line of Spark's text writer is a record without its end; the end of every WARC record, two line breaks, is
    the writer's line separator. Files therefore come and go with Spark's commit protocol, whatever executor is lost.
    """
    heads = written(headers(pages, least), "warc-resolved").select(F.col("page_id").alias("_id"), "payload_bytes", "payload_digest", "refers_to")
    heads = heads.groupBy("_id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.max("refers_to").alias("refers_to"))
    total, n = heads.agg(F.sum("payload_bytes"), F.count("*")).first()
    body = F.coalesce(F.col("html"), F.lit(""))
    both = pages.select("page_id", "url", body.alias("body"), F.sha1(F.encode(body, "UTF-8")).alias("_digest"))
    both = both.join(growing(heads), both["page_id"].eqNullSafe(heads["_id"]) & (F.col("_digest") == F.col("payload_digest")))
    revisit = F.col("refers_to").isNotNull()
    # a URL must not break the header
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    )
    record = F.concat(lines, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    # the join's partitions become files as they are, cut where they hold too many records
    most = max(1, int(file_bytes * n / max(1, total or 1)))
    both.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(data: bytes):
    """The records of one archive, uncompressed: (header fields by lower-case name, payload)."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:head_end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode("ascii", "replace").lower()] = value.decode("utf-8", "replace").strip()
        start = head_end + 4
        end = start + int(fields["content-length"])
        yield fields, data[start:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: record_id, record_type, url, payload (null for revisits), payload_digest, refers_to_id."""
    schema = "record_id string, record_type string, url string, payload binary, payload_digest string, refers_to_id string"

    def records(batches):
        target = arrow_schema(schema)
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                data = content.as_py()
                for fields, payload in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = fields["warc-type"]
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-target-uri"), None if kind == "revisit" else payload, fields["warc-payload-digest"].partition(":")[2], fields.get("warc-refers-to")))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), target)], schema=target)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), target)], schema=target)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(released(records), schema)


def resolve(records: DataFrame) -> DataFrame:
    """Gives each revisit its response's length; a response's digest is computed anew from what was read.

    Responses that revisits refer to are joined by record id; Spark splits a response with many revisits.
    """
    read_back = records.select(
        "record_id", "record_type", "refers_to_id", F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
    )
    read_back = written(read_back, "warc-read")
    originals = read_back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    originals = originals.join(read_back.where("record_type = 'revisit'").select("refers_to_id").distinct(), "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    originals = written(originals, "warc-originals")
    revisits = read_back.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    return read_back.where("record_type = 'response'").select("record_id", "record_type", "refers_to_id", "payload_digest", "payload_bytes").unionByName(
        revisits.select("record_id", "record_type", "refers_to_id", F.coalesce("_digest", "payload_digest").alias("payload_digest"), F.col("_bytes").alias("payload_bytes"))
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' archives, reads them back and gives page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty response; a null page_id is written under the name ``null`` and is never a revisit.
    Repeated rows give repeated records; an empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc-archives")
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return resolve(read_archives(spark, path)).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to_id")).alias("refers_to")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


#: The operator's rows in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest AS d, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN r ON payload_digest = d AND payload_bytes >= 1000
"""
