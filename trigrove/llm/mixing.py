"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.llm.common import growing, read, written

#: Weights of the sources in code-point order, repeating.
CYCLE = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def weighted(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` to (source, source_size): CYCLE along the sources in code-point order, null last."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(CYCLE)))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (place + 1).cast("int")).cast("double"))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes by weight, each up to ``most`` times its size.

    Water filling in closed form. In the order of cap over weight, the first k sources are at their caps and
    the rest share what is left by weight, where k is the least number for which no other cap is exceeded.
    """
    cap = F.col("source_size") * F.lit(most)
    ranked = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = sources.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= cap)
    at = F.min(F.when(F.col("open"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(Window.partitionBy())
    return leveled.withColumn("final", at["level"]).withColumn("target", F.least(cap, F.coalesce(F.col("final") * F.col("weight"), cap))).drop("level", "open", "final")


def when_of(part: Column, slope: Column) -> Column:
    """The time t in 0..1 at which a source with weight schedule 1 + slope * (2t - 1) has spent ``part`` of its demand.

    The demand up to t is the schedule's integral (1 - slope) t + slope t^2, whose inverse this is.
    """
    a = F.lit(1.0) - slope
    return F.when(F.abs(slope) < 1e-9, part).otherwise((F.sqrt(a * a + slope * part * 4) - a) / (slope * 2) + 0.0)


def draw_of(column: str) -> Column:
    """60 bits of the id's MD5: the random order in which a source's documents are taken (a null id draws as '')."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, bucket_rows: int = 2000, slopes: tuple[float, ...] = (0.5, 0.0, -0.5)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position, passes, order_key.

    A source's documents follow each other in an order drawn by hash; its target cuts a repeated walk along
    that order, so each document is taken whole ``floor(target / source_size)`` or one more times, and the one at
    the cut in part. ``position`` in 0..1 is when the curriculum first reaches the document: sources cycle through
    ``slopes`` (rising, level and falling schedules), and the integral of the schedule is inverted at the
    document's share of the source's target. Rows come range-sorted by position; those not taken last.

    Null text counts 0 words. Sources and ids may be null; repeated rows are kept, each with its own place.
    A source without words has target 0. Extra columns are ignored. The running sums of a hot source are
    taken within hash buckets of about ``bucket_rows`` rows and carried over by a sum for each bucket.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw_of("doc_id").alias("draw"))
    rows = written(rows, "mixing-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.pmod(place, F.lit(len(slopes))) + 1).cast("int"))
    sources = written(targets(weighted(sources), share, most).withColumn("slope", slope).withColumn("buckets", F.ceil(F.col("source_rows") / bucket_rows)), "mixing-sources")
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # eqNullSafe keeps the null source; the bucket is a range of the draw, so buckets follow each other in order
    unit = F.col("draw") / F.lit(2.0**60)
    placed = joined.withColumn("bucket", F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size"), "mixing-bases")
    based = placed.join(sums.withColumnsRenamed({"source": "s", "bucket": "b"}), placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b"))).drop("s", "b")
    inner = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("base") + F.sum("size").over(inner)
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - whole * F.col("source_size")
    out = based.withColumn("start", upto - F.col("size")).withColumn("whole", whole).withColumn("rest", rest)
    out = out.withColumn("taken", (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).cast("long"))
    part = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("start") / F.col("target"))).otherwise(F.lit(1.0))
    out = out.withColumn("position", F.when(F.col("taken") > 0, when_of(part, F.col("slope"))))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "draw", "start", "slope")
    # unread rows are spread by their draw, so that no range of positions is hot
    key = F.coalesce(F.col("position"), F.lit(2.0) + unit)
    return out.withColumn("order_key", key).repartitionByRange("order_key", "doc_id").sortWithinPartitions("order_key", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document once for every pass over its source that reaches it, in the order of positions.

    A pass's position inverts the schedule at what its source has spent when that pass reaches the document. The document at a source's cut is kept whole. Documents that no pass reaches go. Columns are those of ``docs``.
    """
    taken = mixed(docs).where("taken > 0")
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    first = F.min(F.struct("position", "start", "source_size", "target", "slope")).alias("_first")
    reached = taken.groupBy("draw").agg(F.max(passes).alias("_passes"), first)
    kept = docs.withColumn("_draw", draw_of("doc_id")).join(growing(reached), F.col("draw") == F.col("_draw"))
    kept = kept.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_passes"))))
    spent = F.col("_first.start") + (F.col("_pass") - 1) * F.col("_first.source_size")
    at = when_of(F.least(F.lit(1.0), spent / F.col("_first.target")), F.col("_first.slope"))
    out = kept.withColumn("_at", at).repartitionByRange("_at", "_draw").sortWithinPartitions("_at", "_draw")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The operator's rows in DuckDB SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents),
sources AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM sources),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY source_size * 2.0::DOUBLE / weight, (source IS NULL), encode(source))),
fin AS (SELECT *, (SELECT min(level) FROM (SELECT arg_min(level, source_size * 2.0::DOUBLE / weight) AS level FROM leveled
         WHERE level * weight <= source_size * 2.0::DOUBLE)) AS top FROM leveled),
t AS (SELECT source, source_size, slope, least(source_size * 2.0::DOUBLE, coalesce(top * weight, source_size * 2.0::DOUBLE)) AS target FROM fin),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS goal,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM placed),
got AS (
  SELECT *, (whole * size + greatest(0, least(size, goal - whole * source_size - start)))::BIGINT AS taken,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, start / target) ELSE 1.0::DOUBLE END AS part FROM cut)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN part
            ELSE (sqrt((1 - slope) * (1 - slope) + slope * part * 4) - (1 - slope)) / (slope * 2) + 0.0 END END AS position
FROM got
"""
