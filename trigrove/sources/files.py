"""Files and tables as documents: (path, content)."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def absolute(path: str) -> str:
    """Local paths made absolute, not canonical; URIs as they are."""
    return path if "://" in path else os.path.abspath(path)


def _literal(path: str) -> str:
    """A path as a pattern that only it fits."""
    return "".join(f"\\{c}" if c in "*?[]{}\\," else c for c in path)


def _load(spark: SparkSession, patterns: list[str]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    one = reader.load(patterns).where("length > 0")
    plain = [p for p in patterns if "://" not in p]
    return one.withColumn("path", F.regexp_replace("path", r"^file:(//)?(?=/)", "")) if plain else one


def scan(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, content) of all regular files at or below the paths. A file named twice comes twice.

    Files that can't be read are left out, as are empty ones and those with a line break in their name. Plain local
    paths come out without a scheme. Paths of which none lies in another are read in one scan.
    """
    scans: list[tuple[bool, set[str]]] = []
    for at in sorted(map(absolute, paths)):
        above = {at[:k] for k in range(1, len(at)) if at[k] == "/"} | {at, at.rstrip("/")}
        local = "://" not in at
        room = next((held for kind, held in scans if kind == local and not held & above), None)
        if room is None:
            scans.append((local, {at}))
        else:
            room.add(at)
    found = None
    for _, held in scans:
        one = _load(spark, [_literal(p) for p in sorted(held)])
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "path string, content binary")
    return usable(found.select("path", "content"))


def named(spark: SparkSession, files: DataFrame, most: int = 500) -> DataFrame:
    """(path, content) of exactly the files that a table's column ``path`` names, as far as they are still there.

    Their names go through the driver, as every scan's file list does. A pattern names ``most`` files of one folder.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    by_folder: dict[str, list[str]] = {}
    for row in files.select("path").distinct().toLocalIterator():
        folder, _, name = row["path"].rpartition("/")
        by_folder.setdefault(folder, []).append(name)
    patterns = []
    for folder, own in by_folder.items():
        for k in range(0, len(own), most):
            pattern = f"{_literal(folder)}/{{{','.join(map(_literal, own[k : k + most]))}}}"
            at = jvm.org.apache.hadoop.fs.Path(pattern)
            if at.getFileSystem(conf).globStatus(at):
                patterns.append(pattern)
    if not patterns:
        return spark.createDataFrame([], "path string, content binary")
    return usable(_load(spark, patterns).select("path", "content"))


def usable(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNotNull() & (F.length("content") > 0) & F.col("path").isNotNull() & ~F.col("path").rlike("[\r\n]"))


def listed(spark: SparkSession, list_file: str) -> list[str]:
    """The paths that a list file names, one a line; blank lines are skipped."""
    return [r["value"] for r in spark.read.text(absolute(list_file)).where(F.trim("value") != "").collect()]


def of_table(table: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
    """(path, content) of a table's rows: the key under a prefix, and the text's UTF-8 bytes."""
    return usable(table.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("path"), F.encode(text, "UTF-8").alias("content")))
