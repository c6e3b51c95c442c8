"""From rewritten trees to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.operators.postings import folders_of
from trigrove.plans.ast import And, AtLeast, Gram, Node, Or, grams_in
from trigrove.plans.planner import is_everything

#: Grams up to which each has a flag of its own; beyond, the grams found are gathered in an array.
FLAGS = 100


def condition(node: Node, of) -> Column:
    """The tree over ``of(gram)``, a boolean column for each gram."""
    if isinstance(node, Gram):
        return of(node)
    parts = [condition(a, of) for a in node.args]
    if isinstance(node, AtLeast):
        total = F.lit(0)
        for p in parts:
            total = total + p.cast("int")
        return total >= node.n
    out = F.lit(isinstance(node, And))
    for p in parts:
        out = (out & p) if isinstance(node, And) else (out | p)
    return out


def lookups(postings: DataFrame, grams: list[Gram]) -> DataFrame:
    """The postings of these grams: partition filters on type and bucket, and a pushed filter on the gram."""
    wanted = None
    for kind in sorted({g.type for g in grams}):
        ids = sorted(g.id for g in grams if g.type == kind)
        one = (F.col("itype") == kind) & F.col("gram").isin(ids)
        if "gram_bucket" in postings.columns:
            one = one & F.col("gram_bucket").isin(sorted({f for i in ids for f in folders_of(i)}))
        wanted = one if wanted is None else wanted | one
    return postings.where(wanted)


def candidates(node: Node, postings: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset_id, file_id) that satisfy a rewritten tree: one filtered scan and one aggregation.

    A tree that holds for every file reads the files instead; no other rewritten tree holds for a file without hits.
    """
    if is_everything(node):
        return files.select("dataset_id", "file_id")
    grams = sorted(grams_in(node))
    if not grams:  # nothing can satisfy it
        return files.select("dataset_id", "file_id").where(F.lit(False))
    hits = lookups(postings, grams)
    keys = hits.groupBy("dataset_id", "file_id")
    if isinstance(node, Gram):
        return hits.select("dataset_id", "file_id")
    if isinstance(node, And) and all(isinstance(a, Gram) for a in node.args):
        # postings are distinct, so a conjunction holds where all its grams are counted
        return keys.agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).drop("n")
    if isinstance(node, Or) and all(isinstance(a, Gram) for a in node.args):
        return keys.agg(F.count("*").alias("n")).drop("n")
    if len(grams) <= FLAGS:
        flags = {g: f"g{k}" for k, g in enumerate(grams)}
        found = keys.agg(*[F.max((F.col("itype") == g.type) & (F.col("gram") == g.id)).alias(n) for g, n in flags.items()])
        return found.where(condition(node, lambda g: F.col(flags[g]))).select("dataset_id", "file_id")
    code = F.lit(None)
    for kind in {g.type for g in grams}:
        code = F.when(F.col("itype") == kind, F.concat(F.lit(f"{kind}:"), F.col("gram").cast("string"))).otherwise(code)
    found = keys.agg(F.collect_set(code).alias("found"))
    return found.where(condition(node, lambda g: F.array_contains("found", f"{g.type}:{g.id}"))).select("dataset_id", "file_id")


def candidates_by_joins(node: Node, postings: DataFrame, files: DataFrame) -> DataFrame:
    """The same as semi-joins, unions and counts, node by node: a second implementation to check the first."""
    every = files.select("dataset_id", "file_id")
    if isinstance(node, Gram):
        return postings.where((F.col("itype") == node.type) & (F.col("gram") == node.id)).select("dataset_id", "file_id")
    parts = [candidates_by_joins(a, postings, files) for a in node.args]
    if isinstance(node, AtLeast):
        if node.n == 0:
            return every
        total = every.where(F.lit(False))
        for p in parts:
            total = total.unionByName(p)
        return total.groupBy("dataset_id", "file_id").agg(F.count("*").alias("n")).where(F.col("n") >= node.n).drop("n")
    if isinstance(node, And):
        out = every
        for p in parts:
            out = out.join(p, ["dataset_id", "file_id"], "left_semi")
        return out
    out = every.where(F.lit(False))
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def scan_condition(node: Node, content: Column) -> Column | None:
    """A tree as a condition on raw bytes, for files without an index: of gram3 and text4 only, else None.

    A file holds such a gram just when it holds its bytes.
    """
    from trigrove.functions.grams import ALPHABET

    grams = grams_in(node)
    if any(g.type not in ("gram3", "text4") for g in grams):
        return None

    def of(g: Gram) -> Column:
        data = g.id.to_bytes(3, "big") if g.type == "gram3" else "".join(ALPHABET[g.id >> s & 63] for s in (18, 12, 6, 0)).encode()
        return F.contains(content, F.lit(bytearray(data)))

    return condition(node, of)
