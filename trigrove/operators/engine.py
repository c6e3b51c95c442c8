"""The search engine: index, select, compact and the other commands, over a catalog."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove import __version__
from trigrove.operators import compaction, postings
from trigrove.operators.catalog import CONFIG, Catalog, CatalogError, Locked, Task
from trigrove.plans import compiler
from trigrove.plans.ast import And, AtLeast, Gram, Node, Or, grams_in
from trigrove.plans.parser import Command, ParseError, parse
from trigrove.plans.planner import plan, rewrite
from trigrove.sources import files as sources
from trigrove.sources.storage import Storage


#: Bytes of a range of contents that a task indexes, about. From UNKNOWN on an estimate only says that Spark has none.
SPREAD, UNKNOWN = 64 << 20, 1 << 50


def in_order(df: DataFrame, *columns: str, name: str, at: str) -> DataFrame:
    """df with ``name``: 0, 1, 2 ... along the columns' order, without gathering the rows in one task.

    Rows are written in sorted ranges to ``at`` and numbered from there, so that ids stand whatever executors are lost; the
    ranges' counts, one number each, give every range its first number.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_m", F.monotonically_increasing_id())
    ranged.withColumn("_part", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m").write.parquet(at)
    kept = spark.read.parquet(at)
    rows, base = [], 0
    for part, n in sorted((r[0], r[1]) for r in kept.groupBy("_part").count().collect()):  # a row for each range
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "_part long, _base long")
    return kept.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_k")).drop("_part", "_k", "_base")


class Engine:
    """Commands over the catalog at ``root``. ``reader`` gives (path, content) of paths; files are read by default."""

    def __init__(self, spark: SparkSession, root: str, reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> None:
        self.spark = spark
        self.storage = Storage(spark, root)
        self.catalog = Catalog.open(self.storage)
        self.reader = reader or sources.scan

    # tables

    def _read(self, top: str, schema: str, entries: dict[str, dict]) -> DataFrame:
        """Rows of these datasets, with ``dataset_id``: all their tables in one scan.

        Tables are folders, so tags and ids prune before any file is opened; a dataset of a table with several is found by
        a pushed filter on its number there.
        """
        tables: dict[str, list[int]] = {}
        for e in entries.values():
            tables.setdefault(e["table"], []).append(e["ds"])
        paths = [self.storage.path(f"{top}/t={t}") for t in sorted(tables) if self.storage.exists(f"{top}/t={t}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, t string, dataset_id string")
        rows = self.spark.read.schema(f"{schema}, t string").option("basePath", self.storage.path(top)).parquet(*paths)
        size = {e["table"]: e["of"] for e in entries.values()}
        parts = {t: sorted(ds) for t, ds in tables.items() if len(ds) < size[t]}
        if parts:
            wanted = ~F.col("t").isin(sorted(parts))
            for t, ds in parts.items():
                wanted = wanted | ((F.col("t") == t) & F.col("ds").isin(ds))
            rows = rows.where(wanted)
            if set(parts) == set(tables):
                rows = rows.where(F.col("ds").isin(sorted({d for ds in parts.values() for d in ds})))
        if len(entries) == 1:
            return rows.withColumn("dataset_id", F.lit(next(iter(entries))))
        if max(size.values()) == 1:
            return rows.withColumn("dataset_id", _lookup({e["table"]: n for n, e in entries.items()}, F.col("t")))
        if len(tables) == 1:
            return rows.withColumn("dataset_id", _lookup({e["ds"]: n for n, e in entries.items()}, F.col("ds")))
        return rows.withColumn("dataset_id", _lookup({f"{e['table']}/{e['ds']}": n for n, e in entries.items()}, F.concat_ws("/", "t", "ds")))

    def _entries(self, names: Iterable[str], snapshot: dict | None = None) -> dict[str, dict]:
        have = (snapshot or self.catalog.manifest)["datasets"]
        return {n: have[n] for n in names}

    def files(self, names: Iterable[str], snapshot: dict | None = None) -> DataFrame:
        """(dataset_id, file_id, path) of these datasets."""
        return self._read("files", "ds int, file_id int, path string", self._entries(names, snapshot)).select("dataset_id", "file_id", "path")

    def runs(self, names: Iterable[str], snapshot: dict | None = None) -> DataFrame:
        """(gram, ids, itype, gram_bucket, dataset_id) of these datasets."""
        return self._read("postings", postings.TABLE, self._entries(names, snapshot))

    def postings(self, names: Iterable[str], snapshot: dict | None = None) -> DataFrame:
        """(gram, dataset_id, file_id, itype, gram_bucket) of these datasets; filters go below the explosion of runs."""
        return self.runs(names, snapshot).select("gram", "dataset_id", F.explode("ids").alias("file_id"), "itype", "gram_bucket")

    # indexing

    def index(self, found: DataFrame, types: Iterable[str] = ("gram3",), taints: Iterable[str] = (), check: bool = True) -> str | None:
        """A new dataset of (path, content); paths that the catalog has already are left out if ``check``. Its id, or None if it'd be empty."""
        with self.catalog.task("index") as (task, snapshot):
            return self._index(task, snapshot, found, list(dict.fromkeys(types)), list(taints), check)

    def index_many(self, found: DataFrame, types: Iterable[str] = ("gram3",), taints: Callable[[str], Iterable[str]] = lambda name: (), check: bool = True) -> list[str]:
        """A dataset for each value of ``name`` in (name, path, content), with that id and the tags ``taints`` gives it, in one job.

        They share a table, so that many small datasets don't make many small files. The ids of those that got files.
        """
        with self.catalog.task("index many") as (task, snapshot):
            names = sorted(r[0] for r in found.select("name").distinct().collect())  # datasets, far fewer than files
            taken = [n for n in names if n in snapshot["datasets"]]
            if taken or not all(names):
                raise CatalogError(f"there are datasets already: {taken}" if taken else "a dataset's name is missing")
            numbered = found.withColumn("ds", _lookup({n: k for k, n in enumerate(names)}, F.col("name"))) if names else found.withColumn("ds", F.lit(0))
            return self._build(task, snapshot, numbered, list(dict.fromkeys(types)), {n: list(taints(n)) for n in names}, check, self.catalog.fresh_id())

    def _index(self, task: Task, snapshot: dict, found: DataFrame, types: list[str], taints: list[str], check: bool) -> str | None:
        name = self.catalog.fresh_id()
        made = self._build(task, snapshot, found.withColumn("ds", F.lit(0)), types, {name: taints}, check, name)
        return made[0] if made else None

    def _build(self, task: Task, snapshot: dict, found: DataFrame, types: list[str], named: dict[str, list[str]], check: bool, table: str) -> list[str]:
        """Datasets of (ds, path, content), the k-th of ``named`` (id to tags) of the rows with ds = k.

        Contents are dealt out in the order of paths, so ids follow it. A scan of each range gives every file a number within its
        task and its postings in blocks; from there on only these are shuffled. Numbers become ids by adding the files of the tasks before.
        """
        if check and snapshot["datasets"]:
            found = found.join(self.files(snapshot["datasets"], snapshot).select("path"), "path", "left_anti")
        scratch = f"scratch/{table}"
        try:
            postings.scanned(self._spread(sources.usable(found)), types).write.parquet(self.storage.path(f"{scratch}/raw"))
            raw = self.spark.read.parquet(self.storage.path(f"{scratch}/raw"))
            base, count = postings.bases(raw)
            if not count:
                return []
            task.work_estimated = sum(count.values())
            placed = raw.where(F.col("path").isNotNull()).join(base, ["ds", "pid"])
            placed.select("ds", (F.col("base") + F.col("k")).cast("int").alias("file_id"), "path").write.parquet(self.storage.path(f"files/t={table}"))
            task.work_done = task.work_estimated // 2
            runs = postings.gathered(raw, base, self._partitions()) if types else None
            if runs is not None:
                postings.write(runs, self.storage.path(f"postings/t={table}"))
            entries = self._described(table, types, {n: (k, count[k]) for k, n in enumerate(named) if k in count}, raw)
        finally:
            self.storage.delete(scratch)
        task.work_done = task.work_estimated
        for name, entry in entries.items():
            task.changes.append(("insert", name, entry))
            task.changes += [("toggle_taint", name, t) for t in dict.fromkeys(named[name])]
        return list(entries)

    def _spread(self, found: DataFrame) -> DataFrame:
        """Contents in the order of paths, which ids follow whatever their size: in ranges of about SPREAD bytes, for all cores at least."""
        size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= SPREAD // 64:
            dealt = found.coalesce(1)
        elif size < UNKNOWN:
            dealt = found.repartitionByRange(max(self.spark.sparkContext.defaultParallelism, -(-size // SPREAD)), "ds", "path")
        else:
            dealt = found.repartitionByRange("ds", "path")
        return dealt.sortWithinPartitions("ds", "path")

    def _partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _described(self, table: str, types: list[str], sets: dict[str, tuple[int, int]], raw: DataFrame | None = None) -> dict[str, dict]:
        """The entries of a table's datasets, id to (number, files). Datasets share its bytes by their postings and files."""
        bytes_of = {t: self.storage.size(f"postings/t={table}/itype={t}") for t in types}
        share = {(t, k): 1.0 for t in types for k, _ in sets.values()}
        if len(sets) > 1:
            rows = raw.where(F.col("block").isNotNull()).groupBy("itype", "ds").agg(F.sum("n").alias("n")).collect()  # a row for each type and dataset
            total = {t: sum(r["n"] for r in rows if r["itype"] == t) for t in types}
            share = {(r["itype"], r["ds"]): r["n"] / total[r["itype"]] for r in rows}
        names, of = self.storage.size(f"files/t={table}"), sum(n for _, n in sets.values())
        out = {}
        for name, (k, n) in sets.items():
            sizes = {t: round(bytes_of[t] * share.get((t, k), 0.0)) for t in types}
            out[name] = {"taints": [], "index_types": sorted(types), "file_count": n, "sizes": sizes, "size": sum(sizes.values()) + names * n // of, "table": table, "ds": k, "of": len(sets)}
        return out

    def reindex(self, name: str, types: Iterable[str]) -> str | None:
        """The dataset built anew with other index types; tags stay. Files that are gone are left out."""
        with self.catalog.task("reindex", {("dataset", name)}) as (task, snapshot):
            if name not in snapshot["datasets"]:
                raise CatalogError(f"no dataset {name}")
            paths = self.files([name], snapshot).select("path")
            if self.reader is sources.scan:
                found = sources.named(self.spark, paths)
            else:
                found = self.reader(self.spark, None).join(paths, "path", "left_semi").dropDuplicates(["path"])
            new = self._index(task, snapshot, found, list(dict.fromkeys(types)), snapshot["datasets"][name]["taints"], check=False)
            task.changes.insert(0, ("drop", name))
            return new

    def compact(self, smart: bool = False, whole: bool = False) -> str | None:
        """Merges the best group of datasets, if there is one: file ids move by the files before them.

        The configured limits bound what one merge takes; ``whole`` merges all of the group at once, however large it is.
        """
        chosen: list[str] = []

        def locks(snapshot: dict):
            limits = (None, None) if whole else (self.catalog.config("merge_max_datasets"), self.catalog.config("merge_max_files"))
            chosen.extend(compaction.choose(snapshot["datasets"], smart, *limits, lambda n: self.catalog.locked("dataset", n)))
            return {("dataset", n) for n in chosen}

        with self.catalog.task(f"compact {'smart' if smart else 'all'}", locks) as (task, snapshot):
            return self._merge(task, snapshot, chosen) if len(chosen) > 1 else None

    def _merge(self, task: Task, snapshot: dict, names: list[str]) -> str:
        entries = [snapshot["datasets"][n] for n in names]
        if any(sorted(e["taints"]) != sorted(entries[0]["taints"]) or e["index_types"] != entries[0]["index_types"] for e in entries):
            raise CatalogError("datasets with different tags or index types can't be merged")
        base, total = {}, 0
        for n, e in zip(names, entries, strict=True):
            base[n] = total
            total += e["file_count"]
        new, types = self.catalog.fresh_id(), entries[0]["index_types"]
        moved = self.files(names, snapshot).select(F.lit(0).alias("ds"), (F.col("file_id") + _lookup(base, F.col("dataset_id"))).cast("int").alias("file_id"), "path")
        moved.write.parquet(self.storage.path(f"files/t={new}"))
        if types:
            runs = postings.joined(self.runs(names, snapshot), _lookup(base, F.col("dataset_id")), total, self._partitions())
            if runs is not None:
                postings.write(runs, self.storage.path(f"postings/t={new}"))
        task.changes += [("drop", n) for n in names]
        for name, entry in self._described(new, types, {new: (0, total)}).items():
            task.changes.append(("insert", name, entry))
        task.changes += [("toggle_taint", new, t) for t in entries[0]["taints"]]
        return new

    def compact_fully(self, smart: bool = True) -> int:
        """Compacts until nothing is merged any more; the number of merges."""
        n = 0
        while self.compact(smart):
            n += 1
        return n

    # queries

    def select(self, query: Node, taints: Iterable[str] = (), datasets: Iterable[str] = (), snapshot: dict | None = None) -> DataFrame:
        """(ordinal, dataset_id, file_id, path) of the files that may satisfy a query, over all datasets with these tags.

        Every dataset is planned for its index types; datasets of equal types are read together.
        """
        m = snapshot or self.catalog.manifest
        have, names = m["datasets"], self._chosen(m, taints, datasets)
        by_types: dict[tuple, list[str]] = {}
        for n in names:
            by_types.setdefault(tuple(have[n]["index_types"]), []).append(n)
        out = None
        for types, group in by_types.items():
            tree = rewrite(plan(query, types))
            files = self.files(group, m)
            found = compiler.candidates(tree, self.postings(group, m), files).join(files, ["dataset_id", "file_id"])
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], "ordinal int, dataset_id string, file_id int, path string")
        return out.select(_lookup({n: k for k, n in enumerate(names)}, F.col("dataset_id")).alias("ordinal"), "dataset_id", "file_id", "path")

    def _chosen(self, m: dict, taints: Iterable[str], datasets: Iterable[str]) -> list[str]:
        """The datasets that a query asks: those named, else all, that have all the tags."""
        wanted, have = list(datasets), m["datasets"]
        for d in wanted:
            if d not in have:
                raise CatalogError(f"Invalid dataset specified in query: {d}")
        names = sorted(set(wanted)) if wanted else list(have)
        return [n for n in names if set(taints) <= set(have[n]["taints"])]

    def explain(self, query: Node, types: Iterable[str]) -> str:
        return str(rewrite(plan(query, types)))

    # commands

    def execute(self, text: str, connection: str = "") -> dict:
        """The response to a command, as the objects of its JSON."""
        try:
            command = parse(text)
        except ParseError as e:
            return error(f"Parse error: {e}", False)
        try:
            return getattr(self, f"_do_{command.kind}")(command, text, connection)
        except CatalogError as e:
            return error(str(e), e.retry)
        except MemoryError:
            return error("out of memory", False)

    def _do_select(self, c: Command, text: str, connection: str) -> dict:
        started = time.monotonic()
        with self.catalog.task(text, connection=connection) as (task, snapshot):
            found = self.select(c.query, c.taints, c.datasets, snapshot)
            counters = self._counters(c, snapshot)
            if c.into_iterator:
                name = self.catalog.fresh_id()
                path = self.storage.path(f"iterators/{name}")
                in_order(found, "ordinal", "file_id", name="place", at=self.storage.path(f"scratch/{name}")).select("place", "path").write.parquet(path)
                self.storage.delete(f"scratch/{name}")
                total = self.spark.read.schema("place long, path string").parquet(path).count()
                task.changes.append(("new_iterator", name, {"position": 0, "total": total, "last_read": time.time()}))
                result = {"mode": "iterator", "file_count": total, "iterator": name}
            else:
                result = {"mode": "raw", "files": [r["path"] for r in found.orderBy("ordinal", "file_id").select("path").collect()]}
        for v in counters.values():
            v["milliseconds"] = int(1000 * (time.monotonic() - started)) if v["count"] else 0
        return {"type": "select", "result": result, "counters": counters}

    def _counters(self, c: Command, snapshot: dict) -> dict:
        total = {k: 0 for k in ("and", "or", "read", "uniq_read", "minof")}

        def count(node: Node) -> None:
            if isinstance(node, Gram):
                total["read"] += 1
                return
            kind = "and" if isinstance(node, And) else "or" if isinstance(node, Or) else "minof"
            total[kind] += 1 if isinstance(node, AtLeast) else max(0, len(node.args) - 1)
            for a in node.args:
                count(a)

        for d in self._entries(self._chosen(snapshot, c.taints, c.datasets), snapshot).values():
            tree = rewrite(plan(c.query, d["index_types"]))
            count(tree)
            total["uniq_read"] += len(grams_in(tree))
        return {k: {"count": v, "milliseconds": 0} for k, v in total.items()}

    def _do_iterator(self, c: Command, text: str, connection: str) -> dict:
        with self.catalog.task(text, {("iterator", c.name)}, connection) as (task, snapshot):
            cursor = snapshot["iterators"].get(c.name)
            if cursor is None:
                raise CatalogError(f"no iterator {c.name}")
            end = min(cursor["total"], cursor["position"] + c.number)
            rows = self.spark.read.schema("place long, path string").parquet(self.storage.path(f"iterators/{c.name}"))
            paths = [r["path"] for r in rows.where((F.col("place") >= cursor["position"]) & (F.col("place") < end)).orderBy("place").collect()]
            task.changes.append(("update_iterator", c.name, {"position": end, "total": cursor["total"], "last_read": time.time()}))
        return {"type": "select", "result": {"mode": "raw", "files": paths, "iterator_position": end, "total_files": cursor["total"]}}

    def _do_index(self, c: Command, text: str, connection: str) -> dict:
        with self.catalog.task(text, connection=connection) as (task, snapshot):
            paths = sources.listed(self.spark, c.list_file) if c.list_file else list(c.paths)
            self._index(task, snapshot, self.reader(self.spark, paths), list(dict.fromkeys(c.types)), list(c.taints), c.check)
        return OK

    def _do_reindex(self, c: Command, text: str, connection: str) -> dict:
        self.reindex(c.name, c.types)
        return OK

    def _do_compact(self, c: Command, text: str, connection: str) -> dict:
        self.compact(c.mode == "smart")
        return OK

    def _do_config(self, c: Command, text: str, connection: str) -> dict:
        if c.mode == "get":
            keys = [k for k in c.keys if k in CONFIG] if c.keys else list(CONFIG)
            return {"type": "config", "result": {"keys": {k: self.catalog.config(k) for k in keys}}}
        key = c.keys[0]
        if key not in CONFIG:
            raise CatalogError(f"Invalid key name specified: {key}")
        if not CONFIG[key][1] <= c.number <= CONFIG[key][2]:
            raise CatalogError(f"Value {c.number} is out of range of {key}")
        with self.catalog.task(text, connection=connection) as (task, _):
            task.changes.append(("config", key, c.number))
        return OK

    def _do_status(self, c: Command, text: str, connection: str) -> dict:
        tasks = [{"id": t.id, "connection_id": t.connection.encode().hex().upper(), "request": t.request, "work_done": t.work_done, "work_estimated": t.work_estimated, "epoch_ms": t.epoch_ms} for t in self.catalog.tasks()]
        return {"type": "status", "result": {"tasks": tasks, "version": __version__}}

    def _do_topology(self, c: Command, text: str, connection: str) -> dict:
        sets = {n: {"indexes": [{"type": t, "size": d["sizes"][t]} for t in d["index_types"]], "size": d["size"], "file_count": d["file_count"], "taints": d["taints"]} for n, d in self.catalog.manifest["datasets"].items()}
        return {"type": "topology", "result": {"datasets": sets}}

    def _do_ping(self, c: Command, text: str, connection: str) -> dict:
        return {"type": "ping", "result": {"status": "ok", "connection_id": connection.encode().hex().upper(), "version": __version__}}

    def _do_dataset(self, c: Command, text: str, connection: str) -> dict:
        if c.mode == "drop":
            with self.catalog.task(text, connection=connection) as (task, _):
                task.changes.append(("drop", c.name))
            return OK
        with self.catalog.task(text, {("dataset", c.name)}, connection) as (task, snapshot):
            if c.name not in snapshot["datasets"]:
                raise CatalogError(f"no dataset {c.name}")
            has = c.keys[0] in snapshot["datasets"][c.name]["taints"]
            if has != (c.mode == "taint"):
                task.changes.append(("toggle_taint", c.name, c.keys[0]))
        return OK


def _lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small dict."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key]


OK = {"type": "ok", "result": {"status": "ok"}}


def error(message: str, retry: bool) -> dict:
    return {"type": "error", "error": {"message": message, "retry": retry}}


__all__ = ["Engine", "Locked", "in_order"]
