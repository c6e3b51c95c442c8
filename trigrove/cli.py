"""Command line: one command or a prompt, creation of a catalog, compaction to the end, trimming."""

from __future__ import annotations

import argparse
import json
import sys
import time


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trigrove", description=__doc__)
    parser.add_argument("root", help="folder or URI of the catalog")
    parser.add_argument("--new", action="store_true", help="create the catalog; an error if there is one")
    parser.add_argument("-c", "--command", help="run one command; a missing semicolon is added")
    parser.add_argument("--index", action="append", metavar="PATH", help="index the files at or below a path; several paths make one dataset each, in one job")
    parser.add_argument("--types", default="gram3,text4,wide8,hash4", help="with --index: index types, separated by commas")
    parser.add_argument("--taint", action="append", default=[], help="with --index: a tag of the new datasets")
    parser.add_argument("--compact", choices=["all", "smart"], help="compact until nothing is merged")
    parser.add_argument("--trim", action="store_true", help="list folders that the catalog doesn't know")
    parser.add_argument("--remove", action="store_true", help="with --trim: remove them")
    parser.add_argument("--bench", type=int, metavar="N", help="index N files of random bytes (gram3), three times, and print milliseconds")
    parser.add_argument("--bench-bytes", type=int, default=1_000_000, help="size of each of these files")
    parser.add_argument("--json", action="store_true", help="print responses as JSON")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from trigrove.operators.catalog import Catalog
    from trigrove.operators.engine import Engine
    from trigrove.sources.files import scan
    from trigrove.sources.storage import Storage

    spark = SparkSession.builder.appName("trigrove").getOrCreate()
    if args.new:
        Catalog.create(Storage(spark, args.root))
    engine = Engine(spark, args.root)
    if args.index:
        found, types = None, [t for t in args.types.split(",") if t]
        for path in args.index:
            one = scan(spark, [path]).withColumn("name", F.lit(engine.catalog.fresh_id()))
            found = one if found is None else found.unionByName(one)
        print("datasets", *engine.index_many(found, types, lambda _: args.taint))
    if args.compact:
        print(engine.compact_fully(args.compact == "smart"), "merges")
    if args.trim:
        print(*engine.catalog.orphans(args.remove), sep="\n")
    if args.bench:
        for _ in range(3):
            started = time.monotonic()
            name = engine.index(random_files(spark, args.bench, args.bench_bytes), ["gram3"], check=False)
            print(int(1000 * (time.monotonic() - started)), "ms")
            engine.execute(f'dataset "{name}" drop;')
    if args.command:
        return show(engine, args.command, args.json)
    if not (args.new or args.index or args.compact or args.trim or args.bench):
        for line in sys.stdin:
            if line.strip():
                show(engine, line.strip(), args.json)
    return 0


def random_files(spark, count: int, size: int):
    """(path, content) of ``count`` rows of random bytes, the same each time."""
    import numpy as np
    import pyarrow as pa

    def make(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = np.random.default_rng(k).integers(0, 256, size, dtype=np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([f"random/{k}"]), pa.array([data], pa.binary())], names=["path", "content"])

    return spark.range(count).mapInArrow(make, "path string, content binary")


def show(engine, text: str, as_json: bool) -> int:
    response = engine.execute(text if text.rstrip().endswith(";") else text + ";")
    if as_json:
        print(json.dumps(response))
    elif response["type"] == "error":
        print("error:", response["error"]["message"], "(try again)" if response["error"]["retry"] else "")
    elif "files" in response["result"]:
        print(*response["result"]["files"], sep="\n")
    else:
        print(json.dumps(response["result"], indent=1))
    return int(response["type"] == "error")


if __name__ == "__main__":
    sys.exit(main())
