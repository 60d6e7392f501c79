"""Command line over a store of strings: put, get, del, list, load, import, compact, stats, verify, digest."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import Corrupt, StoreError
from .plans.replay import state
from .sources.frames import frame_problems, read_frames
from .sources.store import Store


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratakeep", description=__doc__)
    p.add_argument("--path", default="./stratakeep-data")
    sub = p.add_subparsers(dest="command", required=True)
    put = sub.add_parser("put")
    put.add_argument("key")
    put.add_argument("value")
    put.add_argument("--ttl", type=float, default=0, help="seconds, 0 for ever")
    for name in ("get", "del"):
        sub.add_parser(name).add_argument("key")
    sub.add_parser("list").add_argument("limit", type=int, nargs="?", default=10)
    sub.add_parser("load", help="random keys out of ten times as many").add_argument("count", type=int)
    sub.add_parser("import", help="the live values of a folder of framed segments").add_argument("folder")
    for name in ("compact", "stats", "verify", "digest"):
        sub.add_parser(name)
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = build_parser().parse_args(argv)
    say = lambda *x: print(*x, file=out)
    try:
        with Store.open(spark, a.path, readonly=a.command in ("get", "list", "stats", "verify", "digest")) as store:
            if a.command == "put":
                store.put(a.key, a.value, int(a.ttl * 1e9))
            elif a.command == "get":
                say(store.get(a.key))
            elif a.command == "del":
                store.delete(a.key)
            elif a.command == "list":
                for row in store.scan().limit(a.limit):
                    say(f"{row['key']}\t{row['value']}")
            elif a.command == "load":
                key = F.concat(F.lit("key:"), F.floor(F.rand() * 10 * a.count).cast("string"))
                store.write(spark.range(a.count).select(key.alias("key"), F.concat(F.lit("value-"), "id").alias("value"), F.col("id").alias("ord")))
            elif a.command == "import":
                for bad in frame_problems(spark, a.folder).take(1):
                    raise Corrupt("segment {} at offset {}: {}".format(*bad))
                now = store.clock()
                old = state(read_frames(spark, a.folder), now, link_depth=2)
                ttl = F.when(F.col("expires_at_ns") > 0, F.col("expires_at_ns") - now).otherwise(0)
                store.write(old.select("key", F.decode("value", "UTF-8").alias("value"), ttl.alias("ttl_ns")))
            elif a.command == "compact":
                store.compact()
                store.vacuum()
            elif a.command == "stats":
                for row in store.stats():
                    say(row)
            elif a.command == "verify":
                store.verify()
                say("ok")
            else:
                say(store.digest())
        return 0
    except StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
