"""Commands: index a folder, search names, grep, status, tools over standard input, version.

    python -m siftlake index /some/folder /some/index
    python -m siftlake search /some/index "words ext:md" [--json]
    python -m siftlake grep /some/index "text" [where ...]
    python -m siftlake status /some/index
    python -m siftlake stdio /some/index
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.parser import QueryError
from .sources import store
from .sources.segments import Segments
from .tools import Tools, json_lines, match_lines, path_lines, serve

VERSION = "2"


def session() -> SparkSession:
    return SparkSession.builder.appName("siftlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def index(spark: SparkSession, root: str, folder: str, now: int) -> int:
    """Write a snapshot of the entries of root, and bring its content index up to date; how many documents changed."""
    store.save_snapshot(store.crawl(spark, root, folders=True), folder, now, now)
    return Segments(spark, f"{folder}/segments").sync(store.crawl(spark, root, bodies=True).select("path", "size", "mtime", "body")).count()


def opened(spark: SparkSession, folder: str, now: int) -> Engine:
    """The engine over a snapshot and its content index."""
    entries, _, _ = store.load_snapshot(spark, folder)
    segments = Segments(spark, f"{folder}/segments")
    bodies = segments.part("bodies", "gid string, body string, segment string")
    docs = segments.docs().join(bodies, ["segment", "gid"]).select("path", "size", "mtime", "body")
    return Engine(entries, docs, now=now, typos=True)


def show(lines: DataFrame) -> None:
    for row in lines.toLocalIterator():
        print(row.value)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="siftlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=["index", "search", "grep", "status", "stdio", "version"])
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    if given.verb == "version":
        print(VERSION)
        return 0
    if not given.rest:
        parser.error("a folder is missing")
    spark, now = session(), int(time.time())
    if given.verb == "index":
        print(index(spark, given.rest[0], given.rest[1], now))
        return 0
    engine = opened(spark, given.rest[0], now)
    try:
        if given.verb == "status":
            show(json_lines(spark.createDataFrame([engine.counts()])))
        elif given.verb == "search":
            hits = engine.named(engine.search(" ".join(given.rest[1:]))).orderBy(F.desc("score"), "path")
            show(json_lines(hits) if given.json else path_lines(hits))
        elif given.verb == "grep":
            lines = engine.grep(given.rest[1], where=" ".join(given.rest[2:]))
            show(json_lines(lines) if given.json else match_lines(lines))
        else:
            tools = Tools(engine)
            for message in sys.stdin:
                if message.strip() and (reply := serve(tools, message)):
                    print(reply, flush=True)
    except QueryError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
