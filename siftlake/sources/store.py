"""Real folders as entries, snapshots of the tree, the usage file and the skip list."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .corpus import with_names

#: Bodies of more bytes are never read.
MOST_BYTES = 10 << 20


def crawl(spark: SparkSession, root: str, bodies: bool = False, folders: bool = False) -> DataFrame:
    """path, parent, name, kind, size, mtime (and body) of the files below a folder, and of the folders that hold any, if asked for.

    Contents are read only where bodies are asked for; a folder's time is that of the newest file below it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    if bodies:
        files = files.filter(F.col("length") <= MOST_BYTES)
    columns = [path.alias("path"), F.lit(0).alias("kind"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")]
    found = files.select(*columns, *[F.col("content").cast("string").alias("body")] * bodies)
    if folders:
        top = re.sub("^[a-z]+:/+", "/", root).rstrip("/")
        parts = F.split("path", "/")
        above = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
        held = found.select(above.alias("path"), "mtime").filter(F.col("path").startswith(top + "/")).groupBy("path").agg(F.max("mtime").alias("mtime"))
        found = found.unionByName(held.select("path", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("size"), "mtime"), allowMissingColumns=True)
    return with_names(found).select("path", "parent", "name", "kind", "size", "mtime", *["body"] * bodies)


def blocked(path: Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders or lies in one."""
    out = F.lit(False)
    for f in folders:
        out = out | (path == f) | path.startswith(f.rstrip("/") + "/")
    return out


def skip_list(text: str, home: str) -> list[str]:
    """Folders of a skip list: one a line, # starts a comment, ~ is home."""
    lines = [line.strip() for line in text.splitlines()]
    return [(home + x[1:] if x.startswith("~") else x).rstrip("/") for x in lines if x and not x.startswith("#")]


def save_snapshot(entries: DataFrame, folder: str, event_id: int, synced_at: int) -> None:
    """Write a snapshot: a new table first, then its header in one rename, so that a reader sees the old or the new one whole."""
    spark = entries.sparkSession
    table = f"{folder}/entries-{uuid.uuid4().hex}"
    entries.repartitionByRange("parent", "name").sortWithinPartitions("parent", "name").write.parquet(table)
    header = json.dumps({"table": table, "event_id": event_id, "synced_at": synced_at})
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = path(f"{folder}/headers/{event_id:020d}-{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh)
    out.write(bytearray(header.encode()))
    out.close()
    fs.rename(fresh, path(str(fresh.toString()).removesuffix(".tmp")))


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """(entries, event id, synced at) of the snapshot with the latest event id."""
    headers = spark.read.option("pathGlobFilter", "*[!p]").text(f"{folder}/headers").filter("value <> ''")
    latest = headers.select(F.from_json("value", "table string, event_id long, synced_at long").alias("h")).orderBy(F.desc("h.event_id"), F.desc("h.synced_at")).first()
    return spark.read.parquet(latest.h.table), latest.h.event_id, latest.h.synced_at


def write_usage(scores: DataFrame, folder: str) -> None:
    """Usage (path, score, last) as lines of score, last and path; a path with a line break or a first quote as a JSON string."""
    quoted = F.expr("substring(to_json(named_struct('p', path)), 6, length(to_json(named_struct('p', path))) - 6)")
    path = F.when(F.col("path").contains("\n") | F.col("path").startswith('"'), quoted).otherwise(F.col("path"))
    scores.select(F.concat_ws("\t", F.col("score").cast("string"), F.col("last").cast("string"), path).alias("value")).write.mode("overwrite").text(folder)


def read_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The same back; lines that aren't such are left out."""
    parts = F.split("value", "\t", 3)
    raw = spark.read.text(folder).filter(F.size(parts) == 3).select(parts[2].alias("raw"), parts[0].try_cast("double").alias("score"), parts[1].try_cast("long").alias("last"))
    path = F.when(F.col("raw").startswith('"'), F.expr("from_json(concat('{\"p\":', raw, '}'), 'p string').p")).otherwise(F.col("raw"))
    return raw.select(path.alias("path"), "score", "last").filter("path IS NOT NULL AND score IS NOT NULL AND last IS NOT NULL")
