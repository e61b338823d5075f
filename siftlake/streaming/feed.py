"""Keeping the live view current from a change feed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.live import advance, coalesced, folder_diff, should_compact, with_subtrees

QUIET, OLDEST = 5, 60


def flushes(events: DataFrame, unit: str, quiet: int = QUIET, oldest: int = OLDEST) -> DataFrame:
    """unit, first, last, n: batches of a unit's events (ts in seconds) that end after quiet seconds without one, or oldest after the first.

    Times are cut into runs where a unit was quiet, and each run is folded by itself in order, so that a replay of the same events gives
    the same batches and an array is as long as one run.
    """
    own = Window.partitionBy(unit).orderBy("ts")
    fresh = F.coalesce(F.col("ts") - F.lag("ts").over(own) > quiet, F.lit(True)).cast("int")
    counted = events.groupBy(unit, "ts").agg(F.count(F.lit(1)).alias("times"))
    runs = counted.withColumn("run", fresh).withColumn("run", F.sum("run").over(own)).groupBy(unit, "run").agg(F.array_sort(F.collect_list(F.struct("ts", "times"))).alias("seen"))
    # Each time gets the first one of its batch: the batch goes on until oldest after that.
    step = f"(a, x) -> named_struct('first', CASE WHEN x.ts - a.first > {oldest} THEN x.ts ELSE a.first END, 'firsts', concat(a.firsts, array(CASE WHEN x.ts - a.first > {oldest} THEN x.ts ELSE a.first END)))"
    firsts = F.expr(f"aggregate(seen, named_struct('first', seen[0].ts, 'firsts', CAST(array() AS ARRAY<BIGINT>)), {step}).firsts")
    each = runs.select(unit, F.explode(F.arrays_zip(F.col("seen"), firsts.alias("first"))).alias("x")).select(unit, "x.first", F.col("x.seen.ts").alias("ts"), F.col("x.seen.times").alias("times"))
    return each.groupBy(unit, "first").agg(F.max("ts").alias("last"), F.sum("times").cast("int").alias("n")).select(unit, "first", "last", "n")


@dataclass
class Feed:
    """Applies batches of changes (id, dir, recursive, path, kind, size, mtime, gone; stream if there are several) to tables in a folder.

    Each batch is coalesced by folder, its listing is compared with what is current, and the differences are written under the
    batch's number, so that a batch that is delivered again replaces itself. A folder that is gone takes all below it along. The
    watermark is written beside each batch, as are what is put off, so that it outlives the driver; a batch of an older stream is applied
    and leaves the watermark alone.
    """

    folder: str
    #: As of the last batch that this object applied; saved_watermark is what outlives it.
    watermark: int = 0
    stream: int | None = None
    #: Called with each batch and its number once it is applied.
    hooks: list[Callable[[DataFrame, int], None]] = field(default_factory=list)
    #: Least ids of events that are put off, by who holds them; the start of a gap in the feed, until it is replayed.
    floors: dict[str, int] = field(default_factory=dict)
    gap: int | None = None

    def apply(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max_by(F.struct("kind", "size", "mtime", "gone"), "id").alias("now")).select("path", "now.*")
        current = self.current(spark, number)
        gone = with_subtrees(last.filter("gone").select("path"), current)
        listing = last.filter("NOT gone").drop("gone")
        here = current.join(last.select("path").union(gone).distinct(), "path", "left_semi")
        diff = folder_diff(here, listing).join(listing, "path", "left").select("path", "op", "kind", "size", "mtime")
        diff.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")
        coalesced(batch).write.mode("overwrite").parquet(f"{self.folder}/dirs/batch={number}")
        own = batch if self.stream is None or "stream" not in batch.columns else batch.filter(F.col("stream") == self.stream)
        seen = own.agg(F.max("id")).first()[0]
        before = self.saved_watermark(spark, number)
        mark = before if seen is None else advance(before, seen, min(self.floors.values(), default=None), self.gap)
        self.watermark = mark
        spark.createDataFrame([(mark,)], "watermark long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={number}")
        for hook in self.hooks:
            hook(batch, number)

    def list_folder(self, folder: str, listing: DataFrame, number: int) -> None:
        """Apply a whole listing (path, kind, size, mtime) of a folder: children that it lacks are gone, with all below them."""
        spark = listing.sparkSession
        current = self.current(spark, number)
        children = current.filter(F.col("path").startswith(folder + "/") & ~F.expr(f"substring(path, {len(folder) + 2})").contains("/"))
        lost = children.join(listing, "path", "left_anti").select("path")
        changed = children.join(listing.select("path", F.col("kind").alias("now")), "path").filter("kind = 1 AND now <> 1").select("path")
        gone = with_subtrees(lost.union(changed), current).join(listing, "path", "left_anti")
        here = children.unionByName(current.join(gone, "path", "left_semi")).dropDuplicates(["path"])
        diff = folder_diff(here, listing).join(listing, "path", "left").select("path", "op", "kind", "size", "mtime")
        diff.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")

    def saved_watermark(self, spark: SparkSession, before: int | None = None) -> int:
        """As of all batches (before one); without any what this object starts with, the event id of the snapshot that it follows."""
        if not self.exists(spark, "marks"):
            return self.watermark
        marks = spark.read.parquet(f"{self.folder}/marks")
        marks = marks if before is None else marks.filter(F.col("batch") < before)
        found = marks.agg(F.max_by("watermark", "batch")).first()[0]
        return self.watermark if found is None else found

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All that is written: the last compacted table and the differences since, each with its batch."""
        schema = "path string, op string, kind int, size long, mtime long, batch long"
        base, table = self.compacted(spark, before)
        rows = spark.read.schema(schema).option("basePath", f"{self.folder}/delta").parquet(f"{self.folder}/delta") if self.exists(spark, "delta") else spark.createDataFrame([], schema)
        rows = rows.filter(F.col("batch") > base)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows if table is None else rows.unionByName(spark.read.parquet(table).select("path", F.lit("new").alias("op"), "kind", "size", "mtime", F.lit(base).cast("long").alias("batch")))

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """path, kind, size, mtime as of all batches (before one)."""
        last = self.rows(spark, before).groupBy("path").agg(F.max_by(F.struct("op", "kind", "size", "mtime"), "batch").alias("now")).select("path", "now.*")
        return last.filter("op <> 'removed'").drop("op")

    def compacted(self, spark: SparkSession, before: int | None = None) -> tuple[int, str | None]:
        """The last batch that a compacted table holds, and the table."""
        if not self.exists(spark, "compacted"):
            return -1, None
        heads = spark.read.text(f"{self.folder}/compacted/heads")
        rows = [json.loads(r.value) for r in heads.collect()]  # one row a compaction
        rows = [r for r in rows if before is None or r["batch"] < before]
        best = max(rows, key=lambda r: r["batch"], default=None)
        return (best["batch"], best["table"]) if best else (-1, None)

    def compact(self, spark: SparkSession, quiet: float, stale: float, asked: bool = False) -> bool:
        """Write what is current as one table if that is due; batches that it holds are read no more."""
        base, table = self.compacted(spark)
        pending = self.rows(spark).filter(F.col("batch") > base)
        newest = pending.agg(F.max("batch")).first()[0]
        size = spark.read.parquet(table).count() if table else 0
        if newest is None or not should_compact(pending.count(), size, quiet, stale, asked):
            return False
        target = f"{self.folder}/compacted/table-{uuid.uuid4().hex}"
        self.current(spark).write.parquet(target)
        spark.createDataFrame([(json.dumps({"batch": newest, "table": target}),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/compacted/heads")
        return True

    def exists(self, spark: SparkSession, part: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follow a stream of changes until what is there is applied."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
