"""A content index on disk: immutable segments of documents, bodies and postings, tombstones, and a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bits, content
from ..operators.live import merge_plan, sync_diff
from ..plans import trigrams

DOCS = "path string, size long, mtime long, gid string, segment string"
BODIES = "gid string, no long, body string, segment string"
POSTINGS = "key string, no long, segment string"
#: Bytes of written bodies whose postings one task sorts: about 4 million, which fit its memory.
SORTED_BYTES = 8 << 20
#: How tables are written: sorted numbers as differences, in a byte or two each.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#no": "false"}


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Tables are read in pieces of SORTED_BYTES at most."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SORTED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Segments:
    """Tables docs, bodies, postings and symbols below a folder, partitioned by segment; the newest manifest tells which segments count.

    A document whose text is none is recorded without a body, so that it isn't read again. Segments never change: a document that is gone
    or changed gets a tombstone, and merging writes its live ones anew.
    """

    spark: SparkSession
    folder: str

    def manifest(self) -> list[str]:
        if not self.exists("manifests"):
            return []
        rows = [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/manifests").collect()]  # one row a change of the index
        return max(rows, key=lambda r: r["number"])["segments"]

    def publish(self, segments: list[str]) -> None:
        """Make a list of segments the current one: a reader sees the old or the new one whole."""
        number = max((json.loads(r.value)["number"] for r in self.spark.read.text(f"{self.folder}/manifests").collect()), default=0) + 1 if self.exists("manifests") else 1
        line = json.dumps({"number": number, "segments": segments})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/manifests")

    def exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, docs: DataFrame) -> str:
        """A new segment of docs (path, size, mtime, body), not yet in the manifest."""
        segment = uuid.uuid4().hex
        text = F.when((F.col("size") > 0) & content.is_text(F.col("body")), F.col("body"))
        known = docs.select("path", "size", "mtime", text.alias("body")).withColumn("gid", F.sha2("body", 256))
        own = self.write_docs(known, segment)
        copies = own.filter("gid IS NOT NULL").groupBy("gid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gid")
        self.write_bodies(known.filter("body IS NOT NULL").select("gid", "body"), copies, segment)
        return segment

    def write_docs(self, docs: DataFrame, segment: str) -> DataFrame:
        target = f"{self.folder}/docs/segment={segment}"
        docs.select("path", "size", "mtime", "gid").write.options(**PACKED).parquet(target)
        return self.spark.read.parquet(target)

    def write_bodies(self, bodies: DataFrame, copies: DataFrame, segment: str) -> None:
        """A segment's distinct bodies (gid, body), numbered, and their postings and symbols; copies: the gids that come more than once.

        Only bodies with copies are shuffled. Postings have a body's number, and each file of them is sorted by key, so that a search
        reads few row groups of it; they are never shuffled.
        """
        single, rest = bits.parted(bodies, copies, ["gid"])
        distinct = single.unionByName(rest.groupBy("gid").agg(F.first("body").alias("body")))
        target = f"{self.folder}/bodies/segment={segment}"
        distinct.withColumn("no", F.monotonically_increasing_id()).select("gid", "no", "body").write.options(**PACKED).option("parquet.block.size", SORTED_BYTES).parquet(target)
        written = self.spark.read.parquet(target)
        with small_splits(self.spark):
            content.trigrams(written, "no").sortWithinPartitions("key", "no").write.options(**PACKED).parquet(f"{self.folder}/postings/segment={segment}")
        content.symbols(written).sortWithinPartitions("symbol").write.options(**PACKED).parquet(f"{self.folder}/symbols/segment={segment}")

    def part(self, name: str, schema: str) -> DataFrame:
        """A table's rows in the current segments."""
        live = self.manifest()
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/segment={s}" for s in live])

    def dead(self) -> DataFrame:
        schema = "path string, segment string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/dead") if self.exists("dead") else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """The live documents."""
        return self.part("docs", DOCS).join(self.dead(), ["path", "segment"], "left_anti")

    def references(self) -> DataFrame:
        """segment, gid, n: how many live documents hold each body; bodies that none holds are dead and left out."""
        return self.docs().filter("gid IS NOT NULL").groupBy("segment", "gid").agg(F.count(F.lit(1)).alias("n"))

    def dead_bodies(self) -> DataFrame:
        """segment, gid, bytes of the bodies that no live document holds."""
        bodies = self.part("bodies", BODIES).select("segment", "gid", F.octet_length("body").alias("bytes"))
        return bodies.join(self.references(), ["segment", "gid"], "left_anti")

    def sync(self, wanted: DataFrame) -> DataFrame:
        """Make the index hold wanted (path, size, mtime, body): what is gone gets a tombstone, what is new or changed a new segment.

        Returned: path, op of what changed.
        """
        ops = sync_diff(wanted, self.docs()).filter("op <> 'keep'")
        # Written before the segments change, as the plan reads them.
        target = f"{self.folder}/ops/{uuid.uuid4().hex}"
        ops.write.parquet(target)
        ops = self.spark.read.schema("path string, op string").parquet(target)
        changed = ops.filter("op = 'reindex'").select("path")
        # Of a first sync all is new, and nothing is looked up.
        fresh = bits.only(wanted, changed, ["path"]) if self.manifest() else wanted
        segment = self.write(fresh) if changed.head(1) else None
        gone = self.docs().join(ops, "path", "left_semi").select("path", "segment")
        gone.write.mode("append").parquet(f"{self.folder}/dead")
        if segment:
            self.publish([*self.manifest(), segment])
        return ops

    def merge(self) -> list[str]:
        """Rewrite the segments that the policy picks as one; which they were."""
        bodies = self.part("bodies", BODIES).groupBy("segment").agg(F.sum(F.octet_length("body")).alias("bytes"))
        dead = self.dead_bodies().groupBy("segment").agg(F.sum("bytes").alias("dead"))
        names = self.manifest()
        # A row a segment.
        rows = bodies.join(dead, "segment", "left").select("segment", "bytes", F.coalesce("dead", F.lit(0)).alias("dead")).collect()
        picked = [names[i] for i in merge_plan([(names.index(r.segment), r.bytes, r.dead) for r in rows])]
        if picked:
            merged = uuid.uuid4().hex
            among = F.col("segment").isin(picked)
            self.write_docs(self.docs().filter(among), merged)
            gone = self.dead_bodies().filter(among).select("segment", "gid")
            live = bits.without(self.part("bodies", BODIES).filter(among).select("segment", "gid", "body"), gone, ["segment", "gid"])
            # Within a segment bodies are distinct; one that several hold is written once.
            several = self.part("bodies", BODIES).filter(among).groupBy("gid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gid")
            self.write_bodies(live.select("gid", "body"), several, merged)
            self.publish([n for n in names if n not in picked] + [merged])
        return picked

    def candidates(self, pattern: str, mode: str = "literal", case: bool | None = None) -> DataFrame:
        """path, size, mtime, gid of the live documents that the postings let in."""
        postings = self.part("postings", POSTINGS).select(F.struct("segment", "no").alias("gid"), "key")
        docs = self.docs().filter("gid IS NOT NULL")
        if mode == "literal":
            gids = content.literal_candidates(postings, pattern)
        else:
            plan = trigrams.of_regex(content.java_regex(pattern, mode, case))
            gids = None if plan is None else content.planned(postings, plan)
        if gids is None:
            return docs
        numbers = self.part("bodies", BODIES).select("segment", "no", "gid").join(gids.distinct().select("gid.segment", "gid.no"), ["segment", "no"], "left_semi")
        return docs.join(numbers.select("gid").distinct(), "gid", "left_semi")

    def grep(self, pattern: str, mode: str = "literal", fresh: DataFrame | None = None, limit: int | None = 50, per_file: int = content.PER_FILE, unheld: DataFrame | None = None) -> DataFrame:
        """path, line, text, col, fresh of the first limit matching files; of all if it is None.

        Files that changed since the last sync (fresh: path, mtime, body) are read as they are now and come first, newest first; the others
        go by rank, then newest, then path. Files that are recorded without a body, as they don't look like text, are left out unless unheld
        (path, mtime, body) has them as they are.
        """
        regex = content.java_regex(pattern, mode)
        found = self.candidates(pattern, mode)
        if fresh is not None:
            found = found.join(fresh, "path", "left_anti")
        # Those that can't match are out before any is shuffled.
        bodies = self.part("bodies", BODIES).select("gid", "body").filter(F.col("body").rlike("(?m)" + regex)).dropDuplicates(["gid"])
        docs = found.join(bodies, "gid").select("path", "mtime", "body", F.lit(False).alias("fresh"))
        if unheld is not None:
            bare = self.docs().filter("gid IS NULL").select("path")
            bare = bare if fresh is None else bare.join(fresh, "path", "left_anti")
            likely = unheld.filter(F.col("body").rlike("(?m)" + regex))
            docs = docs.unionByName(likely.join(bare, "path", "left_semi").select("path", "mtime", "body", F.lit(False).alias("fresh")))
        if fresh is not None:
            docs = docs.unionByName(fresh.select("path", "mtime", "body", F.lit(True).alias("fresh")))
        lines = content.grep(docs, regex, per_file)
        files = docs.select("path", "mtime", "fresh").join(lines.select("path").distinct(), "path", "left_semi")
        rank = F.when(F.col("fresh"), 0).otherwise(content.doc_rank(F.col("path")))
        order = [F.desc("fresh"), F.desc("rank"), F.desc("mtime"), F.asc("path")]
        page = files.withColumn("rank", rank)
        if limit is not None:
            page = page.orderBy(*order).limit(limit)
        return lines.join(page, "path").orderBy(*order, "line").select("path", "line", "text", "col", "fresh")

